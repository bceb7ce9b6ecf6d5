"""SQL with the rows of the registered queries."""

LINES = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS place, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.place, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('a' || source, 'b') AS source_key,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source_key, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
         (1 + (row_number() OVER (ORDER BY encode(source_key)) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source_key
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT max(level) AS level FROM levels WHERE NOT cap < level * weight
), targets AS (
  SELECT l.source_key, l.source_size,
         CASE WHEN l.cap < l.level * l.weight THEN l.cap ELSE least(l.cap, l.weight * f.level) END AS target,
         ('0x' || substr(md5('42:' || l.source_key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels l, final f
), ranked AS (
  SELECT s.doc_id, s.size, s.source_key, row_number() OVER (
           PARTITION BY s.source_key
           ORDER BY floor(sqrt(s.size)),
                    ('0x' || substr(md5(s.doc_id::VARCHAR), 1, 8))::BIGINT
                      % (32 * ceil((SELECT count(*) FROM sized) / 20000000.0))::BIGINT,
                    s.size, s.doc_id) AS rank
  FROM sized s
)
SELECT r.doc_id, r.size, t.source_size, t.target,
       (r.size * least(3, floor(r.rank * (t.target / t.source_size) + t.shift)
                          - floor((r.rank - 1) * (t.target / t.source_size) + t.shift)))::BIGINT AS taken
FROM ranked r JOIN targets t USING (source_key)
"""

CHAT = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 15 + length(role) + length(text) + length(role) - length(replace(role, ':', ''))
         + list_sum(list_transform([role, text], lambda x: length(x) - length(replace(x, '\', ''))
             + len(regexp_extract_all(x, '#')) - len(regexp_extract_all(x, '#+')) + len(regexp_extract_all(x, '</turn>')))) AS n
  FROM rows_in
), placed AS (
  SELECT *, sum(n) OVER w AS up_to, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS total
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR place = total THEN up_to ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
