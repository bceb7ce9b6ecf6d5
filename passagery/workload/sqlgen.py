"""Fragments of the comparison SQL (DuckDB dialect), written independently of the Spark expressions."""

from __future__ import annotations

NL = "chr(10)"
CTL = "(" + " || ".join(f"chr({i})" for i in range(1, 33)) + ")"
TOK = "'[\\p{L}\\p{N}]+'"
ENDS = "。！？；.!?;\\n"


def trim(x: str) -> str:
    return f"trim({x}, {CTL})"


def pack(parts: str, sep: str, sep_len: int, limit: int, oversize: str) -> str:
    """Greedy packing as a fold; `oversize` is an expression over the long part `b.part` giving a list."""
    joined = f"(a.n + (CASE WHEN a.n > 0 THEN {sep_len} ELSE 0 END) + length(b.part))"
    closed = "(CASE WHEN a.n > 0 THEN list_append(a.o, a.cur) ELSE a.o END)"
    empty = "[]::VARCHAR[]"
    return (
        f"list_transform([list_reduce(list_transform({parts}, lambda p: {{'cur': '', 'n': 0::BIGINT, 'o': {empty}, 'part': p}}), "
        f"lambda a, b: CASE WHEN {joined} <= {limit} "
        f"THEN {{'cur': CASE WHEN a.n > 0 THEN a.cur || {sep} || b.part ELSE b.part END, 'n': {joined}::BIGINT, 'o': a.o, 'part': ''}} "
        f"WHEN length(b.part) > {limit} THEN {{'cur': '', 'n': 0::BIGINT, 'o': list_concat({closed}, {oversize}), 'part': ''}} "
        f"ELSE {{'cur': b.part, 'n': length(b.part)::BIGINT, 'o': {closed}, 'part': ''}} END, "
        f"{{'cur': '', 'n': 0::BIGINT, 'o': {empty}, 'part': ''}})], "
        "lambda s: CASE WHEN s.n > 0 THEN list_append(s.o, s.cur) ELSE s.o END)[1]"
    )


def hard(text: str, limit: int, overlap: int) -> str:
    step = limit - overlap
    return (
        f"list_transform(range(0, greatest(ceil((length({text}) - {limit}) / {step}.0), 0)::BIGINT + 1), "
        f"lambda i: substr({text}, i * {step} + 1, {limit}))"
    )


def sentences(text: str, limit: int) -> str:
    """Oversize cut as a fold over sentence units."""
    empty = "[]::VARCHAR[]"
    whole = "(length(v.u) - 1) // %d" % limit
    pieces = f"list_transform(range(0, {whole}), lambda i: substr(v.u, i * {limit} + 1, {limit}))"
    closed = "(CASE WHEN s.c <> '' THEN list_append(s.o, s.c) ELSE s.o END)"
    units = f"regexp_extract_all({text}, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+')"
    return (
        f"list_filter(list_transform(list_transform([list_reduce(list_transform({units}, lambda x: {{'c': '', 'o': {empty}, 'u': x}}), "
        f"lambda s, v: CASE WHEN length(s.c) + length(v.u) <= {limit} THEN {{'c': s.c || v.u, 'o': s.o, 'u': ''}} "
        f"ELSE {{'c': substr(v.u, ({whole}) * {limit} + 1), 'o': list_concat({closed}, {pieces}), 'u': ''}} END, "
        f"{{'c': '', 'o': {empty}, 'u': ''}})], "
        f"lambda r: CASE WHEN r.c <> '' THEN list_append(r.o, r.c) ELSE r.o END)[1], lambda z: {trim('z')}), lambda z: z <> '')"
    )


def text_pieces(text: str, limit: int = 1024, overlap: int = 50) -> str:
    folded = pack(f"string_split({text}, {NL})", NL, 1, limit, hard("b.part", limit, overlap))
    return f"(CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE {folded} END)"


# CTE chains: every entry may use the ones before it
CHUNKS = f"""
pieces AS (
  SELECT doc_id, lang, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS kb_id, {text_pieces('text')} AS p
  FROM documents WHERE length(text) > 0
),
chunks AS (
  SELECT doc_id, lang, kb_id, (i - 1)::INTEGER AS chunk_index, p[i] AS text, sha256(p[i]) AS text_hash,
         md5(concat_ws('|', doc_id, 'v1.0.0', 'text_model', i - 1)) AS chunk_id
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM pieces)
)"""

QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def token_rows(source: str, key: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM {source})"


def bm25(scope: str = "0", source: str = "chunks", key: str = "chunk_id") -> str:
    """Scores of all (query, chunk) pairs with a common term."""
    return f"""
tok AS (SELECT {key} AS cid, {scope} AS scope, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM {source}),
tf AS (SELECT cid, scope, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT {key} AS cid, {scope} AS scope, len(regexp_extract_all(lower(text), {TOK})) AS dl FROM {source}),
st AS (SELECT scope, count(*) AS n, avg(dl) AS avg_dl FROM dl GROUP BY scope),
dfr AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY scope, term),
qtok AS (SELECT query_id, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM queries),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL),
bm AS (
  SELECT q.query_id, tf.scope, tf.cid AS chunk_id,
         round(sum(q.qtf * ln(1.0 + (st.n - dfr.df + 0.5) / (dfr.df + 0.5))
                   * (tf.tf * 2.2) / (tf.tf + 1.2 * (1.0 - 0.75 + 0.75 * dl.dl / st.avg_dl))), 6) AS score
  FROM qtf q JOIN tf ON tf.term = q.term JOIN dfr ON dfr.term = tf.term AND dfr.scope = tf.scope
  JOIN st ON st.scope = tf.scope JOIN dl ON dl.cid = tf.cid
  GROUP BY ALL
)"""


def hashed(source: str, key: str, name: str) -> str:
    """Unit vectors of the built-in model, in single precision."""
    return f"""
{name}_t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM {source}),
{name}_h AS (SELECT id, md5(term) AS h, count(*) AS n FROM {name}_t GROUP BY id, md5(term)),
{name}_c AS (SELECT id, (('0x' || substr(h, 1, 8))::BIGINT % 64) AS slot,
             sum(CASE WHEN substr(h, 9, 1) < '8' THEN n ELSE -n END)::DOUBLE AS v FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_c GROUP BY id),
{name}_e AS (SELECT id, slot, (CASE WHEN norm > 0 THEN v / norm ELSE 0 END)::FLOAT AS v FROM {name}_c JOIN {name}_n USING (id)),
{name} AS (
  SELECT s.{key} AS id, list_transform(range(0, 64), lambda i: coalesce(map_extract(m.m, i)[1], 0)::DOUBLE) AS e
  FROM {source} s LEFT JOIN (SELECT id, map(list(slot), list(v)) AS m FROM {name}_e GROUP BY id) m ON m.id = s.{key}
)"""


def cosine(a: str, b: str) -> str:
    norm = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {norm} = 0 THEN 0.0 ELSE round(list_dot_product({a}, {b}) / {norm}, 9) + 0.0 END)"


VECTORS = hashed("chunks", "chunk_id", "cv") + "," + hashed("queries", "query_id", "qv") + f""",
vec AS (SELECT qv.id AS query_id, cv.id AS chunk_id, (1.0 + {cosine('qv.e', 'cv.e')}) / 2.0 AS score FROM qv, cv)"""


def top(source: str, k: int, name: str, by: str = "query_id", columns: str = "query_id, chunk_id, score") -> str:
    return f"""{name} AS (
  SELECT {columns}, (row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id))::INTEGER AS rank FROM {source}
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) <= {k})"""


def pool(k: int, vec: str = "vec", bm: str = "bm") -> str:
    """Candidates of both paths with their identity columns."""
    return f"""{top(vec, k, 'vtop')}, {top(bm, k, 'btop')},
pool AS (
  SELECT p.*, c.doc_id, c.text_hash FROM (
    SELECT query_id, 'vector' AS path, 0 AS po, chunk_id, rank, score FROM vtop
    UNION ALL SELECT query_id, 'bm25', 1, chunk_id, rank, score FROM btop) p JOIN chunks c USING (chunk_id))"""


def retrieval(*parts: str) -> str:
    return "WITH " + ",\n".join((CHUNKS, QUERIES) + parts)
