"""Registered queries: sources, text rules, chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagery import constants as K
from passagery.functions import codes, text as T
from passagery.operators import chunking as C
from passagery.sources.tabular import assemble_parts, table_to_text, workbook_text
from passagery.sources.tables import spread
from passagery.workload import base, sqlgen as S
from passagery.workload.registry import Tables, query

FILE_NAMES_SQL = """
names AS (
  SELECT o_orderkey AS doc_id, ['pdf','DOCX','xls','txt','Html','jpeg','csv',''][(o_orderkey % 8 + 1)::INT] AS ext,
         o_orderpriority AS stem, CASE WHEN o_orderstatus = 'P' THEN ' MinerU ' END AS parser_model
  FROM orders),
files AS (SELECT doc_id, stem || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS file_name, lower(ext) AS e, parser_model FROM names)"""


def file_names(t: Tables):
    ext = F.element_at(
        F.array(*[F.lit(x) for x in ("pdf", "DOCX", "xls", "txt", "Html", "jpeg", "csv", "")]),
        (F.col("o_orderkey") % 8 + 1).cast("int"),
    )
    name = F.when(ext == "", F.col("o_orderpriority")).otherwise(F.concat_ws(".", "o_orderpriority", ext))
    return t.orders.select(
        F.col("o_orderkey").alias("doc_id"), name.alias("file_name"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" MinerU ")).alias("parser_model"),
    )


@query(f"""WITH {FILE_NAMES_SQL}
SELECT doc_id, CASE WHEN parser_model IS NOT NULL THEN 'layout' WHEN e = 'pdf' THEN 'layout' WHEN e = 'docx' THEN 'mixed'
  WHEN e = 'xls' THEN 'table' WHEN e = 'jpeg' THEN 'ocr' ELSE 'text' END AS parser,
  CASE WHEN e IN ('', 'csv') THEN 'UNKNOWN' ELSE upper(e) END AS file_type FROM files""")
def parser_routing(t: Tables):
    return file_names(t).select(
        "doc_id", T.route_parser(F.col("file_name"), F.col("parser_model")).alias("parser"),
        T.file_type(F.col("file_name")).alias("file_type"),
    )


@query(f"WITH {FILE_NAMES_SQL} SELECT doc_id, CASE WHEN e = '' THEN 'unknown' ELSE e END AS content_type FROM files")
def content_types(t: Tables):
    return file_names(t).select("doc_id", T.content_type(F.col("file_name")).alias("content_type"))


@query(f"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(h, '(?is)<head(?:\\s[^>]*)?>.*?</head>', ' ', 'g') AS h FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(?:{T.BLOCK_TAGS})(?:\\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM c),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS h FROM d),
f AS (SELECT page_id, regexp_replace(regexp_replace(h, '[ \\t\\r\\f\\x0b]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') AS h FROM e)
SELECT page_id, {S.trim("regexp_replace(h, '\\n{2,}', chr(10), 'g')")} AS text FROM f""")
def page_text(t: Tables):
    return spread(t.pages, "page_id").select("page_id", T.html_to_text(F.col("html")).alias("text"))


SHEETS_SQL = """
nat AS (SELECT 'region ' || n_regionkey AS sheet, n_nationkey AS row_no, [['id', n_nationkey::VARCHAR], ['name', n_name]] AS cells FROM nation),
sup AS (SELECT 'suppliers' AS sheet, s_suppkey AS row_no, [['id', s_suppkey::VARCHAR], ['name', s_name],
        ['列3', CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END]] AS cells FROM supplier),
prt AS (SELECT 'parts' AS sheet, p_partkey AS row_no, [['id', p_partkey::VARCHAR], ['name', p_name], ['brand', p_brand]] AS cells FROM part),
rows_ AS (SELECT * FROM nat UNION ALL SELECT * FROM sup UNION ALL SELECT * FROM prt),
sizes AS (SELECT sheet, count(*) AS n FROM rows_ GROUP BY sheet),
lines AS (
  SELECT r.sheet, row_no, n <= 20 AS md,
    CASE WHEN n <= 20 THEN '| ' || array_to_string(list_transform(cells, lambda c: c[2]), ' | ') || ' |'
    ELSE array_to_string(list_transform(cells, lambda c: c[1] || ': ' || c[2]), ', ') END AS line,
    '| ' || array_to_string(list_transform(cells, lambda c: c[1]), ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(cells)) || chr(10) AS head
  FROM rows_ r JOIN sizes USING (sheet)),
body AS (SELECT sheet, md, any_value(head) AS head, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY row_no) AS body FROM lines GROUP BY sheet, md),
sheets AS (SELECT sheet, md, n_rows, '## ' || sheet || chr(10) || chr(10) || CASE WHEN md THEN head || body || chr(10) ELSE body END AS text FROM body)"""


@query(f"WITH {SHEETS_SQL} SELECT sheet, CASE WHEN md THEN 'markdown' ELSE 'key_value' END AS mode, n_rows, text FROM sheets")
def sheet_text(t: Tables):
    nation = t.nation.withColumn("sheet", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    small = table_to_text(nation, "sheet", "n_nationkey", {"n_nationkey": "id", "n_name": "name"})
    suppliers = table_to_text(
        t.supplier.withColumn("sheet", F.lit("suppliers")), "sheet", "s_suppkey",
        {"s_suppkey": "id", "s_name": "name", "s_acctbal": ""},
    )
    parts = table_to_text(
        t.part.withColumn("sheet", F.lit("parts")), "sheet", "p_partkey",
        {"p_partkey": "id", "p_name": "name", "p_brand": "brand"},
    )
    return small.unionByName(suppliers).unionByName(parts)


@query(f"""WITH {SHEETS_SQL} SELECT md AS small, count(*) AS n_sheets,
string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY sheet) AS text FROM sheets GROUP BY md""")
def workbooks(t: Tables):
    """The sheets of a workbook as one text: one workbook of the small sheets, one of the long ones."""
    sheets = sheet_text(t).withColumn("small", F.col("mode") == "markdown")
    return workbook_text(sheets, "small", "sheet")


def noisy_ocr(text):
    """Recognised-text markup around every document."""
    return F.concat(
        F.lit("<|grounding|><|ref|>"), text, F.lit("<|/ref|>[[12, 3,400 , 5]]\n\n\n\n<|det|>"), text, F.lit("<|/det|> \n")
    )


@query(f"""SELECT doc_id, md5({S.trim("regexp_replace(text || chr(10) || chr(10) || text || ' ', '\\n{3,}', chr(10) || chr(10), 'g')")}) AS text_md5
FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN '' ELSE text END AS one, text FROM documents)""")
def ocr_cleanup(t: Tables):
    return t.documents.select("doc_id", F.md5(T.clean_ocr_text(noisy_ocr(F.col("text")))).alias("text_md5"))


NOISE_SQL = "'" + K.OCR_NOISE.replace("'", "''") + "'"


@query(f"""SELECT page_id, length(regexp_replace(html, {NOISE_SQL}, '', 'g')) >= {K.OCR_MIN_CHARS} AS meaningful,
 length(regexp_replace(url, '[^/.:?=&]', '', 'g')) >= 99 AS punctuation_meaningful FROM pages""")
def meaningful_text(t: Tables):
    marks = F.regexp_replace("url", "[^/.:=_-]", "")
    return t.pages.select(
        "page_id", T.is_meaningful(F.col("html")).alias("meaningful"), T.is_meaningful(marks).alias("punctuation_meaningful")
    )


@query("""SELECT conv_id, count(*) AS n_parts, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def assembled_conversations(t: Tables):
    return assemble_parts(t.conversations, "conv_id", "turn")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS first_key, len([json_extract(props, '$.k')]) AS n_keys,
0 AS n_broken FROM events""")
def json_lists(t: Tables):
    listed = codes.parse_json_list(F.concat(F.lit("["), F.regexp_extract("props", "([0-9]+)", 1), F.lit("]")), "bigint")
    broken = codes.parse_json_list(F.when(F.col("event_id") % 2 == 0, F.lit("{oops")), "bigint")
    return t.events.select(
        "event_id", listed[0].cast("int").alias("first_key"), F.size(listed).cast("bigint").alias("n_keys"),
        F.size(broken).alias("n_broken"),
    )


@query(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, chunk_id, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks")
def text_model_chunks(t: Tables):
    rows = C.chunk_text_model(base.documents(t).select("doc_id", "text"))
    return rows.select(
        "doc_id", "chunk_index", "chunk_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


PARTS_SQL = """
asm AS (SELECT conv_id AS doc_id, string_agg(CASE WHEN role = 'user' THEN '1. ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id
        UNION ALL SELECT 1000000 + doc_id, text FROM documents)"""


def multi_part_texts(t: Tables):
    """Conversations as multi-part documents (blank lines, numbered headings), and all documents."""
    marked = t.conversations.withColumn(
        "text", F.when(F.col("role") == "user", F.concat(F.lit("1. "), F.col("text"))).otherwise(F.col("text"))
    )
    parts = assemble_parts(marked, "conv_id", "turn").select(F.col("conv_id").alias("doc_id"), "text")
    return parts.unionByName(base.documents(t).select((F.col("doc_id") + 1000000).alias("doc_id"), "text"))


TITLE_SQL = f"(length(l) <= {K.TITLE_MAX} AND regexp_matches(l, '^({K.TITLE_FORMS})'))"

PARAGRAPHS_SQL = f"""
cleaned AS (SELECT doc_id, {S.trim("regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM asm),
lines AS (SELECT doc_id, i, {S.trim('ls[i]')} AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM cleaned))),
marked AS (SELECT *, (lag(l) OVER w IS NULL OR lag(l) OVER w = '' OR {TITLE_SQL})::INT AS opens FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, l, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS par FROM marked WHERE l <> ''),
paras AS (SELECT doc_id, par, string_agg(l, chr(10) ORDER BY i) AS p FROM numbered GROUP BY doc_id, par),
para_lists AS (SELECT doc_id, list(p ORDER BY par) AS ps FROM paras GROUP BY doc_id)"""


@query(f"""WITH {PARTS_SQL}, {PARAGRAPHS_SQL}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY par) - 1)::INTEGER AS para_no, md5(p) AS text_md5 FROM paras""")
def paragraphs(t: Tables):
    rows = multi_part_texts(t).select("doc_id", F.posexplode(T.split_paragraphs(T.clean_text(F.col("text")))).alias("para_no", "p"))
    return rows.select("doc_id", "para_no", F.md5("p").alias("text_md5"))


@query(f"""WITH {PARTS_SQL}, {PARAGRAPHS_SQL}
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN {TITLE_SQL} THEN 1 ELSE 0 END)::BIGINT AS n_titles FROM lines GROUP BY doc_id""")
def title_lines(t: Tables):
    lines = multi_part_texts(t).select("doc_id", F.explode(F.split(T.clean_text(F.col("text")), "\n", -1)).alias("line"))
    trimmed = T.trim_control(F.col("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_title_line(trimmed)).alias("n_titles")
    )


MERGED_SQL = f"""
merged AS (SELECT doc_id, {S.pack('ps', f"({S.NL} || {S.NL} || {S.NL})", 3, 2048, '[b.part]')} AS ms FROM para_lists)"""


@query(f"""WITH {PARTS_SQL}, {PARAGRAPHS_SQL}, {MERGED_SQL}
SELECT doc_id, (i - 1)::INTEGER AS block_no, length(ms[i]) AS n_chars, md5(ms[i]) AS text_md5
FROM (SELECT doc_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM merged)""")
def merged_paragraphs(t: Tables):
    merged = C.merge_short(T.split_paragraphs(T.clean_text(F.col("text"))))
    rows = multi_part_texts(t).select("doc_id", F.posexplode(merged).alias("block_no", "m"))
    return rows.select("doc_id", "block_no", F.length("m").cast("bigint").alias("n_chars"), F.md5("m").alias("text_md5"))


PARENTS_SQL = f"""
blocks AS (SELECT doc_id, i, ms[i] AS m FROM (SELECT doc_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM merged)),
cut AS (SELECT doc_id, i, CASE WHEN length(m) > 2048 THEN {S.sentences('m', 2048)} ELSE [m] END AS ps FROM blocks),
parent_rows AS (SELECT doc_id, i, j, ps[j] AS text FROM (SELECT doc_id, i, ps, unnest(range(1, len(ps) + 1)) AS j FROM cut)),
parents AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS parent_index FROM parent_rows),
kid_parts AS (SELECT doc_id, parent_index, list_filter(string_split(text, {S.NL} || {S.NL}), lambda q: {S.trim('q')} <> '') AS qs FROM parents),
kid_lists AS (SELECT doc_id, parent_index, {S.pack('qs', f"({S.NL} || {S.NL})", 2, 1024, S.sentences('b.part', 1024))} AS ks FROM kid_parts),
kids AS (SELECT doc_id, parent_index, j - 1 AS child, ks[j] AS text FROM (SELECT doc_id, parent_index, ks, unnest(range(1, len(ks) + 1)) AS j FROM kid_lists)),
family AS (
  SELECT doc_id, parent_index, NULL::BIGINT AS child, 'parent' AS chunk_type, text FROM parents
  UNION ALL SELECT doc_id, parent_index, child, 'child', text FROM kids),
hier AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY parent_index, coalesce(child, -1)) - 1 AS chunk_index,
    md5(concat_ws('|', doc_id, 'v1.0.0', 'hierarchical_model', 'p' || parent_index)) AS pid,
    md5(concat_ws('|', doc_id, 'v1.0.0', 'hierarchical_model', 'p' || parent_index || CASE WHEN child IS NULL THEN '' ELSE 'c' || child END)) AS chunk_id
  FROM family)"""

HIER_SQL = f"WITH {PARTS_SQL}, {PARAGRAPHS_SQL}, {MERGED_SQL}, {PARENTS_SQL}"


@query(HIER_SQL + """
SELECT doc_id, chunk_index::INTEGER AS chunk_index, chunk_type, parent_index::INTEGER AS parent_index, child::INTEGER AS index_in_parent,
  chunk_id, CASE WHEN chunk_type = 'child' THEN pid END AS parent_chunk_id, md5(text) AS text_md5 FROM hier""")
def hierarchical_chunks(t: Tables):
    rows = C.chunk_hierarchical(multi_part_texts(t))
    return rows.select(
        "doc_id", "chunk_index", "chunk_type", "parent_index", "index_in_parent", "chunk_id", "parent_chunk_id",
        F.md5("text").alias("text_md5"),
    )


@query(HIER_SQL + " SELECT doc_id, parent_index::INTEGER AS parent_index, md5(text) AS text_md5 FROM parents")
def parent_blocks(t: Tables):
    rows = multi_part_texts(t).select("doc_id", F.posexplode(C.hierarchical_parents(F.col("text"))).alias("parent_index", "p"))
    return rows.select("doc_id", "parent_index", F.md5("p").alias("text_md5"))


@query(HIER_SQL + """ SELECT doc_id, parent_index::INTEGER AS parent_index, count(*) AS n_children, max(length(text)) AS longest,
 md5(string_agg(text, '|' ORDER BY child)) AS texts_md5 FROM kids GROUP BY doc_id, parent_index""")
def child_blocks(t: Tables):
    parents = multi_part_texts(t).select("doc_id", F.posexplode(C.hierarchical_parents(F.col("text"))).alias("parent_index", "p"))
    kids = parents.withColumn("kids", C.split_children(F.col("p"))).filter(F.size("kids") > 0)
    return kids.select(
        "doc_id", "parent_index", F.size("kids").cast("bigint").alias("n_children"),
        F.array_max(F.transform("kids", F.length)).cast("bigint").alias("longest"),
        F.md5(F.array_join("kids", "|")).alias("texts_md5"),
    )


@query(f"SELECT doc_id, {S.trim('text')} AS text, len(string_split({S.trim('text')}, chr(10))) AS n_lines FROM documents")
def cleaned_text(t: Tables):
    clean = T.clean_text(F.regexp_replace("text", "\n", "\r\n"))
    return t.documents.select("doc_id", clean.alias("text"), F.size(F.split(clean, "\n", -1)).cast("bigint").alias("n_lines"))


@query(f"""SELECT doc_id, (i - 1)::INTEGER AS piece_no, md5(ps[i]) AS text_md5 FROM (
  SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, {S.sentences('text', 700)} AS ps FROM documents))""")
def oversized_cuts(t: Tables):
    rows = base.documents(t).select("doc_id", F.posexplode(T.split_oversized(F.col("text"), 700)).alias("piece_no", "p"))
    return rows.select("doc_id", "piece_no", F.md5("p").alias("text_md5"))


STRATEGY_SQL = f"""
asm AS (SELECT doc_id, text FROM documents WHERE lang IN ('en', 'de')),
{PARAGRAPHS_SQL}, {MERGED_SQL}, {PARENTS_SQL},
flat_p AS (SELECT doc_id, {S.text_pieces('text')} AS p FROM documents WHERE lang NOT IN ('en', 'de')),
flat AS (SELECT doc_id, i - 1 AS chunk_index, p[i] AS text FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM flat_p))"""


def by_strategy(t: Tables):
    """German documents ask with a hyphen, English with an underscore, Spanish name nothing known, French nothing."""
    wish = (
        F.when(F.col("lang") == "de", "hierarchical-model").when(F.col("lang") == "en", " HIERARCHICAL_MODEL")
        .when(F.col("lang") == "es", "sentences")
    )
    return C.chunk(base.documents(t).select("doc_id", "lang", "text"), wish)


@query(f"""WITH {STRATEGY_SQL}
SELECT doc_id, 'hierarchical_model' AS chunk_mode, chunk_type, chunk_index::INTEGER AS chunk_index, md5(text) AS text_md5 FROM hier
UNION ALL SELECT doc_id, 'text_model', 'flat', chunk_index::INTEGER, md5(text) FROM flat""")
def strategy_dispatch(t: Tables):
    return by_strategy(t).select("doc_id", "chunk_mode", "chunk_type", "chunk_index", F.md5("text").alias("text_md5"))


@query(f"""WITH {STRATEGY_SQL}
SELECT chunk_id, chunk_type, CASE WHEN chunk_type = 'child' THEN pid END AS parent_chunk_id FROM hier
UNION ALL SELECT md5(concat_ws('|', doc_id, 'v1.0.0', 'text_model', chunk_index)), 'flat', NULL FROM flat""")
def chunk_classes(t: Tables):
    kind = C.classify_chunk(F.col("chunk_mode"), F.col("chunk_type"), F.col("parent_chunk_id"))
    return by_strategy(t).select("chunk_id", kind.alias("k")).select("chunk_id", "k.*")


@query(f"""WITH {STRATEGY_SQL}
SELECT doc_id, CASE WHEN lang IN ('en', 'de')
 THEN '{{"parentSeparator":"\\n\\n\\n","parentMaxTokens":2048,"childSeparator":"\\n\\n","childMaxTokens":1024,"parentMode":"paragraph"}}'
 ELSE '{{"delimiter":"\\n","maxTokens":1024,"chunkOverlap":50}}' END AS params_snapshot FROM documents""")
def params_snapshots(t: Tables):
    mode = F.when(F.col("lang").isin("de", "en"), "hierarchical-model").otherwise(F.col("lang"))
    return t.documents.select("doc_id", codes.params_snapshot(codes.normalize_strategy(mode)).alias("params_snapshot"))


HASH_SQL = """lower(printf('%x', list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT),
  lambda h, c: (31 * h + c) & 4294967295, 0::BIGINT)))"""


@query(f"SELECT doc_id, sha256(text) AS text_hash, {HASH_SQL} AS short_hash FROM documents")
def text_hashes(t: Tables):
    return t.documents.select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), T.java_string_hash(F.col("text")).alias("short_hash"))


@query("""WITH d AS (SELECT doc_id, text || ' ' || array_to_string(list_transform(range(0, doc_id % 7), lambda i: '知'), '') AS t FROM documents)
SELECT doc_id, (doc_id % 7 + (length(t) - doc_id % 7) // 4)::INTEGER AS n_tokens FROM d""")
def token_estimates(t: Tables):
    mixed = F.concat(F.col("text"), F.lit(" "), F.repeat(F.lit("知"), (F.col("doc_id") % 7).cast("int")))
    return t.documents.select("doc_id", T.estimate_tokens(mixed).alias("n_tokens"))


@query(f"""WITH {S.CHUNKS}
SELECT chunk_id, doc_id, kb_id, kb_id % 5 + 1 AS tenant_id, 'v1.0.0' AS version, coalesce(quality, -1) AS owner_flag, chunk_index, text_hash
FROM chunks LEFT JOIN labels USING (doc_id)""")
def enriched_chunks(t: Tables):
    kb_of_source = base.kb_of_source
    owners = t.labels.select("doc_id", "quality")
    docs = t.documents.select(
        "doc_id", kb_of_source().alias("kb_id"), (kb_of_source() % 5 + 1).alias("tenant_id"), F.lit("v1.0.0").alias("version")
    ).join(owners, "doc_id", "left").withColumn("owner_flag", F.coalesce("quality", F.lit(-1)))
    rows = C.enrich_chunks(C.chunk_text_model(base.documents(t).select("doc_id", "text")), docs)
    return rows.select("chunk_id", "doc_id", "kb_id", "tenant_id", "version", "owner_flag", "chunk_index", "text_hash")
