"""Registered queries: access control, knowledge bases, documents, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagery import constants as K
from passagery.functions import codes, text as T
from passagery.operators import access as A, catalog as D, chunking as C, versions as V
from passagery.sources import sinks
from passagery.workload import base, derived as R, sqlgen as S
from passagery.workload.registry import Tables, query

SUPER = "sup AS (SELECT DISTINCT user_id FROM bindings WHERE tenant_id = 0 AND role_id = 0)"
ROLE_SQL = R.ctes("kbs", "roles", "bindings", "grants", "requests") + f""", {SUPER},
res AS (SELECT q.*, CASE WHEN s.user_id IS NOT NULL THEN 'SUPER_ADMIN' WHEN r.role_code = 'TENANT_ADMIN' THEN 'TENANT_ADMIN'
    WHEN g.role_id IS NOT NULL THEN r.role_code ELSE 'NONE' END AS kb_role
  FROM requests q LEFT JOIN sup s USING (user_id) LEFT JOIN kbs k USING (kb_id) LEFT JOIN bindings b ON b.user_id = q.user_id AND b.tenant_id = k.tenant_id
  LEFT JOIN roles r ON r.role_id = b.role_id LEFT JOIN grants g ON g.kb_id = q.kb_id AND g.role_id = b.role_id)"""


def resolved(t: Tables):
    return A.effective_kb_roles(R.requests(t), R.kbs(t), R.bindings(t), R.roles(t), R.grants(t))


@query(ROLE_SQL + " SELECT request_id, user_id, kb_id, kb_role FROM res")
def kb_roles(t: Tables):
    return resolved(t).select("request_id", "user_id", "kb_id", "kb_role")


@query(R.ctes("bindings", "roles", "requests") + f""", {SUPER}
SELECT request_id, q.kb_id % 6 AS tenant_id, CASE WHEN s.user_id IS NOT NULL THEN 'SUPER_ADMIN' ELSE role_code END AS tenant_role
FROM requests q LEFT JOIN sup s USING (user_id) LEFT JOIN bindings b ON b.user_id = q.user_id AND b.tenant_id = q.kb_id % 6 LEFT JOIN roles USING (role_id)""")
def tenant_roles(t: Tables):
    asked = R.requests(t).withColumn("tenant_id", F.col("kb_id") % 6)
    return A.tenant_roles(asked, R.bindings(t), R.roles(t)).select("request_id", "tenant_id", "tenant_role")


@query(R.ctes("users", "bindings") + """
SELECT user_id, coalesce(bool_or(role_id = 1 OR (role_id = 0 AND tenant_id = 0)), false) AS is_admin
FROM users LEFT JOIN bindings USING (user_id) GROUP BY user_id""")
def tenant_admins(t: Tables):
    return A.has_tenant_admin(R.users(t), R.bindings(t), R.roles(t))


@query(ROLE_SQL + """ SELECT request_id, kb_role <> 'NONE' AS can_view, kb_role IN ('SUPER_ADMIN', 'TENANT_ADMIN', 'KB_ADMIN', 'CONTRIBUTOR') AS can_upload,
  kb_role IN ('SUPER_ADMIN', 'TENANT_ADMIN', 'KB_ADMIN') AS can_admin, kb_role IN ('TENANT_ADMIN', 'KB_ADMIN') AS can_admin_compat,
  kb_role IN ('SUPER_ADMIN', 'TENANT_ADMIN', 'KB_ADMIN') OR user_id % 9 = 0 AS can_delete FROM res""")
def action_checks(t: Tables):
    role, owner = F.col("kb_role"), F.col("user_id") % 9 == 0
    return resolved(t).select(
        "request_id", A.allowed("view", role).alias("can_view"), A.allowed("upload", role).alias("can_upload"),
        A.allowed("admin", role).alias("can_admin"), A.allowed("admin", role, compat=True).alias("can_admin_compat"),
        A.allowed("delete", role, owner).alias("can_delete"),
    )


@query(ROLE_SQL + " SELECT user_id AS request_id, bool_and(kb_role <> 'NONE') AS permitted, count(*) AS n_kbs FROM res GROUP BY user_id")
def multi_kb_checks(t: Tables):
    rows = resolved(t).select(F.col("user_id").alias("request_id"), "kb_role")
    return A.authorize_all(rows, A.allowed("view", F.col("kb_role")))


@query(R.ctes("bindings", "roles") + """ SELECT binding_id, role_id AS level, role_id >= 1 AS tenant_admin_may_grant, role_id >= 0 AS super_may_grant,
 false AS viewer_may_grant FROM bindings""")
def grant_rules(t: Tables):
    rows = A.with_role_codes(R.bindings(t), R.roles(t))
    code = F.col("role_code")
    return rows.select(
        "binding_id", codes.role_level(code).alias("level"), codes.can_grant(F.lit("TENANT_ADMIN"), code).alias("tenant_admin_may_grant"),
        codes.can_grant(F.lit("SUPER_ADMIN"), code).alias("super_may_grant"), codes.can_grant(F.lit("VIEWER"), code).alias("viewer_may_grant"),
    )


LIST_SQL = R.ctes("users", "bindings", "roles", "tenants") + """,
info AS (SELECT user_id, arg_min(tenant_id, binding_id) AS tenant_id, bool_or(tenant_id = 0) AS is_super, bool_or(tenant_id = 2) AS visible FROM bindings GROUP BY user_id),
held AS (SELECT user_id, string_agg(role_code, ',' ORDER BY role_id) AS role_codes FROM (SELECT DISTINCT user_id, role_id FROM bindings) JOIN roles USING (role_id) GROUP BY user_id)
SELECT u.user_id, username, tenant_id, tenant_name, role_codes FROM users u """


@query(LIST_SQL + "LEFT JOIN info USING (user_id) LEFT JOIN held USING (user_id) LEFT JOIN tenants USING (tenant_id)")
def users_seen_by_super(t: Tables):
    rows = A.list_users(R.users(t), R.bindings(t), R.roles(t), R.tenants(t), None)
    return rows.select("user_id", "username", "tenant_id", "tenant_name", "role_codes")


@query(LIST_SQL + "JOIN info USING (user_id) LEFT JOIN held USING (user_id) LEFT JOIN tenants USING (tenant_id) WHERE visible AND NOT is_super")
def users_seen_by_tenant_admin(t: Tables):
    rows = A.list_users(R.users(t), R.bindings(t), R.roles(t), R.tenants(t), 2)
    return rows.select("user_id", "username", "tenant_id", "tenant_name", "role_codes")


@query(R.ctes("users", "bindings", "tenants") + f""", {SUPER}
SELECT user_id, NULL::INTEGER AS tenant_id, NULL::VARCHAR AS tenant_name, true AS sees_all FROM sup
UNION ALL SELECT DISTINCT user_id, tenant_id, tenant_name, false FROM bindings JOIN tenants USING (tenant_id) WHERE user_id NOT IN (SELECT user_id FROM sup)""")
def visible_tenants(t: Tables):
    return A.list_tenants(R.users(t), R.bindings(t), R.roles(t), R.tenants(t))


@query(R.ctes("kbs", "kb_documents") + """ SELECT kb_id, kb_name, tenant_id, (SELECT count(*) FROM kb_documents d WHERE d.kb_id = k.kb_id) AS n_documents,
  strftime((SELECT min(upload_time) FROM kb_documents d WHERE d.kb_id = k.kb_id), '%Y-%m-%d') AS created FROM kbs k""")
def kb_listing(t: Tables):
    """A base counts as created with its first document."""
    first = R.kb_documents(t).groupBy("kb_id").agg(F.min("upload_time").alias("create_time"))
    listed = D.list_kbs(R.kbs(t).join(first, "kb_id", "left"), R.kb_documents(t))
    return listed.select("kb_id", "kb_name", "tenant_id", "n_documents", F.date_format("create_time", "yyyy-MM-dd").alias("created"))


@query(R.ctes("roles") + """, asked AS (SELECT o_orderkey, ['TENANT_ADMIN', 'VIEWER', 'OWNER', 'KB_ADMIN'][(o_orderkey % 4 + 1)::INTEGER] AS role_code FROM orders)
SELECT o_orderkey, role_code, role_id FROM asked LEFT JOIN roles USING (role_code)""")
def roles_by_code(t: Tables):
    names = F.array(*[F.lit(c) for c in ("TENANT_ADMIN", "VIEWER", "OWNER", "KB_ADMIN")])
    asked = t.orders.select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("role_code"))
    return A.lookup_roles(asked, R.roles(t)).select("o_orderkey", "role_code", "role_id")


@query(R.ctes("bindings", "roles") + """, sets AS (SELECT user_id, list_append(list(role_id), 9) AS ids FROM bindings GROUP BY user_id)
SELECT user_id, string_agg(role_code, ',' ORDER BY role_id) AS role_codes FROM sets JOIN roles ON list_contains(ids, role_id) GROUP BY user_id""")
def roles_by_id_set(t: Tables):
    """The roles of every user as one set of ids, with an id that is no role."""
    sets = R.bindings(t).groupBy("user_id").agg(F.array_append(F.collect_list("role_id"), F.lit(9)).alias("role_ids"))
    return A.roles_in(sets, R.roles(t)).select("user_id", F.array_join("roles.role_code", ",").alias("role_codes"))


@query(R.ctes("bindings", "roles") + """ SELECT role_id, role_code, role_id AS level, count(binding_id) AS n_bindings
FROM roles LEFT JOIN bindings USING (role_id) WHERE role_code <> 'SUPER_ADMIN' GROUP BY ALL""")
def role_listing(t: Tables):
    shown = A.list_roles(R.roles(t))
    counts = R.bindings(t).groupBy("role_id").agg(F.count(F.lit(1)).alias("n_bindings"))
    return shown.join(counts, "role_id", "left").select("role_id", "role_code", "level", F.coalesce("n_bindings", F.lit(0)).alias("n_bindings"))


@query(R.ctes("grants", "roles") + " SELECT kb_id, string_agg(role_code, ',' ORDER BY role_id) AS role_codes FROM grants JOIN roles USING (role_id) GROUP BY kb_id")
def kb_grants(t: Tables):
    return A.kb_permissions(R.grants(t), R.roles(t))


CHANGE_SQL = """
log AS (SELECT o_custkey AS user_id, (o_orderkey % 6)::INTEGER AS tenant_id, (1 + o_orderkey % 4)::INTEGER AS role_id,
  CASE WHEN o_orderstatus = 'P' THEN 'REVOKE' ELSE 'GRANT' END AS action, o_orderkey AS change_no FROM orders),
lastc AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, tenant_id ORDER BY change_no DESC) = 1)"""


@query(R.ctes("bindings") + f""", {CHANGE_SQL}
SELECT user_id, tenant_id, role_id FROM lastc WHERE action = 'GRANT'
UNION ALL SELECT user_id, tenant_id, role_id FROM bindings b WHERE NOT EXISTS (SELECT 1 FROM lastc l WHERE l.user_id = b.user_id AND l.tenant_id = b.tenant_id)""")
def grants_applied(t: Tables):
    log = t.orders.select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 6).cast("int").alias("tenant_id"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("role_id"),
        F.when(F.col("o_orderstatus") == "P", "REVOKE").otherwise("GRANT").alias("action"), F.col("o_orderkey").alias("change_no"),
    )
    return A.apply_grants(R.bindings(t), log, ["user_id", "tenant_id"])


PERM_SQL = "perms AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{role}', '{p}')" for role, held in K.ROLE_PERMISSIONS.items() for p in held
) + ") p(role_code, permission))"


@query(R.ctes("bindings", "roles") + f""", {PERM_SQL}
SELECT permission, count(DISTINCT user_id) AS n_users FROM bindings JOIN roles USING (role_id) JOIN perms USING (role_code) GROUP BY permission""")
def permission_holders(t: Tables):
    held = A.with_role_codes(R.bindings(t), R.roles(t)).select("user_id", "role_code").distinct()
    matrix = F.broadcast(A.permission_matrix(t.spark))
    return held.join(matrix, "role_code").select("user_id", "permission").distinct().groupBy("permission").agg(F.count(F.lit(1)).alias("n_users"))


@query(R.ctes("bindings", "roles") + f""", {PERM_SQL}
SELECT user_id, bool_or(p.permission IS NOT NULL) AS permitted, arg_min(roles.role_code, role_id) AS highest_role
FROM bindings JOIN roles USING (role_id) LEFT JOIN perms p ON p.role_code = roles.role_code AND p.permission = 'kb:config' GROUP BY user_id""")
def user_capabilities(t: Tables):
    b, r = R.bindings(t), R.roles(t)
    return A.has_permission(b, r, "kb:config").join(A.highest_role(b, r), "user_id")


@query(R.ctes("users") + """, names AS (SELECT s_suppkey, 'Customer#' || lpad((s_suppkey * 17)::VARCHAR, 9, '0') AS username FROM supplier)
SELECT s_suppkey, user_id, user_id IS NOT NULL AS taken FROM names LEFT JOIN users USING (username)""")
def username_lookup(t: Tables):
    number = F.lpad((F.col("s_suppkey") * 17).cast("string"), 9, "0")
    names = t.supplier.select("s_suppkey", F.concat(F.lit("Customer#"), number).alias("username"))
    return A.lookup_users(names, R.users(t)).select("s_suppkey", "user_id", "taken")


@query(R.ctes("kbs") + """ SELECT kb_id, 'T' || tenant_id || '_Kb' || kb_id AS collection_name,
CASE kb_id % 3 WHEN 0 THEN 'bge-m3' WHEN 1 THEN 'openai' ELSE 'tongyi' END AS model_family,
CASE kb_id % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1536 ELSE 1024 END AS vector_dim FROM kbs""")
def kb_configs(t: Tables):
    return D.kb_config(R.kbs(t), {"bge-m3": 1024, "openai": 1536, "tongyi": 1024})


@query(R.ctes("kb_documents") + " SELECT doc_id, kb_id FROM kb_documents WHERE contains(lower(file_name), 'urgent') AND process_status = 'COMPLETED'")
def document_facet_filter(t: Tables):
    rows = D.facet_filter(R.kb_documents(t), "URGENT", ["file_name"], {"process_status": "COMPLETED", "kb_id": "all"})
    return rows.select("doc_id", "kb_id")


@query(R.ctes("bindings", "roles") + " SELECT role_code, count(*) AS n_users FROM bindings JOIN roles USING (role_id) GROUP BY role_code")
def role_counts(t: Tables):
    return A.role_facets(R.bindings(t), R.roles(t))


@query(R.ctes("kb_documents") + " SELECT kb_id, doc_id, strftime(upload_time, '%Y-%m-%d %H:%M:%S') AS uploaded FROM kb_documents")
def newest_documents(t: Tables):
    """The whole document list of every knowledge base."""
    return D.list_documents(R.kb_documents(t)).select(
        "kb_id", "doc_id", F.date_format("upload_time", "yyyy-MM-dd HH:mm:ss").alias("uploaded"))


EVENTS_SQL = """
stages AS (SELECT o_orderkey AS doc_id, o_orderdate, CASE o_orderstatus
   WHEN 'F' THEN ['PENDING', 'PARSING', 'PARSED', 'CHUNKING', 'CHUNKED', 'VECTORIZING', 'COMPLETED']
   WHEN 'O' THEN ['PENDING', 'PARSING', 'PARSED', 'CHUNKING', 'CHUNKED', 'VECTORIZING'] ELSE ['PENDING', 'PARSING', 'FAILED'] END AS st,
   o_orderpriority LIKE '1%' AS jump FROM orders),
status_events AS (SELECT doc_id, seq, o_orderdate + to_hours(seq * 5) AS event_time, status
  FROM (SELECT doc_id, o_orderdate, jump, unnest(range(0, len(st))) AS seq, unnest(st) AS status FROM stages) WHERE NOT (jump AND status = 'PARSING'))"""


def status_events(t: Tables):
    """One event per processing stage; urgent documents skip a stage, which is not allowed."""
    full = F.array(*[F.lit(s) for s in K.STATUS_ORDER])
    st = F.when(F.col("o_orderstatus") == "F", full).when(F.col("o_orderstatus") == "O", F.slice(full, 1, 6)).otherwise(
        F.array(F.lit("PENDING"), F.lit("PARSING"), F.lit("FAILED"))
    )
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_orderpriority", F.posexplode(st).alias("seq", "status"))
    kept = rows.filter(~(F.col("o_orderpriority").startswith("1") & (F.col("status") == "PARSING")))
    hours = F.make_interval(hours=F.col("seq") * 5)
    return kept.select("doc_id", F.col("seq").cast("bigint").alias("seq"), (F.col("o_orderdate") + hours).alias("event_time"), "status")


@query(f"WITH {EVENTS_SQL} SELECT doc_id, arg_max(status, seq) AS status, count(*) AS n_events FROM status_events GROUP BY doc_id")
def latest_statuses(t: Tables):
    return D.latest_status(status_events(t))


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY event_time, seq) AS before FROM status_events)
SELECT doc_id, seq, before, status FROM l WHERE (before = 'PENDING' AND status = 'PARSED')""")
def illegal_transitions(t: Tables):
    """Jumping over PARSING is illegal; failing straight after PENDING is not."""
    return D.check_transitions(status_events(t), F.date_trunc("minute", "event_time")).select("doc_id", "seq", "before", "status")


@query(R.ctes("kb_documents") + """ SELECT CASE process_status WHEN 'COMPLETED' THEN 'INDEXED' WHEN 'FAILED' THEN 'FAILED' ELSE 'PROCESSING' END AS facet,
count(*) AS n_documents FROM kb_documents GROUP BY facet""")
def document_status_facets(t: Tables):
    return D.status_facets(R.kb_documents(t))


@query(f"WITH {S.CHUNKS} SELECT doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id) AS chunk_count FROM documents d")
def document_chunk_counts(t: Tables):
    return D.chunk_counts(t.documents.select("doc_id"), C.chunk_text_model(base.documents(t).select("doc_id", "text")))


@query(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, md5(text) AS text_md5 FROM chunks ORDER BY doc_id, chunk_index")
def chunks_in_order(t: Tables):
    return D.get_chunks(C.chunk_text_model(base.documents(t).select("doc_id", "text"))).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


@query("""WITH v AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v' || o_custkey || '.2.3' WHEN 2 THEN o_custkey || '.5'
   WHEN 3 THEN 'draft' ELSE 'v1.x.2' END AS latest, ['MAJOR', 'MINOR', 'PATCH', 'INITIAL'][(o_orderkey % 4 + 1)::INTEGER] AS change_type, o_custkey AS m FROM orders),
p AS (SELECT *, CASE doc_id % 5 WHEN 1 THEN m WHEN 2 THEN m ELSE 1 END AS a, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END AS b, CASE doc_id % 5 WHEN 1 THEN 3 ELSE 0 END AS c FROM v)
SELECT doc_id, CASE WHEN latest IS NULL THEN 'v1.0.0' WHEN change_type = 'MAJOR' THEN 'v' || (a + 1) || '.0.0'
  WHEN change_type = 'PATCH' THEN 'v' || a || '.' || b || '.' || (c + 1) ELSE 'v' || a || '.' || (b + 1) || '.0' END AS next_version FROM p""")
def next_versions(t: Tables):
    n = F.col("o_orderkey") % 5
    cust = F.col("o_custkey").cast("string")
    latest = F.when(n == 1, F.concat(F.lit("v"), cust, F.lit(".2.3"))).when(n == 2, F.concat(cust, F.lit(".5"))).when(n == 3, "draft").when(n == 4, "v1.x.2")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("MAJOR", "MINOR", "PATCH", "INITIAL")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), codes.next_version(latest, kind).alias("next_version"))


ORDER_SQL = ", ".join(R.VERSION_ORDER)
CHAIN_SQL = R.ctes("changes") + f""",
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER_SQL}) AS seq FROM changes),
a AS (SELECT *, CASE WHEN seq = 1 THEN 'MAJOR' ELSE change_type END AS k FROM s),
b AS (SELECT *, sum((k = 'MAJOR')::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS ma FROM a),
c AS (SELECT *, sum((k = 'MINOR')::INT) OVER (PARTITION BY doc_id, ma ORDER BY seq) AS mi FROM b),
chain AS (SELECT *, 'v' || ma || '.' || mi || '.' || sum((k = 'PATCH')::INT) OVER (PARTITION BY doc_id, ma, mi ORDER BY seq) AS version FROM c)"""


def chain(t: Tables):
    return V.version_chain(R.changes(t), ["doc_id"], R.VERSION_ORDER, F.to_date("l_shipdate"))


@query(CHAIN_SQL + " SELECT doc_id, seq, change_type, version FROM chain")
def version_chains(t: Tables):
    return chain(t).select("doc_id", "seq", "change_type", "version")


@query(CHAIN_SQL + " SELECT doc_id, seq, version, seq = max(seq) OVER (PARTITION BY doc_id) AS current_active FROM chain")
def active_versions(t: Tables):
    return V.activate_latest(chain(t), ["doc_id"], ["seq"]).select("doc_id", "seq", "version", "current_active")


@query(CHAIN_SQL + " SELECT doc_id, max(seq) AS n_versions, arg_max(version, seq) AS version, arg_max(change_type, seq) AS change_type FROM chain GROUP BY doc_id")
def current_versions(t: Tables):
    rows = V.current_version(chain(t), ["doc_id"], ["seq"])
    return rows.select("doc_id", F.col("seq").alias("n_versions"), "version", "change_type")


@query(CHAIN_SQL + " SELECT doc_id, seq, version FROM chain ORDER BY doc_id, seq DESC")
def version_histories(t: Tables):
    return V.history(chain(t), ["doc_id"], ["seq"]).select("doc_id", "seq", "version")


TARGET_SQL = "targets AS (SELECT o_orderkey AS doc_id, 'v1.1.0' AS target FROM orders WHERE o_orderstatus = 'F')"


def targets(t: Tables):
    return t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"), F.lit("v1.1.0").alias("version"))


@query(CHAIN_SQL + f""", {TARGET_SQL}, hits AS (SELECT DISTINCT doc_id FROM chain JOIN targets USING (doc_id) WHERE version = target)
SELECT doc_id, seq, CASE WHEN doc_id IN (SELECT doc_id FROM hits) THEN version = 'v1.1.0' ELSE seq = max(seq) OVER (PARTITION BY doc_id) END AS current_active FROM chain""")
def rolled_back_versions(t: Tables):
    return V.rollback(chain(t), targets(t), ["doc_id"], ["seq"]).select("doc_id", "seq", "current_active")


@query(CHAIN_SQL + f", {TARGET_SQL} SELECT doc_id, target AS version FROM targets WHERE doc_id NOT IN (SELECT doc_id FROM chain WHERE version = 'v1.1.0')")
def rollback_failures(t: Tables):
    return V.rollback_errors(chain(t), targets(t), ["doc_id"])


@query(R.ctes("changes") + f""" SELECT doc_id, l_partkey, (row_number() OVER w)::INTEGER AS age FROM changes
WINDOW w AS (PARTITION BY doc_id ORDER BY {', '.join(c + ' DESC' for c in R.VERSION_ORDER)}) QUALIFY row_number() OVER w <= 3""")
def retained_versions(t: Tables):
    return V.retain_versions(R.changes(t), ["doc_id"], R.VERSION_ORDER, 3).select("doc_id", "l_partkey", "age")


EDIT_SQL = f"""
edited AS (SELECT doc_id, CASE lang WHEN 'fr' THEN replace(text, 'que', 'QUE') WHEN 'de' THEN substr(text, 1, length(text) // 2)
   WHEN 'en' THEN text || chr(10) || text ELSE text END AS text FROM documents),
ea AS (SELECT doc_id, {S.text_pieces('text')} AS p FROM documents WHERE length(text) > 0),
eb AS (SELECT doc_id, {S.text_pieces('text')} AS p FROM edited WHERE length(text) > 0),
va AS (SELECT doc_id, i, p[i] AS x FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM ea)),
vb AS (SELECT doc_id, i, p[i] AS y FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM eb))"""


@query(f"""WITH {EDIT_SQL} SELECT doc_id, sum((x IS NULL)::INT)::BIGINT AS added, coalesce(sum((x <> y)::INT), 0)::BIGINT AS modified, sum((y IS NULL)::INT)::BIGINT AS deleted
FROM va FULL JOIN vb USING (doc_id, i) GROUP BY doc_id""")
def version_diff(t: Tables):
    text = (
        F.when(F.col("lang") == "fr", F.replace("text", F.lit("que"), F.lit("QUE")))
        .when(F.col("lang") == "de", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")))
        .when(F.col("lang") == "en", F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    )
    hashed = lambda df: C.chunk_text_model(df).withColumn("text_hash", T.text_hash(F.col("text")))
    docs = base.documents(t).select("doc_id", "lang", "text")
    return V.compare_versions(hashed(docs), hashed(docs.withColumn("text", text)))


@query(f"""WITH {S.CHUNKS}, bad AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM bad)""")
def cascade_delete(t: Tables):
    toxic = t.labels.filter(F.col("toxic") == 1).select("doc_id")
    left = sinks.delete_document({"chunks": base.corpus_chunks(t), "documents": t.documents}, toxic)
    return left["chunks"].join(left["documents"].select("doc_id"), "doc_id").select("doc_id", "chunk_id")


@query(f"""WITH {S.CHUNKS} SELECT chunk_id FROM chunks LEFT JOIN labels USING (doc_id)
WHERE NOT coalesce(quality = 0 AND lang = 'en', false)""")
def delete_by_filter(t: Tables):
    from passagery.functions.filters import filter_expr

    rows = base.corpus_chunks(t).join(t.labels, "doc_id", "left")
    return sinks.delete_where(rows, filter_expr(("and", ("eq", "quality", 0), ("eq", "lang", "en")))).select("chunk_id")
