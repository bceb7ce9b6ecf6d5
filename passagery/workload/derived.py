"""Platform tables derived from the given tables: the same definitions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagery.operators.access import role_table
from passagery.workload.registry import Tables

SQL = {
    "tenants": "SELECT r_regionkey + 1 AS tenant_id, r_name AS tenant_name FROM region",
    "kbs": """SELECT n_nationkey AS kb_id, n_regionkey + 1 AS tenant_id, n_name AS kb_name,
      CASE n_nationkey % 3 WHEN 0 THEN 'bge-m3' WHEN 1 THEN 'text-embedding-3-small' END AS embedding_model FROM nation""",
    "users": "SELECT c_custkey AS user_id, c_name AS username FROM customer",
    "roles": "SELECT * FROM (VALUES (0, 'SUPER_ADMIN'), (1, 'TENANT_ADMIN'), (2, 'KB_ADMIN'), (3, 'CONTRIBUTOR'), (4, 'VIEWER')) r(role_id, role_code)",
    "bindings": """SELECT c_custkey AS binding_id, c_custkey AS user_id,
        CASE WHEN c_custkey % 500 = 0 THEN 0 ELSE n_regionkey + 1 END AS tenant_id,
        CASE WHEN c_custkey % 500 = 0 THEN 0 ELSE (1 + c_custkey % 4)::INTEGER END AS role_id
      FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT c_custkey + 1000000000000, c_custkey, (n_regionkey + 1) % 5 + 1, 4
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'""",
    "grants": "SELECT n_nationkey AS kb_id, role_id FROM nation, (VALUES (2), (3), (4)) v(role_id) WHERE (n_nationkey + role_id) % 2 = 0",
    "kb_documents": """SELECT o_orderkey AS doc_id, c_nationkey AS kb_id, o_custkey AS owner_id, o_orderdate AS upload_time, o_orderpriority AS file_name,
      CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'VECTORIZING' ELSE 'FAILED' END AS process_status
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "requests": "SELECT o_orderkey AS request_id, o_custkey AS user_id, (o_orderkey % 26)::INTEGER AS kb_id FROM orders",
    "changes": """SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'R' THEN 'MAJOR' WHEN 'A' THEN 'MINOR' ELSE 'PATCH' END AS change_type, lineitem.* FROM lineitem""",
    "messages": """SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, turn, upper(role) AS role, text,
      CASE WHEN role = 'assistant' THEN length(text) * 7 % 4000 END AS response_time, (length(text) // 4)::INTEGER AS token_count,
      (turn % 7 = 6)::INTEGER AS deleted FROM conversations""",
    "sessions": """SELECT conv_id AS session_id, (conv_id % 5 + 1)::INTEGER AS tenant_id, conv_id % 37 AS user_id, max(turn) * 60 + conv_id AS last_access_time,
      (conv_id % 10 = 0)::INTEGER AS deleted FROM conversations GROUP BY conv_id""",
}
VERSION_ORDER = [
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def tenants(t: Tables) -> DataFrame:
    return t.region.select((F.col("r_regionkey") + 1).alias("tenant_id"), F.col("r_name").alias("tenant_name"))


def kbs(t: Tables) -> DataFrame:
    model = F.when(F.col("n_nationkey") % 3 == 0, "bge-m3").when(F.col("n_nationkey") % 3 == 1, "text-embedding-3-small")
    return t.nation.select(
        F.col("n_nationkey").alias("kb_id"), (F.col("n_regionkey") + 1).alias("tenant_id"), F.col("n_name").alias("kb_name"),
        model.alias("embedding_model"),
    )


def users(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


def roles(t: Tables) -> DataFrame:
    return role_table(t.spark)


def bindings(t: Tables) -> DataFrame:
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    above = F.col("c_custkey") % 500 == 0
    main = people.select(
        F.col("c_custkey").alias("binding_id"), F.col("c_custkey").alias("user_id"),
        F.when(above, 0).otherwise(F.col("n_regionkey") + 1).alias("tenant_id"),
        F.when(above, 0).otherwise((F.col("c_custkey") % 4 + 1).cast("int")).alias("role_id"),
    )
    second = people.filter(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("c_custkey") + 1000000000000).alias("binding_id"), F.col("c_custkey").alias("user_id"),
        ((F.col("n_regionkey") + 1) % 5 + 1).alias("tenant_id"), F.lit(4).alias("role_id"),
    )
    return main.unionByName(second)


def grants(t: Tables) -> DataFrame:
    each = t.nation.select(F.col("n_nationkey").alias("kb_id"), F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("role_id"))
    return each.filter((F.col("kb_id") + F.col("role_id")) % 2 == 0)


def kb_documents(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "VECTORIZING").otherwise("FAILED")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.col("c_nationkey").alias("kb_id"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("upload_time"), F.col("o_orderpriority").alias("file_name"), status.alias("process_status"),
    )


def requests(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 26).cast("int").alias("kb_id")
    )


def changes(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "MAJOR").when(F.col("l_returnflag") == "A", "MINOR").otherwise("PATCH")
    return t.lineitem.withColumn("doc_id", F.col("l_orderkey")).withColumn("change_type", kind)


def messages(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("session_id"), "turn",
        F.upper("role").alias("role"), "text",
        F.when(F.col("role") == "assistant", F.length("text") * 7 % 4000).alias("response_time"),
        F.floor(F.length("text") / 4).cast("int").alias("token_count"), (F.col("turn") % 7 == 6).cast("int").alias("deleted"),
    )


def sessions(t: Tables) -> DataFrame:
    return t.conversations.groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("turns")).select(
        "session_id", (F.col("session_id") % 5 + 1).cast("int").alias("tenant_id"), (F.col("session_id") % 37).alias("user_id"),
        (F.col("turns") * 60 + F.col("session_id")).alias("last_access_time"), (F.col("session_id") % 10 == 0).cast("int").alias("deleted"),
    )
