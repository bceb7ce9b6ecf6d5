"""Histories with a dominant key, storage, sessions and the smaller rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from passagery import constants as K
from passagery.functions import codes
from passagery.operators import access as A, catalog as D, context as X, dashboard as J, ordered as O, sessions as H, versions as V
from passagery.plans import ingest as PI
from passagery.sources import files, sinks, snapshots, tabular


def test_version_chain_of_a_dominant_document_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 30), rng.randint(0, 400), i, rng.choice(["MAJOR", "minor", "PATCH", "INITIAL"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id int, day int, no int, change_type string").repartition(7)
    got = {r["no"]: r["version"] for r in V.version_chain(df, ["doc_id"], ["day", "no"], F.floor(F.col("day") / 30)).collect()}
    state: dict[int, list[int]] = {}
    for doc, _, no, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        v = state.get(doc)
        if v is None:
            v = [1, 0, 0]
        elif kind == "MAJOR":
            v = [v[0] + 1, 0, 0]
        elif kind == "PATCH":
            v = [v[0], v[1], v[2] + 1]
        else:
            v = [v[0], v[1] + 1, 0]
        state[doc] = v
        assert got[no] == "v%d.%d.%d" % tuple(v)


def test_sessions_and_streaks_cross_bucket_borders(spark):
    rng = random.Random(6)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 9), rng.randint(0, 500_000), i, rng.random() < 0.6) for i in range(1200)]
    df = spark.createDataFrame(rows, "user_id int, s int, event_id int, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["session_no"] for r in H.sessionize(df, ["user_id"], "ts", 900).collect()}
    before = {r["event_id"]: r["before"] for r in O.previous(df, ["user_id"], ["ts", "event_id"], F.to_date("ts"), {"before": F.col("s")}).collect()}
    dense = {r["event_id"]: r["session_no"] for r in H.sessionize(df, ["user_id"], "ts", 900, rows=40).collect()}
    assert dense == got
    last, number = {}, {}
    for user, s, event, failed in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        assert before[event] == last.get(user)
        if user not in last or s - last[user] >= 900:
            number[user] = number.get(user, 0) + 1
        last[user] = s
        assert got[event] == number[user]


@pytest.mark.parametrize("limit, minutes, rows", [(3, 30, 50_000), (2, 2000, 16), (3, 600, 7), (1, 900, 5)])
def test_locks_refuse_attempts_until_they_end(spark, limit, minutes, rows):
    rng = random.Random(limit * 100 + rows)
    tries = [(0 if rng.random() < 0.6 else rng.randint(1, 9), rng.randint(0, 8_000) * 60, i, rng.random() < 0.7) for i in range(1500)]
    df = spark.createDataFrame(tries, "user_id int, s int, event_id int, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    found = H.lockouts(df, ["user_id"], "ts", "event_id", F.col("failed"), limit, minutes, rows)
    got = {(r.user_id, r.event_id, int(r.a), int(r.b)) for r in found.selectExpr("*", "unix_seconds(since) a", "unix_seconds(locked_until) b").collect()}
    count, first, until, expected = {}, {}, {}, set()
    for user, s, event, failed in sorted(tries, key=lambda r: (r[0], r[1], r[2])):
        if s <= until.get(user, -1):
            continue
        if not count.get(user):
            first[user] = s
        count[user] = count.get(user, 0) + 1 if failed else 0
        if count[user] == limit:
            count[user], until[user] = 0, s + minutes * 60
            expected.add((user, event, first[user], until[user]))
    assert got == expected and len(got) > 20


def test_a_busy_day_is_divided_by_its_rows(spark):
    df = spark.range(4000).select((F.col("id") % 2 * F.col("id")).alias("user_id"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.col("id").alias("event_id"))
    sizes = O.by_density(df, ["user_id"], F.date_trunc("minute", "ts"), 100).groupBy("user_id", O.DENSE).count()
    busy = [r["count"] for r in sizes.filter("user_id = 0").collect()]
    assert len(busy) >= 15 and max(busy) <= 110 and sum(busy) == 2000
    assert sizes.filter(f"user_id > 0 AND {O.DENSE} > 0").count() == 0


def test_no_attempts_no_locks(spark):
    df = spark.createDataFrame([], "user_id int, ts timestamp, event_id int, failed boolean")
    assert H.lockouts(df, ["user_id"], "ts", "event_id", F.col("failed")).count() == 0


def test_lockouts_call_python_once_for_a_key_and_not_for_each_bucket(spark):
    df = spark.createDataFrame([(1, i, True) for i in range(20)], "user_id long, event_id long, failed boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    locks = H.lockouts(df, ["user_id"], "ts", "event_id", F.col("failed"), 2, 3, 2)
    plan = locks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == 1 and plan.count("MapInPandas") == 1
    assert sorted(r["event_id"] for r in locks.collect()) == [1, 6, 11, 16]


def test_next_versions(spark):
    cases = [(None, "MAJOR", "v1.0.0"), ("v1.2.3", "MAJOR", "v2.0.0"), ("v1.2.3", "MINOR", "v1.3.0"), ("v1.2.3", "PATCH", "v1.2.4"),
             ("v1.2.3", "other", "v1.3.0"), ("2.5", "PATCH", "v2.5.1"), ("garbage", "MAJOR", "v2.0.0"), ("v1.x", "PATCH", "v1.0.1")]
    df = spark.createDataFrame(cases, "latest string, kind string, expected string")
    assert df.filter(codes.next_version(F.col("latest"), F.col("kind")) != F.col("expected")).count() == 0


def test_tables_of_20_and_21_rows(spark):
    rows = [("s20", i, "x", 1.0, None) for i in range(20)] + [("s21", i, "null" if i == 0 else "y", 2.5, "z") for i in range(21)]
    df = spark.createDataFrame(rows + [("s20", 99, " ", None, "NULL")], "sheet string, no int, a string, b double, c string")
    out = {r["sheet"]: r for r in tabular.table_to_text(df, "sheet", "no", {"a": "A", "b": "B", "c": " "}).collect()}
    lines = out["s20"]["text"].split("\n")
    assert lines[:5] == ["## s20", "", "| A | B | 列3 |", "| --- | --- | --- |", "| x | 1 |  |"] and out["s20"]["mode"] == "markdown"
    assert out["s21"]["text"].split("\n")[2:4] == ["B: 2.5, 列3: z", "A: y, B: 2.5, 列3: z"] and out["s21"]["mode"] == "key_value"


def test_long_sheet_and_long_documents_are_one_text(spark):
    df = spark.range(95).select(F.lit("s").alias("sheet"), F.col("id").alias("no"), F.concat(F.lit("v"), F.col("id")).alias("a"))
    rows = tabular.table_to_text(df, "sheet", "no", {"a": "A"}, segment_rows=10).collect()
    assert [r["text"] for r in rows] == ["## s\n\n" + "\n".join(f"A: v{i}" for i in range(95))]
    parts = tabular.assemble_parts(spark.range(2100).selectExpr("1L AS key", "id", "'p' || id AS text"), "key", "id").collect()
    assert [(r["n_parts"], r["text"]) for r in parts] == [(2100, "\n\n".join(f"p{i}" for i in range(2100)))]


def test_directory_with_a_broken_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.HTML").write_text("<p>page</p>", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.txt").write_text("not read", encoding="utf-8")
    rows = {r["file_name"]: r for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert {n: (r["success"], r["text"]) for n, r in rows.items()} == {
        "a.txt": (True, "hello"), "b.HTML": (True, "page"), "c.pdf": (False, None), "d.txt": (False, None)
    }


def test_a_file_above_the_bound_is_a_failed_row_and_never_opened(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("x" * 2000)
    rows = {r["file_name"]: (r["success"], r["text"], r["message"]) for r in files.read_directory(spark, str(tmp_path), max_bytes=1000).collect()}
    assert rows == {"a.txt": (True, "hello", None), "b.txt": (False, None, "larger than 1000 bytes")}
    (tmp_path / "b.txt").chmod(0)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert files.read_directory(spark, str(tmp_path), max_bytes=1000).filter("success").count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_ingest_reports_failures_and_reprocess_touches_one_folder(spark, tmp_path):
    docs = spark.createDataFrame([(1, 1, 1, "one two"), (2, 1, 2, "three"), (3, 1, 2, " "), (4, 1, 2, None)], "doc_id long, tenant_id int, kb_id int, text string")
    results, chunks = PI.ingest(docs)
    assert {r["doc_id"]: (r["status"], r["chunk_count"]) for r in results.collect()} == {
        1: ("COMPLETED", 1), 2: ("COMPLETED", 1), 3: ("FAILED", 0), 4: ("FAILED", 0)
    }
    path = str(tmp_path / "chunks")
    sinks.write_chunks(chunks.withColumn("text_hash", F.sha2("text", 256)), path)
    PI.reprocess(docs.withColumn("text", F.upper("text")), path, 1, 2)
    stored = {r["doc_id"]: r["text"] for r in sinks.read_chunks(spark, path, 1, [1, 2]).collect()}
    assert stored == {1: "one two", 2: "THREE"}
    left = sinks.delete_document({"chunks": spark.read.parquet(path)}, docs.filter("doc_id = 1"))["chunks"]
    assert [r["doc_id"] for r in left.collect()] == [2]


def test_tenant_list_of_one_user(spark):
    roles = A.role_table(spark)
    tenants = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tenant_id int, tenant_name string")
    bindings = spark.createDataFrame([(1, 9, 0, 0), (2, 8, 2, 4)], "binding_id int, user_id int, tenant_id int, role_id int")
    assert sorted(r["tenant_id"] for r in A.tenants_for(9, bindings, roles, tenants).collect()) == [1, 2, 3]
    assert [r["tenant_id"] for r in A.tenants_for(8, bindings, roles, tenants).collect()] == [2]


def test_grants_are_idempotent(spark):
    current = spark.createDataFrame([(1, 1, 2)], "user_id int, tenant_id int, role_id int")
    log = spark.createDataFrame([(1, 1, 3, "GRANT", 1), (2, 1, 4, "GRANT", 2), (2, 1, 4, "REVOKE", 3)], "user_id int, tenant_id int, role_id int, action string, change_no int")
    once = A.apply_grants(current, log, ["user_id", "tenant_id"])
    twice = A.apply_grants(once, log, ["user_id", "tenant_id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1, 3)]


def test_state_machine(spark):
    def ok(a, b):
        return spark.range(1).select(D.valid_transition(F.lit(a).cast("string"), F.lit(b))).first()[0]

    assert ok(None, "PENDING") and not ok(None, "PARSED") and ok("PENDING", "PARSING") and not ok("PARSING", "CHUNKED")
    assert ok("CHUNKED", "FAILED") and not ok("COMPLETED", "FAILED") and not ok("FAILED", "PENDING")


def test_lists_are_filtered_and_ordered(spark):
    docs = spark.createDataFrame([(1, 7, 10), (2, 7, 30), (3, 8, 99), (4, 7, 30)], "doc_id int, kb_id int, upload_time int")
    assert [r["doc_id"] for r in D.list_documents(docs, 7).collect()] == [4, 2, 1]
    sessions = spark.createDataFrame([(1, 5, 1, 10, 0), (2, 5, 1, 20, 0), (3, 5, 2, 30, 0), (4, 5, 1, 40, 1)], "session_id int, user_id int, tenant_id int, last_access_time int, deleted int")
    assert [r["session_id"] for r in H.list_sessions(sessions, 5, 1).collect()] == [2, 1]
    assert [r["session_id"] for r in H.list_sessions(sessions, 5).collect()] == [3, 2, 1]


def test_bases_newest_first_and_roles_by_id_set(spark):
    docs = spark.createDataFrame([(1, 7), (2, 7)], "doc_id int, kb_id int")
    kbs = spark.createDataFrame([(7, 1, 10), (8, 1, 30), (9, 1, 30), (5, 2, 99)], "kb_id int, tenant_id int, create_time int")
    assert [(r["kb_id"], r["n_documents"]) for r in D.list_kbs(kbs, docs, 1).collect()] == [(9, 0), (8, 0), (7, 2)]
    sets = spark.createDataFrame([(1, [4, 2, 2, 77]), (2, []), (3, None), (4, [None, 1])], "k int, role_ids array<int>")
    got = {r["k"]: [x["role_id"] for x in r["roles"]] for r in A.roles_in(sets, A.role_table(spark)).collect()}
    assert got == {1: [2, 4], 2: [], 3: [], 4: [1]}


def test_a_card_without_a_day_before_has_no_change(spark):
    made = spark.createDataFrame([("2024-01-02",), ("2024-01-02",), (None,), ("2024-01-03",)], "create_time string")
    none = made.filter("create_time > '2025'")
    asked = spark.createDataFrame([("2024-01-02",)], "ts string")
    got = {r["key"]: (r["value"], r["delta"]) for r in J.dashboard_metrics(made, none, made.filter("create_time = '2024-01-02'"), asked, "2024-01-02").collect()}
    assert got == {"kb": (3, 200.0), "doc": (0, 0.0), "chunk": (2, 0.0), "qa": (1, 0.0)}


@pytest.mark.parametrize("phrase", K.INJECTION_PHRASES)
def test_unsafe_phrases(spark, phrase):
    df = spark.createDataFrame([("well, " + phrase.upper() + "!",), ("fine",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(codes.check_input(F.col("t"))).collect()] == [False, True, True, True]


def test_context_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 40), (1, 2, "b" * 400), (1, 3, "c" * 4)], "query_id int, rank int, text string")
    got = X.assemble_context(rows, 150).collect()
    assert [(r["context"], r["used_tokens"]) for r in got] == [("[1] " + "a" * 40 + "\n\n", 10)]


def test_citations_survive_bad_values(spark):
    rows = spark.createDataFrame([(1, 1, "t", "12", "x", "n/a")], "query_id int, rank int, text string, doc_id string, kb_id string, score string")
    c = X.assemble_context(rows).first()["citations"][0]
    assert (c["docId"], c["kbId"], c["score"]) == (12, None, None)
    df = spark.createDataFrame([(None,), ("",), ("[",), ("[]",)], "j string")
    assert [len(r[0]) for r in df.select(X.parse_citations(F.col("j"))).collect()] == [0, 0, 0, 0]


def test_reprocessing_to_nothing_and_clearing_leave_no_stale_chunks(spark, tmp_path):
    from passagery.plans import ingest
    from passagery.sources import sinks

    path = str(tmp_path / "chunks")
    docs = spark.createDataFrame([(1, 1, 1, "first text"), (2, 1, 2, "second text"), (3, 2, 3, "third")], "doc_id long, tenant_id int, kb_id int, text string")
    chunks = ingest.ingest(docs)[1]
    sinks.write_chunks(chunks.withColumn("text_hash", F.sha2("text", 256)), path)
    stored = lambda: sorted(r["kb_id"] for r in sinks.read_chunks(spark, path).collect())
    ingest.reprocess(docs.withColumn("text", F.when(F.col("kb_id") != 2, F.col("text"))), path, 1, 2)
    assert stored() == [1, 3]
    sinks.delete_stored(spark, path, F.col("doc_id") == 3)
    assert stored() == [1]


def stored(spark, root):
    docs = spark.range(60).selectExpr("id AS doc_id", "id % 4 AS kb_id", "id % 4 % 2 AS tenant_id").withColumn("kb_id", F.when(F.col("kb_id") != 3, F.col("kb_id")))
    chunks = docs.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("text"))
    snapshots.create(spark, root, {"chunks": chunks, "documents": docs, "log": docs.filter("false")})
    return lambda name, **k: sorted(r["doc_id"] for r in snapshots.read(spark, root, name, **k).collect())


def test_a_cascade_is_one_change(spark, tmp_path):
    root = str(tmp_path / "s")
    held = stored(spark, root)
    before = {r[3] for r in snapshots._listed(spark, root, None)}
    ids = spark.createDataFrame([(1,), (5,), (3,), (None,), (77,)], "doc_id long")
    assert snapshots.delete_documents(spark, root, ids) == 2
    assert held("documents") == [i for i in range(60) if i not in (1, 3, 5)] and len(held("chunks")) == 114 and held("log") == []
    assert held("documents", version=1) == list(range(60)) and held("documents", kb_ids=[1]) == [i for i in range(60) if i % 4 == 1 and i not in (1, 5)]
    kept = {r[3] for r in snapshots._listed(spark, root, None)} & before
    assert sum("kb_id=0" in f or "kb_id=2" in f for f in kept) == 4  # untouched bases keep their folders
    snapshots.delete_rows(spark, root, F.col("kb_id") == 2, ["chunks"])
    assert not [i for i in held("chunks") if i % 4 == 2] and [i for i in held("documents") if i % 4 == 2]
    assert snapshots.read(spark, root, "chunks", tenant_id=0).select("kb_id").distinct().count() == 1


@pytest.mark.parametrize("broken", ["_put", "_commit"])
def test_a_change_that_dies_midway_is_not_seen(spark, tmp_path, monkeypatch, broken):
    root = str(tmp_path / "s")
    held = stored(spark, root)
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    whole, calls = getattr(snapshots, broken), []

    def dies(*args):
        calls.append(1)
        if broken == "_commit":
            (tmp_path / "s" / "states" / "2").mkdir()  # a list whose job did not commit
            raise OSError("lost")
        if len(calls) > 1:
            raise OSError("lost")
        return whole(*args)

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, broken, dies)
        with pytest.raises(OSError):
            snapshots.delete_documents(spark, root, ids)
    assert held("documents") == list(range(60)) and len(held("chunks")) == 120 and snapshots.versions(spark, root) == [1]
    snapshots.delete_documents(spark, root, ids)
    assert len(held("documents")) == 58 and len(held("chunks")) == 116


def test_the_percentile_of_answer_times_is_exact(spark):
    times = F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("int"))
    rows = spark.range(200_000).select((F.col("id") % 2).alias("tenant"), times.alias("response_time"), F.lit(2).alias("token_count"))
    got = {r.tenant: r for r in J.answer_stats(rows, ["tenant"]).collect()}
    held = rows.collect()
    for tenant in (0, 1):
        known = sorted(r.response_time for r in held if r.tenant == tenant and r.response_time is not None)
        r = got[tenant]
        assert (r.n, r.tokens, r.max_response, r.p95_response) == (100_000, 200_000, known[-1], known[-(-95 * len(known) // 100) - 1])
        assert r.avg_response == pytest.approx(sum(known) / len(known), abs=1e-6)
    lone = spark.createDataFrame([(1, None, 3)], "tenant int, response_time int, token_count int")
    assert [tuple(r) for r in J.answer_stats(lone, ["tenant"]).collect()] == [(1, 1, None, None, None, 3)]


def test_written_files_share_folders_and_come_back_whole(spark, tmp_path):
    texts = [f"text {i}\n\n" for i in range(500)] + ["", None, "　 \n", "line\r\nnext"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").repartition(5)
    broken = spark.sql("SELECT CAST(concat('text', unhex('FF')) AS STRING) AS text")
    assert files.write_directory(rows.unionAll(broken), str(tmp_path / "files"), shelves=8) == 505
    assert len(list((tmp_path / "files").iterdir())) == 8
    back = files.read_directory(spark, str(tmp_path / "files" / "shelf=*"))
    got = [(r.text, r.message) for r in back.collect()]
    known = [(f"{x or ''}\n", None if x and x.strip() else "no text in file") for x in texts] + [(None, "no text in file")]
    assert sorted(got, key=str) == sorted(known, key=str)
    assert files.write_directory(rows.limit(0), str(tmp_path / "none")) == 0


def test_directory_ingest_counts_long_blank_and_missing_texts_as_its_sql_does(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from tests.compare import difference

    texts = ["x " * 200_000, "ß" * 150_000, "plain", " \n", "", None, "z" * ((1 << 18) - 1), "y" * (1 << 18)]
    rows = [(i, texts[i % len(texts)]) for i in range(110)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, con, "directory_ingest", entry.queries()["directory_ingest"], entry.oracle_sql()["directory_ingest"], str(tmp_path)) is None


def test_folders_are_listed_in_tasks_and_empty_or_unfinished_files_are_told_apart(spark, tmp_path):
    assert files.write_directory(spark.range(40).select(F.col("id").cast("string").alias("text")), f"file://{tmp_path}/a b", shelves=4) == 40
    (tmp_path / "a b" / "shelf=1" / "_0-1.7").write_text("cut")
    (tmp_path / "a b" / "shelf=1" / "empty.txt").touch()
    back = files.read_directory(spark, str(tmp_path / "a b" / "shelf=*"))
    assert back.inputFiles() == []  # the driver knows no file
    got = [(r.text, r.success, r.message) for r in back.collect()]
    assert sorted(got) == sorted([(f"{i}\n", True, None) for i in range(40)] + [("", False, "no text in file")])
    one = files.read_directory(spark, f"file:{tmp_path}/a b/shelf=1/empty.txt").select("file_name", "file_size").collect()
    assert [tuple(r) for r in one] == [("empty.txt", 0)]
    assert files.read_directory(spark, str(tmp_path / "none" / "shelf=*")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_directory(spark, str(tmp_path / "none"))
