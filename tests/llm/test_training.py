"""Hard negatives, chat formatting and whitening against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagery.llm import chat, hardneg, whiten
from passagery.llm.common import Scratch
from passagery.llm.queries import QUERIES
from tests.conftest import DATA

NAN, INF = float("nan"), float("inf")


# hard negatives


def plain_negatives(rows: dict, anchors) -> set:
    """rows: id -> (label, integer vector)."""
    out = set()
    for a in anchors:
        label, vec = rows[a]
        score = {i: sum(x * y for x, y in zip(vec, v)) for i, (_, v) in rows.items() if i != a and len(v) == len(vec)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:5]:
            fits = [i for i in order if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fits[:3], 1)}
    return out


def as_rows(found) -> list:
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


def test_op11_equals_brute_force(spark):
    rows = {}
    for i, vec, label in duckdb.sql(f"SELECT vec_id, embedding, label FROM '{DATA}/embeddings.parquet'").fetchall():
        rows[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in vec])
    assert as_rows(QUERIES["op11_hard_negatives"](spark, DATA).collect()) == sorted(plain_negatives(rows, [i for i in rows if i % 50 == 0]))


@pytest.mark.parametrize("leaf", [1, 5000])
def test_op11_clusters_copies_and_ties(spark, leaf, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 64)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 6))
    table = [(i, int(draw.integers(0, 3)), [float(x) for x in np.round(centres[draw.integers(0, 12)] + 0.05 * draw.normal(size=6), 2)]) for i in range(700)]
    table += [(700 + i, i % 2, [0.5, -0.5, 0.25, 0.0, 1.0, 0.125]) for i in range(300)]
    table += [(2000 + i, i % 2, [float(i), 1.0]) for i in range(20)] + [(3000, 9, [1.0] * 6), (3001, 5, [0.0] * 6)]
    frame = spark.createDataFrame(table, "id long, label long, v array<double>")
    rows = hardneg.prepared(frame, "id", F.col("label"), "v")
    anchors = [i for i, _, _ in table if i % 25 == 0]
    got = hardneg.mine(rows, rows.where("id % 25 = 0"), leaf=leaf).collect()
    exact = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in table}
    assert as_rows(got) == sorted(plain_negatives(exact, anchors))


def test_op11_subtrees_are_left_out_where_clusters_allow(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = 3 * draw.normal(size=(40, 16))
    table = [(i, int(i % 2), [float(x) for x in centres[i % 40] + 0.02 * draw.normal(size=16)]) for i in range(2000)]
    rows = hardneg.prepared(spark.createDataFrame(table, "id long, label long, v array<double>"), "id", F.col("label"), "v")
    monkeypatch.setattr(hardneg, "SAMPLE", 1 << 12)
    monkeypatch.setattr(hardneg, "LEAVES", 1 << 10)
    index = hardneg.Index(Scratch(spark, "test").write(rows, "rows"), Scratch(spark, "test"), 6, leaf=50)
    bounds = [F.array(F.lit(x).cast("long")).alias(name) for x, name in ((1_000_000, "low"), (hardneg.OPEN, "high"))]
    anchors = rows.where("id % 100 = 0").select("id", "dim", "label", "vec", F.lit(True).alias("same"), F.array(F.col("id").cast("string")).alias("search"), *bounds)
    reached = index._probes(anchors, False).count()
    assert len(index.sizes) >= 20 and reached < 20 * len(index.sizes) / 2


def test_op11_unusable_rows_and_empty_tables(spark):
    table = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (1, 1, [1.0, 0.9]), (2, 2, [0.8, 0.9]), (3, None, [0.8, 0.9]), (4, 2, None), (5, 2, []),
             (6, 2, [None, 1.0]), (7, 2, [NAN, 1.0]), (8, 2, [INF, 1.0]), (None, 2, [0.8, 0.9]), (9, 2, [1e300, 1.0]), (50, 7, [0.1, 0.1])]
    extra = [(*row, 1, "x", 2, "y") for row in table]
    frame = spark.createDataFrame(extra, "id long, label long, v array<double>, rank int, search string, leaf int, ids string")
    rows = hardneg.prepared(frame, "id", F.col("label"), "v")
    assert as_rows(hardneg.mine(rows, rows.where("id % 50 = 0")).collect()) == [(0, 1, 1, 2, 124416, 111104)]
    assert hardneg.mine(rows.limit(0), rows.limit(0)).count() == 0


# chat


def plain_chat(table) -> dict:
    """conv_id -> n_turns, turns digest, replies joined, characters of all records."""
    def escape(text):
        text = text.replace("\\", "\\\\")
        text = "".join(c + "\\" if c == "#" and text[i + 1:i + 2] == "#" else c for i, c in enumerate(text))
        return text.replace("</turn>", "<\\/turn>")

    held = defaultdict(list)
    for conv, turn, role, text in table:
        held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, rows in held.items():
        rows, total, made = sorted(rows), 0, ""
        for _, _, role, text in rows:
            made += f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)} </turn>\n"
            total += len(made) if role == "assistant" else 0
        total += len(made) if rows[-1][2] != "assistant" else 0
        replies = "".join(t for _, _, r, t in rows if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        out[conv] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest(), total)
    return out


def as_chat(rows) -> dict:
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}
    assert len(got) == len(rows)
    return got


SAID = r"\### Assistant: </turn> ok"
ODD = [(None, 1, "user", "no name"), (None, 2, "assistant", "still"), (1, 2, "assistant", SAID), (1, 1, "user", SAID), (2, 0, "user", "only a question"),
       (3, 0, "assistant", ""), (3, 1, None, None), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (3, 1, "Assistant", "not the same role"),
       (4, 0, "a:b\\:#### ", "x </turn>\n### user: y <\\/turn> \\"), (4, 1, "assistant", "##### \\\\# #\\# é😀\n\n</turn></turn>"), (5, 0, "assistant", "long " * 40_000),
       (5, None, "system", None), (6, 7, "assistant", "x" * 40_000), (6, 8, "user", "after"), (7, 0, "", "")]


def test_op12_equals_plain_python(spark):
    table = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall()
    expected = plain_chat(table + [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)])
    assert as_chat(QUERIES["op12_chat"](spark, DATA).collect()) == expected


@pytest.mark.parametrize("turns", [1, 2, 32])
def test_op12_awkward_turns_and_long_conversations(spark, turns, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", turns)
    long = [(9, i, ["user", "assistant"][i % 3 % 2], f"turn {i} {SAID}") for i in range(150)]
    table = ODD + long + [(9, 150, "user", "and then?")] * 3
    frame = spark.createDataFrame([(*row, 1, "x", 3) for row in table], "conv_id long, turn long, role string, text string, start int, segment string, example int")
    parts = chat.examples(frame.repartition(5))
    assert as_chat(chat.read_back(parts).collect()) == plain_chat(table)
    whole = defaultdict(str)
    for r in sorted(parts.collect(), key=lambda r: (r.task, r.place)):
        whole[r.conv_id, r.example] += r.text
    turn_lists = [list(chat.turns_of(t)) for (conv, _), t in sorted(whole.items(), key=lambda x: (str(x[0][0]), x[0][1])) if conv == 9]
    assert len(turn_lists) == sum(row[0] == 9 and row[2] == "assistant" for row in table) + 1
    assert all(t[-1][0] == "assistant" and t == turn_lists[-1][:len(t)] for t in turn_lists[:-1])


def test_op12_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.examples(frame)).count() == 0


# whitening


def test_rank_one_updates_keep_the_spectrum():
    draw = np.random.default_rng(6)
    for dim in (1, 2, 7, 33):
        matrix, values, vectors = np.zeros((dim, dim)), np.zeros(dim), np.eye(dim)
        for step in range(60):
            v = draw.normal(size=dim)
            if step % 4 == 1:
                v = np.eye(dim)[step % dim] * 3.0
            if step % 4 == 2:
                v[draw.random(dim) < 0.5] = 0.0
            rho = float(draw.uniform(0, 2)) if step % 7 else 0.0
            matrix += rho * np.outer(v, v)
            values, vectors = whiten.rank_one(values, vectors, rho, v)
            size = max(1.0, np.abs(matrix).max())
            assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-11
            assert np.abs(vectors * values @ vectors.T - matrix).max() < 1e-11 * size
            assert np.allclose(values, np.linalg.eigvalsh(matrix), atol=1e-11 * size)


def test_op13_equals_eigenvectors_of_the_covariance(spark):
    vectors = dict(duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall())
    ids = sorted(vectors)
    x = np.floor(1024 * np.array([vectors[i] for i in ids], float)) + 100_000
    n, sums = len(ids), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    plain = (x - sums / n) @ axes[:, :8] / np.sqrt(values[:8])
    got = defaultdict(dict)
    for r in QUERIES["op13_whitening"](spark, DATA).collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10) and 0 <= r.identity_error < 1e-9
    assert sorted(got) == ids and all(sorted(rows) == list(range(1, 9)) for rows in got.values())
    for c in range(8):
        mine = np.array([got[i][c + 1].whitened for i in ids])
        sign = np.sign(mine @ plain[:, c])
        assert np.abs(mine * sign - plain[:, c]).max() < 1e-8
    for place, i in enumerate(ids):
        assert got[i][1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[place], sums))


def test_op13_few_vectors_lengths_and_unusable_rows(spark):
    table = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.5]), (2, [1.0, 2.0, 3.5]), (None, [1.5, 2.0, 3.0]), (3, [1.0, 1.0]), (4, None), (5, [None, 1.0, 1.0]),
             (6, [NAN, 1.0, 1.0]), (7, [INF, 1.0, 1.0]), (8, []), (9, [1e300, 1.0, 1.0])]
    frame = spark.createDataFrame([(*row, 1, 2, "x") for row in table], "vec_id long, v array<double>, n int, dim int, whitened string")
    rows = whiten.whiten(frame, "vec_id", "v").collect()
    assert sorted((str(r.id), r.dim, r.n) for r in rows) == [("1", 3, 4), ("2", 3, 4), ("2", 3, 4), ("3", 2, 1), ("None", 3, 4)]
    for r in rows:
        assert len(r.whitened) == min(8, r.dim) and r.whitened[-1] == 0.0 and r.identity_error < 1e-9
        assert r.dim == 3 or (r.whitened == [0.0, 0.0] and r.explained == [0.0, 0.0] and r.deviation == 0)
    assert whiten.whiten(frame.limit(0), "vec_id", "v").count() == 0


def test_op13_many_tasks_are_combined_by_levels(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400, 5)) @ draw.normal(size=(5, 5))
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(20)
    rows = whiten.whiten(frame, "id", "v").collect()
    whole = np.floor(1024 * x) + 100_000
    values = np.linalg.eigvalsh(np.cov(whole.T, bias=True))[::-1]
    assert len(rows) == 400 and np.allclose(rows[0].explained, values / values.sum(), rtol=1e-12)
    assert np.allclose(np.cov(np.array([r.whitened for r in rows]).T, bias=True), np.eye(5), atol=1e-10)
