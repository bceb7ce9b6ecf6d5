"""Chunkers: hand-made cases for every branch, and random texts against plain models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from passagery.functions import text as T
from passagery.operators import chunking as C


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def pieces(df):
    out: dict[int, list[str]] = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    return out


def model_text(text, delimiter, limit, overlap):
    """Greedy packing of delimited parts, as a loop."""
    if len(text) <= limit:
        return [text] if text else []
    out, cur = [], ""
    for part in text.split(delimiter):
        joined = cur + delimiter + part if cur else part
        if len(joined) <= limit:
            cur = joined
            continue
        if cur:
            out.append(cur)
        cur = ""
        if len(part) > limit:
            start = 0
            while True:
                out.append(part[start : start + limit])
                if start + limit >= len(part):
                    break
                start += limit - overlap
        else:
            cur = part
    return out + [cur] if cur else out


def model_cut(text, limit):
    out, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            last = max((text.rfind(c, start, end) for c in "。！？；.!?;\n"), default=-1)
            if last >= start:
                end = last + 1
        piece = text[start:end].strip("".join(map(chr, range(33))))
        if piece:
            out.append(piece)
        start = end
    return out


@pytest.mark.parametrize("single_pass", [True, False])
def test_text_model_equals_loop_on_random_texts(spark, single_pass):
    rng = random.Random(3)
    alphabet = ["a", "b", "\n", "\n", "é", "知", " "]
    values = ["".join(rng.choices(alphabet, weights=[4, 4, 1, 1, 1, 1, 1], k=rng.randint(0, 90))) for _ in range(3000)]
    got = pieces(C.chunk_text_model(texts(spark, values), max_tokens=10, overlap=3, single_pass=single_pass))
    for i, value in enumerate(values):
        assert got.get(i, []) == model_text(value, "\n", 10, 3), repr(value)


@pytest.mark.parametrize("delimiter", [".", "*", "\n\n", "ab", "]"])
def test_delimiters_are_literal(spark, delimiter):
    rng = random.Random(5)
    values = ["".join(rng.choices(["a", "b", ".", "*", "\n", "]", "x"], k=rng.randint(0, 60))) for _ in range(800)]
    got = pieces(C.chunk_text_model(texts(spark, values), delimiter=delimiter, max_tokens=12, overlap=2))
    for i, value in enumerate(values):
        assert got.get(i, []) == model_text(value, delimiter, 12, 2), repr(value)


def test_exact_fit_and_one_more(spark):
    got = pieces(C.chunk_text_model(texts(spark, ["aaaa\nbbbbb\ncc", "aaaa\nbbbbbb\ncc", "a" * 10, "a" * 11]), max_tokens=10, overlap=2))
    assert got == {0: ["aaaa\nbbbbb", "cc"], 1: ["aaaa", "bbbbbb\ncc"], 2: ["a" * 10], 3: ["a" * 10, "aaa"]}


def test_compat_repeats_the_open_piece_and_loses_a_tail(spark):
    got = pieces(C.chunk_text_model(texts(spark, ["A\n" + "x" * 12 + "\nB"]), max_tokens=10, overlap=2, compat=True))
    assert got[0] == ["A", "x" * 10, "x" * 4, "A\nB"]
    lossy = pieces(C.chunk_text_model(texts(spark, ["abcdefghijklmnopqrst"]), max_tokens=10, overlap=3, compat=True))
    assert lossy[0] == ["abcdefghij", "hijklmnopq"]


def test_null_and_empty_texts_have_no_chunks(spark):
    assert pieces(C.chunk_text_model(texts(spark, [None, ""]))) == {}
    assert pieces(C.chunk_hierarchical(texts(spark, [None, "", " \n\t "]))) == {}


def test_oversized_cut_equals_loop_on_random_texts(spark):
    rng = random.Random(11)
    values = ["".join(rng.choices("ab .!\n。；", weights=[6, 6, 2, 1, 1, 1, 1, 1], k=rng.randint(1, 80))) for _ in range(4000)]
    rows = texts(spark, values).select("doc_id", T.split_oversized(F.col("text"), 9).alias("p")).collect()
    for r in rows:
        assert r["p"] == model_cut(values[r["doc_id"]], 9), repr(values[r["doc_id"]])


def test_paragraphs_break_at_blank_lines_and_headings(spark):
    text = "intro\r\nmore\r\n\r\n\r\n\r\n第一章 总则\n body \n一、 first\nline\n（二）x\n(三)y\n2. z\n \nlast\n1." + "t" * 60
    row = texts(spark, [text]).select(T.split_paragraphs(T.clean_text(F.col("text"))).alias("p")).first()
    assert row["p"] == ["intro\nmore", "第一章 总则\nbody", "一、 first\nline", "（二）x", "(三)y", "2. z", "last\n1." + "t" * 60]


def test_hierarchy_links_children_to_parents(spark):
    para = ["p%d " % i + "w" * 30 for i in range(8)] + ["long sentence. " * 12]
    df = C.chunk_hierarchical(texts(spark, ["\n\n".join(para)]), parent_max=100, child_max=40)
    rows = df.orderBy("chunk_index").collect()
    parents = {r["chunk_id"]: r for r in rows if r["chunk_type"] == "parent"}
    assert all(len(r["text"]) <= 100 for r in parents.values())
    kids = [r for r in rows if r["chunk_type"] == "child"]
    assert kids and all(len(k["text"]) <= 40 and k["text"].strip() in parents[k["parent_chunk_id"]]["text"] for k in kids)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    first_kid = [r for r in kids if r["parent_index"] == 0]
    assert [k["index_in_parent"] for k in first_kid] == list(range(len(first_kid)))


def test_small_parent_has_one_equal_child(spark):
    rows = C.chunk_hierarchical(texts(spark, ["short text"])).collect()
    assert [(r["chunk_type"], r["text"]) for r in rows] == [("parent", "short text"), ("child", "short text")]


def test_short_hash_and_tokens(spark):
    df = spark.createDataFrame([("hello 世界",), ("",), ("abcdefg",), (None,)], "t string")
    rows = df.select(T.java_string_hash(F.col("t")).alias("h"), T.estimate_tokens(F.col("t")).alias("n")).collect()
    assert [r["h"] for r in rows[:2]] == ["d0c9c004", "0"]
    assert [r["n"] for r in rows] == [3, 0, 1, 0]


def test_strategy_names(spark):
    from passagery.functions.codes import normalize_strategy

    names = [None, "", "hierarchical-model", " Hierarchical_Model ", "text-model", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(normalize_strategy(F.col("n"))).collect()]
    assert got == ["text_model", "text_model", "hierarchical_model", "hierarchical_model", "text_model", "text_model"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("x [[1, 2,3 ,4]]<|ref|>name<|/ref|><|det|>\n\n\n\nend ",)], "t string")
    assert df.select(T.clean_ocr_text(F.col("t"))).first()[0] == "x name\n\nend"
    names = spark.createDataFrame([("a.PDF",), (".env",), ("noext",), ("a.b.Md",), ("x.",), ("p.weird",)], "n string")
    got = names.select(T.content_type(F.col("n")), T.route_parser(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("pdf", "layout"), ("unknown", "text"), ("unknown", "text"), ("md", "text"), ("", "text"), ("weird", "text")
    ]
    page = spark.createDataFrame([("<head><title>t</title></head><p>a&#65;b&#x4e16;c &amp;lt; d<br>e<b>f</b></p><script>x</script>",)], "h string")
    assert page.select(T.html_to_text(F.col("h"))).first()[0] == "aAb世c &lt; d\nef"
    noise = spark.createDataFrame([("{}[] ,.",), ("答案是：D甲乙",), ("ab cd",), (None,)], "t string")
    assert [r[0] for r in noise.select(T.is_meaningful(F.col("t"))).collect()] == [False, True, False, False]
