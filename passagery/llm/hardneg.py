"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Scores are inner products of integer vectors. One more coordinate, which lifts every vector to the length of the
longest and is zero for an anchor, makes distance fall exactly as the score rises, so that a window of scores is an
annulus around the anchor. Each split node of the tree deals the space to its nearest split point (multiway
hyperplanes); each split point holds the least and greatest distance to the rows below every sibling. A subtree is
left out where, for any split point, that range does not meet the distances which the annulus allows. What is left are
leaves, and they are scanned exactly, in integers.

A search takes two rounds: the anchor's own leaf gives a first answer, and its last score narrows the annulus with
which the other leaves are chosen. All windows of an anchor go with one copy of its vector. Small leaves that follow
each other in the tree are scanned as one bin. Nothing in the window can be lost, whatever the data: vectors without any clusters
only make more leaves pass.

Split points come from a bounded sample (`SAMPLE` rows and `SAMPLE_BYTES`), so the tree has at most about `LEAVES`
leaves and is sent to the tasks; ranges are taken from all rows. Equal rows of a label are one entry that names its
smallest ids, as many as any answer can need. A bin is cut into blocks and the anchors that reach it into slices of
`BLOCK`, so that a bin of any share of the rows meets any number of anchors in bounded tasks.

Rows with a null id, label or vector, an empty vector, any null or non-finite component, or one beyond `LARGEST` take
no part. Of rows under one id the one of the least label, then vector counts. Vectors of different length never meet.
Ties go to the smaller id. An anchor without rows of its label has no positives; one without rows in the window gives
none. Only id, label and vector are read, so that no further column can clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagery.session import ship_package

from .common import Scratch

SCALE, LARGEST = 256, 2.0**18
POSITIVES, NEGATIVES = 5, 3
FAN, LEAF, LEAVES, BLOCK = 12, 2048, 4096, 4096
SAMPLE, SAMPLE_BYTES = 64 * LEAVES, 1 << 28
OPEN = 1 << 62
WINDOW = ["search", "low", "high"]
ANCHOR = "id long, dim int, label long, vec array<long>, same boolean, search array<string>, low array<long>, high array<long>"


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows as doubles with the coordinate that makes all of them equally long."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])


def distances(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(1)[None] + (rows**2).sum(1)[:, None] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Node:
    """Split points, what lies below each (a node's number, or ~leaf), and distance ranges [point, sibling]."""

    points: np.ndarray
    below: list[int]
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.points)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)


class Tree:
    """The tree over rows of one dimension; `longest` is the greatest squared length of any row."""

    def __init__(self, sample: np.ndarray, longest: float, leaf: int):
        self.longest, self.nodes, self.paths = longest, [], []
        self.slack = 1e-6 * math.sqrt(longest) + 1e-6
        self.root = self._grow(lifted(sample, longest), [], leaf, np.random.default_rng(len(sample)))

    def _grow(self, rows: np.ndarray, path: list[tuple[int, int]], leaf: int, draw) -> int:
        points = self._spread(rows, draw) if len(rows) > leaf else rows[:0]
        if len(points) < 2:
            self.paths.append(path)
            return ~(len(self.paths) - 1)
        number, near = len(self.nodes), distances(points, rows).argmin(1)
        node = Node(points, [])
        self.nodes.append(node)
        for child in range(len(points)):
            node.below.append(self._grow(rows[near == child], [*path, (number, child)], leaf, draw))
        return number

    @staticmethod
    def _spread(rows: np.ndarray, draw) -> np.ndarray:
        """Split points far from each other, among a few candidates."""
        held = rows[draw.choice(len(rows), min(len(rows), 3 * FAN), replace=False)]
        chosen, apart = [0], distances(held[:1], held)[:, 0]
        while len(chosen) < FAN and apart.max() > 1e-3:
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, distances(held[chosen[-1:]], held)[:, 0])
        return held[chosen]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each lifted row."""
        out = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                out[at] = ~number
            elif len(at):
                near = distances(self.nodes[number].points, rows[at]).argmin(1)
                todo += [(below, at[near == child]) for child, below in enumerate(self.nodes[number].below)]
        return out

    def ranges(self, leaf: int, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child, least, greatest) distances of the split points on the way to a leaf to these rows of it."""
        for number, child in self.paths[leaf]:
            apart = distances(self.nodes[number].points, rows)
            yield number, child, apart.min(0), apart.max(0)

    def reached(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(places of anchors, leaf) for the leaves that may hold a row between the distances `near` and `far`."""
        todo = [(self.root, np.arange(len(anchors)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                yield at, ~number
                continue
            node, alive = self.nodes[number], []
            apart = distances(node.points, anchors[at])
            least = np.maximum(np.maximum(apart - far[at, None], near[at, None] - apart), 0) - self.slack
            most = apart + far[at, None] + self.slack
            for child, below in enumerate(node.below):
                met = ((node.low[:, child] <= most) & (node.high[:, child] >= least)).all(1)
                if met.any():
                    alive.append((below, at[met]))
            todo += alive


def prepared(table: DataFrame, id_column: str, label: Column, vector_column: str) -> DataFrame:
    """(id, dim, label, vec) of the rows that take part, components as integers."""
    vec = F.col(vector_column).cast("array<double>")
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = table.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec")).where(
        "id IS NOT NULL AND label IS NOT NULL AND size(vec) > 0").where(fine)
    whole = F.transform("vec", lambda c: F.floor(c * SCALE))
    return rows.groupBy("id").agg(F.min(F.struct("label", whole.alias("vec"))).alias("row")).select(
        "id", F.size("row.vec").alias("dim"), "row.label", "row.vec")


def entries(rows: DataFrame, most: int) -> DataFrame:
    """(rep, dim, label, vec, ids): rows of equal label and vector as one, with their `most` smallest ids."""
    place = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).groupBy("label", "vec").agg(
        F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).select(
        "rep", F.size("vec").alias("dim"), "label", "vec", "ids")


class Index:
    """Entries dealt to the leaves of one tree for each dimension."""

    def __init__(self, rows: DataFrame, scratch: Scratch, most: int, leaf: int = LEAF):
        self.spark, self.scratch = rows.sparkSession, scratch
        held = scratch.write(entries(rows, most), "entries")
        square = F.aggregate("vec", F.lit(0).cast("long"), lambda total, c: total + c * c)
        self.trees: dict[int, Tree] = {}
        for row in held.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect():
            most_rows = min(SAMPLE, SAMPLE_BYTES // (8 * row["dim"]))
            sample = held.where(F.col("dim") == row["dim"]).select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(most_rows).toPandas()
            share = len(sample) / row["n"]
            self.trees[row["dim"]] = Tree(np.stack(sample["vec"]), float(row["longest"]), max(SAMPLE // LEAVES, math.ceil(leaf * share)))
        self.rows = scratch.write(self._dealt(held), "dealt")
        self._range()
        self._pack(leaf)

    def _dealt(self, held: DataFrame) -> DataFrame:
        trees = self.trees

        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    tree = trees[int(dim)]
                    yield part.assign(leaf=tree.leaves(lifted(np.stack(part["vec"]), tree.longest)))

        return held.mapInPandas(run, "rep long, dim int, label long, vec array<long>, ids array<long>, leaf long")

    def _range(self) -> None:
        """Distance ranges of all rows, folded in the tasks; one row for each pair of siblings comes back."""
        trees = self.trees

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            seen: dict[tuple, tuple] = {}
            for batch in batches:
                for (dim, leaf), part in batch.groupby(["dim", "leaf"]):
                    tree = trees[int(dim)]
                    for number, child, low, high in tree.ranges(int(leaf), lifted(np.stack(part["vec"]), tree.longest)):
                        key = (int(dim), number, child)
                        before = seen.get(key, (low, high))
                        seen[key] = np.minimum(before[0], low), np.maximum(before[1], high)
            rows = [(*key, i, float(a), float(b)) for key, pair in seen.items() for i, (a, b) in enumerate(zip(*pair))]
            yield pd.DataFrame(rows, columns=["dim", "node", "child", "point", "low", "high"])

        found = self.rows.select("dim", "leaf", "vec").mapInPandas(run, "dim int, node int, child int, point int, low double, high double")
        for r in found.groupBy("dim", "node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
            node = self.trees[r["dim"]].nodes[r["node"]]
            node.low[r["point"], r["child"]], node.high[r["point"], r["child"]] = r["low"], r["high"]

    def _pack(self, most: int) -> None:
        """Leaves in order of the tree, put together while a bin holds no more than `most` rows."""
        held = {(r["dim"], r["leaf"]): r["count"] for r in self.rows.groupBy("dim", "leaf").count().collect()}
        self.sizes: dict[tuple[int, int], int] = {}
        self.bins: dict[int, np.ndarray] = {}
        for dim, tree in self.trees.items():
            bins, filled = np.zeros(len(tree.paths), np.int64), 0
            for leaf in range(len(bins)):
                size = held.get((dim, leaf), 0)
                bins[leaf] = bins[leaf - 1] + (filled > 0 and filled + size > most) if leaf else 0
                filled = size if leaf and bins[leaf] != bins[leaf - 1] else filled + size
                if size:
                    self.sizes[dim, int(bins[leaf])] = self.sizes.get((dim, int(bins[leaf])), 0) + size
            self.bins[dim] = bins

    def _probes(self, anchors: DataFrame, home: bool) -> DataFrame:
        """The anchors with each bin they have to scan: their own, or all others that some annulus of theirs reaches,
        with the windows that do."""
        trees, bins = self.trees, self.bins

        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    tree = trees.get(int(dim))
                    if tree is None:
                        continue
                    for i in range(0, len(part), 256):
                        rows = part.iloc[i:i + 256]
                        vec = np.stack(rows["vec"])
                        own = bins[int(dim)][tree.leaves(lifted(vec, tree.longest))]
                        if home:
                            yield rows.assign(bin=own)
                            continue
                        owner = np.repeat(np.arange(len(rows)), rows["search"].map(len))
                        search, low, high = (np.concatenate(rows[name].to_list()) for name in WINDOW)
                        points = np.column_stack([vec.astype(float), np.zeros(len(vec))])[owner]
                        size = (points**2).sum(1) + tree.longest
                        far, near = np.sqrt(np.maximum(size - 2.0 * low, 0)), np.sqrt(np.maximum(size - 2.0 * high, 0))
                        met = np.zeros((int(bins[int(dim)].max()) + 1, len(owner)), bool)
                        for at, leaf in tree.reached(points, near, far):
                            met[bins[int(dim)][leaf], at] = True
                        met[own[owner], np.arange(len(owner))] = False
                        for number in np.flatnonzero(met.any(1)):
                            at = np.flatnonzero(met[number])
                            held, starts = np.unique(owner[at], return_index=True)
                            yield rows.iloc[held].assign(bin=int(number), **{
                                name: np.split(column[at], starts[1:]) for name, column in zip(WINDOW, (search, low, high))})

        return anchors.mapInPandas(run, f"{ANCHOR}, bin long")

    def _scan(self, probes: DataFrame, k: int, name: str) -> DataFrame:
        """(search, ids, score) of the best entries of each bin, enough for `k` rows besides the anchor."""
        probes = self.scratch.write(probes, name)
        plan = probes.groupBy("dim", "bin").agg(F.count("*").alias("n")).collect()
        cuts = self.spark.createDataFrame(
            [(r["dim"], r["bin"], -(-self.sizes[r["dim"], r["bin"]] // BLOCK), -(-r["n"] // BLOCK))
             for r in plan if (r["dim"], r["bin"]) in self.sizes], "dim int, bin long, blocks int, parts int")
        places = self.spark.createDataFrame([(dim, leaf, int(number)) for dim, bins in self.bins.items() for leaf, number in enumerate(bins)],
                                            "dim int, leaf long, bin long")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        slot = lambda n, of: F.pmod(F.xxhash64(n), of).cast("int")
        keys = ["dim", "bin", "block", "part"]
        rows = self.rows.join(F.broadcast(places.join(cuts, ["dim", "bin"])), ["dim", "leaf"]).select(
            "dim", "bin", "rep", "label", "vec", "ids", slot("rep", "blocks").alias("block"), every("parts").alias("part"))
        asked = probes.join(F.broadcast(cuts), ["dim", "bin"]).select(
            "dim", "bin", "label", "vec", "same", *WINDOW, slot("id", "parts").alias("part"), every("blocks").alias("block"))

        def meet(key, held, asked):
            import pandas as pd

            if not len(held) or not len(asked):
                return pd.DataFrame({"search": [], "ids": [], "score": []})
            held = held.sort_values("rep", kind="stable")
            x, label = np.stack(held["vec"]), held["label"].to_numpy()
            named, at, scores = [], [], []
            for i in range(0, len(asked), 64):
                some = asked.iloc[i:i + 64]
                owner = np.repeat(np.arange(len(some)), some["search"].map(len))
                search, low, high = (np.concatenate(some[name].to_list()) for name in WINDOW)
                score = products(np.stack(some["vec"]), x)
                rival = (some["label"].to_numpy()[:, None] == label[None]) == some["same"].to_numpy()[:, None]
                score = score[owner]
                window, row = np.nonzero(rival[owner] & (score >= low[:, None]) & (score <= high[:, None]))
                score = score[window, row]
                order = np.lexsort((row, -score, window))
                window = window[order]
                first = np.arange(len(window)) - np.searchsorted(window, window) <= k
                named.append(search[window[first]])
                at.append(row[order[first]])
                scores.append(score[order[first]])
            return pd.DataFrame({"search": np.concatenate(named), "ids": held["ids"].to_numpy()[np.concatenate(at)], "score": np.concatenate(scores)})

        met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "search string, ids array<long>, score long")
        return self.scratch.write(met, f"{name}_met")

    def nearest(self, anchors: DataFrame, windows: DataFrame, k: int, name: str) -> DataFrame:
        """(search, id, score, rank): the first k rows of each window (search, id, low, high) of an anchor (id, dim, label,
        vec, same) with a score from `low` to `high`, of its own label or of others (`same`); its own id is left out.
        An anchor has a bounded number of windows."""
        best = Window.partitionBy("search").orderBy(F.desc("score"), "id")
        own = windows.select("search", F.col("id").alias("own"))

        def gathered(windows: DataFrame) -> DataFrame:
            lists = windows.groupBy("id").agg(F.collect_list(F.struct(*WINDOW)).alias("w"))
            return anchors.join(lists, "id").select("id", "dim", "label", "vec", "same", *[F.col("w")[name].alias(name) for name in WINDOW])

        def ranked(found: DataFrame) -> DataFrame:
            rows = found.select("search", "score", F.explode("ids").alias("id")).join(own, "search").where("id <> own")
            return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("search", "id", "score", "rank")

        home = self._scan(self._probes(gathered(windows), True), k, f"{name}_home")
        bound = ranked(home).where(F.col("rank") == k).select("search", F.col("score").alias("bound"))
        narrowed = windows.join(bound, "search", "left").select("search", "id", F.greatest("low", "bound").alias("low"), "high")
        rest = self._scan(self._probes(gathered(narrowed), False), k, f"{name}_rest")
        return self.scratch.write(ranked(home.unionAll(rest)), f"{name}_found")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles where they are exact."""
    if x.shape[1] * float(np.abs(x).max()) * float(np.abs(y).max()) < 2.0**53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x @ y.T


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = (50, 95), leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    For each anchor its best `positives` other rows of the same label, and for each of them the best `negatives` rows of
    other labels whose score is from window[0] to window[1] hundredths of the positive's. Both tables are as `prepared`
    gives them.
    """
    spark = ship_package(rows.sparkSession)
    scratch = Scratch(spark, "hardneg")
    index = Index(scratch.write(rows, "rows"), scratch, max(positives, negatives) + 1, leaf)
    asked = scratch.write(anchors.select("id", "dim", "label", "vec"), "anchors")
    name = F.col("id").cast("string").alias("search")
    whole = asked.select(name, "id", F.lit(-OPEN).alias("low"), F.lit(OPEN).alias("high"))
    near = index.nearest(asked.withColumn("same", F.lit(True)), whole, positives, "positive").select(
        F.col("search").cast("long").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("rank").alias("positive_rank"),
        F.col("score").alias("positive_score"), F.concat_ws(":", "search", "score").alias("search"))
    low, high = window
    windows = scratch.write(near.where("positive_score >= 0").select(
        "search", F.col("anchor_id").alias("id"), F.expr(f"({low} * positive_score + 99) div 100").alias("low"),
        F.expr(f"({high} * positive_score) div 100").alias("high")).distinct(), "windows")
    far = index.nearest(asked.withColumn("same", F.lit(False)), windows, negatives, "negative").select(
        "search", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, "search").select(
        "anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
