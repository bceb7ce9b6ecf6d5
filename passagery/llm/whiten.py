"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the spectrum of the scatter matrix of the rows it has read and takes every row in as a centred rank-one
update: the new eigenvalues are the roots of a secular equation, after entries without weight and entries of equal
eigenvalue are deflated; the new vectors follow from the roots. Spectra of tasks are combined in groups of `WAYS`, one
rank-one update for each eigenpair and one for the difference of the means, level by level until one is left. A last
distributed pass projects all centred rows on that basis; the eigenvectors of the projected covariance refine it
(Rayleigh-Ritz), so that the components are right to double precision whatever the updates have rounded.

What is held in a task or comes to the driver is a matrix of the dimension squared, at any number of rows. Equal rows
of a batch are one weighted update.

Vectors that are null, empty or hold null or non-finite entries, or entries beyond `LARGEST` in size, take no part.
Vectors of different length are whitened apart. A component without variance (fewer different vectors than dimensions,
or a single one) has the whitened value 0 and takes no part in `identity_error`. Rows repeated, or with a null id, are
rows like others. Ties of eigenvalues are broken in any way, the same for all rows. Only id and vector are read, so that
no further column can clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagery.session import ship_package

from .common import Scratch

COMPONENTS, WAYS = 8, 8
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**24
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(weights / (d - x)) = 0, rising `d` and positive weights of sum 1: the place of the nearer
    pole of each root and the distance from it. All roots are sought at once, each within its bracket."""
    n = len(d)
    at = np.arange(n)
    right = np.append(d[1:], d[-1] + rho)
    middle = (right - d) / 2
    gaps = d[None, :] - d[:, None]
    value = 1 / rho + (weights / (gaps - middle[:, None])).sum(1)
    origin = np.where((value < 0) & (at < n - 1), np.minimum(at + 1, n - 1), at)
    gaps = d[None, :] - d[origin][:, None]
    own, other = d - d[origin], right - d[origin]
    low = np.where(value < 0, own + middle, own)
    high = np.where(value < 0, other, own + middle)
    x = (low + high) / 2
    below = at[None, :] <= at[:, None]
    for _ in range(80):
        delta = gaps - x[:, None]
        term = weights / delta
        slope = term / delta
        value = 1 / rho + term.sum(1)
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        if (np.abs(value) <= 4 * n * EPS * (1 / rho + np.abs(term).sum(1))).all():
            break
        left = np.where(below, slope, 0).sum(1)
        rest = slope.sum(1) - left
        d1, d2 = own - x, other - x
        a = (d1 + d2) * value - d1 * d2 * (left + rest)
        b, c = d1 * d2 * value, value - d1 * left - d2 * rest
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        if (new == x).all():
            break
        x = new
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising spectrum of vectors * values * vectors' + rho * v * v'; rho is not negative."""
    z = vectors.T @ v
    size = float(z @ z)
    if rho * size <= 0:
        return values, vectors
    rho, z = rho * size, z / math.sqrt(size)
    tolerance = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    vectors = vectors.copy()
    cuts = np.flatnonzero(np.diff(values) > tolerance) + 1
    if len(cuts) + 1 < len(values):
        for start, stop in zip(np.append(0, cuts), np.append(cuts, len(values))):
            part = z[start:stop]
            norm = math.sqrt(part @ part)
            if stop - start > 1 and norm > 0:
                # one reflection leaves the weight of equal eigenvalues in the last of them
                mirror = part.copy()
                mirror[-1] += math.copysign(norm, part[-1])
                mirror /= math.sqrt(mirror @ mirror)
                sign = -math.copysign(1.0, part[-1])
                vectors[:, start:stop] -= 2 * np.outer(vectors[:, start:stop] @ mirror, mirror)
                z[start:stop] = 0
                z[stop - 1] = sign * norm
    active = np.flatnonzero(rho * np.abs(z) > tolerance)
    if not len(active):
        return values, vectors
    d, weights = values[active], z[active] ** 2
    origin, x = secular_roots(d, weights / weights.sum(), rho * weights.sum())
    delta = d[:, None] - d[origin][None, :] - x[None, :]
    # weights for which the roots are exact, so that the new vectors are orthogonal
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    ratio = -delta / np.where(apart == 0, EPS, -apart)
    np.fill_diagonal(ratio, -np.diag(delta))
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[active])
    turn = exact[:, None] / delta
    turn /= np.sqrt((turn * turn).sum(0))
    new = values.copy()
    new[active] = d[origin] + x
    vectors[:, active] = vectors[:, active] @ turn
    order = np.argsort(new, kind="stable")
    return new[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, exact sums, mean, and the spectrum of the scatter matrix of some rows."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, object), np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray, times: int) -> None:
        off, total = x - self.mean, self.n + times
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * times / total, off)
        self.mean = self.mean + off * (times / total)
        self.n, self.sums = total, self.sums + x.astype(object) * times

    def join(self, other: Spectrum) -> None:
        off, total = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / total, off)
        self.mean = self.mean + off * (other.n / total)
        self.n, self.sums = total, self.sums + other.sums

    def row(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean, "values": self.values,
                "vectors": self.vectors.ravel()}

    @classmethod
    def of(cls, row) -> Spectrum:
        dim = len(row["mean"])
        return cls(int(row["n"]), np.array([int(s) for s in row["sums"]], object), np.array(row["mean"]),
                   np.array(row["values"]), np.array(row["vectors"]).reshape(dim, dim))


SPECTRUM = "n long, sums array<string>, mean array<double>, values array<double>, vectors array<double>"


def integers(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, dim, x) of the rows that take part, x the vector as integers."""
    vec = F.col(vector_column).cast("array<double>")
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return table.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")).where("size(vec) > 0").where(fine).select(
        "id", F.size("vec").alias("dim"), F.transform("vec", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def folded(rows: DataFrame, schema: str, merge: Callable) -> DataFrame:
    """One row for each dimension: rows of (dim, slot, ...) merged `WAYS` at a time."""
    import pandas as pd

    def step(key, held: pd.DataFrame) -> pd.DataFrame:
        row = merge(held.sort_values("slot").to_dict("records"))
        return pd.DataFrame([{"dim": int(key[0]), "slot": int(key[1]), **row}])

    top = rows.agg(F.max("slot")).first()[0] or 0
    while True:
        top //= WAYS
        rows = rows.select("dim", F.expr(f"slot div {WAYS}").alias("slot"), *[c for c in rows.columns if c not in ("dim", "slot")]).groupBy(
            "dim", "slot").applyInPandas(step, f"dim int, slot long, {schema}")
        if not top:
            return rows


def spectra(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One spectrum for each dimension."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held: dict[int, Spectrum] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                state = held.setdefault(int(dim), Spectrum.none(int(dim)))
                for x, times in zip(*np.unique(np.stack(part["x"]), axis=0, return_counts=True)):
                    state.add(x, int(times))
        if held:
            yield pd.DataFrame([{"dim": dim, "slot": TaskContext.get().partitionId(), **s.row()} for dim, s in held.items()])

    def merge(parts: list[dict]) -> dict:
        first, *others = map(Spectrum.of, parts)
        for other in others:
            first.join(other)
        return first.row()

    schema = f"dim int, slot long, {SPECTRUM}"
    return folded(scratch.write(rows.select("dim", "x").mapInPandas(run, schema), "spectra"), SPECTRUM, merge)


@dataclass
class Whitening:
    """Number, sums, eigenvalues (falling) and components (columns) of one dimension."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def used(self, count: int) -> list[bool]:
        """For the first components whether they have variance beyond rounding."""
        return [bool(e > len(self.values) * EPS * 64 * self.values[0]) for e in self.values[:count]]


def fit(rows: DataFrame, scratch: Scratch) -> dict[int, Whitening]:
    """The whitening of each dimension of the rows of (dim, x)."""
    found = {r["dim"]: Spectrum.of(r) for r in spectra(rows, scratch).collect()}
    bases = {dim: Whitening(s.n, list(s.sums), s.values[::-1], np.linalg.qr(s.vectors[:, ::-1])[0]) for dim, s in found.items()}

    def project(batches: Iterator) -> Iterator:
        import pandas as pd

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                basis = bases[int(dim)]
                y = (np.stack(part["x"]) - basis.mean) @ basis.components
                held[int(dim)] = held.get(int(dim), 0) + y.T @ y
        if held:
            yield pd.DataFrame([{"dim": dim, "slot": TaskContext.get().partitionId(), "products": p.ravel()} for dim, p in held.items()])

    def merge(parts: list[dict]) -> dict:
        return {"products": np.sum([p["products"] for p in parts], axis=0)}

    products = scratch.write(rows.select("dim", "x").mapInPandas(project, "dim int, slot long, products array<double>"), "products")
    for row in folded(products, "products array<double>", merge).collect():
        basis = bases[row["dim"]]
        values, turn = np.linalg.eigh(np.array(row["products"]).reshape(row["dim"], row["dim"]) / basis.n)
        basis.values, basis.components = np.maximum(values[::-1], 0), basis.components @ turn[:, ::-1]
    return bases


def whiten(table: DataFrame, id_column: str, vector_column: str, components: int = COMPONENTS) -> DataFrame:
    """(id, dim, n, deviation decimal(38,0), whitened array, explained array, identity_error) of each row that takes
    part; the arrays hold the first `components`, or all where the dimension is less."""
    spark = ship_package(table.sparkSession)
    scratch = Scratch(spark, "whiten")
    rows = integers(table, id_column, vector_column)
    fits = fit(rows, scratch)

    def apply(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for dim, part in batch.groupby("dim"):
                one = fits[int(dim)]
                used = np.array(one.used(components))
                scale = np.where(used, 1 / np.sqrt(np.where(used, one.values[:components], 1.0)), 0.0)
                y = (np.stack(part["x"]) - one.mean) @ one.components[:, :components] * scale
                yield pd.DataFrame({"id": part["id"], "dim": part["dim"], "x": part["x"], "whitened": list(y)})

    turned = scratch.write(rows.mapInPandas(apply, "id long, dim int, x array<long>, whitened array<double>"), "turned")
    facts = []
    for dim, one in fits.items():
        used = [i for i, fine in enumerate(one.used(components)) if fine]
        w = lambda i: F.col("whitened")[i]
        off = [F.abs(F.covar_pop(w(i), w(j)) - (1 if i == j else 0)) for i in used for j in used if i <= j]
        error = turned.where(F.col("dim") == dim).agg(F.greatest(*off, F.lit(0.0), F.lit(0.0))).first()[0] if off else 0.0
        total = float(one.values.sum())
        facts.append((dim, one.n, one.sums, [float(e / total) if total else 0.0 for e in one.values[:components]], error))
    known = spark.createDataFrame(facts, "dim int, n long, sums array<long>, explained array<double>, identity_error double")
    wide = "decimal(38,0)"
    off = F.zip_with("x", "sums", lambda x, s: x.cast("decimal(18,0)") * F.col("n").cast("decimal(19,0)") - s)
    deviation = F.aggregate(off, F.lit(0).cast(wide), lambda total, o: (total + (o.cast("decimal(19,0)") * o.cast("decimal(19,0)"))).cast(wide))
    return turned.join(F.broadcast(known), "dim").select(
        "id", "dim", "n", deviation.alias("deviation"), "whitened", "explained", "identity_error")
