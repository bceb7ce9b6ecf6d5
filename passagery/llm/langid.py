"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes. Filters of several widths run over each window, the largest
response of each filter goes through a softmax layer, and a document's probabilities are the mean of its windows'
by their length. A filter over one-hot bytes is a sum of rows of a table, so no embedding is needed. The network is
trained in numpy on the driver with windows of a bounded sample; it is a few kilobytes wide and goes to the workers
with the task. Prediction covers every window of every text, in blocks of bounded size.

Null texts and texts without a letter are `und` with score 0. Without labelled rows every text is `und`. Repeated rows
are predicted each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 16, 256
BLOCK = 2048
SALTS = 64
UNKNOWN = "und"

#: byte -> symbol: A-Z as a-z, digits as 0, white space as a space; 0 fills short windows
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[9:14] = 32
FOLD[0] = 1


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a whole text, the last one filled up, and the number of bytes in each."""
    data = FOLD[np.frombuffer(text.encode(), np.uint8)]
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[:len(data)] = data
    sizes = np.full(n, LENGTH, np.float32)
    sizes[-1] = max(1, len(data) - (n - 1) * LENGTH)
    return out.reshape(n, LENGTH), sizes


@dataclass
class Network:
    """`tables[width]` is (width, 256, FILTERS); `dense` maps the pooled responses to languages."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> Network:
        draw, pooled = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        tables = {w: draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        dense = draw.normal(0, 0.1, (pooled, len(languages))).astype(np.float32)
        return cls(languages, tables, np.zeros(pooled, np.float32), dense, np.zeros(len(languages), np.float32))

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        table, n = self.tables[width], LENGTH - width + 1
        out = table[0].take(x[:, :n], axis=0)
        for k in range(1, width):
            out += table[k].take(x[:, k:k + n], axis=0)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.shift

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(x), BLOCK // 8):
            block = x[i:i + BLOCK // 8]
            pooled = np.concatenate([self.responses(block, w).max(axis=1) for w in WIDTHS], axis=1)
            parts.append(softmax(self.logits(pooled)))
        return np.concatenate(parts)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01, batch: int = 64) -> None:
        """Adam on the cross entropy; pooling sends a filter's gradient to the place of its largest response."""
        draw = np.random.default_rng(seed)
        weights = [*self.tables.values(), self.bias, self.dense, self.shift]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i:i + batch]
                xb, yb, rows = x[at], y[at], np.arange(len(at))
                places, pooled = [], []
                for w in WIDTHS:
                    out = self.responses(xb, w)
                    places.append(out.argmax(axis=1))
                    pooled.append(np.take_along_axis(out, places[-1][:, None], axis=1)[:, 0])
                hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
                error = softmax(hidden @ self.dense + self.shift)
                error[rows, yb] -= 1
                error /= len(at)
                back = (error @ self.dense.T) * (hidden > 0)
                grads = []
                for j, w in enumerate(WIDTHS):
                    grad = np.zeros_like(self.tables[w])
                    own = back[:, j * FILTERS:(j + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(grad[k], (xb[rows[:, None], places[j] + k], np.arange(FILTERS)[None]), own)
                    grads.append(grad)
                grads += [back.sum(0), hidden.T @ error, error.sum(0)]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(labelled: DataFrame, per_language: int, slices: int) -> DataFrame:
    """(lang, slice): `slices` places, evenly spread over the whole text, of `per_language` documents of each language.

    Ranks are taken on ids alone, first within salts of a language and then among the few that are left, so that no task
    sees a whole language; the texts of the chosen documents are read in a second, narrow pass.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    salted = labelled.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    few = salted.withColumn("rank", first).where(F.col("rank") <= per_language)
    ids = few.withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = sorted({r["doc_id"] for r in ids.select("doc_id").collect()})
    span = F.greatest(F.char_length("text") - LENGTH, F.lit(0))
    cut = [F.substring(F.col("text"), (span * k / max(1, slices - 1)).cast("int") + 1, F.lit(LENGTH)) for k in range(slices)]
    held = labelled.where(F.col("doc_id").isin(chosen)).select("doc_id", "lang", F.array_distinct(F.array(*cut)).alias("cuts"))
    return held.groupBy("doc_id", "lang").agg(F.min("cuts").alias("cuts")).orderBy("lang", "doc_id").select(
        "lang", F.explode("cuts").alias("slice"))


def fit(labelled: DataFrame, per_language: int = 400, slices: int = 4, epochs: int = 8, seed: int = 7) -> Network | None:
    """A network trained on at most `per_language` x `slices` windows of each language; None without usable rows.

    `labelled` is (doc_id, text, lang); rows without id, language or a letter are left out.
    """
    usable = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = sample(usable, per_language, slices).collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    network = Network.fresh(languages, seed)
    x = np.concatenate([windows(r["slice"])[0][:1] for r in rows])
    network.train(x, np.array([languages.index(r["lang"]) for r in rows]), epochs, seed)
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of each row, from its text alone."""
    small_batches(docs.sparkSession)

    def of_batch(texts: list[str | None]) -> tuple[list[str], list[float]]:
        usable = [i for i, t in enumerate(texts) if t and network and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            probs = network.predict(np.concatenate([x for _, x, _ in held]))
            sizes = np.concatenate([s for _, _, s in held])
            starts = np.cumsum([0, *[len(x) for _, x, _ in held[:-1]]])
            means = np.add.reduceat(probs * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
            for (i, _, _), best, p in zip(held, means.argmax(axis=1), means):
                names[i], scores[i] = network.languages[best], float(min(1.0, p[best]))
            held.clear()

        for i in usable:
            held.append((i, *windows(texts[i])))
            if sum(len(x) for _, x, _ in held[-1:]) >= BLOCK or len(held) >= 64:
                flush()
        flush()
        return names, scores

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names, scores = of_batch(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  names=["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """The part of the documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
