"""Byte-pair encoding and decoding with the vocabulary of a tokenizer file.

The merges of a word are found with a segment tree over the ranks of its adjacent pairs: the root holds the lowest
rank, the walk to its leftmost leaf the place; a merge changes three leaves, each in logarithmic time, until no pair
can be merged. Words are cached up to a bound that does not depend on the corpus, and each text is encoded whole.

Null and empty texts have no tokens and decode to an empty text. Strings of special tokens in a text are those tokens.
Repeated rows are encoded each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

NO_RANK = 1 << 30
CACHED_WORDS, CACHED_CHARS = 300_000, 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, the others in order from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def merge_word(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The ids left when the leftmost lowest-rank merge has been applied until there is none. Changes `symbols`."""
    n, none = len(symbols), (NO_RANK, -1)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [NO_RANK] * size + [merges.get(pair, none)[0] for pair in zip(symbols, symbols[1:])]
    tree += [NO_RANK] * (2 * size - len(tree))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (lowest := tree[1]) != NO_RANK:
        i = 1
        while i < size:  # the left child first, so that the leftmost of equal ranks is met
            i = 2 * i if tree[2 * i] == lowest else 2 * i + 1
        i -= size
        j = after[i]
        symbols[i] = new = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k, h = after[j], before[i]
        after[i] = k
        changed = [(i, merges.get((new, symbols[k]), none)[0] if k < n else NO_RANK)]
        if k < n:
            before[k] = i
            changed.append((j, NO_RANK))
        if h >= 0:
            changed.append((h, merges.get((symbols[h], new), none)[0]))
        for leaf, rank in changed:
            at = leaf + size
            tree[at] = rank
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < rank:
                    rank = other
                if tree[at] == rank:
                    break
                tree[at] = rank
    return [s for s in symbols if s >= 0]


class Recent(dict):
    """`make(key)` for each key, kept in two generations of at most `most` entries; what is used moves to the newer."""

    def __init__(self, make: Callable[[str], list[int]], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> list[int]:
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Encoder and decoder of one file, with bounded caches for pieces and for what stands between white space."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        names = byte_symbols()
        self.inner, self.last = [vocab[s] for s in names], [vocab[s + suffix] for s in names]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.unspaced = regex.compile(r"[\x1C-\x1F]").search
        self.of_piece, self.of_chunk = Recent(self._merged, CACHED_WORDS), Recent(self._cut, CACHED_WORDS)

    def _merged(self, piece: str) -> list[int]:
        data = piece.encode()
        return merge_word([self.inner[b] for b in data[:-1]] + [self.last[data[-1]]], self.merges)

    def _cut(self, chunk: str) -> list[int]:
        return list(chain.from_iterable(map(self.of_piece.__getitem__, self.pieces(chunk))))

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return self._plain(text)
        ids: list[int] = []
        for part in self.parts(text):
            ids.extend([self.special[part]] if part in self.special else self._plain(part))
        return ids

    def _plain(self, text: str) -> list[int]:
        # each character is lower-cased by itself: a final capital sigma is an ordinary one
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.unspaced(text):  # str.split takes these separators for white space, the vocabulary does not
            return self._cut(text)
        return list(chain.from_iterable(map(self.of_chunk.__getitem__, text.split())))

    def decode(self, ids: Sequence[int]) -> str:
        """The file names no decoder: tokens as they are, parted by a space."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named by `carry`, then `ids` (array of int) and `decoded`, the text that the ids decode to.

    Workers read the vocabulary from `path`, which must be the same place on every machine.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    fields = docs.select(*carry).schema

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        vocab = vocabulary(path)
        for batch in batches:
            ids = [vocab.encode(t or "") for t in batch.column(len(carry)).to_pylist()]
            decoded = pa.array([vocab.decode(x) for x in ids], pa.string())
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
            yield pa.record_batch([*batch.columns[:len(carry)], pa.ListArray.from_arrays(offsets, pa.array(flat)), decoded],
                                  names=[*batch.schema.names[:len(carry)], "ids", "decoded"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, decoded string"
    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(run, out)
