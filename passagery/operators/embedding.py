"""Embedding as an Arrow UDF with a pluggable model, and a deterministic built-in model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

WORD = re.compile(r"[^\W_]+")
DIM = 64
BATCH = 500


@lru_cache(maxsize=1 << 18)
def _slot(word: str) -> tuple[int, float]:
    digest = hashlib.md5(word.encode("utf-8")).hexdigest()
    return int(digest[:8], 16), 1.0 if int(digest[8], 16) < 8 else -1.0


def hashing_model(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of words, scaled to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        found = [WORD.findall(text.lower()) for text in texts]
        flat = list(chain.from_iterable(found))
        # each distinct word of the batch is hashed once, and all words are counted in one pass
        places = {word: i for i, word in enumerate(dict.fromkeys(flat))}
        slot, sign = np.array([_slot(word) for word in places] or np.empty((0, 2))).T
        word = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
        cell = np.repeat(np.arange(len(texts)) * dim, [len(words) for words in found]) + slot.astype(np.int64)[word] % dim
        out = np.bincount(cell, sign[word], len(texts) * dim).reshape(len(texts), dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1.0, norm)).astype(np.float32)

    return encode


def embed_column(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_model) -> Column:
    """Vector of a text; `load` runs once per task and returns a batch encoder. Null text has no vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            known = texts.notna().to_numpy()
            out = np.empty(len(texts), dtype=object)
            plain = texts[known].tolist()
            parts = [encode(plain[i : i + BATCH]) for i in range(0, len(plain), BATCH)]
            if parts:
                rows = np.concatenate(parts)
                for position, row in zip(np.flatnonzero(known), rows):
                    out[position] = row
            yield pd.Series(out)

    return vectors(text)


def embed(df: DataFrame, text_col: str = "text", load=hashing_model, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embed_column(F.col(text_col), load))
