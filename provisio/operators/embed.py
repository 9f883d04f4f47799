"""Embedding of texts by a plug-in; the built-in one hashes words and needs no model."""

from __future__ import annotations

import re
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[a-z0-9]+")
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words in ``dim`` places; deterministic, needs no model.

    Words are runs of ASCII letters and digits. The first 32 bits of a word's MD5 give its place,
    the last of them the sign. Without any count left, the first place is 1. Not of unit length.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if word not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[word] = int.from_bytes(md5(word.encode(), usedforsecurity=False).digest()[:4])
        return self.known[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            h = np.array([self._hash(w) for w in WORD.findall(t.lower())], np.int64)
            np.add.at(out[i], h // 2 % self.dim, 1 - 2 * (h % 2))
        out[(out == 0).all(axis=1), 0] = 1
        return out


def embedded(rows: DataFrame, embedder: Embedder, *, text_col: str = "text", is_query: bool = False) -> DataFrame:
    """``rows`` with ``embedding``; queries get the instruction prefix, null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        prefix = QUERY_PREFIX if is_query else ""
        return pd.Series(list(embedder([prefix + (t or "") for t in texts])))

    return rows.withColumn("embedding", run(F.col(text_col)))
