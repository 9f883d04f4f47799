"""Encoding of whole tables of texts with a public byte-level BPE vocabulary.

A text is cut into chunks of ``chunk_chars`` characters that overlap; each chunk is pre-tokenised
on its own, and neighbours are stitched at the first place in the overlap where both have a
pre-token boundary after a character that isn't blank. Pre-tokens depend only on what follows
their start, so from such a place on both agree. The pieces between these places are encoded
and their ids put in order. Where two chunks never meet, the rest of the text is one piece.

The chunks of a text are worked on where the row lies. Those of a text of more than ``far_chars``
characters are dealt out to all tasks, and so are its pieces.

Null and empty texts give the empty list. Equal ids of different rows stay different rows; the
text decides nothing about the id. The vocabulary file is read by the driver and sent along.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pattern that splits a text into pre-tokens (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters at the end of a chunk whose boundaries may still change with what follows.
UNSURE = 8


@lru_cache(maxsize=4)
def encoding(data: bytes):
    """The encoder of a file of ranks; one for each Python process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.split(b"\n")))}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(column: pa.Array) -> list[str | None]:
    """Python strings of a column; bytes that aren't UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _encode(enc, texts: list[list[str]]) -> pa.Array:
    """The ids of each text, given as its pieces."""
    none = np.zeros(0, np.uint32)
    ids = [[enc.encode_to_numpy(t, disallowed_special=()) for t in pieces] for pieces in texts]
    ends = np.r_[0, np.cumsum([sum(map(len, x)) for x in ids])].astype(np.int32)
    flat = np.concatenate([none, *(x for row in ids for x in row)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(chunk: str, chunk_chars: int, overlap: int) -> tuple[list[int], list[int]]:
    """Pre-token boundaries that a chunk may be stitched at: in its first ``overlap`` characters, and in those after ``chunk_chars``."""
    sure = len(chunk) - UNSURE
    at = [p for p in (m.start() for m in _pattern().finditer(chunk)) if (0 < p < overlap or p >= chunk_chars) and p <= sure and not chunk[p - 1].isspace()]
    return [p for p in at if p < overlap], [p - chunk_chars for p in at if p >= chunk_chars]


def pieces(text: str | None, chunk_chars: int, overlap: int) -> list[str]:
    """The text as pieces that can be encoded on their own."""
    if not text:
        return []
    if len(text) <= chunk_chars:
        return [text]
    cuts, tail = [0], []
    for k, start in enumerate(range(0, len(text), chunk_chars)):
        head, next_tail = boundaries(text[start : start + chunk_chars + overlap], chunk_chars, overlap)
        if k:
            met = set(tail).intersection(head)
            if not met:  # nothing after is known to be in step
                break
            cuts.append(start + min(met))
        tail = next_tail
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def decode(enc_file: str, ids: list[int]) -> bytes:
    """The raw bytes that the ids stand for, joined."""
    with open(enc_file, "rb") as f:
        return encoding(f.read()).decode_bytes(ids)


def encode_texts(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 2_048, overlap: int = 256, far_chars: int = 1_000_000,
) -> DataFrame:
    """(id, ids): the token ids of each row's text."""
    kind = dict(docs.dtypes)[id_col]
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    is_long = F.coalesce(F.length("_t") > far_chars, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(data.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                cut_up = [pieces(t, chunk_chars, overlap) for t in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), _encode(enc, cut_up)], names=["_id", "ids"])

    near = src.filter(~is_long).mapInArrow(whole, f"_id {kind}, ids array<int>")

    # rows get a number, so that repeated ids stay apart
    long = src.filter(is_long).withColumn("_row", F.monotonically_increasing_id())
    chunks = long.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / chunk_chars).cast("int"))))
    chunks = chunks.select("_id", "_row", "_k", F.expr(f"substring(_t, _k * {chunk_chars} + 1, {chunk_chars + overlap})").alias("_c"))
    chunks = chunks.repartition("_row", "_k")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = zip(*(boundaries(t, chunk_chars, overlap) for t in texts_of(b.column(3)))) if b.num_rows else ((), ())
            kind_of = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind_of), pa.array(tails, kind_of)], names=["_id", "_row", "_k", "_c", "_head", "_tail"])

    cut = chunks.mapInArrow(mark, f"_id {kind}, _row long, _k int, _c string, _head array<int>, _tail array<int>")
    order = Window.partitionBy("_id", "_row").orderBy("_k")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("_k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("_tail").over(order), "_head")))
    cut = cut.withColumn("_start", start)
    # once two chunks don't meet, nothing after them is known to be in step
    cut = cut.withColumn("_start", F.when(F.max(F.col("_start").isNull()).over(so_far), F.lit(None).cast("int")).otherwise(F.col("_start")))
    cut = cut.withColumn("_piece", F.count("_start").over(so_far)).withColumn("_next", F.lead("_start").over(order))
    own = F.expr(f"substring(_c, coalesce(_start, 0) + 1, coalesce(_next, 0) + {chunk_chars} - coalesce(_start, 0))")
    stretches = cut.select("_id", "_row", "_piece", F.struct("_k", own.alias("t")).alias("_part"))
    stretches = stretches.groupBy("_id", "_row", "_piece").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    stretches = stretches.select("_id", "_row", "_piece", F.array_join(F.col("_parts.t"), "").alias("_t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _encode(enc, [[t] for t in texts_of(b.column(3))])], names=["_id", "_row", "_piece", "_ids"])

    coded = stretches.mapInArrow(encode, f"_id {kind}, _row long, _piece long, _ids array<int>")
    joined = coded.groupBy("_id", "_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_ids"))), lambda x: x["_ids"])).alias("ids"))
    return near.unionByName(joined.select("_id", "ids")).withColumnRenamed("_id", id_col)
