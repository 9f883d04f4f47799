"""Held-out passages inside documents: q-gram filtering and banded alignment.

Documents and passages are compared as their words (longest runs of letters or digits, without
case) joined by single blanks. A passage of an item is any run of ``min_words`` of its words,
or all of them if it has fewer. A document leaks it if it holds the passage with at most
``max_edits`` character edits, at word borders.

By the q-gram lemma, an occurrence with e edits of a passage of n characters shares at least
n - q + 1 - q * e character q-grams with it, on diagonals (place in the document less place in
the item) that differ by at most e. So the q-grams of each document are looked up among those
of the items, the hits counted in overlapping bands of diagonals, and only bands that reach the
bound are aligned, on the diagonals of the band and e more. With ``max_edits=0`` these are the two
diagonals of a band, followed as far as they agree.

The items are a fixed evaluation set: their table is sent to all tasks after a check of its
size, and above ``most_item_chars`` it is taken in blocks, one pass over the documents each. Null
and empty texts hold nothing; null and wordless item fields give no passage. A pair comes out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm.tokenize import texts_of
from provisio.llm.word_bytes import MARK, plain, words_of

Q = 8
TABLE_BITS = 22
#: Pairs of texts and item texts whose hits are counted beforehand.
MOST_COUNTS = 10_000_000
#: Hits of q-grams that are held at a time; one text's may be more.
MOST_HITS = 300_000


class ItemIndex:
    """The q-grams of the item texts, and their passages with the places where these begin."""

    def __init__(self, texts: list[tuple[str, str]], min_words: int, max_edits: int):
        self.min_words, self.max_edits = min_words, max_edits
        self.items, self.bounds, self.passages, self.spans = [], [], [], []
        kept = bytearray()
        starts = [0]
        for item, text in texts:
            w = words_of(text)
            if not w:
                continue
            run = min(min_words, len(w))
            line = b" " + b" ".join(w) + b" "
            at, places = 1, []
            for x in w:
                places.append(at)
                at += len(x) + 1
            lengths = [places[i + run - 1] + len(w[i + run - 1]) - places[i] + 2 for i in range(len(w) - run + 1)]
            self.passages.append([(places[i] - 1, b" " + b" ".join(w[i : i + run]) + b" ") for i in range(len(w) - run + 1)])
            begin, size = np.array([p for p, _ in self.passages[-1]]), np.array([len(x) for _, x in self.passages[-1]])
            self.spans.append((begin, begin + size - Q + 1, size - Q + 1 - Q * max_edits))
            self.items.append(item)
            self.bounds.append(min(lengths) - Q + 1 - Q * max_edits)
            kept += line + bytes(Q)
            starts.append(len(kept))
        self.line_starts = np.array(starts, np.int64)
        grams = _grams(np.frombuffer(bytes(kept), np.uint8))
        at = np.arange(len(grams))
        line = np.searchsorted(self.line_starts, at, "right") - 1
        inside = at + Q <= self.line_starts[np.minimum(line + 1, len(starts) - 1)] - Q if len(starts) > 1 else np.zeros(0, bool)
        order = np.argsort(grams[inside], kind="stable")
        self.grams, self.line, self.place = grams[inside][order], line[inside][order], (at - self.line_starts[line])[inside][order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_bucket(self.grams)] = True
        self.bounds = np.array(self.bounds, np.int64)
        sure = self.bounds[self.bounds > 0]
        #: q-grams that the shortest passage has.
        self.least = int(sure.min()) + Q * max_edits if len(sure) else 1
        #: Passages too short, or edits too many, for any q-gram to be sure of: looked for directly.
        self.direct = [n for n in range(len(self.items)) if self.bounds[n] < 1]


def _grams(b: np.ndarray) -> np.ndarray:
    """The q-grams of bytes as 64-bit numbers."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, Q)).view(np.uint64)[:, 0]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _same(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many bytes from places i and j on are the same."""
    n, wide = min(len(a) - i, len(b) - j), 32
    done = 0
    while done < n:
        other = np.flatnonzero(a[i + done : i + min(n, done + wide)] != b[j + done : j + min(n, done + wide)])
        if len(other):
            return done + int(other[0])
        done, wide = done + wide, wide * 4
    return max(0, n)


def aligned(passage: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Is a stretch of the text, begun at one of the places from ``low`` to ``high``, at most ``edits`` edits from the passage?

    Only the diagonals from there to ``edits`` further on either side are filled, each with the
    farthest place of the passage that so many edits reach.
    """
    first, last = low - edits, high + edits
    reach = {}
    for e in range(edits + 1):
        new = {}
        for d in range(first, last + 1):
            at = 0 if low <= d <= high and d >= 0 else -1
            if e:  # a byte replaced, one more in the text, one less
                at = max(at, reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            if at < 0 or at + d < 0:
                continue
            at = min(at, len(passage), len(text) - d)
            if at < 0:
                continue
            new[d] = at + _same(passage, text, at, at + d)
            if new[d] >= len(passage):
                return True
        reach = new
    return False


def _anywhere(passage: bytes, text: bytes, edits: int) -> bool:
    """Is there a stretch of ``text`` at most ``edits`` edits from ``passage``? For passages too short for q-grams."""
    if not edits:
        return passage in text
    t = np.frombuffer(text, np.uint8)
    place = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return int(row.min()) <= edits


def _dense(known: np.ndarray, least: int, edits: int) -> np.ndarray:
    """Places of known q-grams in stretches that hold as many as the shortest passage must share.

    A stretch of any longer passage as long as the shortest one has no more edits, so the bound holds for all.
    """
    wide = least + edits
    if len(known) < wide:
        known = np.r_[known, np.zeros(wide - len(known), bool)]
    upto = np.zeros(len(known) + 1, np.int32)
    np.cumsum(known, out=upto[1:])
    enough = np.flatnonzero(upto[wide:] - upto[:-wide] >= least - Q * edits)
    if not len(enough):
        return enough
    # runs of stretches that overlap
    new = np.flatnonzero(np.r_[True, np.diff(enough) > wide])
    begin, end = enough[new], enough[np.r_[new[1:] - 1, len(enough) - 1]] + wide
    at = np.arange((end - begin).sum()) + np.repeat(begin - np.r_[0, np.cumsum(end - begin)[:-1]], end - begin)
    return at[known[at]]


def leaks(index: ItemIndex, texts: list[str]) -> list[tuple[int, int]]:
    """(text number, item text number) of every leak."""
    if not index.items:
        return []
    docs = plain(texts).split(MARK.encode())[: len(texts)]
    docs = [b" " + b" ".join(d.split()) + b" " for d in docs]
    out = {(i, n) for n in index.direct for i, d in enumerate(docs) if any(_anywhere(p, d, index.max_edits) for _, p in index.passages[n])}
    buffer = np.frombuffer(MARK.encode().join(docs), np.uint8)
    begins = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
    grams = _grams(buffer)
    at = _dense(index.table[_bucket(grams)], index.least, index.max_edits)
    found = grams[at]
    lo, hi = np.searchsorted(index.grams, found), np.searchsorted(index.grams, found, "right")
    doc = np.searchsorted(begins, at, "right") - 1
    upto = np.cumsum(hi - lo)
    a = 0
    while a < len(at):  # whole texts with about so many hits at a time
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MOST_HITS, "right"))
        b = max(int(np.searchsorted(doc, doc[min(b, len(at) - 1)])) if b < len(at) else b, int(np.searchsorted(doc, doc[a], "right")))
        _banded(index, docs, begins, at[a:b], lo[a:b], hi[a:b], doc[a:b], out)
        a = b
    return sorted(out)


def _banded(index: ItemIndex, docs: list[bytes], begins: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, out: set[tuple[int, int]]) -> None:
    """Add what the bands with enough hits hold to ``out``."""
    count = hi - lo
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return
    hit = np.arange(ends[-1]) + np.repeat(lo - (ends - count), count)
    of = np.repeat(np.arange(len(at)), count)
    line = index.line[hit]
    # an item text with too few hits in a text has too few in any band
    pair = ((doc - doc[0]) * len(index.items))[of] + line
    if (doc[-1] - doc[0] + 1) * len(index.items) < MOST_COUNTS:
        enough = np.flatnonzero(np.bincount(pair)[pair] >= index.bounds[line])
        if not len(enough):
            return
        hit, of, line, pair = hit[enough], of[enough], line[enough], pair[enough]
    at, doc, place = at[of], doc[of], index.place[hit]
    diagonal = at - place - begins[doc]
    half = index.max_edits + 1
    for shift in (0, half):  # bands of 2 * half diagonals, each overlapping the next by half
        band = (diagonal + shift) // (2 * half)
        order = np.lexsort((band, pair))  # the hits come in the order of the text
        d, n, b, a, p = doc[order], line[order], band[order], at[order], place[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (n[1:] != n[:-1]) | (b[1:] != b[:-1])])
        fresh = np.r_[True, a[1:] != a[:-1]] | np.r_[True, p[1:] != p[:-1]]  # a q-gram of the item counts once for each place in it
        size = np.add.reduceat(fresh.astype(np.int64), first)
        until = np.r_[first[1:], len(d)]
        enough = size >= index.bounds[n[first]]
        for f, z in zip(first[enough], until[enough]):
            who = (int(d[f]), int(n[f]))
            if who in out:
                continue
            held = np.unique(p[f:z])
            begin, end, bound = index.spans[who[1]]
            likely = np.flatnonzero(np.searchsorted(held, end) - np.searchsorted(held, begin) >= bound)
            low = int(b[f]) * 2 * half - shift - index.max_edits
            text = np.frombuffer(docs[who[0]], np.uint8)
            for s, x in (index.passages[who[1]][i] for i in likely):
                if aligned(np.frombuffer(x, np.uint8), text, low + s, low + s + 2 * (half + index.max_edits) - 1, index.max_edits):
                    out.add(who)
                    break


def _bounded(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most 1,000 texts and about ``chars`` characters."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars or i - a >= 999:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def leaked_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "id",
    item_texts: tuple[str, ...] = ("question", "reference_answer"), min_words: int = 12, max_edits: int = 0, most_item_chars: int = 20_000_000,
) -> DataFrame:
    """(doc id, item_id): the documents that hold a passage of an item, and which item."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    item_kind = dict(items.dtypes)[item_col]
    long = items.select(F.col(item_col).alias("i"), F.explode(F.array(*(F.col(c) for c in item_texts))).alias("t")).filter("i is not null and t is not null")
    chars = long.agg(F.sum(F.length("t"))).collect()[0][0] or 0
    blocks = max(1, -(-chars // most_item_chars))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter("_t is not null")
    out = None
    for block in range(blocks):
        part = long if blocks == 1 else long.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, min_words, max_edits)
            for b in batches:
                texts = texts_of(b.column(1))
                for a, z in _bounded(texts, 2_000_000):
                    piece = b.slice(a, z - a)
                    got = leaks(index, texts[a:z])
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array([d for d, _ in got], pa.int64())), pa.array([index.items[n] for _, n in got])] if got
                        else [piece.column(0).slice(0, 0), pa.array([], pa.string() if item_kind == "string" else pa.int64())], names=["_id", "item_id"]
                    )

        found = src.mapInArrow(run, f"_id {kind}, item_id {item_kind}")
        out = found if out is None else out.unionByName(found)
    return out.distinct().withColumnRenamed("_id", id_col)
