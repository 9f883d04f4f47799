"""Long spans that stand word for word in more than one document: relative Lempel-Ziv factors.

The unit is the gram, a run of ``length`` characters: a shared span of n characters is
n - length + 1 shared grams in a row. A gram belongs to the reference block of the ``width``
characters in it whose hash is smallest, so equal grams are in one block wherever they stand. A document
is factored against every block that it has a stretch in (a stretch is a row of grams of one
block): from left to right, the longest row of grams that each stand in another document of the
block is a factor. As factors are made of whole grams, each is long enough to be a duplicate span, and
the factors of neighbouring blocks join at their boundaries. A factor keeps all documents that hold a
gram, not one source as in data compression, because every pair and every shared place is asked for.

Most blocks hold one document only: the first pass sends the block and the document alone, and
keeps the blocks with several. Only documents in these are read again, and the hashes of the grams
there are all that is compared, so what is moved follows the shared characters and not the pairs of
documents. Blocks of more than ``hot_rows`` stretches aren't gathered: their grams are counted as rows.

A stretch that repeats itself has few different grams; it is kept as one period and the number of
grams. Equal texts go through once. Null texts and texts shorter than ``length`` have no
spans. Offsets count code points. Grams are told apart by two hashes, of 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from provisio.llm.tokenize import texts_of
from provisio.llm.word_bytes import BASE, mix, powers
from provisio.runtime import broadcast_if_small, cut, over_salts, with_salt

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
SALTS = 8
#: Stretches of different blocks that are worked on together.
TOGETHER = 2_000
STRETCH = "_h long, _key long, _at int, _count int, _grams binary"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, the least of the ``width`` values from there on; ``len(h) - width + 1`` of them."""
    n = len(h)
    rows = -(-n // width)
    grid = np.full(rows * width, TOP, np.uint64)
    grid[:n] = h
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(texts: list[str], width: int, length: int, with_grams: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, first gram, number of grams, block) of the stretches of texts, each at least ``length`` long.

    If asked for, then the hashes of the runs of ``length`` characters of the joined texts.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.r_[0, ends[:-1]]
    n = len(chars)
    power, back = powers(BASE, n + 1), powers(pow(BASE, -1, 1 << 64), n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((chars + np.uint32(7)) * power[:n], out=total[1:])
    least = _least(mix((total[width:] - total[:-width]) * back[: n - width + 1]), length - width + 1)
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change[starts] = True
    first = np.flatnonzero(change)
    doc = np.searchsorted(ends, first, "right")
    count = np.minimum(np.r_[first[1:], len(least)], ends[doc] - length + 1) - first
    inside = count > 0  # the others run over the end of a text
    first, doc = first[inside], doc[inside]
    out = doc, first - starts[doc], count[inside], least[first]
    return (*out, mix((total[length:] - total[:-length]) * back[: n - length + 1])) if with_grams else out


def periods(grams: np.ndarray, most: int) -> list[tuple[int, int, np.ndarray]]:
    """(first gram, number of grams, grams kept) of a stretch; the part of a long one that repeats itself keeps one period."""
    n = len(grams)
    again = np.flatnonzero(grams[:-1] == grams[-1]) if n > most else []
    if not len(again):
        return [(0, n, grams)]
    step = n - 1 - int(again[-1])
    other = np.flatnonzero(grams[step:] != grams[:-step])
    s = int(other[-1]) + 1 if len(other) else 0
    if n - s <= 2 * step:
        return [(0, n, grams)]
    return ([(0, s, grams[:s])] if s else []) + [(s, n - s, grams[s : s + step])]


def factors(block: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first gram, number of grams) of the factors of the stretches against the others of their blocks."""
    row, kept, index = _indexed(block, grams)
    shared = np.zeros(len(index), bool)
    order = np.argsort(index)
    i, k = index[order], key[row][order]
    edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    several = np.minimum.reduceat(k, edge) != np.maximum.reduceat(k, edge)
    shared[order] = np.repeat(several, np.diff(np.r_[edge, len(i)]))
    return _rows_of(shared, kept, at, count)


def _indexed(block: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each gram, grams kept of each row, index of the gram in its block)."""
    kept = np.fromiter(map(len, grams), np.int64, len(grams))
    row = np.repeat(np.arange(len(block)), kept)
    return row, kept, mix(np.concatenate(grams) + mix(block.view(np.uint64))[row])


def _rows_of(shared: np.ndarray, kept: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of shared grams, periods written out."""
    ends = np.cumsum(kept)
    out: list[tuple[np.ndarray, ...]] = []
    plain = np.flatnonzero(kept == count)
    if len(plain):
        where = np.arange(kept[plain].sum()) + np.repeat((ends - kept)[plain] - (np.cumsum(kept[plain]) - kept[plain]), kept[plain])
        row = np.repeat(plain, kept[plain])
        gram = at[row] + where - (ends - kept)[row]
        row, gram = row[shared[where]], gram[shared[where]]
        out.append(_runs(row, gram))
    for r in np.flatnonzero(kept != count):
        own = np.resize(shared[ends[r] - kept[r] : ends[r]], count[r])
        gram = at[r] + np.flatnonzero(own)
        out.append(_runs(np.full(len(gram), r), gram))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _runs(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
    return row[first], gram[first], np.diff(np.r_[first, len(row)])


def partners(block: np.ndarray, key: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of keys that hold a gram in common, smaller key first; each set of keys is paired once."""
    row, _, index = _indexed(block, grams)
    order = np.lexsort((key[row], index))
    i, k = index[order], key[row][order]
    once = np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]
    i, k = i[once], k[once]
    edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[edge, len(i)])
    # sets told apart by their sums
    _, first = np.unique(np.add.reduceat(mix(k.view(np.uint64)), edge), return_index=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for e, n in zip(edge[first], size[first]):
        if n > 1:
            x, y = np.triu_indices(n, 1)
            a.append(k[e + x])
            b.append(k[e + y])
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pair[0], pair[1]


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    block, key, at, count = (table.column(c).to_numpy().astype(np.int64) for c in ("_h", "_key", "_at", "_count"))
    return block, key, at, count, [np.frombuffer(b, "<u8") for b in table.column("_grams").to_pylist()]


def _texts(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(_id, _t, _key, _key2) of the texts of at least ``length`` characters."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_id").isNotNull() & (F.length("_t") >= length))
    return keyed.withColumns({"_key": F.xxhash64("_t"), "_key2": F.xxhash64(F.lit(1), "_t")})


def block_stretches(keyed: DataFrame, length: int, width: int) -> DataFrame:
    """(_h, _key, _at, _count, _grams): the stretches of the blocks that several texts are in."""
    if not 1 <= width <= length:
        raise ValueError("width must be between 1 and length")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, texts, chars = [], [], 0
            for last, (k, t) in enumerate(zip(b.column(0).to_pylist(), texts_of(b.column(1))), 1 - b.num_rows):
                if k not in seen:  # copies in this task once
                    seen.add(k)
                    keys.append(k)
                    texts.append(t)
                    chars += len(t)
                if texts and (chars >= 2_000_000 or last == 0):
                    doc, _, _, block = stretches(texts, width, length)
                    yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(np.array(keys, np.int64)[doc])], names=["_h", "_key"])
                    keys, texts, chars = [], [], 0
            if len(seen) > 1_000_000:
                seen = set()

    prints = keyed.select("_key", "_t").mapInArrow(mark, "_h long, _key long")
    several = cut(prints.groupBy("_h").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b")).filter("_a != _b").select("_h"))
    small = broadcast_if_small(several, 2_000_000)
    found = prints.join(small, "_h", "left_semi") if small is not several else with_salt(prints, "_key", SALTS).join(over_salts(several, SALTS), ["_h", "_salt"], "left_semi").drop("_salt")
    found = cut(found.distinct())
    wanted = broadcast_if_small(found, 1_000_000)
    wanted = (F.broadcast if wanted is not found else lambda x: x)(found.groupBy("_key").agg(F.collect_list("_h").alias("_hs")))
    texts = keyed.select("_key", "_t").join(wanted, "_key").groupBy("_key").agg(F.first(F.struct("_hs", "_t")).alias("_x")).select("_key", "_x._hs", "_x._t")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, wanted, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2))):
                _, at, count, block, grams = stretches([text], width, length, with_grams=True)
                for i in np.flatnonzero(np.isin(block.view(np.int64), wanted)):
                    for a, n, kept in periods(grams[at[i] : at[i] + count[i]], length - width + 1):
                        out.append((int(block[i].view(np.int64)), key, int(at[i]) + a, n, kept.tobytes()))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in STRETCH.split(", ")])

    return texts.mapInArrow(cut_out, STRETCH)


def _hot(rows: DataFrame, hot_rows: int) -> tuple[GroupedData, DataFrame]:
    """The stretches of blocks up to ``hot_rows`` of them, some blocks together, and one row for each gram of the others."""
    many = cut(rows.groupBy("_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select("_h"))
    many = broadcast_if_small(many, 1_000_000)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                grams = np.frombuffer(b.column(4)[i].as_py(), "<i8")
                own = b.slice(i, 1).take(pa.array(np.zeros(len(grams), np.int64)))
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(np.full(len(grams), len(grams), np.int32)), pa.array(np.arange(len(grams), dtype=np.int32)), pa.array(grams)], names=["_h", "_key", "_at", "_count", "_kept", "_i", "_g"])

    parts = -(-rows.count() // TOGETHER) or 1
    cold = rows.join(many, "_h", "left_anti").groupBy(F.pmod("_h", F.lit(parts)).alias("_part"))
    return cold, rows.join(many, "_h", "left_semi").mapInArrow(spell, "_h long, _key long, _at int, _count int, _kept int, _i int, _g long")


def shared_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 250, width: int = 160, hot_rows: int = 20_000) -> DataFrame:
    """(key, start, end): the factors of each text, ``xxhash64`` of which is the key; they may overlap or touch."""
    rows = cut(block_stretches(_texts(docs, id_col, text_col, length), length, width))
    cold, grams = _hot(rows, hot_rows)
    span = "key long, start int, end int"

    def spans(key: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        return [pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(first + count - 1 + length, pa.int32())]

    def factor(table: pa.Table) -> pa.Table:
        block, key, at, count, held = _arrays(table)
        row, first, n = factors(block, key, at, count, held)
        return pa.Table.from_arrays(spans(key[row], first, n), names=["key", "start", "end"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, at, count, kept = (b.column(i).to_numpy().astype(np.int64) for i in range(4))
            shared = np.zeros(int(kept.sum()), bool)
            for begin, own in zip(np.cumsum(kept) - kept, b.column(4).to_pylist()):
                shared[begin + np.array(own, np.int64)] = True
            row, first, n = _rows_of(shared, kept, at, count)
            yield pa.RecordBatch.from_arrays(spans(key[row], first, n), names=["key", "start", "end"])

    several = grams.groupBy("_h", "_g").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b")).filter("_a != _b").select("_h", "_g")
    again = with_salt(grams, "_key", SALTS).join(over_salts(several, SALTS), ["_h", "_g", "_salt"], "left_semi")
    again = again.groupBy("_key", "_at", "_count", "_kept", "_h").agg(F.collect_set("_i").alias("_is")).drop("_h")
    return cold.applyInArrow(factor, span).unionByName(again.mapInArrow(join_up, span))


def sharing_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 250, width: int = 160, hot_rows: int = 2_000) -> DataFrame:
    """(id_a, id_b): every pair of different ids whose texts share a span, id_a < id_b.

    The texts of a block of more than ``hot_rows`` stretches are paired as rows.
    """
    keyed = _texts(docs, id_col, text_col, length)
    rows = cut(block_stretches(keyed, length, width))
    cold, grams = _hot(rows, hot_rows)

    def pair(table: pa.Table) -> pa.Table:
        block, key, _, _, held = _arrays(table)
        a, b = partners(block, key, held)
        return pa.table({"key_a": pa.array(a, pa.int64()), "key_b": pa.array(b, pa.int64())})

    each = grams.select("_h", "_g", "_key").distinct()
    hot = each.withColumnRenamed("_key", "key_a").join(each.withColumnRenamed("_key", "key_b"), ["_h", "_g"]).filter("key_a < key_b").select("key_a", "key_b")
    pairs = cut(cold.applyInArrow(pair, "key_a long, key_b long").unionByName(hot).distinct())
    ids = keyed.select("_key", "_key2", "_id")
    keys = cut(pairs.select(F.explode(F.array("key_a", "key_b")).alias("_key")).distinct())
    own = ids.join(broadcast_if_small(keys, 2_000_000), "_key", "left_semi").select("_key", "_id").distinct()
    linked = pairs.join(own.select(F.col("_key").alias("key_a"), F.col("_id").alias("_x")), "key_a").join(own.select(F.col("_key").alias("key_b"), F.col("_id").alias("_y")), "key_b")
    many = cut(ids.groupBy("_key", "_key2").agg(F.min("_id").alias("_i"), F.max("_id").alias("_j")).filter("_i != _j").select("_key", "_key2"))
    copied = ids.join(broadcast_if_small(many, 2_000_000), ["_key", "_key2"], "left_semi").distinct()
    copies = copied.withColumnRenamed("_id", "_x").join(copied.withColumnRenamed("_id", "_y"), ["_key", "_key2"]).filter("_x < _y")
    every = linked.select("_x", "_y").filter("_x != _y").unionByName(copies.select("_x", "_y"))
    return every.select(F.least("_x", "_y").alias(f"{id_col}_a"), F.greatest("_x", "_y").alias(f"{id_col}_b")).distinct()


def shared_shares(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 250, **how) -> DataFrame:
    """(id, n_chars, shared_chars, share): how much of each text of at least ``length`` characters stands elsewhere.

    A text with copies is shared whole. Factors are merged per text in order of their starts.
    """
    own = shared_spans(docs, id_col=id_col, text_col=text_col, length=length, **how)
    own = own.groupBy("key", "start").agg(F.max("end").alias("end"))  # at most one row for each place of a text
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = own.withColumn("_b", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = fresh.groupBy(F.col("key").alias("_key")).agg(F.sum(F.greatest(F.col("end") - F.col("_b"), F.lit(0))).alias("_c"))
    members = _texts(docs, id_col, text_col, length).select("_key", "_key2", "_id", F.length("_t").alias("n_chars")).distinct()
    copies = members.groupBy("_key", "_key2").agg(F.count("*").alias("_n"))
    out = members.join(copies, ["_key", "_key2"]).join(covered, "_key", "left")
    shared = F.when(F.col("_n") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("_c", F.lit(0).cast("long")))
    return out.select(F.col("_id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("share"))


def document_shares(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 250, **how) -> DataFrame:
    """``shared_shares`` with a row for every document.

    Texts shorter than ``length``, empty and null ones hold no span: ``shared_chars`` and ``share``
    are 0, and so is ``n_chars`` of a null text. Rows without an id are left out.
    """
    long = shared_shares(docs, id_col=id_col, text_col=text_col, length=length, **how)
    rest = docs.filter(F.col(id_col).isNotNull()).select(id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    rest = rest.filter(F.col("n_chars") < length).distinct()
    return long.unionByName(rest.select(id_col, "n_chars", F.lit(0).cast("long").alias("shared_chars"), F.lit(0.0).alias("share")))
