"""Near-duplicate texts: an exact set-similarity join with adaptive multi-match prefixes.

A text is the set of its word shingles. Each set is dealt by hash into ``PARTS`` parts. If two
sets have a Jaccard similarity of t or more, so has at least one pair of their corresponding
parts, as the shared and all shingles of the parts sum up to those of the sets. So the join
runs part by part, and what any part finds is checked on the whole texts.

The shingles of a part are ordered from rare to frequent, by counts over all texts in a table of
fixed size: with very many texts, only those that stand out from the mean count as frequent. Of a part of k shingles that needs an overlap of o, a similar part holds one of the
first k - o + 1, and m of the first k - o + m. So a text goes to the cells of its first k - o + 1
shingles, the rare ones; a frequent one is hardly ever among them. For what it meets there it
picks its m from the estimated cost, the occurrences of its prefix's shingles in all texts: the
more there are, the longer the prefix and the more shared shingles it asks for. A cell is
(group, part, hash of the shingle). There are the more cells the more texts there are, and the
cells of a shingle more frequent than ``hot_rows`` are split into blocks of texts.

A text takes along one byte for each shingle of its part, from which parity and prefix bitmaps are
made. These bound the overlap from above, so they drop most of what is met, and no pair that is
similar. Parts of more than ``LONG`` shingles take along a bitmap of 256 bits instead; for texts of far
more than a thousand words it drops little, and more is left to the check of the texts.

Equal texts of one group go through once, whatever their number. Null texts, null groups and
texts with fewer words than a shingle take no part. Rows of one id count once for each
different text. Group values are compared without case and outer blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.llm.word_bytes import mix, word_hashes
from provisio.runtime import broadcast_if_small, cut

PART_BITS = 3
PARTS = 1 << PART_BITS
MOST_MATCHES = 4
#: Bits of a shingle by which it is counted.
TABLE_BITS = 17
#: Shingles of a part that take along one byte each.
LONG = 64
#: Bytes of a text's key within a cell; whole keys come back with the texts.
KEY_BYTES = 5
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each run of words, text of its first word, is it within that text)."""
    h, lengths = word_hashes(texts)
    n = max(0, len(h) - size + 1)
    own = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    acc = np.zeros(n, np.uint64)
    for j in range(size):
        acc = mix(acc * ODD[0] + h[j : j + n] * ODD[1] + ODD[2])
    return acc, own[:n], own[:n] == own[size - 1 :] if n else np.zeros(0, bool)


def shingle_slots(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index * PARTS + part, token), sorted, of the distinct word shingles of up to 2**20 texts.

    Shingles of one text are told apart by 44 bits; a token is 32 of these.
    """
    acc, own, whole = _shingles(texts, size)
    packed = own[whole] << np.uint64(44) | acc[whole] >> np.uint64(20)
    packed.sort()
    if len(packed):
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    return (packed >> np.uint64(44 - PART_BITS)).astype(np.int64), packed.astype(np.uint32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + count)."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _needed(sizes: np.ndarray, over: int, under: int) -> np.ndarray:
    """ceil(sizes * over / under)."""
    return -(-sizes * over // under)


def frequencies(texts: list[str], size: int) -> np.ndarray:
    """How many shingles of the texts fall on each place of the count table, by the first bits of their tokens."""
    acc, _, whole = _shingles(texts, size)
    at = acc[whole] >> np.uint64(52 - TABLE_BITS) & np.uint64((1 << TABLE_BITS) - 1)
    return np.bincount(at.astype(np.int64), minlength=1 << TABLE_BITS)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes of one, two or four each, as the largest asks for."""
    width = 1 if (top := int(values.max(initial=0))) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64) for b in column.to_pylist()])


def _parity(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """256-bit parities of runs of bytes, as four numbers each."""
    bit = np.uint64(1) << (bits & 63).astype(np.uint64)
    return np.stack([np.bitwise_xor.reduceat(np.where(bits >> 6 == w, bit, np.uint64(0)), starts) for w in range(4)], axis=1)


def route(key: np.ndarray, group: list, texts: list[str], size: int, num: int, den: int, often: np.ndarray, cells: int, hot_rows: int) -> Iterator[tuple]:
    """(group, part, cell, keys, sizes and matches, marks, entries of each, their places, their tokens) of each cell that these texts go to."""
    names = sorted(set(group))
    kind = np.array([names.index(g) for g in group], np.int64)
    slot, token = shingle_slots(texts, size)
    if not len(slot):
        return
    rank = np.empty(1 << TABLE_BITS, np.uint32)
    rank[np.argsort(often, kind="stable")] = np.arange(1 << TABLE_BITS, dtype=np.uint32)
    low = np.uint32(32 - TABLE_BITS)
    # numbered anew from rare to frequent
    both = np.sort(slot.astype(np.uint64) << np.uint64(32) | rank[token >> low] << low | token & np.uint32((1 << (32 - TABLE_BITS)) - 1))
    slot, token = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
    times = np.sort(often)[token >> low]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    count = np.diff(np.r_[first, len(slot)])
    doc, part = slot[first] // PARTS, slot[first] % PARTS
    spread = mix(token.astype(np.uint64))
    mark = spread.astype(np.uint8)
    enough = _needed(count, num, den)
    # the longer prefix that bounds the number of candidates best
    upto = np.r_[0, np.cumsum(times)]
    bound = np.full((MOST_MATCHES, len(first)), np.inf)
    for m in range(1, MOST_MATCHES + 1):
        met = upto[first + np.minimum(count, count - enough + m)] - upto[first]
        bound[m - 1] = np.where(m <= enough, met / m, np.inf)
    match = bound.argmin(axis=0) + 1
    # what a text takes along
    long = np.flatnonzero(count > LONG)
    width = np.where(count > LONG, 32, count)
    begin = np.cumsum(width) - width
    marks = np.empty(int(width.sum()), np.uint8)
    short = np.repeat(count <= LONG, count)
    marks[_ranges(begin[count <= LONG], count[count <= LONG])] = mark[short]
    if len(long):
        own = mark[~short]
        marks[_ranges(begin[long], width[long])] = _parity(own, np.cumsum(count[long]) - count[long]).view(np.uint8).ravel()
    # where it goes
    at = np.arange(len(slot)) - np.repeat(first, count)
    entry = np.flatnonzero(at < np.repeat(count - enough + 1, count))
    owner = np.repeat(np.arange(len(first)), count)[entry]
    cell = ((spread[entry] >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
    # what falls on every place of the table is no sign of a frequent shingle
    blocks = -(-(times[entry] - (int(often.sum()) >> TABLE_BITS)) // hot_rows)
    hot = np.flatnonzero(blocks > 1)
    if len(hot):  # once for each other block
        n = blocks[hot]
        copy = np.repeat(hot, n)
        other = _ranges(np.zeros(len(n), np.int64), n)
        mine = (mix(key[doc[owner[copy]]].astype(np.uint64)) % np.repeat(n, n).astype(np.uint64)).astype(np.int64)
        pair = (np.minimum(mine, other) * np.repeat(n, n) + np.maximum(mine, other)).astype(np.uint64)
        apart = cells + (mix(spread[entry[copy]] + mix(pair)) >> np.uint64(24)).astype(np.int64)
        cold = blocks <= 1
        entry, owner, cell = np.r_[entry[cold], entry[copy]], np.r_[owner[cold], owner[copy]], np.r_[cell[cold], apart]
    where = kind[doc[owner]] * PARTS + part[owner]
    if len(hot):
        order = np.lexsort((entry, cell, where))
    else:  # in one number
        bits = max(1, len(slot).bit_length())
        order = np.argsort((where * cells + cell) << bits | entry, kind="stable")
    entry, owner, cell, where = entry[order], owner[order], cell[order], where[order]
    new = np.r_[True, (cell[1:] != cell[:-1]) | (where[1:] != where[:-1])]
    head = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]])  # a text in a cell
    entries = np.diff(np.r_[head, len(entry)])
    cuts = np.flatnonzero(new[head])
    short_key = (key.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).copy()
    extra = (spread >> np.uint64(8)).astype("<u2")
    for a, b in zip(cuts, np.r_[cuts[1:], len(head)]):
        who = owner[head[a:b]]
        e = entry[head[a] : head[b - 1] + entries[b - 1]]
        w = int(where[head[a]])
        yield (
            names[w // PARTS], w % PARTS, int(cell[head[a]]), short_key[doc[who]].tobytes(), _pack(count[who] * MOST_MATCHES + match[who] - 1),
            marks[_ranges(begin[who], width[who])].tobytes(), _pack(entries[a:b]), _pack(at[e]), extra[e].tobytes(),
        )


CELL = "_g string, _part int, _cell long, _keys binary, _sizes binary, _marks binary, _counts binary, _places binary, _tokens binary"


def join_cell(table: pa.Table, num: int, den: int, most: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of short keys whose parts may have a Jaccard similarity of num/den or more, from the rows of a cell."""
    none = np.zeros(0, np.int64)
    raw = {c: b"".join(table.column(c).to_pylist()) for c in ("_keys", "_marks", "_tokens")}
    size, places, counts = _unpack(table.column("_sizes")), _unpack(table.column("_places")), _unpack(table.column("_counts"))
    match, size = size % MOST_MATCHES + 1, size // MOST_MATCHES
    n = len(size)
    key = np.zeros((n, 8), np.uint8)
    key[:, :KEY_BYTES] = np.frombuffer(raw["_keys"], np.uint8).reshape(n, KEY_BYTES)
    key = key.view("<i8").ravel()
    mark, token = np.frombuffer(raw["_marks"], np.uint8), np.frombuffer(raw["_tokens"], "<u2").astype(np.int64)
    long = size > LONG
    width = np.where(long, 32, size)
    starts = np.cumsum(width) - width
    parity = _parity(mark, starts)
    if long.any():
        parity[long] = mark[_ranges(starts[long], width[long])].copy().view("<u8").reshape(-1, 4)
    sketch = np.bitwise_xor.reduce(parity, axis=1)
    # copies of a text met in several tasks, then from small to large
    order = np.lexsort((sketch, key, size))
    once = np.r_[True, (key[order][1:] != key[order][:-1]) | (sketch[order][1:] != sketch[order][:-1]) | (size[order][1:] != size[order][:-1])]
    order = order[once]
    e_at, e_from = _ranges((np.cumsum(counts) - counts)[order], counts[order]), np.repeat(np.arange(len(order)), counts[order])
    key, size, match, parity, sketch, long = key[order], size[order], match[order], parity[order], sketch[order], long[order]
    starts, width, n = starts[order], width[order], len(order)
    token, place = token[e_at], places[e_at]
    as_small, as_large = _needed(size, 2 * num, num + den), _needed(size, num, den)
    low = max(1, n.bit_length())
    by_token = np.argsort(token << low | e_from, kind="stable")
    held = by_token[place[by_token] < (size - as_small + 1)[e_from[by_token]]]  # met by larger ones
    slot = token[held] << low | e_from[held]
    smallest = np.searchsorted(size, as_large)
    probe = token[by_token] << low | e_from[by_token]
    rest = size[e_from] - place  # shingles from here on, of which a partner must share enough
    who, x = by_token, e_from[by_token]
    largest = np.searchsorted(size, rest[by_token] * (num + den) // num - size[x], "right")
    lo, hi = (np.searchsorted(slot, probe - x + to) for to in (smallest[x], np.minimum(x, largest)))
    some = np.flatnonzero(hi > lo)
    who, lo, meets = who[some], lo[some], (hi - lo)[some]
    if not len(who):
        return none, none
    upto = np.cumsum(meets)
    y_of, x_of = e_from[held], e_from[who]
    near = sketch[y_of]
    rest_y = rest[held]
    most_apart = np.minimum(2 * size * (den - num) // (den + num), 255).astype(np.uint8)  # by a partner no larger
    # bitmaps of the prefixes in which a text needs so many shared shingles, and how many shingles these can't tell apart
    inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    bit = np.uint64(1) << (mark[_ranges(starts, width)] & 63).astype(np.uint64)
    first = np.cumsum(width) - width

    def prefix(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_or.reduceat(np.where(inner < np.repeat(reach, width), bit, np.uint64(0)), first)
        alike = np.minimum(reach, size) - np.bitwise_count(bits)
        return np.where(long, ~np.uint64(0), bits), np.where(long, 64, alike)

    as_x = prefix(size - as_large + match)
    as_y = [np.stack(v) for v in zip(*(prefix(size - as_small + m) for m in range(1, MOST_MATCHES + 1)))]
    found = [none]
    a = 0
    while a < len(who):  # blocks of entries that stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        m = meets[a:b]
        ends = np.cumsum(m)
        e = np.arange(ends[-1], dtype=np.int32) + np.repeat((lo[a:b] - (ends - m)).astype(np.int32), m)
        apart = np.bitwise_count(near[e] ^ np.repeat(sketch[x_of[a:b]], m))
        ok = np.flatnonzero(apart <= np.repeat(most_apart[x_of[a:b]], m))
        e, i = e[ok], np.searchsorted(ends, ok, "right") + a
        x, y = x_of[i], y_of[e]
        total = size[x] + size[y]
        # all shared shingles come after the first shared one
        ok = np.minimum(rest[who[i]], rest_y[e]) >= _needed(total, num, num + den)
        x, y, total = x[ok], y[ok], total[ok]
        ok = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64) <= total * (den - num) // (den + num)
        x, y = x[ok], y[ok]
        k = match[x] - 1
        ok = np.bitwise_count(as_x[0][x] & as_y[0][k, y]) + np.minimum(as_x[1][x], as_y[1][k, y]) > k
        found.append(np.unique(x[ok] << low | y[ok]))
        a = b
    pair = np.unique(np.concatenate(found))
    u, v = key[pair >> low], key[pair & ((1 << low) - 1)]
    return np.minimum(u, v), np.maximum(u, v)


def _keyed(docs: DataFrame, id_col: str, text_col: str, group_col: str | None) -> DataFrame:
    group = F.lower(F.trim(F.col(group_col))) if group_col else F.lit("")
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), group.alias("_g"))
        .filter("_id is not null and _t is not null and _g is not null")
        .withColumns({"_key": F.xxhash64("_g", "_t"), "_key2": F.xxhash64(F.lit(1), "_g", "_t")})
    )


def _buffers(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
    """(keys, groups, texts) of batches of (_g, _key, _t), about ``chars`` characters at a time; copies in this task once."""
    keys, groups, texts, held, seen = [], [], [], 0, set()
    for b in batches:
        for g, k, t in zip(*(c.to_pylist() for c in b.columns)):
            if k in seen:
                continue
            seen.add(k)
            keys.append(k)
            groups.append(g)
            texts.append(t)
            held += len(t)
            if held >= chars or len(texts) >= 1 << 20:
                yield np.array(keys, np.int64), groups, texts
                keys, groups, texts, held = [], [], [], 0
                if len(seen) > 1_000_000:
                    seen = set()
    if keys:
        yield np.array(keys, np.int64), groups, texts


def similar_texts(
    docs: DataFrame, *, id_col: str, text_col: str, group_col: str | None = None, shingle: int = 5, num: int = 4, den: int = 5,
    cell_rows: int = 2_000_000, least_cells: int = 3, hot_rows: int = 200_000, buffer_chars: int = 8_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, texts) of texts of one group whose shingle sets have a Jaccard similarity of num/den or more.

    pairs: (key_a, key_b, jaccard) of different texts, key_a < key_b. texts: (_g, _key, _key2, _id, _t),
    the rows that carry each text; copies share a key. There are so many cells for each part
    that one holds about ``cell_rows`` rare shingles of all groups, and ``least_cells`` at least.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col, group_col)
    source = keyed.select("_g", "_key", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TABLE_BITS, np.int64)
        for _, _, texts in _buffers(batches, buffer_chars):
            total += frequencies(texts, shingle)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["_at", "_n"])

    # a table of fixed size
    counted = source.mapInArrow(count, "_at int, _n long").groupBy("_at").agg(F.sum("_n").alias("_n")).toArrow()
    often = np.zeros(1 << TABLE_BITS, np.int64)
    often[counted.column("_at").to_numpy()] = counted.column("_n").to_numpy()
    rare = int(often.sum()) * (den - num) // den  # shingles in all prefixes
    cells = max(least_cells, -(-rare // (cell_rows * PARTS)))
    sent = spark.sparkContext.broadcast(often)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, groups, texts in _buffers(batches, buffer_chars):
            rows = list(route(keys, groups, texts, shingle, num, den, sent.value, cells, hot_rows))
            for a in range(0, len(rows), 1000):
                g, part, cell, *rest = zip(*rows[a : a + 1000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.string()), pa.array(part, pa.int32()), pa.array(cell, pa.int64()), *(pa.array(c, pa.binary()) for c in rest)],
                    names=[c.split()[0] for c in CELL.split(", ")],
                )

    def join(table: pa.Table) -> pa.Table:
        a, b = join_cell(table, num, den)
        return pa.table({"_a": pa.array(a, pa.int64()), "_b": pa.array(b, pa.int64())})

    found = source.mapInArrow(deal, CELL).groupBy("_g", "_part", "_cell").applyInArrow(join, "_a long, _b long")
    candidates = cut(found.distinct())

    short = F.col("_key").bitwiseAND(F.lit((1 << 8 * KEY_BYTES) - 1)).alias("_short")
    wanted = candidates.select(F.explode(F.array("_a", "_b")).alias("_short")).distinct()
    texts = keyed.select("_g", "_key", short, "_t").join(broadcast_if_small(cut(wanted), 2_000_000), "_short", "left_semi")
    texts = texts.groupBy("_key", "_short").agg(F.first(F.struct("_g", "_t")).alias("_t"))
    both = candidates.join(texts.select(F.col("_short").alias("_a"), F.col("_key").alias("key_a"), F.col("_t").alias("_ta")), "_a")
    both = both.join(texts.select(F.col("_short").alias("_b"), F.col("_key").alias("key_b"), F.col("_t").alias("_tb")), "_b")
    both = both.filter("_ta._g = _tb._g and key_a != key_b and (_a != _b or key_a < key_b)").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), F.col("_ta._t").alias("_ta"), F.col("_tb._t").alias("_tb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, value = [], []
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            number = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
            sets = whole_shingles(list(number), shingle)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = sets[number[x]], sets[number[y]]
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                union = len(both) - shared
                if union and shared * den >= num * union:
                    keep.append(i)
                    value.append(shared / union)
            sel = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(sel), b.column(1).take(sel), pa.array(value, pa.float64())], names=["key_a", "key_b", "jaccard"])

    pairs = both.mapInArrow(verify, "key_a long, key_b long, jaccard double")
    return pairs, keyed


def _has_shingle(text: Column, size: int) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) >= size


def whole_shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's shingles."""
    acc, own, whole = _shingles(texts, size)
    acc, own = acc[whole], own[whole]
    edge = np.searchsorted(own, np.arange(len(texts) + 1, dtype=np.uint64))
    return [np.unique(acc[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def near_duplicate_pairs(docs: DataFrame, *, id_col: str = "chunk_id", shingle: int = 5, **how) -> DataFrame:
    """(id_a, id_b): every pair of different ids with similar or equal texts, id_a < id_b."""
    pairs, keyed = similar_texts(docs, id_col=id_col, shingle=shingle, **how)
    pairs = cut(pairs)
    keys = pairs.select(F.explode(F.array("key_a", "key_b")).alias("_key")).distinct()
    ids = keyed.select("_key", "_id").join(broadcast_if_small(cut(keys), 2_000_000), "_key", "left_semi").distinct()
    a, b = f"{id_col}_a", f"{id_col}_b"
    linked = pairs.join(ids.select(F.col("_key").alias("key_a"), F.col("_id").alias("_x")), "key_a").join(ids.select(F.col("_key").alias("key_b"), F.col("_id").alias("_y")), "key_b").select("_x", "_y")
    many = cut(keyed.groupBy("_key", "_key2").agg(F.min("_id").alias("_i"), F.max("_id").alias("_j")).filter("_i != _j").select("_key", "_key2", "_j"))
    of_copy = F.when(F.col("_j").isNotNull(), _has_shingle(F.col("_t"), shingle))  # after the join
    copied = keyed.join(broadcast_if_small(many, 2_000_000), ["_key", "_key2"]).filter(of_copy).select("_key", "_key2", "_id").distinct()
    copies = copied.select("_key", "_key2", F.col("_id").alias("_x")).join(copied.select("_key", "_key2", F.col("_id").alias("_y")), ["_key", "_key2"]).filter("_x < _y").select("_x", "_y")
    every = linked.filter("_x != _y").unionByName(copies)
    return every.select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b)).distinct()


def near_duplicate_links(docs: DataFrame, *, id_col: str = "chunk_id", shingle: int = 5, **how) -> DataFrame:
    """(id, class_id, copies, links): one row for each document that takes part.

    ``class_id`` is the smallest id of its text, ``copies`` the number of ids with that text,
    ``links`` the number of other texts similar to it. Copies aren't expanded into pairs.
    """
    pairs, keyed = similar_texts(docs, id_col=id_col, shingle=shingle, **how)
    members = keyed.filter(_has_shingle(F.col("_t"), shingle)).select("_key", "_key2", "_id").distinct()
    links = pairs.select(F.explode(F.array("key_a", "key_b")).alias("_key")).groupBy("_key").agg(F.count("*").alias("links"))
    classes = members.groupBy("_key", "_key2").agg(F.min("_id").alias("class_id"), F.count("*").alias("copies")).join(links, "_key", "left")
    out = members.join(classes, ["_key", "_key2"])
    return out.select(F.col("_id").alias(id_col), "class_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
