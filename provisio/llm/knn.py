"""The k most similar vectors of every vector: cells, four-bit codes, table scans and exact reranking.

A coarse spherical k-means, fitted on a bounded sample, gives the cells; with more vectors than it can
tell apart, each of its cells is divided by the nearest of further centroids of what is left, the same ones for all,
so that the number of cells follows the number of vectors. Every vector is stored in the cell nearest
to it and looked for in its nearest cells, the more of them the more cells there are (``probed``). What
is left of a vector after its cell's centre is product-quantised with 16 codewords in each
two-dimensional subspace (four bits). Codes and codebooks are fitted to the score-aware loss
``|e|^2 + (eta - 1) <e, x>^2``, which punishes the part of the error e along the vector x, as
that part is what changes the inner products that matter.

For a query, its inner products with all codewords are tables of 16 entries; those that a
member's codes point to add up to the estimated score. The best ``rerank`` members of each cell are
compared exactly, and the best ``k`` over all probed cells come out.

Cells that lie together are one region, the unit of the shuffle: a vector goes there once for all
its cells in it, and the best ``k`` of a region come back.

Vectors that are null, of another length, not finite or all zero take no part; of several rows
of one id the latest usable one counts. Of equal vectors, the ``k + 1`` smallest ids are
indexed and the others get their list from these, so copies are never compared with each
other. Large regions are split into blocks of members and of queries. Equal similarities are
ordered by id. A vector alone in its cells has fewer than ``k`` rows, or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.runtime import broadcast_if_small, cut, over_salts, with_salt

CODEWORDS = 16
SUB = 2
SALTS = 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float32).reshape(-1, dim)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, time_col: str | None, dim: int) -> DataFrame:
    """(_id, _v): unit vectors, the latest usable one of each id."""
    kind = dict(vectors.dtypes)[id_col]
    src = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<float>").alias("_v"), (F.col(time_col) if time_col else F.lit(0)).alias("_at"))
    src = src.filter(F.col("_id").isNotNull() & (F.size("_v") == dim) & ~F.exists("_v", lambda x: x.isNull()))
    at = dict(src.dtypes)["_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim).astype(np.float64)
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1)
                keep = np.isfinite(x).all(axis=1) & (top > 0)
                x = x[keep] / top[keep, None]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sel = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(sel), _lists(x.astype(np.float32), pa.float32()), b.column(2).take(sel)], names=["_id", "_v", "_at"])

    unit = src.mapInArrow(run, f"_id {kind}, _v array<float>, _at {at}")
    return unit.groupBy("_id").agg(F.max_by("_v", F.struct("_at", F.xxhash64("_v"))).alias("_v"))


def _kmeans(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator, unit: bool = True) -> np.ndarray:
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        half = 0 if unit else (c**2).sum(1) / 2
        who = np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)])
        count = np.bincount(who, minlength=n)
        order = np.argsort(who, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0)
        c[full] = sums
        empty = np.flatnonzero(count == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        else:
            c[full] /= count[full, None]
    return c


def _codes(x: np.ndarray, y: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 1) -> np.ndarray:
    """Codes of the residuals y of the vectors x by coordinate descent on the score-aware loss."""
    n, d = x.shape
    m = d // SUB
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)  # one row for each dimension
    codes = np.empty((m, n), dtype=np.uint8)
    along = np.empty((m, n), dtype=np.float32)
    rows = np.arange(n)

    def errors(s: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared errors, and errors along the vectors, of all codewords of subspace s."""
        e = [ys[s * SUB + t][:, None] - books[s][:, t][None] for t in range(SUB)]
        return sum(v * v for v in e), sum(v * xs[s * SUB + t][:, None] for t, v in enumerate(e))

    for s in range(m):
        square, par = errors(s)
        codes[s] = square.argmin(1)
        along[s] = par[rows, codes[s]]
    total = along.sum(0)
    for _ in range(sweeps):
        for s in range(m):
            square, par = errors(s)
            rest = total - along[s]
            codes[s] = (square + np.float32(eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
            along[s] = par[rows, codes[s]]
            total = rest + along[s]
    codes = np.ascontiguousarray(codes.T)
    return codes


class Cells:
    """Centres of the cells: every centroid plus every one of the further ones; cell number is centroid * further + number of the further one."""

    def __init__(self, sample: np.ndarray, total: int, cell_rows: int, region_rows: int, rng: np.random.Generator):
        wanted = max(1, total // cell_rows)
        self.coarse = _kmeans(sample, min(wanted, max(1, len(sample) // 8)), 12, rng).astype(np.float32)
        n = len(self.coarse)
        more = min(-(-wanted // n), max(1, len(sample) // 8))
        self.fine = np.zeros((1, sample.shape[1]), np.float32)
        if more > 1:
            left = sample - self.coarse[np.concatenate([(sample[i : i + 4096] @ self.coarse.T).argmax(1) for i in range(0, len(sample), 4096)])]
            self.fine = _kmeans(left, more, 12, rng, unit=False).astype(np.float32)
        self.half = (self.fine**2).sum(1) / 2 + self.coarse @ self.fine.T  # of the squared lengths, as far as they differ
        # regions: neighbouring centroids, or parts of one
        regions = -(-total // region_rows)
        if regions <= n:
            centre = _kmeans(self.coarse, max(1, regions), 12, rng)
            self.region = np.repeat((self.coarse @ centre.T).argmax(1), len(self.fine)).astype(np.int32)
        else:
            parts = min(-(-regions // n), len(self.fine))
            self.region = np.arange(n * len(self.fine), dtype=np.int32) // -(-len(self.fine) // parts)

    def __len__(self) -> int:
        return len(self.region)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each row, the nearest first."""
        score, f = x @ self.coarse.T, len(self.fine)
        if f > 1:  # all further ones of the nearest centroids
            some = min(len(self.coarse), -(-4 * probes // f) + 8)
            near = np.argpartition(-score, some - 1, axis=1)[:, :some]
            score = np.take_along_axis(score, near, 1)[:, :, None] + (x @ self.fine.T)[:, None] - self.half[near]
            cells = (near[:, :, None] * f + np.arange(f)).reshape(len(x), -1)
            score = score.reshape(len(x), -1)
        else:
            cells = np.broadcast_to(np.arange(len(self.coarse)), score.shape)
        best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1), 1)
        return np.take_along_axis(cells, best, 1)


def fit(sample: np.ndarray, total: int, cell_rows: int, region_rows: int, eta: float, seed: int = 7, book_rows: int = 6_000) -> tuple[Cells, np.ndarray]:
    """Cells from unit vectors, and codebooks from at most ``book_rows`` of them."""
    rng = np.random.default_rng(seed)
    cells = Cells(sample, total, cell_rows, region_rows, rng)
    sample = sample[rng.permutation(len(sample))[:book_rows]]
    y = sample - np.concatenate([cells.centre(cells.nearest(sample[i : i + 1024], 1)[:, 0]) for i in range(0, len(sample), 1024)])
    n, d = sample.shape
    m = d // SUB
    ys, xs = y.reshape(n, m, SUB), sample.reshape(n, m, SUB)
    books = np.stack([ys[rng.choice(n, CODEWORDS, replace=n < CODEWORDS), s] for s in range(m)]).astype(np.float32)
    for it in range(8):
        codes = _codes(sample, y, books, 1.0 if it < 3 else eta, sweeps=0 if it < 3 else 1)
        e = ys - np.stack([books[s][codes[:, s]] for s in range(m)], axis=1)
        along = (e * xs).sum(-1)
        total = along.sum(1)
        weight = 0.0 if it < 3 else eta - 1
        for s in range(m):  # least squares for each codeword, the other subspaces held fixed
            rest = total - along[:, s]
            outer = xs[:, s, :, None] * xs[:, s, None, :]
            right = ys[:, s] + weight * (rest + (ys[:, s] * xs[:, s]).sum(-1))[:, None] * xs[:, s]
            for c in range(CODEWORDS):
                own = codes[:, s] == c
                if own.any():
                    left = own.sum() * np.eye(SUB) + weight * outer[own].sum(0)
                    books[s, c] = np.linalg.solve(left, right[own].sum(0))
    return cells, books


def probed(cells: int, least: int) -> int:
    """Cells to look in: ``least``, or half of ``cells ** (2/3)`` if that is more, as a smaller cell holds less of a vector's surroundings."""
    return min(cells, max(least, round(cells ** (2 / 3) / 2)))


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated inner products of queries with what is left of members: for each subspace, the entries of a table of 16 that the codes point to."""
    n, m = len(q), len(books)
    table = np.matmul(books, q.reshape(n, m, SUB).transpose(1, 2, 0))  # subspace, codeword, query
    out, entries = np.zeros((len(codes), n), np.float32), np.empty((len(codes), n), np.float32)
    for s in range(m):
        out += np.take(table[s], codes[:, s], axis=0, out=entries, mode="clip")
    return out.T


def _top(q: np.ndarray, q_key: np.ndarray, m: np.ndarray, m_key: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int, least: float):
    """(query row, member row, similarity) of the exact best k among the ``rerank`` best by codes; members in the order of their keys."""
    out = []
    for i in range(0, len(q), 128):
        part = q[i : i + 128]
        r = min(rerank, len(m))
        if r < len(m):
            near = np.argpartition(-scan(part, codes, books), r - 1, axis=1)[:, :r]
            near.sort(axis=1)
        else:
            near = np.broadcast_to(np.arange(len(m)), (len(part), len(m)))
        exact = np.einsum("qd,qrd->qr", part, m[near])
        exact[m_key[near] == q_key[i : i + 128, None]] = -2
        best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        sim = np.take_along_axis(exact, best, 1)
        row, col = np.nonzero(sim >= max(least, -1.5))
        out.append((row + i, np.take_along_axis(near, best, 1)[row, col], sim[row, col]))
    return [np.concatenate(x) for x in zip(*out)]


def nearest(
    vectors: DataFrame, *, id_col: str, vec_col: str, time_col: str | None = None, dim: int = 64, k: int = 5, least: float = -1.0,
    probes: int = 16, rerank: int = 32, cell_rows: int = 400, region_rows: int = 8_192, sample_rows: int = 20_000, book_rows: int = 6_000, block_rows: int = 65_536, eta: float = 4.0,
) -> DataFrame:
    """(id, neighbour, similarity, place) for the ``k`` most similar others with a cosine of at least ``least``.

    The sample for fitting is the ``sample_rows`` vectors of smallest id hash, of which
    ``book_rows``, a few hundred for each codeword, serve for the codebooks; every vector is
    indexed and searched for. There is a cell for each ``cell_rows`` vectors and a region for each
    ``region_rows``; ``probes`` is the least number of cells that are looked in. A region of more
    members than twice ``region_rows``, or more queries than ``block_rows``, is worked on in blocks.
    """
    if dim % SUB:
        raise ValueError(f"dim must be a multiple of {SUB}")
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    same = [F.xxhash64("_v"), F.xxhash64(F.lit(1), "_v")]
    order = Window.partitionBy("_s1", "_s2").orderBy("_id")
    unit = usable_vectors(vectors, id_col, vec_col, time_col, dim).withColumns({"_s1": same[0], "_s2": same[1]})
    unit = cut(unit)
    kept = unit.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= k + 1)
    total = unit.count()
    rows = unit.select("_v", F.xxhash64("_id").alias("_o")).orderBy("_o").limit(sample_rows).select("_v").toArrow()
    sample = _matrix(rows.column(0).combine_chunks(), dim) if total else np.eye(1, dim, dtype=np.float32)
    cells, books = fit(sample, total, cell_rows, region_rows, eta, book_rows=book_rows)
    model = spark.sparkContext.broadcast((cells, books))
    probes = probed(len(cells), probes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, books = model.value
        for b in (whole.slice(a, 1024) for whole in batches for a in range(0, whole.num_rows, 1024)):
            x = _matrix(b.column(1), dim)
            near = cells.nearest(x, probes)
            codes = _codes(x, x - cells.centre(near[:, 0]), books, eta)
            packed = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
            packed = packed[:, 0::2] | packed[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(near[:, 0], pa.int32()), pa.array(cells.region[near[:, 0]]), _by_region(near, cells.region), pa.array([r.tobytes() for r in packed], pa.binary())],
                names=["_id", "_v", "_cell", "_region", "_near", "_code"],
            )

    shape = "_cell int, _region int, _near array<struct<r:int,c:array<int>>>, _code binary"
    placed = cut(kept.select("_id", "_v").mapInArrow(assign, f"_id {kind}, _v array<float>, {shape}"))
    # one row for each region
    asked = placed.select(F.explode("_near").alias("n"), "_region").groupBy(F.col("n.r").alias("_region")).agg(F.count("*").alias("_asked"))
    sizes = placed.groupBy("_region").agg(F.count("*").alias("_held")).join(asked, "_region", "left")
    blocks = sizes.select("_region", F.ceil(F.col("_held") / (2 * region_rows)).cast("int").alias("_mb"), F.ceil(F.coalesce("_asked", F.lit(1)) / block_rows).cast("int").alias("_qb"))
    blocks = broadcast_if_small(cut(blocks), 1_000_000)
    members = placed.join(blocks, "_region").withColumn("_m", F.pmod(F.xxhash64("_id"), "_mb")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_qb").cast("long") - 1)))
    queries = placed.select("_id", "_v", F.explode("_near").alias("_n")).select("_id", "_v", F.col("_n.r").alias("_region"), F.col("_n.c").alias("_cells")).join(blocks, "_region")
    queries = queries.withColumn("_q", F.pmod(F.xxhash64("_id"), "_qb")).withColumn("_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mb").cast("long") - 1)))
    both = members.select("_region", "_m", "_q", "_id", "_v", "_code", F.array("_cell").alias("_cells")).unionByName(queries.select("_region", "_m", "_q", "_id", "_v", F.lit(None).cast("binary").alias("_code"), "_cells"))

    def search(table: pa.Table) -> pa.Table:
        _, books = model.value
        table = table.combine_chunks()
        is_query = table.column("_code").is_null().to_numpy()
        order = np.argsort(table.column("_id").to_numpy(zero_copy_only=False).astype(object if kind == "string" else None), kind="stable")
        x = _matrix(table.column("_v").combine_chunks(), dim)
        names = ["_id", "_other", "_sim"]
        schema = pa.schema([("_id", table.schema.field("_id").type), ("_other", table.schema.field("_id").type), ("_sim", pa.float64())])
        if is_query.all() or not is_query.any():
            return schema.empty_table()
        key = np.empty(len(x), np.int64)
        key[order] = np.cumsum(np.r_[0, _differs(table.column("_id"), order)])
        # rows of each cell, members and queries apart, in the order of their ids
        lists = table.column("_cells").combine_chunks()
        row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        cell = lists.flatten().to_numpy()
        by_cell = np.lexsort((key[row], is_query[row], cell))
        row, cell = row[by_cell], cell[by_cell]
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        at = np.full(len(x), -1)
        at[~is_query] = np.arange(int((~is_query).sum()))
        code = np.frombuffer(b"".join(table.column("_code").drop_null().to_pylist()), np.uint8).reshape(int((~is_query).sum()), -1)
        code = np.stack([code & 15, code >> 4], axis=2).reshape(len(code), -1).astype(np.intp)
        found: list[tuple[np.ndarray, ...]] = []
        for rows in np.split(row, edge[1:]):
            n = int((~is_query[rows]).sum())
            mem, que = rows[:n], rows[n:]
            if n and len(que):
                q, m, sim = _top(x[que], key[que], x[mem], key[mem], code[at[mem]], books, k, rerank, least)
                found.append((que[q], mem[m], sim))
        if not found:
            return schema.empty_table()
        q, m, sim = (np.concatenate(v) for v in zip(*found))
        best = np.lexsort((key[m], -sim, q))
        q, m, sim = q[best], m[best], sim[best]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
        ids = table.column("_id")
        return pa.table([ids.take(pa.array(q[keep])), ids.take(pa.array(m[keep])), pa.array(sim[keep], pa.float64())], names=names).cast(schema)

    hits = both.groupBy("_region", "_m", "_q").applyInArrow(search, f"_id {kind}, _other {kind}, _sim double")
    best = Window.partitionBy("_id").orderBy(F.desc("_sim"), "_other")
    found = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    # further copies of a vector, those after the last one kept: their neighbours are its first ones
    full = kept.groupBy("_s1", "_s2").agg(F.max("_copy").alias("_most"), F.max("_id").alias("_last")).filter(F.col("_most") == k + 1)
    first = kept.filter(F.col("_copy") <= k).select("_s1", "_s2", F.col("_id").alias("_other"), F.col("_copy").alias("place"))
    lists = over_salts(full.join(first, ["_s1", "_s2"]).select("_s1", "_s2", "_last", "_other", "place"), SALTS)
    rest = with_salt(unit.select("_id", "_s1", "_s2"), "_id", SALTS).join(lists, ["_s1", "_s2", "_salt"]).filter(F.col("_id") > F.col("_last"))
    rest = rest.select("_id", "_other", F.lit(1.0).alias("_sim"), "place").filter(F.lit(1.0) >= least)
    out = found.select("_id", "_other", "_sim", "place").unionByName(rest)
    return out.select(F.col("_id").alias(id_col), F.col("_other").alias("neighbour"), F.col("_sim").alias("similarity"), "place")


def _by_region(near: np.ndarray, region: np.ndarray) -> pa.Array:
    """For each row the regions of its cells, and the cells of each."""
    n, p = near.shape
    of = region[near]
    order = np.argsort(of, axis=1, kind="stable")
    of, cell = np.take_along_axis(of, order, 1).ravel(), np.take_along_axis(near, order, 1).ravel()
    row = np.repeat(np.arange(n), p)
    head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (row[1:] != row[:-1])]) if n else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(cell)].astype(np.int32)), pa.array(cell.astype(np.int32)))
    parts = pa.StructArray.from_arrays([pa.array(of[head].astype(np.int32)), lists], names=["r", "c"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[head], minlength=n))].astype(np.int32)), parts)


def _differs(ids: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """For neighbours in ``order``: 1 where the id changes."""
    codes = ids.combine_chunks().dictionary_encode()
    codes = codes.indices if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices
    c = codes.to_numpy()[order]
    return (c[1:] != c[:-1]).astype(np.int64)


def similar_pairs(vectors: DataFrame, *, id_col: str = "chunk_id", least: float = 0.9, **how) -> DataFrame:
    """(id_a, id_b): pairs with a cosine of at least ``least``, one among the nearest of the other."""
    near = nearest(vectors, id_col=id_col, least=least, **how)
    return near.select(F.least(id_col, "neighbour").alias(f"{id_col}_a"), F.greatest(id_col, "neighbour").alias(f"{id_col}_b")).distinct()
