"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

The least Euclidean distance is the largest q.x - |x|^2 / 2, with both centred on a sample's medians and scaled by
a power of two to about unit length, so that neither large nor small vectors leave the range of the tables. The
norm is kept exactly; x is quantised in subspaces of two dimensions with 16 centroids each (four bits).
Codebooks and codes minimise a loss that weighs the residual parallel to x by `eta` times its
orthogonal part, since that part changes the inner products of near queries most: codes by coordinate
descent over the subspaces, centroids by the normal equations of the weighted loss. They are fitted on
a bounded sample (`SAMPLE` vectors, drawn by a hash, long ones shortened); every row is encoded and scanned. Rows
too far out for the tables (`FAR`) are bounded by the product of the lengths instead, and queries too far out
(`WILD`) are compared with every row.

A scan reads a block's 4-bit codes through tables of a query's partial scores. The length of each row's
residual is kept beside its code: it bounds what the code may be off by, `SPREAD` standard deviations of
a product with a residual of that length. Candidates are reranked by exact distance in double precision in
the order of score plus that bound, until it falls below the k-th nearest so far; so the depth follows from
the data, and where very many vectors lie close together the reranking goes on through them.

The queries go to every task while their vectors take `BROADCAST_BYTES` at most; beyond that, groups of queries
meet groups of candidates in a cogrouped shuffle, and one task holds one group of either (`GROUP_BYTES`, an eighth for queries). The k
of each block go through a partial top-k in every task and a last one by query.

Equal vectors lie at equal distance, so only the k + 1 smallest ids of each distinct vector are
encoded (a query excludes at most one, itself): a vector shared by a third of all rows costs no more
than one shared by eleven.

Defined cases: null, empty and all-zero vectors, vectors with null or non-finite components and
vectors not of the commonest length take no part; null ids neither; a repeated id takes part with
each of its vectors; with no vector left the result is empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K, EVERY, STEP = 10, 100, 128
#: Standard deviations of a residual's product that a candidate may be better than its score.
SPREAD = 3.0
SAMPLE, ROUNDS, THRESHOLD = 4096, 6, 0.2
BLOCK, QUERIES = 8192, 256
#: Bytes of query vectors that are sent to every task, and of the vectors in one group where they are more.
BROADCAST_BYTES, GROUP_BYTES = 16 << 20, 64 << 20
#: Scaled lengths from which a row is not coded and a query is compared with every row; lengths in a sample that longer ones are cut to.
FAR, WILD, LONGEST = 2.0**20, 2.0**40, 8.0
#: The bound of a row whose square is out of range; rows ruled out have minus infinity.
_LAST = -1e300


def lengths_of(x: np.ndarray) -> np.ndarray:
    """The length of each row, whatever its range: as the plain formula where that stays in range."""
    with np.errstate(invalid="ignore"):
        e = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
        own = np.ldexp(x, -e[:, None])
        return np.ldexp(np.sqrt((own**2).sum(axis=1)), e)


class Codebooks:
    """Centroids of all subspaces, (subspaces, 16, 2), the weight of the parallel residual, and where vectors are placed: centre and scale."""

    def __init__(self, dim: int, centroids: np.ndarray, eta: float, centre: np.ndarray | float = 0.0, exponent: int = 0):
        self.dim, self.centroids, self.eta, self.centre, self.exponent = dim, centroids, eta, centre, exponent

    def placed(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.ldexp(x - self.centre, -self.exponent)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))) if x.shape[1] % 2 else x

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss, by coordinate descent from the nearest centroids."""
        x = self.padded(x.astype(np.float32))
        n, m = len(x), len(self.centroids)
        part = x.reshape(n, m, 2)
        unit = part / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        code = np.empty((n, m), np.int64)
        for k in range(m):
            code[:, k] = ((part[:, k, None] - self.centroids[k]) ** 2).sum(axis=2).argmin(axis=1)
        residual = part - self.centroids[np.arange(m), code]
        parallel = (residual * unit).sum(axis=(1, 2))
        for _ in range(sweeps):
            for k in range(m):
                options = part[:, k, None] - self.centroids[k]
                along = np.einsum("ncd,nd->nc", options, unit[:, k])
                rest = parallel - (residual[:, k] * unit[:, k]).sum(axis=1)
                loss = (options**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + along) ** 2
                code[:, k] = loss.argmin(axis=1)
                rows = np.arange(n)
                residual[:, k] = options[rows, code[:, k]]
                parallel = rest + along[rows, code[:, k]]
        return code

    def lengths(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of each residual."""
        m = len(self.centroids)
        own = self.padded(x.astype(np.float32)).reshape(len(x), m, 2) - self.centroids[np.arange(m), codes]
        return np.sqrt((own**2).sum(axis=(1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial scores of pairs of subspaces: (queries, pairs, 256), low four bits first."""
        q = self.padded(queries.astype(np.float32)).reshape(len(queries), -1, 2)
        one = np.einsum("qmd,mcd->qmc", q, self.centroids)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], axis=1)
        low, high = one[:, ::2], one[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), low.shape[1], 256)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, by pair of subspaces: (pairs, rows)."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8).T)


def parallel_weight(dim: int, threshold: float) -> float:
    """How much more a residual along x counts than one across it where products of at least threshold * |x| matter.

    The expected squared error of a product with a query spread evenly over the directions within
    arccos(threshold) of x splits into these two parts; the ratio is 1 without a threshold and grows
    with it and with the dimension.
    """
    angle = np.linspace(0, np.arccos(threshold), 4097)
    sine = np.sin(angle)
    if dim == 1:
        return 1.0
    along = (dim - 1) * np.trapezoid(np.cos(angle) ** 2 * sine ** (dim - 2), angle)
    return float(along / np.trapezoid(sine**dim, angle))


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 3) -> Codebooks:
    """Codebooks of a sample of vectors, centred on its medians and scaled by its median length."""
    dim = x.shape[1]
    books = Codebooks(dim, np.zeros((0, 16, 2), np.float32), parallel_weight(dim, threshold), np.median(x, axis=0))
    length = lengths_of(books.placed(x))
    some = length[(length > 0) & np.isfinite(length)]
    books.exponent = int(np.frexp(np.median(some))[1]) if len(some) else 0
    x = books.placed(x)[np.isfinite(length)]
    x = x if len(x) else np.zeros((1, dim))
    x = x * np.minimum(1.0, LONGEST / np.maximum(lengths_of(x), 1e-30))[:, None]
    rng = np.random.default_rng(seed)
    x = books.padded(x.astype(np.float32))
    m = x.shape[1] // 2
    part = x.reshape(len(x), m, 2)
    books.centroids = part[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
    for _ in range(8):  # plain k-means in each subspace
        for k in range(m):
            near = ((part[:, k, None] - books.centroids[k]) ** 2).sum(axis=2).argmin(axis=1)
            count = np.bincount(near, minlength=16)
            total = np.stack([np.bincount(near, weights=part[:, k, d], minlength=16) for d in (0, 1)], axis=1)
            books.centroids[k][count > 0] = (total / np.maximum(count, 1)[:, None])[count > 0]
    unit = part / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        code = books.codes(x)
        at = (np.arange(m) * 16 + code)[:, :, None] * 2 + np.arange(2)  # unknowns that a row touches
        size = m * 32
        u = np.zeros((len(x), size), np.float32)
        np.put_along_axis(u, at.reshape(len(x), -1), unit.reshape(len(x), -1), axis=1)
        lhs = (books.eta - 1) * (u.T @ u).astype(np.float64)
        lhs[np.arange(size), np.arange(size)] += np.bincount(at.ravel(), minlength=size) + 1e-3
        rhs = books.eta * np.bincount(at.ravel(), weights=part.ravel(), minlength=size) + 1e-3 * books.centroids.ravel()
        books.centroids = np.linalg.solve(lhs, rhs).reshape(m, 16, 2).astype(np.float32)
    return books


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, components as double."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Block:
    """Candidates: ids, vectors, and of the placed vectors lengths, half squares, residual lengths and packed codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, books: Codebooks):
        self.ids, self.x, self.books = ids, x, books
        own = books.placed(x)
        self.norms = lengths_of(own)
        self.far = np.flatnonzero(~(self.norms < FAR))
        own[self.far] = 0
        codes = np.concatenate([books.codes(own[at : at + 1024]) for at in range(0, len(own), 1024)])
        self.halves = (own * own).sum(axis=1) / 2
        self.lengths = books.lengths(own, codes).astype(np.float64)
        self.codes = pack(codes)

    def distances(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact distances of rows to v, in the scale of the placed vectors."""
        with np.errstate(over="ignore"):
            return lengths_of(np.ldexp(self.x[at] - v, -self.books.exponent))

    def bounds(self, own: np.ndarray, wide: float, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The largest q.x - |x|^2 / 2 that each row may have."""
        score = np.zeros(len(self.ids), np.float32)
        for part, code in zip(table, codes):
            score += part[code]
        most = score + wide * self.lengths - self.halves
        if len(self.far):
            with np.errstate(over="ignore", invalid="ignore"):
                n = self.norms[self.far]
                out = np.linalg.norm(own) * n - n * n / 2
            most[self.far] = np.where(np.isfinite(out), out, _LAST)
        return most

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query ids, row ids, distances) of the k nearest found for each query, ties to smaller ids, and the number of distances computed."""
        placed = self.books.placed(queries)
        wild = ~(lengths_of(placed) < WILD)
        placed[wild] = 0
        spread = SPREAD / np.sqrt(self.x.shape[1]) * np.linalg.norm(placed, axis=1)
        codes, out, read = self.codes.astype(np.int64), [], 0
        for q, v, own, all_, wide, table in zip(query_ids.tolist(), queries, placed, wild.tolist(), spread.tolist(), self.books.tables(placed)):
            most = np.zeros(len(self.ids)) if all_ else self.bounds(own, wide, table, codes)
            most[self.ids == q] = -np.inf
            best, near, n = rerank(most, None if all_ else float(own @ own), lambda at: self.distances(at, v), self.ids, k, step)
            with np.errstate(over="ignore"):
                near = np.ldexp(near, self.books.exponent)
            out.append((np.full(len(best), q), self.ids[best], near))
            read += n
        return *map(np.concatenate, zip(*out)), read


def _stacked(batches, size: int):
    """(ids, matrix) of `size` rows at a time."""
    ids, rows, n = [], [], 0
    for batch in batches:
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            ids.append(part.column("vec_id").to_numpy().astype(np.int64))
            rows.append(_matrix(part.column("v")).astype(np.float64))
            n += len(part)
            if n >= size:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(rows)


def rerank(most: np.ndarray, square: float | None, distances, ids: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """The k nearest (rows, distances), ties to smaller ids, and how many distances were computed.

    most is the largest q.x - |x|^2 / 2 that each row may have; rows are read in its falling order, until
    it falls below that of the k-th nearest so far. square is |q|^2; without it all rows are read.
    """
    best, near, at, n = np.zeros(0, np.int64), np.zeros(0), 0, len(most)
    order = np.zeros(0, np.int64)
    while at < n:
        if at >= len(order):
            size = min(n, max(8 * step, 4 * len(order)))
            order = np.argpartition(-most, size - 1)[:size] if size < n else np.arange(n)
            order = order[np.argsort(-most[order], kind="stable")]
        part = order[at : min(at + step, len(order))]
        part = part[most[part] > -np.inf]
        if len(best) == k and square is not None:
            reach = (square - near[-1] ** 2) / 2
            part = part[most[part] >= reach - 1e-5 * (abs(reach) + square)]
        if not len(part):
            break
        rows, d = np.concatenate([best, part]), np.concatenate([near, distances(part)])
        pick = np.lexsort((ids[rows], d))[:k]
        best, near, at = rows[pick], d[pick], at + len(part)
    return best, near, at


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _found(query_ids, row_ids, distances) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((query_ids, row_ids, distances), _FOUND)], schema=_FOUND)


def _scan_all(batches, books: Codebooks, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
    """Every block of candidates of a task against all queries."""
    for ids, x in _stacked(batches, BLOCK):
        block = Block(ids, x, books)
        for query_ids, vectors in queries:
            yield _found(*block.search(query_ids, vectors, k)[:3])


def _packed(batches, size: int):
    for ids, x in _stacked(batches, size):
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (ids, x)], ["ids", "vectors"])


def _unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.float64).reshape(len(ids), -1)


def _rows(blocks: pa.Table):
    for i in range(blocks.num_rows):
        yield _unpacked(blocks.column("ids")[i].as_py(), blocks.column("vectors")[i].as_py())


def _scan_group(candidates: pa.Table, queries: pa.Table, books: Codebooks, k: int) -> pa.Table:
    """One group of candidates against one group of queries, block by block; the k best of each query leave."""
    found = [_found([], [], [])]
    for ids, x in _rows(candidates):
        block = Block(ids, x, books)
        found += [_found(*block.search(query_ids, vectors, k)[:3]) for query_ids, vectors in _rows(queries)]
    q, v, d = (np.concatenate([b.column(i).to_numpy() for b in found]) for i in range(3))
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return pa.Table.from_batches([_found(q[place < k], v[place < k], d[place < k])])


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by default the rows whose id is divisible by EVERY.

    queries has the columns of vectors; a row with the query's id is not a candidate for it.
    """
    context = vectors.sparkSession.sparkContext
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(F.col("vec_id") % EVERY == 0) if queries is None else usable(queries, id_col, vec_col)
    n = rows.count()
    draw = F.xxhash64("vec_id", "v", F.lit("ann"))
    drawn = rows.where(F.pmod(draw, F.lit(1 << 30)) < min(1.0, 2 * SAMPLE / max(n, 1)) * float(1 << 30))
    sample = drawn.orderBy(draw, "vec_id").limit(SAMPLE).select("v").collect() or rows.orderBy(draw, "vec_id").limit(16).select("v").collect()
    books = context.broadcast(fit(np.array([r["v"] for r in sample])) if sample else None)
    wide = 8 * len(sample[0]["v"]) if sample else 8  # bytes of a vector

    copies = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("vec_id")
    few = rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).select("vec_id", "v")
    found_kind = "query_id long, vec_id long, score double"
    packed = asked.mapInArrow(lambda b: _packed(b, QUERIES), "ids binary, vectors binary")
    n_asked = asked.count()
    if n_asked * wide <= broadcast_bytes:
        sent = context.broadcast([_unpacked(bytes(r["ids"]), bytes(r["vectors"])) for r in packed.collect()])
        found = few.mapInArrow(lambda b: _scan_all(b, books.value, sent.value, k), found_kind)
    else:
        blocks = few.mapInArrow(lambda b: _packed(b, BLOCK), "ids binary, vectors binary")
        groups = {"g": -(-n * wide // group_bytes), "h": -(-8 * n_asked * wide // group_bytes)}

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each block in one group of its own side, and once for each group of the other."""
            each = F.explode(F.sequence(F.lit(0).cast("int"), F.lit(groups[other] - 1).cast("int")))
            return df.select("ids", "vectors", F.pmod(F.hash("ids"), F.lit(groups[own])).alias(own), each.alias(other))

        sides = [dealt(blocks, "g", "h").groupBy("g", "h"), dealt(packed, "h", "g").groupBy("g", "h")]
        found = sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: _scan_group(a, b, books.value, k), found_kind)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 10 nearest rows found for every hundredth row."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
