"""Exact top-k inner-product search: a Voronoi kNN join.

Queries and data are grouped by their nearest pivot; there are about as many pivots as the square root of
the number of vectors. A summary per group (size, radius, greatest norm, and the distances of the k + 1
nearest members of different ids) bounds every score from both sides: for a member x of the group of pivot
p, ``q.p - |q| d(p, x) <= q.x <= min(q.p + |q| radius, |q| norm)``. The lower bounds, among them the exact
scores of the pivots, give each query a score that its k-th best certainly reaches; only groups whose
upper bound reaches that too are searched for it.

Neighbouring groups of data form bins of bounded size. A query, of which there are few, is copied to those bins that
hold a group which it needs, and to no other; each bin meets its queries locally, in parts of bounded size, and the
bins' top k are merged. Integers travel in as few bytes as they need.

What goes to every task is the pivots and their summaries, which grow with the square root of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_package

#: Vectors of a bin, and queries that meet one in a task, at most; bins that there are if the data is small.
BIN, PART, LEAST_BINS = 131_072, 32_768, 48


def _packed(ints: np.ndarray) -> bytes:
    """Integers in the smallest of 2, 4 and 8 bytes each that holds all of them."""
    low, high = (int(ints.min()), int(ints.max())) if len(ints) else (0, 0)
    for kind, bits in (("<i2", 15), ("<i4", 31)):
        if -(1 << bits) <= low and high < 1 << bits:
            return ints.astype(kind).tobytes()
    return ints.astype("<i8").tobytes()


def _packed_rows(ints: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``_packed`` of the rows that end before ``ends[1:]``, at once where all of them fit two bytes."""
    if len(ints) and -(1 << 15) <= ints.min() and ints.max() < 1 << 15 and 2 * len(ints) < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype("<i4").tobytes()), pa.py_buffer(ints.astype("<i2").tobytes())])
    return pa.array([_packed(ints[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary())


def _matrix(packed, dim: int) -> np.ndarray:
    """Rows of ``_packed`` as one matrix, of the widest type among them."""
    packed = list(packed)
    sizes = np.array([len(v) for v in packed]) // max(dim, 1)
    out = np.zeros((len(packed), dim), f"<i{max([2, *sizes.tolist()])}")
    for size in {*sizes.tolist()} - {0}:
        own = np.flatnonzero(sizes == size)
        out[own] = np.frombuffer(b"".join(packed[i] for i in own), f"<i{size}").reshape(len(own), dim)
    return out


def _longest(x: np.ndarray) -> float:
    """The greatest Euclidean norm of a row."""
    return math.sqrt(max((float(np.square(x[i : i + 4096], dtype=np.float64).sum(1).max()) for i in range(0, len(x), 4096)), default=0.0))


def _exact(queries: np.ndarray, data: np.ndarray) -> type:
    """A type in which all inner products come out exact: no part of a sum exceeds the product of the norms."""
    most = _longest(queries) * _longest(data) * (1 + 1e-9)
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact, else in wrapping 64-bit integers."""
    kind = _exact(queries, data)
    return (queries.astype(kind) @ data.astype(kind).T).astype(np.int64)


def _top(query_ids, data_ids, found: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each row of ``found``, ties to the smaller id, never the query itself."""
    query_ids, data_ids = np.asarray(query_ids), np.asarray(data_ids)
    if (np.diff(data_ids) < 0).any():
        order = np.argsort(data_ids, kind="stable")
        data_ids, found = data_ids[order], found[:, order]
    least = np.iinfo(found.dtype).min if found.dtype.kind == "i" else -np.inf
    start, end = (np.searchsorted(data_ids, query_ids, side) for side in ("left", "right"))
    if (start < end).any():
        found = found.copy() if found.base is not None else found
        for row in np.flatnonzero(start < end):
            found[row, start[row] : end[row]] = least
    # What the k-th best of some columns falls short of is no candidate; equals stay.
    some = found[:, : max(4096, 2 * k)]
    floor = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] if some.shape[1] > k else np.full(len(found), least)
    row, column = np.nonzero(found >= floor[:, None])
    own = query_ids[row] != data_ids[column]
    row, column = row[own], column[own]
    score = found[row, column]
    order = np.lexsort((column, -score.astype(np.int64) if score.dtype.kind != "i" else ~score, row))
    row, column, score = row[order], column[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"query_id": query_ids[row[kept]], "vec_id": data_ids[column[kept]], "score": score[kept].astype(np.int64)})


def query_groups(pivots: np.ndarray, queries: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """Group of each cell's queries, and how many blocks the group is dealt into: coarse cells among the pivots.

    ``queries`` counts the queries of each cell. A group of more than ``block`` of them has several blocks.
    """
    coarse = pivots[: max(1, math.ceil(sum(queries.values()) / block))]
    group = {}
    for cell in queries:
        group[cell] = int(((coarse - pivots[cell]) ** 2).sum(1).argmin())
    load: dict[int, int] = {}
    for cell, n in queries.items():
        load[group[cell]] = load.get(group[cell], 0) + n
    return {cell: (g, math.ceil(load[g] / block)) for cell, g in group.items()}


def data_bins(pivots: np.ndarray, sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """The bin of each cell, and how many parts its vectors are dealt into: neighbouring cells fill a bin, one larger than that has parts."""
    most = min(BIN, max(block, -(-sum(sizes.values()) // LEAST_BINS)))
    coarse = pivots[: max(1, math.isqrt(len(pivots)))]
    near = {cell: int(((coarse - pivots[cell]) ** 2).sum(1).argmin()) for cell in sizes}
    out, number, held = {}, 0, 0
    for cell in sorted(sizes, key=lambda c: (near[c], c)):
        if held and held + sizes[cell] > most:
            number, held = number + 1, 0
        held += sizes[cell]
        out[cell] = (number, math.ceil(sizes[cell] / most))
    return out


def needed_pairs(vectors: DataFrame, is_query, id_col: str, vector_col: str, scale: int, k: int, pivots: int | None, block: int) -> tuple[DataFrame, DataFrame] | None:
    """The vectors (uid, vec_id, dim, v, is_query, cell), and which queries need which cells.

    The second table (uid, dim, cell, qblock, n_blocks, bin, parts) has a row for each query and cell that may hold one of its k
    best; None if there are no vectors.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    ok = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            values, ends = np.asarray(column.flatten(), np.float64), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            with np.errstate(all="ignore"):
                ints = np.clip(np.floor(scale * values), -(2.0**63), 2.0**63 - 1024).astype("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int32()), _packed_rows(ints, ends), b.column(2)], ["vec_id", "dim", "v", "is_query"])

    packed = valid.mapInArrow(pack, "vec_id bigint, dim int, v binary, is_query boolean").withColumn("uid", F.monotonically_increasing_id())
    packed = materialize(packed, "knn-vectors")

    # Pivots: for each length the origin, and the vectors whose hashes fall into one of so many buckets.
    chosen: dict[int, np.ndarray] = {}
    counts = {r["dim"]: r["count"] for r in packed.groupBy("dim").count().collect()}
    if not counts:
        return None
    bucket = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    one_in = lambda n: max(1, (1 << 40) // max(1, round(n / (pivots or math.sqrt(n)))))
    drawn = F.lit(False)
    for dim, n in counts.items():
        drawn = drawn | ((F.col("dim") == dim) & (bucket < one_in(n)))
    for dim, vs in packed.filter(drawn).groupBy("dim").agg(F.collect_set("v")).collect():
        chosen[dim] = _matrix(sorted(map(bytes, vs)), dim).astype(np.float64)
    for dim in counts:
        chosen[dim] = np.concatenate([np.zeros((1, dim)), chosen.get(dim, np.zeros((0, dim)))])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby("dim"):
                p, x = chosen[dim], _matrix(part["v"], dim).astype(np.float64)
                cell = np.zeros(len(x), np.int64)
                far = np.zeros(len(x))
                for at in range(0, len(x), 1024):
                    y = x[at : at + 1024]
                    square = (y * y).sum(1)[:, None] - 2 * y @ p.T + (p * p).sum(1)
                    c = square.argmin(1)
                    cell[at : at + 1024] = c
                    far[at : at + 1024] = np.sqrt(((y - p[c]) ** 2).sum(1))  # not from the rounded squares
                yield part[["uid", "vec_id", "dim", "v", "is_query"]].assign(cell=cell.astype("int32"), far=far, norm=np.sqrt((x * x).sum(1)))

    celled = materialize(
        packed.mapInPandas(assign, "uid bigint, vec_id bigint, dim int, v binary, is_query boolean, cell int, far double, norm double"), "knn-cells"
    )
    # Of different ids, so that k remain beside the query's own rows, however many these are.
    near = Window.partitionBy("dim", "cell").orderBy("far")
    of_id = celled.groupBy("dim", "cell", "vec_id").agg(F.min("far").alias("far"))
    nearest = of_id.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    lows = nearest.groupBy("dim", "cell").agg(F.collect_list(F.struct("far", "vec_id")).alias("lows"))
    totals = celled.groupBy("dim", "cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("far").alias("radius"), F.max("norm").alias("norm"), F.count_if("is_query").alias("queries")
    )
    summary: dict[int, list] = {}
    groups: dict[int, dict] = {}
    for r in totals.join(lows, ["dim", "cell"]).orderBy("dim", "cell").toLocalIterator():
        summary.setdefault(r["dim"], []).append((r["cell"], r["size"], r["radius"], r["norm"], [x[0] for x in r["lows"]], [x[1] for x in r["lows"]]))
        if r["queries"]:
            groups.setdefault(r["dim"], {})[r["cell"]] = r["queries"]
    groups = {dim: query_groups(chosen[dim], queries, block) for dim, queries in groups.items()}
    bins = {dim: data_bins(chosen[dim], {c[0]: c[1] for c in cells}, block) for dim, cells in summary.items()}

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with every group that can hold one of its k best."""
        for f in frames:
            for dim, part in f.groupby("dim"):
                cells = summary[dim]
                number = np.array([c[0] for c in cells], np.int32)
                blocks = np.array([-(-c[1] // block) for c in cells], np.int32)
                bin_of, parts_of = np.array([bins[dim][c[0]] for c in cells], np.int32).T
                p = chosen[dim][number]
                radius, longest = (np.array([c[i] for c in cells]) for i in (2, 3))
                far, ids = (np.array([x for c in cells for x in c[i]]) for i in (4, 5))
                of = np.repeat(np.arange(len(cells)), [len(c[4]) for c in cells])
                x = _matrix(part["v"], dim).astype(np.float64)
                for at in range(0, len(x), 256):
                    q, some = x[at : at + 256], part.iloc[at : at + 256]
                    norm, dot = np.sqrt((q * q).sum(1)), q @ p.T
                    slack = 1e-9 * (np.abs(dot).max(1) + norm * (1 + radius.max() + longest.max())) + 1e-9
                    low = dot[:, of] - norm[:, None] * far
                    low[some["vec_id"].to_numpy()[:, None] == ids] = -np.inf  # the query's own rows are no candidates
                    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q), -np.inf)
                    most = np.minimum(dot + norm[:, None] * radius, norm[:, None] * longest)
                    i, c = np.nonzero(most >= (floor - 2 * slack)[:, None])
                    group, parts = np.array([groups[dim][own] for own in some["cell"]]).T
                    uid = some["uid"].to_numpy()
                    yield pd.DataFrame({"uid": uid[i], "dim": np.int32(dim), "cell": number[c], "qblock": ((group << 32) + uid % parts)[i], "n_blocks": blocks[c], "bin": bin_of[c], "parts": parts_of[c]})

    pairs = celled.filter("is_query").mapInPandas(needed, "uid bigint, dim int, cell int, qblock bigint, n_blocks int, bin int, parts int")
    return celled, materialize(pairs, "knn-pairs")


def top_k(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    pivots: int | None = None,
    block: int = 1024,
) -> DataFrame:
    """The ``k`` other vectors with the highest integer inner product, for each row where ``is_query`` holds.

    A component x counts as floor(scale * x). Returns ``query_id``, ``rank`` (from 1), ``vec_id``,
    ``score``; ties go to the smaller id. Every row is a candidate for every query but those with its
    own id. ``pivots``: about how many; the square root of the number of vectors if not given.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take
    no part; vectors are compared with those of the same length only; repeated rows are candidates
    each. Fewer candidates than ``k`` give fewer rows, an empty table none. Components beyond the
    64-bit range stop at its ends, and scores beyond it wrap. Other columns are not read, whatever their names.
    """
    found = needed_pairs(vectors, is_query, id_col, vector_col, scale, k, pivots, block)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    celled, pairs = found
    # Of more queries than a task takes, each part meets all data that it needs.
    n_parts = -(-celled.filter("is_query").count() // PART)
    part = F.pmod(F.xxhash64("uid"), F.lit(max(n_parts, 1))).cast("int").alias("qpart")
    needs = pairs.select("uid", "dim", "bin", "parts").distinct()
    asked = needs.join(celled.filter("is_query").select("uid", F.col("vec_id").alias("query_id"), "v"), "uid")
    asked = asked.select("query_id", "dim", "bin", part, "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    # Data goes to the parts of queries that need its cell; a large cell's is dealt by id.
    wanted = pairs.select("dim", "cell", "bin", "parts", part).distinct()
    data = celled.select("dim", "cell", "vec_id", "v").join(wanted, ["dim", "cell"])
    dealt = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("block")
    # Named anew, since both sides of the cogroup come from one table.
    data = data.select(*[F.col(c).alias(c) for c in ("dim", "bin", "qpart", "vec_id", "v")], dealt)
    keys = ["dim", "bin", "block", "qpart"]

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(queries["dim"].iloc[0])
        data = data.sort_values("vec_id", kind="stable")
        ids, x, q, out = data["vec_id"].to_numpy(), _matrix(data["v"], dim), _matrix(queries["v"], dim), []
        kind = _exact(q, x)
        x, asking = x.astype(kind), queries["query_id"].to_numpy()
        step = max(16, (1 << 23) // len(x))
        for at in range(0, len(q), step):
            out.append(_top(asking[at : at + step], ids, q[at : at + step].astype(kind) @ x.T, k))
        return pd.concat(out)

    solved = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten best for every hundredth row of the whole of ``embeddings``."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP3_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, len(embedding) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
