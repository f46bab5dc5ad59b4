"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook; a pair of centroids is a cell with a list of vectors. A query
visits cells in the order of their summed centroid distance, by a heap over the two sorted lists of centroids, until
they hold enough vectors, and those are ranked again by their original vectors. How many are enough is measured on the
sample that the codebooks are fitted on: few where vectors cluster, a third of all where they are as good as random.
Cells are packed into blocks of bounded size; a block's vectors and the queries that visit it meet in one task, which
returns its best few.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decisa.llm.words import tidy
from decisa.session import materialize

#: Vectors that the index is fitted on at most: those with the smallest hashed ids.
SAMPLE = 20_000
CENTROIDS = 128
ROUNDS = 12
#: A query visits cells until they hold the share of all vectors that finds RECALL of the nearest ones for ASKED queries
#: of the sample, searched whole; and LEAST vectors at least.
RECALL, ASKED, LEAST = 0.94, 400, 400
#: Vectors of a block at most, of a small table's blocks at least, and queries that stream past one copy of a block.
BLOCK, FEWEST, QUERIES = 8192, 256, 65_536
#: Queries that are scored at once.
STEP = 64
#: Rounding of an inner product, relative to the lengths of both vectors.
MARGIN = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most k centroids; starts are distinct rows."""
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = near(x, c)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return (x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)).argmax(axis=1)


def visit_order(far_a: np.ndarray, far_b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells a * len(b) + b by growing far_a[a] + far_b[b], until they hold `enough` vectors."""
    a, b = np.argsort(far_a, kind="stable"), np.argsort(far_b, kind="stable")
    la, lb = far_a[a].tolist(), far_b[b].tolist()
    a, b, width = a.tolist(), b.tolist(), len(lb)
    heap, out, held = [(la[0] + lb[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := sizes[a[i] * width + b[j]]:
            out.append(a[i] * width + b[j])
            held += n
        # each cell is pushed once: right from anywhere, down from the first column only
        if j + 1 < width:
            heapq.heappush(heap, (la[i] + lb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(la):
            heapq.heappush(heap, (la[i + 1] + lb[0], i + 1, 0))
    return out


def far(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How far centroids are from queries, by inner product."""
    return -(q @ centroids.T)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal numbers wherever they stand."""
    return (x * q).sum(axis=1)


class _Block:
    """A block's vectors in order of id, ranked for batches of queries."""

    def __init__(self, ids: list, vectors: list, cells: list, books: tuple[np.ndarray, np.ndarray]):
        ids, cells = np.concatenate(ids), np.concatenate(cells)
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.books = ids[order], np.concatenate(vectors)[order], books
        self.a, self.b = np.divmod(cells[order], len(books[1]))
        self.longest = np.sqrt((self.x * self.x).sum(axis=1).max())

    def nearest(self, query: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int):
        """(query ids, ids, scores): the best k of each query among the vectors of the cells it visits here."""
        first, second = self.books
        half = first.shape[1]
        far_a, far_b = far(q[:, :half], first), far(q[:, half:], second)
        rough = q @ self.x.T
        seen = far_a[:, self.a] + far_b[:, self.b] <= reach[:, None]
        seen &= self.ids[None, :] != query[:, None]
        rough[~seen] = -np.inf
        slack = MARGIN * self.longest * np.sqrt((q * q).sum(axis=1))
        out: tuple[list, list, list] = ([], [], [])
        for i in range(len(query)):
            row = rough[i]
            least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            at = np.flatnonzero(row >= least - slack[i]) if least > -np.inf else np.flatnonzero(seen[i])
            score = _scores(self.x[at], q[i])
            best = np.lexsort((self.ids[at], -score))[:k]
            out[0].append(np.full(len(best), query[i]))
            out[1].append(self.ids[at][best])
            out[2].append(score[best])
        return [np.concatenate(x) for x in out]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(books: tuple[np.ndarray, np.ndarray], k: int):
    """Over rows in order of (block, part, asks): a block's vectors first, then the queries that visit it, which stream
    past them; the task holds one block."""

    def run(batches):
        now, block, ids, vectors, cells = None, None, [], [], []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "asks")], axis=1).astype(np.int64)
            vec_id, cell, reach = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "cell", "reach"))
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if (keys[lo, 0], keys[lo, 1]) != now:
                    now, block, ids, vectors, cells = (keys[lo, 0], keys[lo, 1]), None, [], [], []
                if not keys[lo, 2]:
                    ids.append(vec_id[lo:hi].copy())
                    vectors.append(v[lo:hi].copy())
                    cells.append(cell[lo:hi].copy())
                    continue
                if block is None and ids:
                    block, ids, vectors, cells = _Block(ids, vectors, cells, books), [], [], []
                for i in range(lo, hi if block else lo, STEP):
                    z = min(i + STEP, hi)
                    yield pa.RecordBatch.from_arrays(block.nearest(vec_id[i:z], v[i:z], reach[i:z], k), schema=FOUND)

    return run


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: id and vector not null, no null or non-finite component, not
    zero, and as long as most others (the longest of equally frequent lengths)."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    fine = rows.filter("vec_id is not null and vector is not null")
    fine = fine.filter(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0))
    common = fine.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return fine.filter(F.size("vector") == (common["dims"] if common else 0))


def needed_share(x: np.ndarray, books: list[np.ndarray], cells: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The share of vectors that must be visited to find `recall` of the k nearest: asked for rows of x among all of x."""
    half, q = books[0].shape[1], x[:ASKED]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    a, b = np.divmod(cells, len(books[1]))
    order = far(q[:, :half], books[0])[:, a] + far(q[:, half:], books[1])[:, b]
    at = np.sort(order, axis=1)
    rank = np.concatenate([np.searchsorted(at[i], order[i, top[i]], "right") for i in range(len(q))])
    return float(np.quantile(rank, recall)) / len(x)


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of every row for which is_query(column) holds.

    All other rows are candidates, a query's own id is not. Ranks start at 1; equal scores go to the smaller vec_id;
    repeated ids are repeated candidates. A query id is searched once, with its smallest vector where it has several.
    Rows that usable_vectors() leaves out take no part. No row or no query: no result.

    Every vector is in the index; the codebooks and the share of vectors to visit come from one bounded sample.
    A block's vectors are sent once for each QUERIES queries that visit it, and the queries stream past them.
    """
    fine = materialize(usable_vectors(rows, id_col, vector), "vectors")
    total = fine.count()
    empty = fine.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE)

    def fit(batches):
        x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for b in batches])
        half = (x.shape[1] + 1) // 2
        parts = (x[:, :half], x[:, half:])
        books = [kmeans(part, CENTROIDS) if part.shape[1] else np.zeros((1, 0)) for part in parts]
        cells = near(parts[0], books[0]) * len(books[1]) + near(parts[1], books[1])
        share = needed_share(x, books, cells, k, recall)
        schema = pa.schema([("half", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("share", pa.float64())])
        yield pa.RecordBatch.from_pylist([{"half": i, "n": len(c), "data": c.tobytes(), "share": share} for i, c in enumerate(books)], schema=schema)

    fitted = sample.select("vector").repartition(1).mapInArrow(tidy(fit), "half int, n long, data binary, share double").orderBy("half").collect()
    first, second = books = tuple(np.frombuffer(r["data"]).reshape(r["n"], -1) for r in fitted)
    half = first.shape[1]

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_list())
        return pd.Series(near(x[:, :half], first) * len(second) + near(x[:, half:], second)).astype("int32")

    placed = materialize(fine.withColumn("cell", cell_of("vector")), "cells")
    sizes = np.zeros(len(first) * len(second), np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        sizes[r["cell"]] = r["count"]
    # cells in order fill blocks; a cell larger than a block has its own, several ones, and is split over them by hash
    tasks = int(fine.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(BLOCK, max(FEWEST, total // (2 * tasks)))
    block, parts, held, at = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            at, held = at + int(parts[c - 1]), 0
        block[c], parts[c], held = at, max(1, -(-n // most)), held + n
    where = fine.sparkSession.createDataFrame([(c, int(block[c]), int(parts[c])) for c in np.flatnonzero(sizes).tolist()], "cell int, block long, parts long")
    longest = max(np.sqrt((c * c).sum(axis=1)).max() for c in books)
    enough, cell_sizes = max(LEAST, int(fitted[0]["share"] * total)), sizes.tolist()

    @F.pandas_udf("struct<reach: double, blocks: array<bigint>>")
    def visits_of(vectors: pd.Series) -> pd.DataFrame:
        q = np.stack(vectors.to_list())
        far_a, far_b, reach, out = far(q[:, :half], first), far(q[:, half:], second), [], []
        for i in range(len(q)):
            cells = np.array(visit_order(far_a[i], far_b[i], cell_sizes, enough), np.int64)
            last = cells[-1]
            reach.append(far_a[i, last // len(second)] + far_b[i, last % len(second)] + MARGIN * longest * np.sqrt(q[i] @ q[i]))
            n = parts[cells]
            out.append(np.unique(np.repeat(block[cells], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)))
        return pd.DataFrame({"reach": reach, "blocks": out})

    # a traversal takes milliseconds, so queries are dealt to all tasks first; their bytes alone would fill one, and a
    # deal by vec_id itself would be left out, as the aggregate's
    queries = fine.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector")).repartition(tasks, F.xxhash64("vec_id"))
    visits = queries.withColumn("_v", visits_of("vector")).select("vec_id", "vector", F.col("_v.reach").alias("reach"), F.explode("_v.blocks").alias("block"))
    visits = materialize(visits, "visits")
    turns = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))  # a row a block
    kept = placed.join(F.broadcast(where), "cell").withColumn("block", F.col("block") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")))
    kept = kept.join(F.broadcast(turns), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    visits = visits.join(F.broadcast(turns), "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int"))
    sides = kept.select("block", "part", F.lit(0).alias("asks"), "vec_id", "vector", "cell", F.lit(0.0).alias("reach"))
    sides = sides.unionByName(visits.select("block", "part", F.lit(1).alias("asks"), "vec_id", "vector", F.lit(0).alias("cell"), "reach"))
    met = sides.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "asks")
    found = met.mapInArrow(tidy(_search(books, k)), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
