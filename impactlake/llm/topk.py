"""Exact top-k inner products: long vectors first, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components are quantised to integers, so scores are exact.  One aggregate over the table gives the
Gram matrix, whose eigenvectors turn the space so that the first coordinates carry most of a
product.  Queries go out in blocks of bounded size; every task sorts its vectors by descending
length and, for a slice of them at a time, drops the queries that the slice's greatest length
cannot reach, then the pairs whose product over the first turned coordinates plus the
Cauchy-Schwarz bound of the rest stays below the query's k-th score so far.  What is left is
scored with integers.  The k-th scores start from the longest vectors of the whole table.

Bounds are sums of doubles, so each is widened by what their rounding can come to: a share of the product of
both lengths that grows with the dimension.  Scores are 64-bit sums, which are exact whenever the score fits a
long; a score that does not, or a component beyond 2^62, raises an error that names the row.

Null vectors, vectors with null or non-finite components, empty vectors and rows without an id take no part.
Vectors of unlike length have no inner product and are not compared.  A query competes with every row but
itself: of rows that repeat its id and vector one is left out, and rows that only share its id are
candidates.  Queries that repeat id and vector are asked once; an id with several vectors is asked once for each of them (told apart by
`query_no`).  Equal scores go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read, scratch, ship, tidy

DEPTHS = (8, 24)  # turned coordinates after which pairs are pruned
SLICE, CHUNK, BUFFER = 1024, 256, 1 << 15
DENSE, PIECE = 0.05, 1 << 15  # share of a block's pairs from which one product is cheaper; pairs scored at a time
SEEDS = 512
CELLS = 1 << 21  # components of the queries of a block, and of the vectors a task holds at a time
LARGEST = float(1 << 62)


def matrix(ids: pa.Array, vectors: pa.ListArray, scale: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and quantised vectors of the rows that take part."""
    ok = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    ok &= lengths == dim
    rows = vectors.filter(pa.array(ok))
    flat = rows.flatten()
    x = np.asarray(flat.fill_null(float("nan")), dtype=np.float64).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    own, x = np.asarray(ids.filter(pa.array(ok)), dtype=np.int64)[fine], np.floor(scale * x[fine])
    large = np.flatnonzero((np.abs(x) > LARGEST).any(axis=1))
    if large.size:
        raise OverflowError(f"the vector of id {own[large[0]]} has a component that is too large for an exact score")
    return own, x.astype(np.int64)


class Best:
    """The k best (score, id) of every query; equal scores by smaller id.  A query's own row is kept like any other, and marked."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.turned = q @ turn
        self.norm = np.linalg.norm(self.turned, axis=1)
        self.rest = [np.linalg.norm(self.turned[:, h:], axis=1) for h in DEPTHS]
        self.round = 8 * (q.shape[1] + 16) * 2.0**-52  # of the product of both lengths: what sums of doubles can be wrong by
        self.floor = floor.astype(float)  # the k-th score so far, or a bound of it
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.vec = np.zeros(0, np.int64)
        self.own = np.zeros(0, bool)

    def add(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray) -> None:
        turned = x @ turn
        norm = np.linalg.norm(turned, axis=1)
        order = np.argsort(-norm, kind="stable")
        ids, x, turned, norm = ids[order], x[order], turned[order], norm[order]
        rest = [np.linalg.norm(turned[:, h:], axis=1) for h in DEPTHS]
        for lo in range(0, len(ids), SLICE):
            s = slice(lo, lo + SLICE)
            slack = 0.5 + self.round * self.norm * norm[lo]
            alive = np.flatnonzero(self.norm * norm[lo] + slack >= self.floor)
            if not alive.size:
                break  # all later vectors are shorter
            for c in range(0, len(alive), CHUNK):
                self._block(alive[c : c + CHUNK], ids[s], x[s], turned[s], [r[s] for r in rest], slack, float(norm[lo]))

    def _block(self, some: np.ndarray, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, rest: list[np.ndarray], slack: np.ndarray, longest: float) -> None:
        h = DEPTHS[0]
        part = self.turned[some, :h] @ turned[:, :h].T
        least = self.floor - slack
        qi, xi = np.nonzero(part + self.rest[0][some][:, None] * rest[0][None, :] >= least[some][:, None])
        sums = part[qi, xi]
        for before, h, own, theirs in zip(DEPTHS, DEPTHS[1:], self.rest[1:], rest[1:]):
            if len(qi) > DENSE * part.size:
                break  # too many to look at one by one
            sums = sums + np.einsum("ij,ij->i", self.turned[some[qi], before:h], turned[xi, before:h])
            keep = sums + own[some[qi]] * theirs[xi] >= least[some[qi]]
            qi, xi, sums = qi[keep], xi[keep], sums[keep]
        # what is left is scored exactly: a dense block by one product, a sparse one pair by pair, both in bounded memory
        dense = len(qi) > DENSE * part.size
        exact = self._product(some, x) if dense else None
        for lo in range(0, len(qi), PIECE):
            i, j = qi[lo : lo + PIECE], xi[lo : lo + PIECE]
            q = some[i]
            score = exact[i, j] if dense else np.einsum("ij,ij->i", self.q[q], x[j])
            beyond = np.flatnonzero(self.norm[q] * longest > LARGEST)
            if beyond.size:
                self._check(q[beyond], x[j[beyond]], ids[j[beyond]])
            good = score >= self.floor[q]
            if good.any():
                q, j = q[good], j[good]
                self._merge(q, score[good], ids[j], (self.ids[q] == ids[j]) & (self.q[q] == x[j]).all(axis=1))

    def _check(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Raises if a score does not fit a long; sums of long products wrap, and so are right whenever it does."""
        for a, v, i in zip(q, x, ids):
            true = sum(c * d for c, d in zip(self.q[a].tolist(), v.tolist()))
            if not -(1 << 63) <= true < 1 << 63:
                raise OverflowError(f"the score of ids {self.ids[a]} and {i} does not fit a long")

    def _product(self, some: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer inner products; doubles hold them exactly below 2^52."""
        q = self.q[some]
        if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 1 << 52:
            return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
        return q @ x.T

    def _merge(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray, own: np.ndarray) -> None:
        q, score, vec, own = (np.concatenate(p) for p in ((self.query, q), (self.score, score), (self.vec, vec), (self.own, own)))
        order = np.lexsort((~own, vec, ~score, q))  # ~score descends as score ascends, and cannot overflow
        q, score, vec, own = q[order], score[order], vec[order], own[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.score, self.vec, self.own = q[keep], score[keep], vec[keep], own[keep]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])


def _gram(df: DataFrame, scale: float, dim: int) -> np.ndarray:
    """The sum of the outer products of all vectors: dim x dim numbers, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for batch in batches:
            _, x = matrix(batch.column(0), batch.column(1), scale, dim)
            g += x.T.astype(float) @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(g.ravel())], names=["cell", "value"])

    cells = df.mapInArrow(tidy(run), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(dim * dim)
    for c in cells:
        out[c["cell"]] = c["value"]
    return out.reshape(dim, dim)


def top_k(df: DataFrame, is_query, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", block: int = 1 << 14) -> DataFrame:
    """query_id, query_no, rank, vec_id and score of the k best other rows of every row that is_query (a Column) holds for.

    At most about `block` queries, and CELLS of their components, are on the driver or in a broadcast at a time."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("_q")).where("vec_id is not null and size(v) > 0")
    asked = rows.where("_q").groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    folder, number = scratch(spark), 0
    for dim, n in asked:
        own = rows.where(F.size("v") == dim)
        turn = np.linalg.eigh(_gram(own.select("vec_id", "v"), scale, dim))[1][:, ::-1].copy()
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double"), 2))
        seeds = own.select("vec_id", "v", length.alias("len")).where("len < double('Infinity') and not isnan(len)").orderBy(F.desc("len"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
        seed_ids, seed_x = matrix(*_columns(seeds), scale, dim)
        blocks = -(-n // max(1, min(block, CELLS // dim)))
        for b in range(blocks):
            some = own.where("_q").select("vec_id", "v").where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).distinct().toArrow()
            ids, q = matrix(*_columns(some), scale, dim)
            distinct = np.unique(np.column_stack([ids, q]), axis=0)
            ids, q = distinct[:, 0].copy(), distinct[:, 1:].copy()
            start = Best(ids, q, turn, np.full(len(ids), -np.inf), k + 1)  # one more, as a query's own row may be among them
            start.add(seed_ids, seed_x, turn)
            shared = spark.sparkContext.broadcast((ids, q, turn, start.floor))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, dim: int = dim, number: int = number) -> Iterator[pa.RecordBatch]:
                ids, q, turn, floor = shared.value
                best = Best(ids, q, turn, floor, k + 1)
                held: list = []
                for batch in batches:
                    held.append(matrix(batch.column(0), batch.column(1), scale, dim))
                    if sum(len(h[0]) for h in held) >= min(BUFFER, CELLS // dim):
                        best.add(*(np.concatenate(p) for p in zip(*held)), turn)
                        held = []
                if held:
                    best.add(*(np.concatenate(p) for p in zip(*held)), turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[best.query]), pa.array(best.query << 32 | number), pa.array(best.vec), pa.array(best.score), pa.array(best.own)],
                    names=["query_id", "query_no", "vec_id", "score", "own"],
                )

            own.select("vec_id", "v").mapInArrow(tidy(run), FOUND).write.mode("append").parquet(folder)
            shared.destroy()
            number += 1
    found = spark.read.schema(FOUND).parquet(folder) if number else spark.createDataFrame([], FOUND)
    # one row of the query's own comes first and gets no rank; at most k + 1 rows a query and task are here
    per = Window.partitionBy("query_id", "query_no")
    mine = found.withColumn("at", F.row_number().over(per.orderBy(F.desc("own"), F.desc("score"), "vec_id"))).where("not (own and at = 1)")
    return mine.select("query_id", "query_no", F.row_number().over(per.orderBy(F.desc("score"), "vec_id")).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


FOUND = "query_id long, query_no long, vec_id long, score long, own boolean"


def _columns(table: pa.Table) -> tuple[pa.Array, pa.ListArray]:
    t = table.combine_chunks()
    return tuple(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("query_no")


ORACLES = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
QUERIES = {"op1_topk": op1_topk}
