"""MinHash near-duplicates: universal hash minima, banding, signature verification, star contraction.

1. Every text becomes its set of distinct word shingles (64-bit hashes), 288 minima of universal
   (multiply-add) hashes of them, and 48 bands of 6 minima.  Texts of equal sets are one node.
2. Nodes that share a band value share a bucket.  A pair at the similarity 0.8 misses all 48 bands
   with a probability of 5e-7.
3. Pairs inside a bucket are never listed while a leader will do: each member is compared with the
   smallest id of its bucket first, and members whose components are then joined need no comparison.
   In buckets that still hold several components, a member with too many shingles of its own to reach the threshold is out; the others
   are compared, in large buckets by blocks of bounded size that only give the links they find.
4. A comparison first looks at the signatures (six standard deviations below 0.8 is out) and then
   counts the full sets: only links with |A and B| / |A or B| >= threshold are kept.
5. Components by alternating large-star and small-star on the links, written to the shared
   folder after each step.

A null or empty text has an empty set and is linked with nothing; with fewer words than a shingle
the whole sequence is one.  Rows without an id are linked with nothing, have a null
component and are kept.  Rows that repeat an id are one document in the links; where their texts differ, every
row counts its own shingles and the links follow one of the texts.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop, read, slices, tidy, written

BANDS, ROWS = 48, 6
MINIMA = BANDS * ROWS
LARGE = 50  # members of a mixed bucket above which it is compared in blocks
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048  # documents and shingles of a block, columns of a matrix product
P = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80


@functools.cache
def _constants() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240501)
    a = rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, MINIMA, np.uint32)
    letters = rng.integers(0, 1 << 64, 256, np.uint64)
    mixers = rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
    return a, b, letters, mixers


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n; one size is kept."""
    up, down = np.full(n, P, np.uint64), np.full(n, pow(P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of a whole text, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    letters = _constants()[2]
    data = np.frombuffer(b" ".join(found), np.uint8)
    up, down = _powers(1 << max(16, int(len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1], ends[k - 1 :]
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(29))


def minima(keys: np.ndarray) -> np.ndarray:
    """The least value of each of the universal hashes over a set."""
    a, b, *_ = _constants()
    x = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        h = a[:, None] * x[None, lo : lo + 1024]
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_values(least: np.ndarray) -> np.ndarray:
    """One long for each band; the top bits tell the band, so that values of two bands never meet."""
    h = (least.reshape(BANDS, ROWS).astype(np.uint64) * _constants()[3]).sum(axis=1, dtype=np.uint64)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(6) | np.arange(BANDS, dtype=np.uint64) << np.uint64(58)).view(np.int64)


def _features(docs: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            ids, sizes, digests, bands = part.column(0), [], [], []
            for text in part.column(1).to_pylist():
                keys = shingles(text, rule.words)
                sizes.append(len(keys))
                digests.append(_digest(keys) if len(keys) else None)
                bands.append(band_values(minima(keys)) if len(keys) else None)
            flat = pa.ListArray.from_arrays(np.cumsum([0, *(BANDS if x is not None else 0 for x in bands)]).astype(np.int32), pa.array(np.concatenate([x for x in bands if x is not None] or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), flat], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _digest(keys: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Id, signature (a byte of each minimum) and full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            keys = [shingles(t, rule.words) for t in part.column(1).to_pylist()]
            signs = [_signature(k) for k in keys]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["doc", "sig", "set"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc long, sig binary, set binary")


def _signature(keys: np.ndarray) -> bytes:
    least = minima(keys).astype(np.uint64) * np.uint64(P)
    return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links among pairs (a, b)."""
    least = rule.percent / 100
    low = least - 6 * (least * (1 - least) / MINIMA) ** 0.5
    percent = rule.percent

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(j).to_pylist()), np.uint8).reshape(-1, MINIMA) for j in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= low))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (n + m - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both_sides(p: DataFrame, what: str) -> DataFrame:
        one = sets.select("doc", what)
        return p.join(one.select(F.col("doc").alias("a"), F.col(what).alias("x")), "a").join(one.select(F.col("doc").alias("b"), F.col(what).alias("y")), "b").select("a", "b", "x", "y")

    near = both_sides(pairs, "sig").mapInArrow(tidy(alike), "a long, b long")
    return written(both_sides(near, "set").mapInArrow(tidy(linked), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges (a, b), by alternating large-star and small-star."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        # large-star: every larger neighbour of u is tied to the least of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: u and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, now = now, written(small.distinct())
        drop(before, large)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._scratch = now._scratch
    return out


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(r)


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    feats = written(_features(docs, rule))
    known = F.col("n_shingles").__gt__(0) & F.col("doc_id").isNotNull()
    # one node for each distinct set; only sets that occur again need the join
    again = feats.where(known).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "rep")
    again = written(again)  # tables of their own, so that Spark can split what joins them by a hot digest or bucket
    tagged = written(feats.join(again, "digest", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.when(known & (F.coalesce("rep", "doc_id") == F.col("doc_id")), F.col("bands")).alias("bands")))
    drop(feats, again)
    spread = tagged.where("bands is not null").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key", F.col("lo").alias("lead"))
    shared = written(shared)
    members = written(spread.join(shared, "key").select("key", "doc", "n", "lead"))
    drop(shared)
    involved = written(members.select("doc").distinct())
    # Spark broadcasts the ids only if their file is small, and shuffles otherwise
    sets = written(_sets(docs.select("doc_id", "text").join(involved.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"), rule).dropDuplicates(["doc"]), "lz4")

    roots = spark.createDataFrame([], "node long, root long")

    def joined(*new: DataFrame) -> DataFrame:
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        for n in new:
            links = links.union(n)
        out = components(links)
        drop(roots, *new)
        return out

    # every member against the leader of its bucket
    pairs = members.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
    done = written(pairs.distinct())
    if not done.isEmpty():
        roots = joined(_verified(done, sets, rule))
        # what is left: members that could still reach the threshold, in buckets of several components
        placed = _mixed(members, roots)
        rare = written(_rare(sets.join(placed.select("doc").distinct(), "doc", "left_semi")))
        alive = _mixed(_alive(placed, rare, rule).select("key", "doc", "n"), roots)
        small, large = alive.where(F.col("size") <= LARGE), alive.where(F.col("size") > LARGE)
        x, y = (small.select("key", F.col("doc").alias(d), F.col("root").alias(f"r{d}"), F.col("n").alias(f"n{d}")) for d in "ab")
        near = F.lit(100) * F.least("na", "nb") >= F.lit(rule.percent) * F.greatest("na", "nb")
        pairs = x.join(y, "key").where("a < b and ra <> rb").where(near).select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
        pairs = written(pairs)
        new = [_verified(pairs, sets, rule)]
        if not large.isEmpty():
            new.append(_in_blocks(large, sets, rule))
        roots = joined(*new)
        drop(placed, rare, alive, pairs)
    drop(members, involved, sets, done)
    out = tagged.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), root.eqNullSafe(F.col("doc_id")).alias("kept"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component, and the bucket's size and smallest set."""
    placed = members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("root", "doc").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("n").alias("least_n")).where("lo < hi").select("key", "size", "least_n")
    mixed = written(mixed)  # a table whose size Spark knows: few buckets are broadcast, and no large bucket is dealt to one task
    out = written(placed.join(mixed, "key"))
    drop(mixed)
    return out


def _rare(sets: DataFrame) -> DataFrame:
    """doc, rare: how many of its shingles no other of the documents has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), doc))], names=["h", "doc"])

    once = sets.select("doc", "set").mapInArrow(run, "h long, doc long").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("doc")).where("c = 1")
    return once.groupBy("doc").agg(F.count(F.lit(1)).alias("rare"))


def _alive(placed: DataFrame, rare: DataFrame, rule: Rule) -> DataFrame:
    """Members that the threshold does not rule out: shingles that no other document has cannot be in common,
    and no partner in the bucket is smaller than its smallest set."""
    rows = placed.join(rare, "doc", "left").withColumn("s", F.col("n") - F.coalesce("rare", F.lit(0)))
    return rows.where(F.lit(100) * F.col("s") >= F.lit(rule.percent) * (F.col("n") + F.greatest("least_n", "s") - F.col("s"))).drop("rare", "s")


def _in_blocks(large: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links among the members of large buckets, by full sets, in pairs of blocks of bounded size.

    Buckets that share members make a cloud; a cloud's documents are dealt to blocks by hash, and each pair of
    blocks is one group: its common shingles are counted by a matrix product, and of the links it finds only a spanning forest
    goes on, so that rows grow with the documents and not with the pairs."""
    edges = large.groupBy("key").agg(F.min("doc").alias("lead")).join(large.select("key", "doc"), "key").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
    clouds = components(edges)
    placed = large.select("doc", "root", "n").distinct().join(clouds.select(F.col("node").alias("doc"), F.col("root").alias("cloud")), "doc", "left").withColumn("cloud", F.coalesce("cloud", "doc"))
    sizes = placed.groupBy("cloud").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = placed.join(sizes, "cloud").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cloud", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc", "root").join(sets.select("doc", "set"), "doc")
    percent = rule.percent

    def links(t: pa.Table) -> pa.Table:
        doc, root, own = (np.asarray(t.column(c)) for c in ("doc", "root", "own"))
        keys = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        n = np.array([len(k) for k in keys])
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        common = _common(keys, left, right)
        total = n[left][:, None] + n[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * total) & (root[left][:, None] != root[right][None, :]))
        return _forest(doc[left[i]], root[left[i]], doc[right[j]], root[right[j]])

    out = written(dealt.groupBy("cloud", "p", "q").applyInArrow(links, "a long, b long"))
    drop(clouds)
    return out


def _common(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many keys each of the left sets has in common with each of the right ones."""
    flat, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(which, minlength=len(flat))
    again = np.cumsum(counts > 1) - 1  # columns of keys that occur again
    at = np.cumsum([0, *(len(k) for k in keys)])
    some = [again[c[counts[c] > 1]] for c in (which[a:b] for a, b in zip(at, at[1:]))]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int((counts > 1).sum())
    for lo in range(0, width, COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for m, rows in ((x, left), (y, right)):
            for r, i in enumerate(rows):
                c = some[i]
                c = c[np.searchsorted(c, lo) : np.searchsorted(c, lo + COLUMNS)]
                m[r, c - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _forest(a: np.ndarray, root_a: np.ndarray, b: np.ndarray, root_b: np.ndarray) -> pa.Table:
    """Of links between components as many as join them."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for x, rx, y, ry in zip(a.tolist(), root_a.tolist(), b.tolist(), root_b.tolist()):
        rx, ry = find(rx), find(ry)
        if rx != ry:
            up[rx] = ry
            out.append((x, y))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), Rule(words=4))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five words, 0.8), with its own columns."""
    gone = written(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: All pairs that share a shingle, counted exactly, and every document's reach along the links.
ORACLES = {
    "op5_minhash": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
             s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
             n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
             e AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
             r(d, o) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.d, CASE WHEN l.x = r.o THEN l.y ELSE l.x END FROM r JOIN l ON l.x = r.o OR l.y = r.o),
             k AS (SELECT d, min(o) AS m FROM r GROUP BY 1)
        SELECT doc_id, n AS n_shingles, m AS component_id, m = doc_id AS kept FROM n JOIN k ON d = doc_id""",
}
QUERIES = {"op5_minhash": op5_minhash}
