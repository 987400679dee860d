"""Lines that too many documents share are dropped: levelled sorted runs of line digests.

A line's key is the line without white space (blank, tab, LF, VT, FF, CR) at both ends, A-Z in lower case; its
digest is 128 bits of it.  Digests are kept in runs: tables sorted by digest, with the number of
documents that hold it, so that a reader prunes by range.  Each new batch of documents is counted, merge-anti-joined
with the digests that the runs already hold often enough (nothing more is to be learnt about them), and the rest is added as a run
of level 0.  Where a level has `fan` runs, they are merged into one run of the next level.  A manifest names the
runs that count; it is written anew under the next number after the runs it names, and old runs are deleted after that, so
a job that is lost on the way leaves the last whole state to go on from.

The digests that enough documents hold go to the documents while they are at most FEW, counted first; beyond that they
are joined with the lines of each document by digest, and the numbers of the lines to drop with the documents by id and text.
Texts are not shuffled in the first case.

A row is a document: rows that repeat count as often as they stand there, and null ids count too.  A null
or empty text is one empty line; empty keys (shorter than min_chars) are never dropped.  A text that loses
all its lines becomes empty.  Lines of any length are hashed whole.  An empty table gives no rows.  Other
columns pass through unless they bear the name of an added one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop, extra_columns, fresh, read, scratch, ship, slices, tidy, written

BLANK = b" \t\n\x0b\x0c\r"
FEW = 1 << 20  # digests (16 bytes each) that a broadcast holds at most
RUN = "hi long, lo long, n long"


def keys(text: bytes) -> list[bytes]:
    """The key of each line of a text, in order."""
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]  # lower() of bytes knows A-Z only


def digests(text: bytes, min_chars: int = 1) -> list[bytes | None]:
    """16 bytes for each line, None for a key of fewer than min_chars code points."""
    return [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars) else None for k in keys(text)]


def pairs(some: list[bytes]) -> np.ndarray:
    """Digests as (n, 2) longs."""
    return np.frombuffer(b"".join(some), ">i8").astype(np.int64).reshape(-1, 2)


def counted(docs: DataFrame, text: str = "text", min_chars: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """hi, lo and n: in how many rows a digest occurs, for each value of the columns `by`."""
    ship(docs.sparkSession)
    own = docs.select(*by, F.coalesce(text, F.lit("")).cast("binary").alias("line_text"))
    wide = len(by)
    schema = T.StructType([*own.schema.fields[:wide], T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, wide):
            rows, found = [], []
            for i, t in enumerate(part.column(wide).to_pylist()):
                some = set(digests(t, min_chars)) - {None}
                found += some
                rows += [i] * len(some)
            if found:
                longs = pairs(found)
                yield pa.RecordBatch.from_arrays([*(part.column(j).take(pa.array(rows)) for j in range(wide)), pa.array(longs[:, 0]), pa.array(longs[:, 1])], names=schema.names)

    return own.mapInArrow(tidy(run), schema).groupBy(*by, "hi", "lo").agg(F.count(F.lit(1)).alias("n"))


class Runs:
    """Levelled sorted runs of digests in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan: int = 4):
        self.spark, self.folder, self.fan = spark, folder or scratch(spark), fan
        self.levels: list[list[str]] = []
        self.version = -1
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path())] if self._fs().exists(self._path()) else []
        for name in sorted(x for x in found if x.startswith("manifest-"))[-1:]:
            self.levels = json.loads(spark.read.text(f"{self.folder}/{name}", wholetext=True).head()[0])
            self.version = int(name.removeprefix("manifest-").removesuffix(".json"))

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, gone: list[str]) -> None:
        """The state as it is now counts; a manifest is there whole (by renaming) or not at all."""
        self.version += 1
        fs, half, whole = self._fs(), self._path(f"_{uuid.uuid4().hex}"), self._path(f"manifest-{self.version:012d}.json")
        out = fs.create(half)
        out.write(bytearray(json.dumps(self.levels).encode()))
        out.close()
        fs.rename(half, whole)
        fs.delete(self._path(f"manifest-{self.version - 1:012d}.json"), False)
        for name in gone:
            fs.delete(self._path(name), True)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.select("hi", "lo", "n").repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo").write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*[f"{self.folder}/{x}" for x in names])

    def table(self) -> DataFrame:
        """All runs; a digest may stand in several."""
        return self._read([x for level in self.levels for x in level])

    def unseen(self, rows: DataFrame, least: int = 1) -> DataFrame:
        """Rows whose digest (hi, lo) no run holds with at least `least` documents."""
        if not any(self.levels):
            return rows
        return rows.join(self.table().where(F.col("n") >= least).select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")

    def add(self, rows: DataFrame, settled: int | None = None) -> None:
        """Add a batch of hi, lo, n (each digest once), but for digests that a run alone holds in `settled` documents; then compact."""
        own = self._write(rows if settled is None else self.unseen(rows, settled))
        self.levels = self.levels or [[]]
        self.levels[0].append(own)
        self._commit([])
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            old = self.levels[level]
            merged = self._write(self._read(old).groupBy("hi", "lo").agg(F.sum("n").alias("n")))
            self.levels += [[]] * (level + 2 - len(self.levels))
            self.levels = [*self.levels[:level], [], [*self.levels[level + 1], merged], *self.levels[level + 2 :]]
            self._commit(old)
            level += 1

    def frequent(self, least: int) -> DataFrame:
        """hi and lo of the digests that at least `least` documents hold."""
        return self.table().groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hi", "lo")

    def delete(self) -> None:
        self._fs().delete(self._path(), True)


def shared_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan: int = 3) -> DataFrame:
    """hi and lo of the lines that at least min_docs rows hold, as a written table.

    The rows are dealt into `batches`, as they would arrive one after another; their texts are read once."""
    spark = docs.sparkSession
    ship(spark)
    (number,) = fresh(docs, "_batch")
    folder = scratch(spark)
    counted(docs.withColumn(number, F.pmod(F.monotonically_increasing_id(), F.lit(batches)).cast("int")).select(number, text), text, min_chars, (number,)).write.partitionBy(number).parquet(folder)
    arrived = spark.read.schema(f"{RUN}, {number} int").parquet(folder)
    runs = Runs(spark, fan=fan)
    for b in range(batches):
        runs.add(arrived.where(F.col(number) == b).drop(number), settled=min_docs)
    out = written(runs.frequent(min_docs))
    runs.delete()
    arrived._scratch = folder
    drop(arrived)
    return out


def _strip(docs: DataFrame, text: str, marks, taken: set[str], lines: str, dropped: str, at: str | None = None) -> DataFrame:
    """docs with the lines gone that `marks` (text, value of column `at`: line numbers) names."""
    keep = [c for c in extra_columns(docs, taken) if c != at]
    own = docs.select(*keep, *([at] if at else []))
    where, wide = keep.index(text), len(keep)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, where):
            texts, n, gone = [], [], []
            for t, x in zip(part.column(where).to_pylist(), part.column(wide).to_pylist() if at else [None] * part.num_rows):
                raw = (t or "").encode()
                bad = marks(raw, x)
                every = raw.split(b"\n")
                texts.append(b"\n".join(v for i, v in enumerate(every) if i not in bad).decode() if bad else raw.decode())
                n.append(len(every))
                gone.append(len(bad))
            cols = [pa.array(texts, pa.string()) if j == where else part.column(j) for j in range(wide)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return own.mapInArrow(tidy(run), schema)


def strip_lines(docs: DataFrame, bad: DataFrame, text: str = "text", id_: str = "doc_id", min_chars: int = 1, few: int = FEW, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """docs without the lines whose digest is in bad (hi, lo, each once); text is what is left, n_lines counts before, n_dropped what went."""
    spark = docs.sparkSession
    ship(spark)
    taken = {lines, dropped}
    if bad.limit(few + 1).count() <= few:  # a checked size
        table = bad.toArrow()
        raw = np.column_stack([table.column(c).to_numpy() for c in ("hi", "lo")]).astype(">i8").tobytes()
        known = frozenset(raw[i : i + 16] for i in range(0, len(raw), 16))
        shared = spark.sparkContext.broadcast(known)
        return _strip(docs, text, lambda raw, _: {i for i, d in enumerate(digests(raw, min_chars)) if d in shared.value}, taken, lines, dropped)
    hi, lo, at = fresh(docs, "_hi", "_lo", "_lines")
    own = docs.select(F.col(id_).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("t"))
    schema = T.StructType([own.schema.fields[0], *(T.StructField(c, T.LongType()) for c in ("a", "b", "hi", "lo")), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows, of, found, places = [], [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                where: dict[bytes, list[int]] = {}
                for j, d in enumerate(digests(t, min_chars)):
                    if d:
                        where.setdefault(d, []).append(j)
                rows += [i] * len(where)
                of += [xxhash.xxh3_128_digest(t)] * len(where)
                found += where
                places += where.values()
            x, y = pairs(of), pairs(found)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v[:, k]) for v in (x, y) for k in (0, 1)), pa.array(places, pa.list_(pa.int32()))], names=schema.names)

    names, place = [*docs.columns, hi, lo], docs.columns.index(text)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            x = pairs([xxhash.xxh3_128_digest((t or "").encode()) for t in part.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(x[:, 0]), pa.array(x[:, 1])], names=names)

    # a line that a third of the documents hold is one key here: a skewed left side, which Spark splits
    hits = own.mapInArrow(tidy(split), schema).join(bad, ["hi", "lo"], "left_semi")
    per = hits.groupBy("id", "a", "b").agg(F.flatten(F.collect_set("at")).alias("at"))  # equal rows have equal lists
    with_key = docs.mapInArrow(tidy(keyed), T.StructType([*docs.schema.fields, T.StructField(hi, T.LongType()), T.StructField(lo, T.LongType())]))
    ours = with_key.alias("l").join(per.alias("r"), F.col(f"l.{id_}").eqNullSafe(F.col("r.id")) & (F.col(f"l.{hi}") == F.col("r.a")) & (F.col(f"l.{lo}") == F.col("r.b")), "left")
    return _strip(ours.select(*[F.col(f"l.{c}") for c in docs.columns], F.col("r.at").alias(at)), text, lambda _, x: set(x or ()), taken, lines, dropped, at)


def dedup_lines(docs: DataFrame, text: str = "text", id_: str = "doc_id", min_docs: int = 10, min_chars: int = 1, few: int = FEW) -> DataFrame:
    """docs without the lines that at least min_docs rows share; adds n_lines (before) and n_dropped."""
    return strip_lines(docs, shared_lines(docs, text, min_docs, min_chars), text, id_, min_chars, few)


def op11_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least ten documents hold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES = {
    "op11_linededup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
             k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f ON k.key = f.key GROUP BY r""",
}
QUERIES = {"op11_linededup": op11_linededup}
