"""Tables in buckets of a key that are changed by copy-on-write: a version is a manifest, and the manifest is swapped last.

A table is a folder.  Below data/ every change writes the buckets it touches anew, as Parquet files of their own; a manifest below
versions/ names for each bucket the folder that holds it now.  A new manifest gets the next number and is there whole or not at all (it
is renamed into place), so a reader sees the old table or the new one, never half a change, whatever is lost on the way; files of
buckets that hold no changed key are neither read nor touched.  Two writers that began at the same version cannot both
end: the second rename finds its number taken and fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


FEW = 100_000  # keys up to this number may be broadcast: what Spark takes for small is the size of files, of which the driver would hold many times as much


class Conflict(RuntimeError):
    """Another writer has made a version meanwhile."""


class Buckets:
    """A table at `folder`, in `buckets` parts by a hash of `key` (columns of the table).

    The number of buckets is fixed when the table is made; choose it so that a bucket is a few files."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.buckets = buckets
        found = self._manifest()
        if found:
            self.key, self.buckets = found["key"], found["buckets"]

    # --- files -------------------------------------------------------------------------------------------------------

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, of: str) -> list[str]:
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(of))) if fs.exists(self._path(of)) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")]

    def _manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version (None: the last); a table without one is empty."""
        have = self.versions()
        if not have:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{have[-1] if version is None else version:012d}.json", wholetext=True).head()[0])

    def _swap(self, base: int, manifest: dict) -> int:
        fs, version = self._fs(), base + 1
        half, whole = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{version:012d}.json")
        out = fs.create(half)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(whole) or not fs.rename(half, whole):
            fs.delete(half, False)
            raise Conflict(f"version {version} is there already")
        return version

    # --- reading -----------------------------------------------------------------------------------------------------

    def _read(self, manifest: dict | None, only: Iterable[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        places = [p for b, p in manifest["places"].items() if only is None or int(b) in set(only)]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in sorted(places)]) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was at a version that is still kept."""
        manifest = self._manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        return self._read(manifest)

    def of(self, keys: DataFrame) -> DataFrame | None:
        """The buckets that `keys` fall into, all rows of them; None of a table without a version."""
        manifest = self._manifest()
        return self._read(manifest, sorted(self._touched(keys))) if manifest else None

    def note(self) -> object:
        """What the last change left in the manifest (for writers that must know whether they have been here)."""
        return (self._manifest() or {}).get("note")

    def _touched(self, keys: DataFrame) -> dict[int, int]:
        """How many of the keys fall into each bucket."""
        return dict(keys.groupBy(self.bucket().alias("b")).count().collect())  # at most one row a bucket

    def bucket(self) -> Column:
        """Null keys are a key of their own."""
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.key]), F.lit(self.buckets)).cast("int")

    # --- changes -----------------------------------------------------------------------------------------------------

    def change(self, keys: DataFrame, rows: DataFrame, fold: Callable[[DataFrame], DataFrame], note: object = None, touched: Iterable[int] | None = None) -> int:
        """Write the buckets of `keys` anew: what `fold` makes of their stored rows.  keys: the key columns; rows: of the table's form (for a first version);
        touched: the buckets, where they are known already."""
        have = self.versions()
        base, old = (have[-1], self._manifest(have[-1])) if have else (0, None)
        touched = sorted(self._touched(keys) if touched is None else touched)
        if not touched and (note is None or old is None):
            return base
        if not touched:
            return self._swap(base, {**old, "note": note})
        stored = self._read(old, touched) if old else self.spark.createDataFrame([], rows.schema)
        result = fold(stored)
        schema = result.schema
        (name,) = (f"data/{uuid.uuid4().hex}",)
        part = "_bucket"
        # buckets are dealt to tasks, and a large one to several of them
        result.withColumn(part, self.bucket()).hint("rebalance", part).write.partitionBy(part).parquet(f"{self.folder}/{name}")
        made = {int(n.removeprefix(f"{part}=")) for n in self._names(name) if n.startswith(f"{part}=")}
        places = {b: p for b, p in (old["places"] if old else {}).items() if int(b) not in touched}
        places |= {str(b): f"{name}/{part}={b}" for b in made}
        return self._swap(base, {"key": self.key, "buckets": self.buckets, "schema": json.loads(schema.json()), "places": places, "note": note})

    def _same(self, a: str, b: str, names: list[str]) -> Column:
        out = F.lit(True)
        for k in names:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    def replace(self, keys: DataFrame, rows: DataFrame) -> int:
        """All rows of `keys` go, and `rows` of those keys come; others of `rows` are ignored.  The new version's number is given.

        A second run with the same arguments gives an equal table; without keys nothing is written."""
        asked = keys.select(*self.key).distinct()
        touched = self._touched(asked)
        if sum(touched.values()) > FEW:
            asked = asked.hint("merge")

        def fold(stored: DataFrame) -> DataFrame:
            stay = stored.alias("s").join(asked.alias("k"), self._same("s", "k", self.key), "left_anti")
            come = rows.alias("s").join(asked.alias("k"), self._same("s", "k", self.key), "left_semi")
            return stay.unionByName(come, allowMissingColumns=True)

        return self.change(asked, rows, fold, touched=touched)

    def upsert(self, rows: DataFrame, unique: list[str] | None = None, order: list[str] | None = None, note: object = None) -> int:
        """Rows replace stored rows of equal `unique` columns (the table's key by default, which they must include); all others stay.

        Of incoming rows that are equal there the last by `order` counts (columns that are dropped from the table unless it has them)."""
        names = unique or self.key
        if not set(self.key) <= set(names):
            raise ValueError("unique columns must include the key of the buckets")
        once = Window.partitionBy(*names).orderBy(*[F.desc(c) for c in order or names])
        last = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        have = self._manifest()
        known = {f["name"] for f in have["schema"]["fields"]} if have else set(rows.columns) - set(order or ())
        last = last.drop(*[c for c in order or () if c not in known])

        def fold(stored: DataFrame) -> DataFrame:
            stay = stored.alias("s").join(last.alias("n"), self._same("s", "n", names), "left_anti")
            return stay.unionByName(last, allowMissingColumns=True)

        return self.change(last.select(*self.key).distinct(), last, fold, note)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last `keep`, and the files that no kept version names.  Not while a writer is at work."""
        have = self.versions()
        kept = have[-max(1, keep) :]
        named = {p for v in kept for p in self._manifest(v)["places"].values()}
        fs, gone = self._fs(), 0
        for v in have:
            if v not in kept:
                fs.delete(self._path(f"versions/{v:012d}.json"), False)
        for name in self._names("data"):
            for part in self._names(f"data/{name}"):
                if part.startswith("_bucket=") and f"data/{name}/{part}" not in named:
                    fs.delete(self._path(f"data/{name}/{part}"), True)
                    gone += 1
            if not any(part.startswith("_bucket=") for part in self._names(f"data/{name}")):
                fs.delete(self._path(f"data/{name}"), True)
        return gone
