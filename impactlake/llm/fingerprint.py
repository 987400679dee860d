"""Document fingerprints: invertible Bloom lookup sketches of paragraph cells.

A text is a bag of paragraphs: a line is cut after the end of a sentence, and a long sentence after
every eight words, so that one-line texts have parts too; a text of at most SHORT characters is cut into words, and so
is one that is compared with such a text.  Each part is a 64-bit key: 48 bits of its digest
(with how often it came before, so that repeats count) and 16 bits of its length.  A sketch has
three blocks of cells; a key is put in one cell of each: count, sum (xor) of keys, sum of checks.
Sketches of two versions are subtracted cell by cell, and peeling cells that hold one key recovers
the keys that differ.  If peeling gets stuck, both versions are sketched again four times larger
with other hashes.  The likeness of two texts is the share of characters in parts that do not differ.
Stored fingerprints can be compared without their texts (`stored_likeness`) as long as the base sketch peels.

All documents of a batch are sketched, subtracted and peeled together, as arrays.

Null texts count as empty; two empty texts have likeness 1.  Rows with equal texts have equal
fingerprints.  An empty table gives no rows.  `with_next` orders by id, then text; null ids come first.
Other columns pass through unless they bear the name of an added one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import extra_columns, fresh, read, slices, tidy

BASE = 11  # cells in each of the three blocks of a stored sketch
GROW = 4
SENTENCE = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
LONG, WORDS, MOST = 80, 8, 64
SHORT, TOKEN, PIECE = 400, 16, 8  # characters of a short text, of a word that stays whole in it, and of the pieces of longer ones
HIGH = np.uint64(0xFFFFFFFF00000000)  # the bits of a check
MIX = np.uint64(0xBF58476D1CE4E5B9)
LEN = np.uint64(0xFFFF)


def parts(text: str, fine: bool) -> list[str]:
    out = []
    if fine:
        for w in text.split():
            out += [w] if len(w) <= TOKEN else [w[j : j + PIECE] for j in range(0, len(w), PIECE)]
        return out
    for s in SENTENCE.findall(text):
        if len(s) <= LONG:
            if s := s.strip():
                out.append(s)
        else:
            words = s.split()
            for i in range(0, len(words), WORDS):
                p = " ".join(words[i : i + WORDS])
                out += [p] if len(p) <= MOST else [p[j : j + MOST] for j in range(0, len(p), MOST)]
    return out


def keys_of(text: str, fine: bool | None = None) -> np.ndarray:
    """Distinct 64-bit keys of the parts of a text; the low 16 bits are the part's length.  fine: words; by the text's own length if None."""
    seen: dict[str, int] = {}
    out = []
    digest = xxhash.xxh3_64_intdigest
    for p in parts(text, len(text) <= SHORT if fine is None else fine):
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append(digest(p if not k else f"{p}\n{k}") & ~0xFFFF | len(p))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    h = (x ^ x >> np.uint64(31) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * MIX
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The three cells of each key, (3, n), in sketches of 3 x size cells."""
    return np.stack([(_mix(keys, 3 * size + j) >> np.uint64(33)).astype(np.int64) % size + j * size for j in range(3)])


class Sketches:
    """Sketches of several documents, side by side."""

    def __init__(self, docs: int, size: int):
        self.size = size
        self.count = np.zeros(docs * 3 * size, np.int32)
        self.key = np.zeros(docs * 3 * size, np.uint64)
        self.check = np.zeros(docs * 3 * size, np.uint64)

    def put(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = _mix(keys, 1) & HIGH
        for cell in _cells(keys, self.size):
            at = doc * (3 * self.size) + cell
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.size)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, keys and signs of what differs, and which documents came out whole; empties the sketches."""
        got = []
        cells = 3 * self.size
        look = np.flatnonzero(np.abs(self.count) == 1)
        while look.size:
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _mix(self.key[look], 1) & HIGH)]
            if not pure.size:
                break
            doc, key, sign = pure // cells, self.key[pure], self.count[pure]
            _, first = np.unique(np.stack([doc.astype(np.uint64), key]), axis=1, return_index=True)
            doc, key, sign = doc[first], key[first], sign[first]
            got.append((doc, key, sign))
            self.put(doc, key, -sign)
            look = np.unique(doc * cells + _cells(key, self.size))
        left = (self.count != 0) | (self.key != 0)
        whole = ~left.reshape(-1, cells).any(axis=1)
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), whole
        return *(np.concatenate(x) for x in zip(*got)), whole


def sketch(keys: list[np.ndarray], size: int) -> Sketches:
    out = Sketches(len(keys), size)
    out.put(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys) if keys else np.zeros(0, np.uint64), 1)
    return out


def stored(keys: list[np.ndarray]) -> list[str]:
    """The fingerprint strings: parts, their characters, and the base sketch."""
    s = sketch(keys, BASE)
    cells = 3 * BASE
    out = []
    for i, k in enumerate(keys):
        own = slice(i * cells, (i + 1) * cells)
        body = s.count[own].astype("<i4").tobytes() + s.key[own].astype("<u8").tobytes() + (s.check[own] >> np.uint64(32)).astype("<u4").tobytes()
        out.append(f"iblt3x{BASE}:{len(k)}:{int((k & LEN).sum())}:{base64.b64encode(body).decode()}")
    return out


def stored_likeness(a: list[str], b: list[str]) -> list[float | None]:
    """The likeness of each pair of stored fingerprints by subtracting and peeling them; None where they hold too many differences
    for their size (compare the texts then, in larger sketches)."""
    cells = 3 * BASE

    def load(prints: list[str]) -> tuple[Sketches, np.ndarray]:
        s, total = Sketches(len(prints), BASE), np.zeros(len(prints), np.int64)
        for i, p in enumerate(prints):
            _, _, chars, body = p.split(":")
            raw, own, total[i] = base64.b64decode(body), slice(i * cells, (i + 1) * cells), int(chars)
            s.count[own] = np.frombuffer(raw, "<i4", cells)
            s.key[own] = np.frombuffer(raw, "<u8", cells, 4 * cells)
            s.check[own] = np.frombuffer(raw, "<u4", cells, 12 * cells).astype(np.uint64) << np.uint64(32)
        return s, total

    (x, n), (y, m) = load(a), load(b)
    doc, key, _, whole = x.minus(y).peel()
    gone = np.bincount(doc, (key & LEN).astype(float), len(a))
    return [None if not w else 1.0 if not t else 1 - g / t for w, g, t in zip(whole.tolist(), gone.tolist(), (n + m).tolist())]


def differing(old: list[np.ndarray], new: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of versions the keys only the old one has and those only the new one has.

    Sketches grow until all peel; the hashes change with the size, so another try is another chance."""
    out: list = [None] * len(old)
    left, size = np.arange(len(old)), BASE
    while left.size:
        doc, key, sign, whole = sketch([old[i] for i in left], size).minus(sketch([new[i] for i in left], size)).peel()
        order = np.argsort(doc, kind="stable")
        doc, key, sign = doc[order], key[order], sign[order]
        cuts = np.searchsorted(doc, np.arange(len(left) + 1))
        for j in np.flatnonzero(whole):
            k, s = key[cuts[j] : cuts[j + 1]], sign[cuts[j] : cuts[j + 1]]
            out[left[j]] = (k[s > 0], k[s < 0])
        left, size = left[~whole], size * GROW
    return out


def likeness(old: list[np.ndarray], new: list[np.ndarray]) -> list[float]:
    out = []
    for a, b, (gone, come) in zip(old, new, differing(old, new)):
        total = int((a & LEN).sum()) + int((b & LEN).sum())
        out.append(1 - (int((gone & LEN).sum()) + int((come & LEN).sum())) / total if total else 1.0)
    return out


def alike_cut(a: list[str], ka: list[np.ndarray], b: list[str], kb: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of both texts of each pair, cut the same way: into words if one of them is short."""
    short = [(len(x) <= SHORT, len(y) <= SHORT) for x, y in zip(a, b)]
    return [keys_of(x, True) if s == (False, True) else k for x, k, s in zip(a, ka, short)], [keys_of(y, True) if s == (True, False) else k for y, k, s in zip(b, kb, short)]


def compare(df: DataFrame, text: str, others: list[str], recovered: bool = False, near_only: tuple[str, ...] = ()) -> DataFrame:
    """Adds fingerprint, and for each other text column x: x_fingerprint (not for those in near_only), x_near, and if wanted x_gone and
    x_come, the digests (arrays of long) of the parts that only this text or only the other one has."""
    fields = [("fingerprint", T.StringType())]
    for x in others:
        fields += [(f"{x}_fingerprint", T.StringType())] * (x not in near_only) + [(f"{x}_near", T.DoubleType())]
        fields += [(f"{x}_gone", T.ArrayType(T.LongType())), (f"{x}_come", T.ArrayType(T.LongType()))] if recovered else []
    keep = extra_columns(df, {n for n, _ in fields})
    passed = [c for c in keep if c not in {text, *others}]
    base = df.select(*passed, text, *others)
    schema = T.StructType([*base.select(*passed).schema.fields, *(T.StructField(n, t) for n, t in fields)])
    wide = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, wide, 128):
            texts = [[t or "" for t in part.column(wide + j).to_pylist()] for j in range(1 + len(others))]
            keys = [[keys_of(t) for t in some] for some in texts]
            cols = [*part.columns[:wide], pa.array(stored(keys[0]), pa.string())]
            for x, some, k in zip(others, texts[1:], keys[1:]):
                mine, other = alike_cut(texts[0], keys[0], some, k)
                cols += [] if x in near_only else [pa.array(stored(k), pa.string())]
                cols.append(pa.array(likeness(mine, other), pa.float64()))
                if recovered:
                    diff = differing(mine, other)
                    cols += [pa.array([d[s].view(np.int64).tolist() for d in diff], pa.list_(pa.int64())) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(tidy(run), schema)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "next_text") -> DataFrame:
    """Adds the text of the row with the next key (after the last: the first).

    Keys are cut into ranges by approximate quantiles; the first row of each range also goes, as a
    guard, to the range before; then every range finds its successors alone.  One shuffle, and
    nothing but range bounds passes through the driver."""
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(np.array(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)), float))
    cut = np.array(sorted({int(b) for b in bounds}), np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series(np.where(null, 0, np.searchsorted(cut, k.to_numpy().astype(np.int64), side="right")).astype(np.int32))

    # nulls go along as a flag: beside them pandas would make doubles of the ids
    id_, null = F.coalesce(F.col(key), F.lit(0)), F.col(key).isNull()
    heads = df.groupBy(range_of(id_, null).alias("part")).agg(F.min(key).alias("head"), F.max(F.col(key).isNull()).alias("nulls")).orderBy("part").collect()  # a row a range
    if not heads:
        return df.withColumn(out, F.lit(None).cast("string"))
    parts_ = np.array([h["part"] for h in heads], np.int32)
    before = dict(zip([None if h["nulls"] else int(h["head"]) for h in heads], np.roll(parts_, 1).tolist()))
    known = np.array(sorted(k for k in before if k is not None), np.int64)
    target = np.array([before[k] for k in known.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def routes(k: pd.Series, nulls: pd.Series, part: pd.Series) -> pd.Series:
        null = nulls.to_numpy().astype(bool)
        ids = k.to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
        head = (known[at] == ids) & ~null if len(known) else np.zeros(len(k), bool)
        guards = np.where(head, target[at] if len(known) else 0, before.get(None, 0))
        return pd.Series([[p, g] if h else [p] for p, g, h in zip(part.tolist(), guards.tolist(), (head | null & (None in before)).tolist())])

    way, guard, own = fresh(df, "_routes", "_is_guard", "_range")
    routed = df.withColumn(way, routes(id_, null, range_of(id_, null)))
    both = routed.select("*", F.posexplode(way).alias(guard, own)).drop(way)
    order = Window.partitionBy(own).orderBy(guard, key, F.xxhash64(text))
    return both.withColumn(out, F.lead(text).over(order)).where(F.col(guard) == 0).drop(guard, own)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against an edited version of it and against the next document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = with_next(docs).select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"))
    found = compare(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "text", ["edited", "next_text"], near_only=("next_text",))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("edited_fingerprint"), F.col("edited_near").alias("near_edited"), F.col("next_text_near").alias("near_next"))


QUERIES = {"op7_fingerprint": op7_fingerprint}
