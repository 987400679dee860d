"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3- to 6-grams of the lower-cased text, present or not.  The naive Bayes
log-count ratio of each feature, over a bounded sample of labelled rows, scales it; features whose
ratio does not stand out from chance are left out; a logistic regression on the scaled features is
fitted on the sample, label 1 holding 0.65 of all weight: a text with no evidence stays below the
threshold of 0.7.  Scoring is one pass over whole texts with array operations only.

The sample is at most `sample` rows of each class (a documented bound, not a cap on scored rows):
the labelled rows of least hash.  Null labels, null doc_ids and labels other than 0 and 1 are not
learnt from; a doc_id labelled twice counts twice.  Null and empty texts score as an empty text.
Without both classes every score is the share of label 1 (0.5 without any labels).  Repeated rows
get equal scores; other columns pass through unless they bear the name of an added one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop, extra_columns, fresh, read, ship, slices, tidy, written

BITS = 22
SIZES = (3, 4, 5, 6)
BATCH_CHARS = 1 << 19


@dataclass
class Model:
    features: np.ndarray  # ascending hashed n-grams
    weights: np.ndarray
    bias: float


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed n-grams that start at each place, by size; points: code points of texts laid end to end."""
    c = points.astype(np.uint64)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, SIZES[-1] + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + c[n - 1 :]
        if n >= SIZES[0]:
            yield ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


def presence(texts: list[str | None], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text; wanted: a mask over all hashes, to keep fewer."""
    out: list[np.ndarray] = []
    lo = 0
    # a text is framed by blanks; six more between texts would glue nothing, so grams that cross are cut off by their start
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BATCH_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        framed = [f" {(t or '').lower()} " for t in texts[lo:hi]]
        points = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in framed])
        found = []
        for n, g in zip(SIZES, grams(points)):
            at = np.flatnonzero(wanted[g]) if wanted is not None else np.arange(len(g))
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            found.append(doc[inside].astype(np.int64) << BITS | g[at[inside]])
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(keys >> BITS, np.arange(hi - lo + 1))
        hashes = (keys & (1 << BITS) - 1).astype(np.int32)
        out += [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        lo = hi
    return out


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float, steps: int, share1: float = 0.65) -> tuple[np.ndarray, float]:
    """Logistic regression on presence x ratio to its optimum by L-BFGS; label 1 has share1 of all weight."""
    lengths = np.array([len(r) for r in rows])
    col = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    by_col = np.repeat(np.arange(len(rows)), lengths)[np.argsort(col, kind="stable")]
    weight = np.where(y == 1, share1 / max(1, (y == 1).sum()), (1 - share1) / max(1, (y == 0).sum()))

    def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, has = np.zeros(len(lengths)), lengths > 0
        if has.any():
            out[has] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[has])
        return out

    often = np.bincount(col, minlength=len(ratio))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        v = p[:-1]
        z = sums((v * ratio)[col], lengths) + p[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * l2 * (v @ v)), np.append(sums(g[by_col], often) * ratio + l2 * v, g.sum())

    p = np.zeros(len(ratio) + 1)
    now, grad = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max() < 1e-7:
            break
        d, scales = -grad, []
        for s, t, r in reversed(past):
            scales.append(r * (s @ d))
            d = d - scales[-1] * t
        d = d / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else d / np.abs(grad).sum()
        for s, t, r in past:
            d = d + (scales.pop() - r * (t @ d)) * s
        slope, step = grad @ d, 1.0
        while (new := loss(p + step * d))[0] > now + 1e-4 * step * slope and step > 1e-8:
            step /= 2
        s, t = step * d, new[1] - grad
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        p, (now, grad) = p + s, new
    return p[:-1], float(p[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, z: float = 3.0, l2: float = 4e-4, steps: int = 400) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, training rows only.  At most `sample` labelled rows of each class are used."""
    ship(docs.sparkSession)
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    pick = lambda c: clean.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).unionByName(pick(1))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            got = presence(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.tobytes() for g in got], pa.binary())], names=["toxic", "grams"])

    # at most 2 x sample rows of two numbers: safe to broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a document that stands there many times gives one text, so that no more than 2 x sample reach what is collected below
    joined = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("toxic", "text")
    rows = written(joined.mapInArrow(tidy(features), "toxic int, grams binary").distinct())  # copies of a text would pass for evidence

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y, np.frombuffer(g, np.int32)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[0, some], pa.int64()), pa.array(seen[1, some], pa.int64())], names=["gram", "n0", "n1"])

    sizes = dict(rows.groupBy("toxic").count().collect())
    total0, total1 = sizes.get(0, 0), sizes.get(1, 0)
    if not total0 or not total1:
        drop(rows)
        share = (total1 + 0.5) / (total0 + total1 + 1)
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share))))
    n0, n1 = F.col("n0") + 1.0, F.col("n1") + 1.0
    ratio = F.log(n1 / F.lit(total1 + 2.0)) - F.log(n0 / F.lit(total0 + 2.0))
    # grams that stand out from chance: a function of the bounded sample, a few thousand
    stand_out = (
        rows.mapInArrow(tidy(count), "gram long, n0 long, n1 long")
        .groupBy("gram")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .select("gram", ratio.alias("ratio"))
        .where(F.abs("ratio") >= F.lit(z) * F.sqrt(1 / n0 + 1 / n1))
        .orderBy("gram")
        .collect()
    )
    chosen_grams = np.array([r["gram"] for r in stand_out], np.int32)
    ratios = np.array([r["ratio"] for r in stand_out], float)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.flatnonzero(np.isin(chosen_grams, np.frombuffer(g, np.int32), assume_unique=True)).astype(np.int32).tobytes() for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["toxic", "grams"])

    small = rows.mapInArrow(tidy(narrow), "toxic int, grams binary").collect()  # at most 2 x sample short rows
    drop(rows)
    small.sort(key=lambda r: (r["toxic"], bytes(r["grams"])))
    y = np.array([r["toxic"] for r in small], float)
    w, bias = _fit([np.frombuffer(r["grams"], np.int32).astype(np.int64) for r in small], y, ratios, l2, steps)
    return Model(chosen_grams, w * ratios, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of every whole text."""
    keep = extra_columns(docs, {out})
    kept = docs.select(*keep)
    at = keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wanted = np.zeros(1 << BITS, bool)
        wanted[m.features] = True
        for part in slices(batches, at):
            z = [m.bias + float(m.weights[np.searchsorted(m.features, g)].sum()) for g in presence(part.column(at).to_pylist(), wanted)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*keep, out])

    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_tables(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out()).select("doc_id", "toxic"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, from labels of the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_tables(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents below the threshold, with their own columns."""
    model = fit_tables(docs, read(spark, sf_dir, "labels"))
    (own,) = fresh(docs, "_toxicity")
    # the whole row goes along so that no join is needed
    return score(docs, model, out=own).where(F.col(own) < threshold).select(*docs.columns)


QUERIES = {"op8_toxicity": op8_toxicity}
