"""Language ID by prediction by partial matching over bytes.

Each language has a context tree: how often each byte follows each context of 0 to 4 bytes.  A
byte seen after a context costs log2((total + distinct) / count) bits; else the escape costs
log2((total + distinct) / distinct) bits and the next shorter context is asked (escape method C),
down to all 256 bytes alike.  The counts are frozen after learning, so the exact cost of every
byte after every context is worked out once and laid in hash tables with one column a language;
scoring a text looks up all its positions at once and adds the bits.  The language with the
shortest code wins, ties by name, however long its code is.

Whether a text is in any learnt language at all is another question, which only the pipeline's stage asks: is even the shortest code too long?
How long is told by all texts of the learnt languages, whether they are in the sample or not: texts are halved by a
hash, what is learnt from one half's sample costs all texts of the other half, and a bound is SLACK times the median cost a byte
of a language's distinct texts (costs are cut to STEPS parts of a bit, so that counts tell the median).  It
is never below 4 bits (half of what the byte takes) nor above 8, the cost without any model; what a
text has more than its bound must also exceed SPARE bits, for texts of a few letters.

Learning uses about `sample` distinct texts a language (a documented bound): those of least hash of id and text;
documents without lang, doc_id or text are not learnt from.  Texts that are null or have no letter get `und` and score 0;
without any learnt language every text does.  Scores are the posterior of the
winner under equal priors.  Repeated rows get equal results; other columns pass through unless
they bear the name of an added one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import extra_columns, fresh, read, ship, slices, tidy

ORDER = 4
BATCH_BYTES = 1 << 19
PAD = b"\n" * ORDER
SLOTS = 1 << 52  # hash values a share of the documents is cut from, fine enough for any table
SLACK, LEAST, MOST, SPARE = 2.25, 4.0, 8.0, 16.0
STEPS = 4096  # of a bit, in the median cost of a language's texts
LETTER = regex.compile(r"\p{L}")


class Table:
    """uint64 keys to row numbers, open addressing with arrays only."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = self.rows[at] < 0
            slot, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slot >= 0]
            self.rows[at[first]] = left[first]
            self.keys[at[first]] = keys[left[first]]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, at = left[stay], (at[stay] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(21)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        at = self._slot(keys)
        rows = self.rows[at]
        open_ = np.flatnonzero((rows >= 0) & (self.keys[at] != keys))
        at = at[open_]
        while open_.size:
            at = (at + 1) & (1 << self.bits) - 1
            got = self.rows[at]
            rows[open_] = got
            go = (got >= 0) & (self.keys[at] != keys[open_])
            open_, at = open_[go], at[go]
        return rows


@dataclass
class Model:
    langs: list[str]
    grams: list[tuple[Table, np.ndarray]]  # by order n = 0..ORDER: n bytes of context and a symbol -> bits a language
    escapes: list[tuple[Table, np.ndarray]]  # by order: n bytes of context -> bits of its escape, 0 where a language lacks it
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0))  # bits a byte by language: what costs more is in none


def packed(data: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER+1 the last n bytes up to each place as one number (n also in it)."""
    wide = data.astype(np.uint64)
    out, acc = [], np.zeros(len(data), np.uint64)
    for n in range(1, ORDER + 2):
        shifted = np.zeros(len(data), np.uint64)
        shifted[n - 1 :] = wide[: len(data) - n + 1]
        acc = acc | shifted << np.uint64(8 * (n - 1))
        out.append(acc)
    return out


def count(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of n-grams, n = 1..ORDER+1, in whole texts; each text begins after a padding of line feeds."""
    data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
    real = np.ones(len(data), bool)
    at = 0
    for t in texts:
        real[at : at + ORDER] = False
        at += ORDER + len(t)
    return [np.unique(k[real], return_counts=True) for k in packed(data)]


def build(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """Costs from counts; counts: for each language, by n = 1..ORDER+1, n-grams ascending and how often."""
    langs = sorted(counts)
    grams, escapes = [], []
    for n in range(ORDER + 1):
        every = np.unique(np.concatenate([counts[x][n][0] for x in langs]))
        contexts = np.unique(every >> np.uint64(8))
        bits = np.empty((len(every), len(langs)), np.float32)
        escape = np.zeros((len(contexts), len(langs)), np.float32)
        of = np.searchsorted(contexts, every >> np.uint64(8))
        for j, lang in enumerate(langs):
            keys, times = counts[lang][n]
            own = np.searchsorted(contexts, keys >> np.uint64(8))
            total = np.bincount(own, times, len(contexts))
            distinct = np.bincount(own, minlength=len(contexts)).astype(float)
            there = total > 0
            escape[there, j] = np.log2((total[there] + distinct[there]) / distinct[there])
            if n:
                table, lower = grams[-1]
                shorter = every & np.uint64((1 << 8 * n) - 1)
                below = lower[table.find(shorter), j]
            else:
                below = np.full(len(every), 8.0)
            bits[:, j] = escape[of, j] + below
            pos = np.searchsorted(every, keys)
            bits[pos, j] = np.log2((total + distinct)[own] / times)
        grams.append((Table(every), bits))
        escapes.append((Table(contexts), escape))
    return Model(langs, grams, escapes, np.full(len(langs), MOST))


def lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language (texts x languages)."""
    out = np.zeros((len(texts), len(model.langs)))
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_BYTES):
            size += len(texts[hi])
            hi += 1
        some = texts[lo:hi]
        data = np.frombuffer(b"".join(PAD + t for t in some), np.uint8)
        keys = packed(data)
        begins = np.cumsum([0, *(len(t) + ORDER for t in some)])[:-1]
        # bits by position; the padding itself costs nothing
        bits = np.zeros((len(data), len(model.langs)), np.float32)
        real = np.ones(len(data), bool)
        for k in range(ORDER):
            real[begins + k] = False
        left = np.flatnonzero(real)
        for n in range(ORDER, -1, -1):
            table, costs = model.grams[n]
            rows = table.find(keys[n][left])
            hit = rows >= 0
            bits[left[hit]] += costs[rows[hit]]
            left = left[~hit]
            if not left.size:
                break
            table, costs = model.escapes[n]
            rows = table.find(keys[n][left] >> np.uint64(8))
            known = rows >= 0
            bits[left[known]] += costs[rows[known]]
        bits[left] += 8.0
        for i, (a, t) in enumerate(zip(begins, some)):
            out[lo + i] = bits[a : a + ORDER + len(t)].sum(axis=0, dtype=np.float64)
        lo = hi
    return out


def rates(bits: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Bits a byte of the winner, after SPARE bits; texts: none empty."""
    return np.maximum(bits.min(axis=1) - SPARE, 0) / np.array([len(t) for t in texts])


def own_costs(docs: DataFrame, halves: list[Model]) -> dict[str, float]:
    """The median cost a byte, by language, of all distinct texts that are taken for what `lang` says.

    docs: lang, text and half; halves: what is learnt from texts of half 0 and of half 1.  A text is costed by the other half's."""
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in slices(batches, 1):
            rows = [x for x in zip(*(c.to_pylist() for c in batch.columns)) if LETTER.search(x[1])]
            for half in (0, 1):
                m, own = models[1 - half], [x for x in rows if x[2] == half]
                if own and m.langs:
                    texts = [x[1].encode() for x in own]
                    bits = lengths(m, texts)
                    steps = np.floor(np.minimum(rates(bits, texts), MOST) * STEPS).astype(int).tolist()
                    got = [(x[0], x[3], k) for x, k, best in zip(own, steps, bits.argmin(axis=1).tolist()) if m.langs[best] == x[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int32()))], names=["lang", "digest", "step"])

    # copies of a text would pass for many; at most MOST * STEPS + 1 counts a language come here
    told = docs.select("lang", "text", "half", F.unhex(F.md5("text")).alias("digest")).mapInArrow(tidy(run), "lang string, digest binary, step int")
    counts = told.groupBy("lang", "digest").agg(F.min("step").alias("step")).groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    shared.destroy()
    out = {}
    for lang in {x["lang"] for x in counts}:
        steps, n = np.array(sorted((x["step"], x["n"]) for x in counts if x["lang"] == lang)).T
        upto = np.cumsum(n)
        middle = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right")
        out[lang] = float(steps[middle].mean()) / STEPS
    return out


def fit(docs: DataFrame, sample: int = 1000, bounded: bool = True) -> Model:
    """docs: doc_id, text, lang of training rows.  At most about `sample` distinct texts a language are learnt from.

    bounded: also work out, from all training rows, what a text of a learnt language costs at most (`predict` with `known` needs it)."""
    ship(docs.sparkSession)
    named = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = named.groupBy("lang").agg((F.least(F.lit(1.0), sample / F.count(F.lit(1))) * F.lit(float(SLOTS))).cast("long").alias("below"))
    lots = named.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLOTS)).alias("lot"), F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int").alias("half"))
    # the sizes are a row a language, and the model has a column for each; rows that repeat would all be in or all be out: a text counts once
    chosen = lots.join(F.broadcast(sizes), "lang").where("lot < below").select("lang", "text", "half").distinct()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[bytes]] = {}
        for batch in batches:
            for lang, text, half in zip(*(x.to_pylist() for x in batch.columns)):
                seen.setdefault((lang, half), []).append(text.encode())
        for (lang, half), texts in seen.items():
            for n, (k, c) in enumerate(count(texts)):
                c0 = c if half == 0 else np.zeros(len(c), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(np.full(len(k), n), pa.int32()), pa.array(k.view(np.int64)), pa.array(c, pa.int64()), pa.array(c0, pa.int64())], names=["lang", "n", "gram", "c", "c0"])

    rows = chosen.mapInArrow(tidy(partial), "lang string, n int, gram long, c long, c0 long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"), F.sum("c0").alias("c0"))
    table = rows.orderBy("lang", "n", "gram").toArrow()  # bounded by the sample
    lang, n = np.array(table.column("lang").to_pylist(), object), table.column("n").to_numpy()
    gram = table.column("gram").to_numpy().view(np.uint64)

    def counts(c: np.ndarray) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
        out = {}
        for x in set(lang[c > 0].tolist()):
            own = (lang == x) & (c > 0)
            out[x] = [(gram[own & (n == k)], c[own & (n == k)]) for k in range(ORDER + 1)]
        return out

    all_, first = table.column("c").to_numpy().astype(float), table.column("c0").to_numpy().astype(float)
    if not len(all_):
        return Model([], [], [])
    model = build(counts(all_))
    if bounded:
        costs = own_costs(lots, [build(half) if half else Model([], [], []) for half in (counts(first), counts(all_ - first))])
        model.bounds = np.array([np.clip(SLACK * costs.get(x, MOST), LEAST, MOST) for x in model.langs])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """Adds the language of every whole text (`und` for null and letterless ones) and the winner's posterior.

    known: the name of a boolean column to add: whether the text costs no more than a text of a learnt language does."""
    added = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(known, T.BooleanType())] if known else [])]
    keep = extra_columns(docs, {f.name for f in added})
    kept = docs.select(*keep)
    at = keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if m.langs else []
            langs, scores, within = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if lettered:
                coded = [texts[i].encode() for i in lettered]
                bits = lengths(m, coded)
                best = bits.argmin(axis=1)
                post = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                for i, b, p, k in zip(lettered, best.tolist(), post.tolist(), (rates(bits, coded) <= m.bounds[best]).tolist()):
                    langs[i], scores[i], within[i] = m.langs[b], min(1.0, p), k
            cols = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(within, pa.bool_())] if known else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*keep, *(f.name for f in added)])

    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, *added]))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_tables(docs: DataFrame, bounded: bool = True) -> Model:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"), bounded=bounded)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = fit_tables(docs, bounded=False)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; those without text or any letter and those that cost more than texts of the learnt languages go.

    Where no language was learnt there is nothing to judge by, and every document stays.  Rows that repeat fare alike; null ids are
    judged by their text as all others are, but not learnt from; columns come back as they were."""
    model = fit_tables(docs)
    if not model.langs:
        return docs
    lang, own, known = fresh(docs, "_lang_pred", "_lang_score", "_lang_known")
    return predict(docs, model, lang=lang, score=own, known=known).where(known).select(*docs.columns)


QUERIES = {"op9_language": op9_language}
