"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays, not on a regular expression.  Every code point has a class; a
class is a function from the scanner's state to its next state (four states, so a function is
one byte), and functions compose associatively, so the state before every code point comes from a
doubling scan over composed functions.  Most functions are constant, so the scan settles after a
step or two.  Class changes and states give the boundaries, their UTF-8 offsets give slices, and
each distinct slice is merged once and kept in a bounded cache.

Nulls count as empty texts; an empty text has no ids.  Texts may hold any code point; lone
surrogates cannot occur in a Spark string.  Repeated rows give repeated results, an empty table an
empty result, and other columns are passed through unless they bear the name of an added one.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import extra_columns, read, slices, tidy

L, N, S, O = 0, 1, 2, 3
W, X, A, T2 = 0, 1, 2, 3  # states: match may start here; it may not; after an opening '; one suffix letter left
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BATCH_CHARS = 1 << 21
CACHE_BYTES = 12 << 20  # of a generation of the cache, counted with about what Python adds to an entry


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point: letter, number, white space or other.

    Python's own tables decide; code points on which the installed libraries' Unicode versions
    differ (new ones) follow the tokenizer library, which is asked about each of them."""
    import regex
    import tiktoken

    of = {"L": L, "N": N}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    newer = np.full(0x110000, O, np.uint8)
    for lo in range(0, 0x110000, 0x1000):  # piece by piece, for little memory
        every = "".join(map(chr, (c for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000)))
        for kind, pattern in ((L, r"\P{L}+"), (N, r"\P{N}+")):
            newer[np.frombuffer(regex.sub(pattern, "", every).encode("utf-32-le"), np.uint32)] = kind
    # a probe of two letters, or two digits, is one piece exactly if the pattern takes the code point for one
    glue = {bytes([i]): i for i in range(256)} | {bytes([x, i]): 256 + 256 * k + i for k, x in enumerate(b"a1") for i in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=glue, special_tokens={})
    for c in np.flatnonzero(newer != table):
        table[c] = L if probe.encode_ordinary("a" + chr(c))[0] > 255 else N if probe.encode_ordinary("1" + chr(c))[0] > 255 else O
    table[WHITE] = S
    return table


def _pack(w: int, x: int, a: int, t: int) -> int:
    return w | x << 2 | a << 4 | t << 6


CONST_W, CONST_X = _pack(W, W, W, W), _pack(X, X, X, X)
APOSTROPHE, TWO = _pack(A, X, X, A), _pack(W, W, T2, W)


@functools.cache
def compose_table() -> np.ndarray:
    """compose[f, g]: first f, then g; 256 x 256."""
    f = np.arange(256)
    outs = np.stack([(f >> 2 * s) & 3 for s in range(4)])
    table = np.zeros((256, 256), np.uint8)
    for s in range(4):
        table |= (((f[None, :] >> (2 * outs[s][:, None])) & 3) << (2 * s)).astype(np.uint8)
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of packed transition functions by doubling; only unsettled places go on."""
    acc = functions.copy()
    comp = compose_table().ravel()
    constant = np.zeros(256, bool)
    constant[[_pack(s, s, s, s) for s in range(4)]] = True
    open_ = np.flatnonzero(~constant[acc])
    step = 1
    while open_.size:
        open_ = open_[open_ >= step]
        before = acc[open_ - step].astype(np.uint16)
        now = comp[before << 8 | acc[open_]]
        acc[open_] = now
        open_ = open_[~constant[now]]
        step *= 2
    return acc


def starts_of(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start (boolean by code point), for texts laid end to end.

    doc_starts: the first index of each non-empty text."""
    n = len(points)
    cls = class_table()[points]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    space = points == 0x20
    # the last white-space character of a run that meets a word goes with the word if it is a blank, else alone
    meets = np.flatnonzero((cls[1:] != S) & (cls[:-1] == S) & ~first[1:]) + 1
    start[meets] = ~space[meets - 1]
    start[meets - 1] = True
    start |= first
    apostrophe = points == 0x27
    if apostrophe.any():
        nxt = np.zeros(n, points.dtype)
        nxt[:-1] = points[1:]
        nxt[:-1][first[1:]] = 0
        one = (points == 0x73) | (points == 0x74) | (points == 0x6D) | (points == 0x64)
        two = ((points == 0x72) | (points == 0x76)) & (nxt == 0x65) | (points == 0x6C) & (nxt == 0x6C)
        fun = np.full(n, CONST_W, np.uint8)
        fun[(cls == O) | space] = CONST_X
        fun[two] = TWO
        fun[apostrophe] = APOSTROPHE
        # at a text's start the state is W whatever came before
        at = np.flatnonzero(first)
        after = fun[at] & 3
        fun[at] = after | after << 2 | after << 4 | after << 6
        state = np.zeros(n, np.uint8)
        state[1:] = scan(fun)[:-1] & 3
        state[first] = W
        for suffix, length in ((one, 1), (two, 2)):
            hit = np.flatnonzero((state == A) & suffix)
            start[hit] = False
            end = hit + length
            start[end[end < n]] = True
    return start


class Encoder:
    """Encodes texts by a rank file; bytes of ids are cached by pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache = _Cache(self)

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and linked places: n log n for very long pieces."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        prev = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or not alive[j] or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """For each text its ids (little-endian unsigned 32-bit) and the byte offsets of its pre-tokens."""
        ids, offsets = [], []
        for lo, hi in _spans(texts):
            some = texts[lo:hi]
            joined = "".join(some)
            if not joined:
                ids += [b""] * (hi - lo)
                offsets += [np.zeros(0, np.int64)] * (hi - lo)
                continue
            data = joined.encode()
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, some), np.int64, hi - lo)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            at = np.flatnonzero(starts_of(points, np.unique(begins[lengths > 0])))
            first = np.searchsorted(at, begins)
            last = np.searchsorted(at, ends)
            if len(data) != len(points):
                wide = np.zeros(len(points) + 1, np.int64)
                np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=wide[1:])
                at, begins = wide[at], wide[begins]
            bounds = [*at.tolist(), len(data)]
            words = [data[a:b] for a, b in zip(bounds, bounds[1:])]
            got = list(map(self.cache.__getitem__, words))
            for a, b, begin in zip(first.tolist(), last.tolist(), begins.tolist()):
                ids.append(b"".join(got[a:b]))
                offsets.append(at[a:b] - begin)
        return ids, offsets


class _Cache(dict):
    """Ids by pre-token, two generations of at most CACHE_BYTES, so memory is bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old, self.size = encoder, {}, 0

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = np.array(self.encoder.merge(word), "<u4").tobytes()
        if len(word) <= 64:
            if self.size >= CACHE_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self.size += 180 + len(word) + len(got)
            self[word] = got
        return got


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about BATCH_CHARS."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > BATCH_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder.from_file(path)


@functools.cache
def _pieces(path: str) -> list[bytes]:
    ranks = encoder(path).ranks
    out = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


def encode(df: DataFrame, ranks: str, text: str = "text", with_offsets: bool = True) -> DataFrame:
    """Add ids (binary, little-endian unsigned 32-bit) and offsets (binary, little-endian signed 64-bit: where in
    the UTF-8 bytes each pre-token starts) to every row.  ranks: path of a rank file that every worker can read.

    The column of texts itself is not carried through Python twice: all other columns come back with it."""
    keep = extra_columns(df, {"ids", "offsets"})
    kept = df.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType()), *([T.StructField("offsets", T.BinaryType())] if with_offsets else [])])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for part in slices(batches, at):
            ids, offsets = enc.encode_batch([t or "" for t in part.column(at).to_pylist()])
            more = [pa.array(ids, pa.binary())] + ([pa.array([o.astype("<i8").tobytes() for o in offsets], pa.binary())] if with_offsets else [])
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*keep, "ids", *(["offsets"] if with_offsets else [])])

    return kept.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes (binary) that the ids stand for; null ids give no bytes."""
    keep = extra_columns(df, {out})
    kept = df.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _pieces(ranks).__getitem__
        for part in slices(batches, at):
            got = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*keep, out])

    return kept.mapInArrow(tidy(run), schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded again; digests of both."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, ranks, with_offsets=False).select("doc_id", "ids")
    return decode(ids, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
