"""Packing documents into sequences by the sum-of-squares rule.

A document's ids, closed by an end id, are cut into whole windows and one rest.  Each rest goes to
the fill level of a partially filled window that makes the sum of the squared counts of the levels
smallest (a new window is level 0); the counts stand in one array, so a step is one vectorised
look.  Ties go to the fullest level.

Every task packs its own rows and writes the windows that are full; what stands in open windows, a bounded
number a task, goes on in rounds to fewer packers that place it by the same rule, each about ITEMS pieces, until one
packer is left (or a round leaves more than half of its pieces open).  Only what is open then is cut: the fullest windows
stay as they are and are topped up with the content of the emptiest ones, the last window is cut at powers of two, and so no
sequence needs padding.

Nulls count as empty texts, which still hold the end id.  Repeated rows are packed one by one; an
empty table gives no sequence; other columns are not returned.  A row without doc_id is packed too and
keeps its null.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from ._common import read, ship, slices, tidy, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = f"{PIECES}, ids binary"
ITEMS = 1 << 14  # pieces that one packer gets after the first round


class Packer:
    """Online packing into windows of one size; emits windows when full."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # the level array: open windows by fill
        self.open: list[list] = [[] for _ in range(window)]  # their contents, by level

    def place(self, piece: tuple) -> list | None:
        """piece: (doc, start, ids, doc_tokens), shorter than a window.  Returns a window that is now full."""
        size = len(piece[2])
        n = self.counts[: self.window - size + 1]  # the levels it fits on top of
        grown = 2 * self.counts[size:] + 1
        grown[-1] = 0  # a full window counts no more
        cost = grown - 2 * n + 1
        cost[0] = grown[0]
        cost[1:][n[1:] == 0] = np.iinfo(np.int64).max
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        content = [piece]
        if level:
            content = self.open[level].pop()
            content.append(piece)
            self.counts[level] -= 1
        level += size
        if level == self.window:
            return content
        self.open[level].append(content)
        self.counts[level] += 1
        return None

    def opened(self) -> Iterator[tuple]:
        """The pieces of all open windows, from the fullest window to the emptiest."""
        for level in reversed(self.open):
            for content in level:
                yield from content

    def rest(self) -> Iterator[list]:
        """What is open at the end: the fullest windows, topped up with cuts of the emptiest ones, then powers of two."""
        windows = [content for level in reversed(self.open) for content in level]
        left = sum(len(p[2]) for content in windows for p in content)
        whole = left // self.window
        spare = [p for content in windows[whole:] for p in content]

        def take(size: int, content: list) -> list:
            while size:
                doc, start, ids, total = spare.pop()
                content.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    spare.append((doc, start + size, ids[size:], total))
                size = max(0, size - len(ids))
            return content

        for content in windows[:whole]:
            yield take(self.window - sum(len(p[2]) for p in content), content)
        left %= self.window
        while left:
            size = 1 << left.bit_length() - 1
            yield take(size, [])
            left -= size


@functools.cache
def id_reader(vocabulary: str, ranks: str | None):
    """text -> ids as the tokenizer file gives them.

    With ranks, the same vocabulary as a rank file, ordinary text goes through the faster library;
    texts that hold a special token's string, or that its pattern engine gives up on, do not."""
    import tiktoken
    from public_tokenizers import PATTERN

    @functools.cache
    def slow():  # few texts need it: built on demand
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def by_file(text: str) -> np.ndarray:
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return by_file
    with open(vocabulary, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return by_file(text)
        try:
            return np.array(fast.encode_to_numpy(text), np.uint32)
        except ValueError:  # the pattern engine's backtracking limit, on very long runs of white space
            return np.frombuffer(bpe.encoder(ranks).encode_batch([text])[0][0], "<u4")

    return ids


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document (PIECES).  vocabulary: a tokenizer's JSON file; ranks: the same as a rank file."""
    if window & window - 1:
        raise ValueError("window must be a power of two")
    ship(docs.sparkSession)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Pieces of the documents: whole windows and a rest."""
        ids_of = id_reader(vocabulary, ranks)
        for part in slices(batches, 1):
            pieces = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = np.append(ids_of(text or ""), np.uint32(end_id))
                pieces += [(doc, lo, ids[lo : lo + window], len(ids)) for lo in range(0, len(ids), window)]
            yield pieces

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Pieces that an earlier round left open."""
        for part in slices(batches, 3):
            yield [(doc, lo, np.frombuffer(ids, "<u4"), total) for doc, lo, total, ids in zip(*(c.to_pylist() for c in part.columns))]

    table = written(docs.select("doc_id", "text").mapInArrow(_round(tokens, window, 0, False), OPEN))
    done = table.where("ids is null").drop("ids")
    before = number = 0
    while items := (left := table.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids")).count():
        packers = -(-items // ITEMS)
        last = packers == 1 or 0 < before < 2 * items  # pieces that cannot fill windows would go round for ever
        before, number = items, number + 1
        table = written(left.repartition(packers).mapInArrow(_round(again, window, number, last), OPEN))
        done = done.unionByName(table.where("ids is null").drop("ids"))
    return done


def _round(pieces_of, window: int, number: int, last: bool):
    """A round of packing, rows to rows: full windows as PIECES, and with their ids the pieces that it leaves open (none in the last round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window)
        base, made = number << 59 | TaskContext.get().partitionId() << 34, 0
        rows: list[tuple] = []

        def emit(content: list) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in content:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base | made, at, None))
                at += len(ids)
            made += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=[f.split()[0] for f in OPEN.split(", ")])

        for pieces in pieces_of(batches):
            for piece in pieces:
                full = [piece] if len(piece[2]) == window else packer.place(piece)
                if full:
                    emit(full)
            yield out()
        if last:
            for content in packer.rest():
                emit(content)
        else:
            for doc, start, ids, total in packer.opened():
                rows.append((doc, start, len(ids), None, total, None, None, ids.astype("<u4").tobytes()))
                if len(rows) >= 1024:
                    yield out()
        yield out()

    return tidy(run)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers as tokenizers

    return pack(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return stage(spark, read(spark, sf_dir, "documents"), sf_dir)


QUERIES = {"op4_packing": op4_packing}
