"""Conversation structure repair: the cheapest edits, by dynamic programming over a shared prefix trie.

A repaired conversation is empty or an optional system row and then user and assistant in turn.  Every
row has a signature symbol: its role's kind (system, user, assistant, other, told by the initial) and its first fault (blank, duplicate,
truncated, none).  A conversation's signature is one symbol a row.  Distinct signatures are dealt in ranges and
sorted; walking through them in that order is walking through their prefix trie, so the layer of the program (least cost
by what the grammar expects next) is worked out once for every shared prefix.  Layers are kept relative to their least
cost, and costs that no cheapest way can go through (over SLACK more) as unreachable: then there are few different layers, a place in the trie is
two bytes, and a step is a lookup.  At a terminal node the cheapest ways are marked from the end, and the first of them
in ASCII order is read off from the beginning.

Rows are in the order of turn (nulls first), then role, then the MD5 of the text; equal rows are neighbours.  Whether a row repeats
an earlier one is told by joining counts, and signatures are put together from the pieces of sorted ranges: a
conversation of any length is spread over tasks until only one byte a row is left of it.  The repaired rows themselves are made in one pass
over rows sorted by conversation, which begins with the conversation's edits and holds one batch at a time.

Null conversation ids are one conversation; null roles and texts read as one space, as do nulls in the damage's key.  A conversation
without rows costs nothing.  Texts of any length are handled whole.  An empty table gives no rows.  Only the
four named columns are used, whatever others there are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop, read, ship, slices, tidy, written

SPACE = r"[^\x20\x09-\x0D]"
TRIM = " \t\n\x0b\x0c\r"
KINDS = "sua"  # others are kind 3
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
SYMBOLS = "ABCDEFGHIJKLMNOP"  # 4 x kind + fault
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row of the repaired conversation is
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Any state can follow the ways of any other for less: the system row deleted (3) and at most two rows inserted (4).
SLACK = 8
FAR = 1 << 40
ENDS = (START, ASSISTANT)

Layer = tuple[int, int, int, int]


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Edits of a row, by initial: D, K, R with their costs and the state after."""
    kind, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault in (CLEAN, TRUNCATED):
        if (state, kind) in KEEP:
            out.append(("K", CUT * (fault == TRUNCATED), KEEP[state, kind]))
        out.append(("R", REROLE + CUT * (fault == TRUNCATED), NEXT[state]))
    return out


class Repair:
    """The trie walk: layers are numbered, and what follows from a number is worked out once."""

    def __init__(self) -> None:
        self.layers: list[Layer] = []
        self.number: dict[Layer, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.backs: dict[tuple[int, int, int], int] = {}
        self.walks: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        first, _ = self._named([0, FAR, FAR, FAR])
        self.path, self.costs, self.before = array("H", [first]), array("q", [0]), ""

    def _named(self, raw: list[int]) -> tuple[int, int]:
        """The number of a layer and its least cost, rows inserted where that is cheaper."""
        raw = list(raw)
        for at in (USER, ASSISTANT, USER):
            raw[at] = min(raw[at], *(raw[s] + INSERT for s in range(4) if NEXT[s] == at))
        least = min(raw)
        layer = tuple(c - least if c - least <= SLACK else FAR for c in raw)
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer], least

    def _step(self, at: int, symbol: int) -> tuple[int, int]:
        key = at, symbol
        if key not in self.steps:
            raw = [FAR] * 4
            for state, cost in enumerate(self.layers[at]):
                if cost < FAR:
                    for _, more, to in edits(state, symbol):
                        raw[to] = min(raw[to], cost + more)
            self.steps[key] = self._named(raw)
        return self.steps[key]

    def _closed(self, layer: Layer, marks: int) -> int:
        """The marked states and those from which an insert leads to one as cheaply."""
        for _ in range(2):
            for s in range(4):
                if layer[s] < FAR and marks >> NEXT[s] & 1 and layer[s] + INSERT == layer[NEXT[s]]:
                    marks |= 1 << s
        return marks

    def _back(self, at: int, symbol: int, marks: int) -> int:
        """States of layer `at` on a cheapest way to the marked ones of the next layer."""
        key = at, symbol, marks
        if key not in self.backs:
            to, grown = self._step(at, symbol)
            here, there, out = self.layers[at], self.layers[to], 0
            for s in range(4):
                if here[s] < FAR and any(marks >> x & 1 and here[s] + more == there[x] + grown for _, more, x in edits(s, symbol)):
                    out |= 1 << s
            self.backs[key] = self._closed(here, out)
        return self.backs[key]

    def _walk(self, at: int, symbol: int, marks: int, after: int, state: int) -> tuple[str, int]:
        """The ASCII-least edits from `state` until the row is consumed, and the state then."""
        key = at, symbol, marks, after, state
        if key not in self.walks:
            to, grown = self._step(at, symbol)
            here, there, said, s = self.layers[at], self.layers[to], "", state
            while True:
                ways = [(e, x, True) for e, more, x in edits(s, symbol) if after >> x & 1 and here[s] + more == there[x] + grown]
                if marks >> NEXT[s] & 1 and here[s] + INSERT == here[NEXT[s]]:
                    ways.append(("I", NEXT[s], False))
                edit, s, done = min(ways)
                said += edit
                if done:
                    break
            self.walks[key] = said, s
        return self.walks[key]

    def answer(self, signature: str) -> tuple[int, str]:
        """The least cost and the audit of a signature; cheapest when signatures come in sorted order."""
        shared = 0
        for a, b in zip(signature, self.before):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :], self.costs[shared + 1 :]
        symbols = [ord(c) - 65 for c in signature]
        for x in symbols[shared:]:
            to, grown = self._step(self.path[-1], x)
            self.path.append(to)
            self.costs.append(self.costs[-1] + grown)
        self.before = signature
        last = self.layers[self.path[-1]]
        best = min(last[s] for s in ENDS)
        marks = bytearray(len(symbols) + 1)
        marks[-1] = self._closed(last, sum(1 << s for s in ENDS if last[s] == best))
        for i in range(len(symbols) - 1, -1, -1):
            marks[i] = self._back(self.path[i], symbols[i], marks[i + 1])
        said, state = [], START
        for i, x in enumerate(symbols):
            text, state = self._walk(self.path[i], x, marks[i], marks[i + 1], state)
            said.append(text)
        while not (state in ENDS and last[state] == best):
            said.append("I")
            state = NEXT[state]
        return self.costs[-1] + best, "".join(said)


ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def answers(signatures: DataFrame) -> DataFrame:
    """Counts of faults, the least cost and the ASCII-least cheapest audit of every distinct signature (column `signature`)."""
    legal = {(0, 1), (1, 2), (2, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Repair()
        for batch in slices(batches, 0):
            out = []
            for s in batch.column(0).to_pylist():
                faults = [0] * 4
                for c in set(s):
                    faults[(ord(c) - 65) % 4] += s.count(c)
                row = [(ord(c) - 65) // 4 for c in s]
                illegal = sum((a, b) not in legal for a, b in zip(row, row[1:]))
                out.append((s, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, *trie.answer(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 6) else pa.int64()) for i, c in enumerate(zip(*out))], names=[x.split()[0] for x in ANSWER.split(", ")])

    ship(signatures.sparkSession)
    return signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(tidy(run), ANSWER)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The test damage: by crc32 of `conv:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes it the user's."""
    of = F.crc32(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in (conv, ":", turn)]).cast("binary")) % 20
    said, who = F.coalesce(text, F.lit(" ")), F.coalesce(role, F.lit(" "))
    return (
        df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"), of.alias("of"))
        .where("of != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("of") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("of") == 1, "").when(F.col("of") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("of") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


class Found:
    """What `diagnose` gives: rows in the form the repair takes, and a report a conversation (conv_id, gaps, faults, illegal, cost, audit)."""

    def __init__(self, rows: DataFrame, report: DataFrame):
        self.rows, self.report = rows, report


def diagnose(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Found:
    """Faults, gaps of turns, and the cheapest repair of every conversation that has rows."""
    ship(df.sparkSession)
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    last = F.right(F.rtrim("text", F.lit(TRIM)), F.lit(1))
    fault = F.when(~F.col("text").rlike(SPACE), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    counted = rows.select("conv_id", "turn", "role", "digest", fault.alias("fault")).groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("times"))
    first = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.role") == F.col("r.role")) & (F.col("l.digest") == F.col("r.digest"))
    told = counted.alias("l").join(first.alias("r"), same).select("l.*", F.col("l.turn").eqNullSafe(F.col("r.first.turn")).alias("is_first"))
    kind = F.when(F.col("role") == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(KINDS), F.left("role", F.lit(1))), F.lit(0)) - 1, F.lit(3)))
    symbol = lambda of: F.substring(F.lit(SYMBOLS), kind * 4 + of + 1, F.lit(1))
    again = symbol(F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE))
    piece = F.concat(F.when(F.col("is_first"), symbol(F.col("fault"))).otherwise(again), F.repeat(again, (F.col("times") - 1).cast("int")))
    order = ["conv_id", "turn", "role", "digest"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = told.select(*order, piece.alias("piece")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "piece")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One piece for each conversation of this range."""
        at, own, held = TaskContext.get().partitionId(), [], None

        def out(ids: list, pieces: list[str], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([at] * len(ids), pa.int32()), pa.array(pieces, pa.string())], names=["conv_id", "part", "piece"])

        for batch in batches:
            ids, done, whole = batch.column(0).to_pylist(), [], []
            for c, p in zip(ids, batch.column(1).to_pylist()):
                if held is not None and held[0] != c:
                    done.append(held[0])
                    whole.append("".join(own))
                    own = []
                held = (c, batch.schema.field(0).type)
                own.append(p)
            if done:
                yield out(done, whole, held[1])
        if held is not None:
            yield out([held[0]], ["".join(own)], held[1])

    named = T.StructType([rows.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType())])
    ordered = F.array_sort(F.collect_list(F.struct("part", "piece")))
    signed = written(told.mapInArrow(tidy(join_up), named).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("signature")))
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    solved = signed.join(answers(signed), "signature").alias("l").join(turns.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")))
    report = written(solved.select("l.conv_id", "r.gaps", *[f"l.{x}" for x in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]))
    drop(signed)
    return Found(rows, report)


def repaired(found: Found) -> DataFrame:
    """The rows of every repaired conversation: conv_id, position (from 0), edit (K, R or I), role, text; a conversation's rows come one after another in one partition."""
    rows = found.rows.select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "digest", "text")
    plans = found.report.select("conv_id", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    both = rows.unionByName(plans).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest").select("conv_id", "is_row", "role", "text")
    named = T.StructType([both.schema["conv_id"], T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv, kind_of = "", 0, START, 0, None, pa.int64()
        out: list[tuple] = []

        def put(edit: str, to: int, role: str, text: str) -> None:
            nonlocal state, place
            state = to
            out.append((conv, place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", NEXT[state], ROLES[NEXT[state]], "")
                at += 1

        def given() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind_of), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], names=named.names)

        for part in slices(batches, 3):
            kind_of = part.schema.field(0).type
            for c, is_row, role, text in zip(*(x.to_pylist() for x in part.columns)):
                if not is_row:
                    inserts()
                    audit, at, state, place, conv = text, 0, START, 0, c
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put("K", KEEP[state, KINDS.find(role[:1]) if role else 3], role, text)
                elif edit == "R":
                    put("R", NEXT[state], ROLES[NEXT[state]], text)
            if out:
                yield given()
                out.clear()
        inserts()
        if out:
            yield given()

    return both.mapInArrow(tidy(run), named)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text` joined by line feeds; rows: as `repaired` gives them, not shuffled since."""
    named = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind = None, None, None
        for batch in batches:
            ids, shas = [], []
            kind = batch.schema.field(0).type
            for c, at, role, text in zip(*(batch.column(j).to_pylist() for j in (0, 1, 3, 4))):
                if not at:
                    if sha:
                        ids.append(conv)
                        shas.append(sha.hexdigest())
                    conv, sha = c, hashlib.sha256()
                sha.update(f"{role}:{text}".encode() if not at else f"\n{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas, pa.string())], names=named.names)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()], pa.string())], names=named.names)

    return rows.select("conv_id", "position", "edit", "role", "text").mapInArrow(tidy(run), named)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage: its faults, the cheapest repair, and the digest of what that gives."""
    table = read(spark, sf_dir, "conversations")
    found = diagnose(damage(table))
    every = table.select("conv_id").distinct()
    hashed = digests(repaired(found))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    with_report = every.alias("e").join(found.report.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select("e.conv_id", *[F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("r.audit", F.lit("")).alias("audit"))
    return (
        with_report.alias("a")
        .join(hashed.alias("h"), F.col("a.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
        .select("a.*", F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    )


def _sql() -> str:
    """The same as SQL: the program runs over the rows from the last to the first, with cost and audit in one string that sorts by both."""
    more = lambda v, cost, edit: f"(lpad(CAST(CAST({v}[:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || {v}[10:])"
    names = ("v0", "vs", "vu", "va")

    def row(state: int) -> str:
        ways = [more(names[state], DELETE, "D")]
        ways.append(f"CASE WHEN fault < 2 THEN {more(names[NEXT[state]], f'({REROLE} + {CUT} * fault)', 'R')} END")
        for (of, kind), to in KEEP.items():
            if of == state:
                ways.append(f"CASE WHEN fault < 2 AND kind = {kind} THEN {more(names[to], f'{CUT} * fault', 'K')} END")
        return f"least({', '.join(ways)})"

    return f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
        named AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        of AS (SELECT * EXCLUDE (key), xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(key)), lambda i: CAST(ascii(substr(key, i + 1, 1)) AS BIGINT))),
                                           lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256]))) % 20 AS how FROM named, crc),
        hurt AS (SELECT c, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM of WHERE how <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
        told AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM placed),
        faulty AS (SELECT c, i, turn, role, text, CASE WHEN body = '' THEN {BLANK} WHEN seen > 1 THEN {DUPLICATE} WHEN right(body, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {CLEAN} END AS fault,
                          CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM told),
        counts AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = {BLANK}) AS blank,
                          count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate, count(*) FILTER (WHERE fault = {TRUNCATED}) AS truncated,
                          count(*) FILTER (WHERE i > 1 AND (before || left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
        dp(c, i, v0, vs, vu, va) AS (
            SELECT c, n, '000000000', '000000004II', '000000002I', '000000000' FROM counts
            UNION ALL
            SELECT c, i, least(b0, {more("u", INSERT, "I")}), least(bs, {more("u", INSERT, "I")}), u, least(ba, {more("bu", INSERT, "I")})
            FROM (SELECT *, least(bu, {more("ba", INSERT, "I")}) AS u
                  FROM (SELECT dp.c, dp.i - 1 AS i, {row(START)} AS b0, {row(SYSTEM)} AS bs, {row(USER)} AS bu, {row(ASSISTANT)} AS ba FROM dp JOIN faulty f ON f.c = dp.c AND f.i = dp.i))),
        best AS (SELECT c, CAST(v0[:9] AS BIGINT) AS cost, v0[10:] AS audit FROM dp WHERE i = 0),
        steps AS (SELECT c, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS p FROM best WHERE audit <> ''),
        made AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY p) AS i, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY p) AS o FROM steps),
        kept AS (SELECT m.c, m.p, m.edit, m.o, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
                        max(CASE WHEN o = 1 AND edit = 'K' AND f.kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m.c) AS led
                 FROM made m LEFT JOIN faulty f ON f.c = m.c AND f.i = m.i WHERE edit <> 'D'),
        said AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM kept GROUP BY c)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, c FROM named) e LEFT JOIN counts ON counts.c = e.c LEFT JOIN best ON best.c = e.c LEFT JOIN said ON said.c = e.c"""


ORACLES = {"op12_repair": _sql()}
QUERIES = {"op12_repair": op12_repair}
