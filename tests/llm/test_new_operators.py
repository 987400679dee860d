"""Line dedup, conversation repair and whitening against SQL, brute force and exact arithmetic, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
from fractions import Fraction
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from impactlake import llm
from impactlake.llm import conversations, linededup, whitening

CLASH = "n_lines int, n_dropped int, hi long, _batch int, at int"
CONV = "conv_id long, turn long, role string, text string, audit string, digest int, copy int, is_row string"
LINES = ["Shared line", "  shared LINE\t", "ÄRGER", "ärger", "", " ", "Other shared.", "x"]


def texts(n=60, seed=3):
    r = random.Random(seed)
    out = [(i, "\n".join(r.choice(LINES) if r.random() < 0.5 else f"own {r.randint(0, 400)}" for _ in range(r.randint(0, 12)))) for i in range(n)]
    return [*out, (100, None), (101, ""), (102, "\n\n"), (103, "Shared line"), (103, "Shared line"), (None, "shared line\nkept"), (None, None), (104, "y" * 300_000 + "\nx\r\nSHARED LINE\x0b"), (105, "x" + " y" * 70_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, 3, 4, 5) for x in rows], f"doc_id long, text string, {CLASH}").repartition(3)


def plain(rows, min_docs=10, min_chars=1):
    key = lambda v: v.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held: dict[str, int] = {}
    for _, t in rows:
        for k in {key(v) for v in (t or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
    bad = {k for k, n in held.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [v for v in every if key(v) not in bad]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few,min_docs,min_chars", [(linededup.FEW, 10, 1), (0, 10, 1), (0, 5, 6), (linededup.FEW, 1, 1)])
def test_lines_equal_brute_force(spark, few, min_docs, min_chars):
    rows = texts()
    got = linededup.dedup_lines(frame(spark, rows), min_docs=min_docs, min_chars=min_chars, few=few)
    assert set(got.columns) == {"doc_id", "text", "n_lines", "n_dropped", "hi", "_batch", "at"}
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got.collect()), key=repr) == plain(rows, min_docs, min_chars)
    assert {(x.hi, x._batch, x.at) for x in got.collect()} == {(3, 4, 5)}


def test_runs_are_sorted_levelled_and_opened_again(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    runs = linededup.Runs(spark, folder, fan=3)
    want: dict[tuple[int, int], int] = {}
    r = random.Random(1)
    for b in range(8):
        batch = {(r.randint(-50, 50), 0): r.randint(1, 4) for _ in range(30)}
        runs.add(spark.createDataFrame([(*k, n) for k, n in batch.items()], linededup.RUN))
        for k, n in batch.items():
            want[k] = want.get(k, 0) + n
        assert all(len(level) < 3 for level in runs.levels)
    again = linededup.Runs(spark, folder, fan=3)
    assert again.levels == runs.levels and len(again.levels) == 2 and len(again.levels[1]) == 2
    assert {(x.hi, x.lo): x.n for x in again.table().groupBy("hi", "lo").agg(F.sum("n").alias("n")).collect()} == want
    assert {(x.hi, x.lo) for x in again.frequent(9).collect()} == {k for k, n in want.items() if n >= 9}
    for f in tmp_path.glob("runs/run-*/part-*.parquet"):
        his = [x[0] for x in duckdb.sql(f"select hi from '{f}'").fetchall()]
        assert his == sorted(his)
    seen = spark.createDataFrame([(999, 0), *want], "hi long, lo long")
    assert [tuple(x) for x in again.unseen(seen).collect()] == [(999, 0)]
    plan = again.unseen(seen)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_runs_after_a_lost_write(spark, tmp_path, monkeypatch):
    """A batch whose writing or whose manifest is lost leaves the last whole state."""
    folder = f"file://{tmp_path}/runs"
    one = spark.createDataFrame([(1, 1, 1)], linededup.RUN)
    runs = linededup.Runs(spark, folder, fan=2)
    runs.add(one)
    runs.add(one)  # compacted
    monkeypatch.setattr(linededup.Runs, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        runs.add(one)
    monkeypatch.undo()
    again = linededup.Runs(spark, folder, fan=2)
    assert [x.n for x in again.table().collect()] == [2]
    again.add(one)
    assert len(again.frequent(3).collect()) == 1 and not again.frequent(4).collect()


def test_settled_lines_are_not_added_again(spark, tmp_path):
    runs = linededup.Runs(spark, f"file://{tmp_path}/runs")
    runs.add(spark.createDataFrame([(1, 1, 12), (2, 2, 9)], linededup.RUN), settled=10)
    runs.add(spark.createDataFrame([(1, 1, 5), (2, 2, 1)], linededup.RUN), settled=10)
    assert sorted((x.hi, x.n) for x in runs.table().collect()) == [(1, 12), (2, 1), (2, 9)]
    assert sorted(x.hi for x in runs.frequent(10).collect()) == [1, 2]


def as_table(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


def same(got, want):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda p: sorted(repr([None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r]).replace(".0,", ",").replace(".0]", "]") for r in p[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_op11_equals_sql(spark, tmp_path):
    con = as_table(spark, [(*x, 1, 2, 3, 4, 5) for x in texts()], f"doc_id long, text string, {CLASH}", tmp_path, "documents")
    same(llm.queries()["op11_linededup"](spark, str(tmp_path)).toPandas(), con.execute(llm.oracle_sql()["op11_linededup"]).df())


def talk(n=250, seed=9):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.2 else r.choice(["system", "tool", "", None]) if r.random() < 0.15 else ("user", "assistant")[turn % 2]
            text = r.choice(["", " \t", "Again.", "cut", None, "ends!  ", "a\nb?", "😀 ok."]) if r.random() < 0.4 else f"Text {r.random()}."
            out.append((c, None if r.random() < 0.05 else turn * r.choice([1, 1, 1, 2]), role, text))
    out += [(None, t, "user", f"n{t}.") for t in range(5)] + [(None, None, "assistant", "x")] * 3 + [(900, 1, "user", "tie a."), (900, 1, "user", "tie b."), (900, 1, "user", "tie a.")]
    out += [(901, t, ("user", "assistant")[t % 2], f"long {t} " + "w" * (100_000 if t == 3 else 5) + ".") for t in range(300)]
    return [(*x, "z", 1, 2, "q") for x in out]


def test_op12_equals_sql(spark, tmp_path):
    con = as_table(spark, talk(), CONV, tmp_path, "conversations")
    got = llm.queries()["op12_repair"](spark, str(tmp_path)).toPandas()
    assert len(got) == 253
    same(got, con.execute(llm.oracle_sql()["op12_repair"]).df())
    assert {"D", "I", "K", "R"} <= set("".join(got.audit)) and got.duplicate.sum() and got.truncated.sum() and got.blank.sum() and got.gaps.sum() and got.illegal.sum()


def test_op12_of_conversations_that_lose_all_rows(spark, tmp_path):
    import zlib

    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    spark.createDataFrame([(c, 0, "user", "Hi.", "z", 1, 2, "q") for c in gone], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    for x in llm.queries()["op12_repair"](spark, str(tmp_path)).collect():
        assert (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def search(signature):
    """Cheapest and then ASCII-least edits by trying all of them from the end."""
    rows = [divmod(ord(c) - 65, 4) for c in signature]
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            kind, fault = "sua?"[rows[i][0]], rows[i][1]
            ways.append((3, "D", best(i + 1, state, 0)))
            if fault < 2:
                if kind == after[state] or kind == "s" and not state:
                    ways.append((fault, "K", best(i + 1, kind, 0)))
                ways.append((2 + fault, "R", best(i + 1, after[state], 0)))
        if inserted < 4:
            ways.append((2, "I", best(i, after[state], inserted + 1)))
        return min((w if len(w) == 2 else (w[0] + w[2][0], w[1] + w[2][1]) for w in ways), default=(10**9, ""))

    return best(0, "", 0)


def test_trie_answers_equal_a_search(spark):
    r = random.Random(5)
    some = {"".join(r.choice(conversations.SYMBOLS if r.random() < 0.5 else "ABEFIJ") for _ in range(r.randint(0, 9))) for _ in range(4000)}
    some |= {"".join(r.choice("EEEEIAB") for _ in range(150)) for _ in range(20)} | {"A" * 30, "E" * 40, "I" * 40, "N" * 20, "AEI" * 20}
    trie, other = conversations.Repair(), conversations.Repair()
    want = {s: search(s) for s in some}
    assert {s: trie.answer(s) for s in sorted(some)} == want
    assert {s: other.answer(s) for s in r.sample(sorted(some), len(some))} == want  # sharing saves work, the order changes nothing
    rows = conversations.answers(spark.createDataFrame([(s,) for s in some] * 2, "signature string")).collect()
    assert {x.signature: (x.cost, x.audit) for x in rows} == want and len(rows) == len(some)


def test_layers_of_shared_prefixes_are_worked_out_once():
    class Counting(conversations.array):
        added = 0

        def append(self, x):
            Counting.added += 1
            super().append(x)

    trie, added = conversations.Repair(), []
    trie.path = Counting("H", trie.path)
    for s in sorted(["EIEIEI" * 50 + t for t in ("E", "EI", "I", "J")]):
        Counting.added = 0
        trie.answer(s)
        added.append(Counting.added)
    assert added == [301, 1, 1, 1]


def test_repaired_rows_follow_the_grammar_and_keep_their_texts(spark):
    found = conversations.diagnose(spark.createDataFrame(talk(), CONV))
    rows = conversations.repaired(found).collect()
    by: dict = {}
    for x in rows:
        by.setdefault(x.conv_id, []).append(x)
    given: dict = {}
    for c, _, _, t, *_ in talk():
        given.setdefault(c, set()).add(" " if t is None else t)
    for c, own in by.items():
        own.sort(key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own)))
        kinds = "".join(x.role[:1] for x in own).removeprefix("s")
        assert kinds and kinds == "ua" * (len(kinds) // 2)
        assert all(x.text == "" if x.edit == "I" else x.text in given[c] for x in own)
    audits = {x.conv_id: x.audit for x in found.report.collect()}
    assert all("".join(x.edit for x in own) == audits[c].replace("D", "") for c, own in by.items())


VEC = "vec_id long, embedding array<float>, n string, whitened int, other int"


def vectors(dim=12, n=150, seed=4):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(dim, dim))
    out = [(i, (r.normal(size=dim) @ mix).tolist()) for i in range(n)]
    out += [(n, out[0][1]), (n, out[0][1]), (None, out[1][1]), (n + 1, None), (n + 2, []), (n + 3, [float("nan")] * dim), (n + 4, [None] * dim), (n + 5, [float("inf"), *[0.0] * (dim - 1)])]
    return [(*x, "z", 3, 4) for x in out]


def test_op13_equals_exact_arithmetic(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, VEC).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = llm.queries()["op13_whitening"](spark, str(tmp_path)).toPandas()
    whole = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, dim = len(whole), 12
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    sums = [sum(v[j] for _, v in whole) for j in range(dim)]
    deviation = {i: sum((n * x - s) ** 2 for x, s in zip(v, sums)) for i, v in whole}
    assert all(d == deviation[None if i != i else int(i)] for i, d in zip(got.vec_id, got.deviation))
    exact = [[Fraction(x) - Fraction(s, n) for x, s in zip(v, sums)] for _, v in whole]
    cov = np.array([[float(sum(a[i] * a[j] for a in exact) / n) for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = {i: np.array([float(c) for c in a]) @ axes[:, :8] / np.sqrt(values[:8]) for (i, _), a in zip(whole, exact)}
    for k in range(1, 9):
        one = got[got.component == k]
        assert one.explained.to_numpy() == pytest.approx(values[k - 1] / values.sum(), rel=1e-12)
        a, b = one.whitened.to_numpy(), np.array([want[None if i != i else int(i)][k - 1] for i in one.vec_id])
        assert a * np.sign(a @ b) == pytest.approx(b, abs=1e-9)


def test_sums_of_products_are_right_beyond_doubles():
    """Double-double keeps what doubles lose: products of 2^53 in size whose sum is small."""
    r = np.random.default_rng(2)
    x = r.integers(-(1 << 40), 1 << 40, size=(301, 5)).astype(float)
    x = np.concatenate([x, -x[:, ::-1] + r.integers(-3, 4, size=x.shape)])
    acc = whitening.Products(5)
    for part in (x[:100], x[100:101], x[101:]):
        acc.add(part, np.zeros_like(part))
    for hi, lo, i, j in zip(*acc.sum, acc.left, acc.right):
        want = sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))
        assert abs(Fraction(hi) + Fraction(lo) - want) <= abs(want) * Fraction(1, 1 << 95) + 1


def test_eigenvectors_of_close_values():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(30, 30)))[0]
    values = np.concatenate([[1e6, 5.0, 5.0 + 1e-7], np.linspace(1, 2, 27)])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.eigen(v, np.zeros_like(v))
    assert got == pytest.approx(np.sort(values)[::-1], rel=1e-9) and np.abs(x.T @ x - np.eye(30)).max() < 1e-12
    assert np.abs(v @ x - x * got).max() < 1e-8


@pytest.mark.parametrize("rows,none", [([(1, [1.0, 2.0, 3.0])], 3), ([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0, 2.0])], 1), ([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [4.0, 4.0])], 1)])
def test_components_without_variance_are_null(spark, tmp_path, rows, none):
    spark.createDataFrame([(*x, "z", 3, 4) for x in rows], VEC).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = llm.queries()["op13_whitening"](spark, str(tmp_path)).toPandas()
    dim = len(rows[0][1])
    assert len(got) == dim * len(rows) and got.whitened.isna().sum() == none * len(rows)
    assert got.identity_error.isna().all() if none == dim else got.identity_error.max() < 1e-9


def test_lengths_are_spaces_of_their_own_and_extra_columns_stay(spark):
    rows = [(i, [float(i % 7), float(i * i % 5)], "z", 3, 4) for i in range(20)] + [(100 + i, [float(i), 1.0, float(-i * i % 3)], "z", 3, 4) for i in range(9)]
    df = spark.createDataFrame(rows, VEC)
    spaces = whitening.fit(df)
    assert [(s.dim, s.n) for s in spaces] == [(2, 20), (3, 9)]
    got = whitening.whiten(df, spaces).collect()
    assert len(got) == 29 and {x.other for x in got} == {4} and {x.n for x in got} == {20, 9}
    errors = whitening.identity_error(df, spaces, 8)
    assert set(errors) == {2, 3} and all(e < 1e-12 for e in errors.values())


def test_entries_beyond_a_long_are_named(spark):
    df = spark.createDataFrame([(7, [1e30], "z", 3, 4)], VEC)
    with pytest.raises(Exception, match="beyond a long"):
        whitening.fit(df)
