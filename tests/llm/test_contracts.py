"""The ten queries as the driver calls them: every contract column against plain Python or SQL, on small tables with nulls, empty and long
texts, ties, repeated texts and columns whose names clash; and all of them on empty tables."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from impactlake import llm

from .test_operators import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, SHARD int, _arc int, _toxicity double, _lang_pred string, _Lang_Score string, _routes int, component_id long, size long, sequence_id long, ids binary"
PAGES = "page_id long, url string, html string, TEXT string, sha1 string, payload string, record_type int"
VECTORS = "vec_id long, embedding array<float>, label int, rank int, SCORE int, _q boolean"
LABELS = "doc_id long, quality int, toxic int, text string"
SPANISH = "el la de que y en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir otro ese".split()


def documents():
    r = random.Random(21)
    out = []
    for i in range(150):
        spanish = i % 3 == 0
        t = " ".join(r.choice(SPANISH) for _ in range(r.randint(15, 90))) if spanish else prose(r, r.randint(15, 90))
        if i % 4 == 1:
            t += " vilecreature rottenscum " + prose(r, 8)
        out.append((i, t, "es" if spanish else "en"))
    base = prose(r, 120)
    out += [(200 + i, base.replace("the", f"the{i}", 1), "en") for i in range(6)] + [(210, base, "en"), (211, base, None)]
    out += [(220, None, "en"), (221, "", None), (222, " \n\t", "en"), (223, "one two", "en"), (224, "ONE  two", "en"), (225, "12345 !!", "en"), (226, prose(r, 30000), "en"), (227, "x" * 50000, None), (228, "<|endoftext|> it's é中😀", "en")]
    out += [(229, "Съешь ещё этих мягких французских булок", None), (230, "Ok", None), (231, base64.b64encode(r.randbytes(300)).decode(), None), (232, "日本語の文章です", None)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = documents()
    extra = (0.5, 1, 2, 0.1, "x", "y", 3, 4, 5, 6, b"z")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), *extra) for i, t, lang in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 1), "clash") for i, _, _ in docs if i < 150] + [(None, 1, 1, None), (9999, 0, None, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    pages = [(i, f"http://h/{i % 5}", f"<html><body><nav><a href=/>Home</a> <a href=/a>About us</a></nav><article><h1>Head {i % 7}</h1><p>Some prose &amp; words, number {i % 7}, stand here for all.</p></article></body></html>", "t", "s", "p", 1) for i in range(40)]
    pages += [(100, None, None, None, None, None, None), (101, "http://h/ä b", "", "t", "s", "p", 1), (102, "u", "<p>" + "long words. " * 40000 + "</p>", "t", "s", "p", 1)]
    spark.createDataFrame(pages, PAGES).repartition(3).write.parquet(f"{folder}/pages.parquet")
    r = np.random.default_rng(2)
    vectors = [(i, r.normal(size=12).round(2).tolist(), 0, 1, 2, True) for i in range(120)] + [(150, [1.0] * 12, 0, 1, 2, True), (151, [1.0] * 12, 0, 1, 2, True), (200, None, 0, 1, 2, False), (250, [float("nan")] * 12, 0, 1, 2, False), (300, [None] * 12, 0, 1, 2, False)]
    spark.createDataFrame(vectors, VECTORS).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("pages", PAGES), ("embeddings", VECTORS), ("conversations", "conv_id long, turn long, role string, text string, audit string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows_of(spark, tables, name):
    return llm.queries()[name](spark, tables).collect()


def by_sql(tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    return con.execute(llm.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", ["op1_topk", "op5_minhash", "op10_warc"])
def test_queries_with_sql(spark, tables, name):
    got, want = llm.queries()[name](spark, tables).toPandas(), by_sql(tables, name)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda p: sorted(repr([None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in row]).replace(".0", "") for row in p[sorted(p.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_op2(spark, tables):
    got = {x["page_id"]: x for x in rows_of(spark, tables, "op2_html")}
    assert len(got) == 43
    for i in range(40):
        assert got[i]["text"] == f"Head {i % 7}\nSome prose & words, number {i % 7}, stand here for all." and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == f"http://h/{i % 5}"
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == ("long words. " * 40000).strip()


def test_op3(spark, tables):
    import tiktoken

    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x["doc_id"]: x for x in rows_of(spark, tables, "op3_byte_bpe")}
    assert len(got) == len(documents())
    for i, t, _ in documents():
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op4(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    p = llm.queries()["op4_packing"](spark, tables).toPandas()
    texts = {i: t or "" for i, t, _ in documents()}
    assert set(p.doc_id) == set(texts)
    for doc, g in p.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        g = g.sort_values("start")
        assert (g["start"].values == np.cumsum([0, *g["length"]])[:-1]).all() and g["length"].sum() == len(ids) and (g["doc_tokens"] == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in g[["start", "length", "ids_crc32"]].itertuples(index=False))
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = int(g["length"].sum())
        assert (g["offset"].values == np.cumsum([0, *g["length"]])[:-1]).all() and n <= 1024 and n & n - 1 == 0


def test_op6(spark, tables):
    p = llm.queries()["op6_sharding"](spark, tables).toPandas()
    texts = {i: (t or "").encode() for i, t, _ in documents()}
    assert len(p) == len(texts) and set(p["law"]) == {"rows"} and p["grown_shard"].isna().all() and set(p["shard"]) == set(range(40))
    assert all(len(texts[d]) + 16 == s and zlib.crc32(texts[d]) == c for d, s, c in p[["doc_id", "size", "text_crc32"]].itertuples(index=False))
    counts = p.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in p.groupby("shard"))


def test_op7(spark, tables):
    got = {x["doc_id"]: x for x in rows_of(spark, tables, "op7_fingerprint")}
    docs = [(i, t or "") for i, t, _ in sorted(documents())]
    assert len(got) == len(docs)
    prints = {}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        x = got[i]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        prints.setdefault(t, set()).add(x["fingerprint"])
        prints.setdefault(edited, set()).add(x["edited_fingerprint"])
        if len(t.split()) > 12:
            assert x["near_edited"] >= 0.6
        if t == after:
            assert x["near_next"] == 1
    assert all(len(p) == 1 for p in prints.values())


def test_op8(spark, tables):
    got = {x["doc_id"]: x for x in rows_of(spark, tables, "op8_toxicity")}
    assert len(got) == len(documents())
    right = n = 0
    for i, x in got.items():
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7)
        if x["held_out"] and i < 150:
            n += 1
            right += x["predicted"] == int(i % 4 == 1)
    assert n > 30 and right == n
    assert got[220]["score"] == got[221]["score"] and got[220]["predicted"] == 0


def test_op8_learns_only_from_rows_that_are_not_held_out(spark, tables, tmp_path):
    """Turning the labels of the held-out rows round changes no score."""
    turned = spark.read.parquet(f"{tables}/labels.parquet").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{tables}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ({x["doc_id"]: x["score"] for x in rows_of(spark, d, "op8_toxicity")} for d in (tables, str(tmp_path)))
    assert a == pytest.approx(b, abs=1e-9)


def test_op9(spark, tables):
    got = {x["doc_id"]: x for x in rows_of(spark, tables, "op9_language")}
    assert len(got) == len(documents())
    for i, t, lang in documents():
        x = got[i]
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["lang_pred"] in ("en", "es", "und")
        if i < 150:
            assert x["lang_pred"] == lang
        assert (x["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, nothing, name):
    assert llm.queries()[name](spark, nothing).count() == 0


def test_pipeline_on_clashing_columns_and_empty_tables(spark, tables, nothing):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        kept = {x["doc_id"]: x.asDict() for x in out.collect()}
        mine = {x["doc_id"]: x.asDict() for x in docs.collect()}
        assert kept and all(mine[k] == v for k, v in kept.items())  # columns that bear the operators' own names come back as they were
    empty = spark.read.parquet(f"{nothing}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, nothing).count() == 0
    assert corpus_pipeline.run(spark, nothing).count() == 0
