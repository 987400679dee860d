"""The pipeline's stages against plain versions of their decisions."""

import os

import corpus_pipeline
import numpy as np
import public_tokenizers as tokenizers
import pytest
from impactlake.llm import language, neardup, toxicity

from .test_operators import brute_components

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, toxicity.fit_tables(docs, spark.read.parquet(f"{SF}/labels.parquet"))).toPandas()
    one = toxicity.stage(spark, docs, SF)
    assert one.columns == docs.columns and {x["doc_id"] for x in one.collect()} == set(scored[scored.score < 0.7].doc_id)
    two = language.stage(spark, docs, SF)
    found = language.predict(docs, language.fit_tables(docs)).toPandas()
    assert two.columns == docs.columns and {x["doc_id"] for x in two.collect()} == set(found[found.lang_pred != "und"].doc_id)
    three = neardup.stage(spark, docs, SF)
    want = brute_components([(x["doc_id"], x["text"]) for x in docs.collect()], 5)
    assert three.columns == docs.columns and {x["doc_id"] for x in three.collect()} == {d for d, (_, c) in want.items() if c == d}


def test_run_equals_one_decision_after_another(spark):
    """Scores and languages by the models, near-duplicates by all pairs, ids by the tokenizer, one document at a time."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, toxicity.fit_tables(docs, spark.read.parquet(f"{SF}/labels.parquet"))).toPandas()
    clean = docs.where(docs.doc_id.isin(scored[scored.score < 0.7].doc_id.tolist()))
    found = language.predict(clean, language.fit_tables(clean)).toPandas()
    known = [(d, t) for d, t, p in found[["doc_id", "text", "lang_pred"]].itertuples(index=False) if p != "und"]
    kept = {d for d, (_, c) in brute_components(known, 5).items() if c == d}
    texts = {d: t or "" for d, t in known if d in kept}
    assert len(kept) > 100
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == kept
    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    sizes = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    assert out.groupby("doc_id")["length"].sum().to_dict() == sizes
    used = out.groupby("sequence_id")["length"].sum().to_numpy()
    assert (used <= 1024).all() and (np.bitwise_and(used, used - 1) == 0).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_toxicity_spares_clean_held_out_documents(spark):
    """A fit on fewer n-grams and steps rejects 4 of these 95."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clean = labels.where("toxic = 0").where(toxicity.held_out()).select("doc_id").distinct()
    p = toxicity.score(docs.join(clean, "doc_id"), toxicity.fit_tables(docs, labels)).toPandas()
    assert len(p) > 90 and (p.score >= 0.7).sum() <= 1
