"""The stages in order, each against a plain version of its decision, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from sagebrook.llm import language_id, toxicity

from .test_simhash_and_packing import plain_components, plain_fingerprint

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "exact dedup", "SimHash near-dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{D}/labels.parquet")

    out = stage["language ID"](spark, docs, D)
    assert out.columns == docs.columns
    keep = {r.doc_id for r in language_id.document_languages(docs).where("kept").collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter(keep)

    out = stage["toxicity"](spark, docs, D)
    assert out.columns == docs.columns
    mild = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 0").collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter(mild)

    out = stage["exact dedup"](spark, docs, D)
    assert out.columns == docs.columns
    last = {r.text: r.doc_id for r in sorted(docs.collect(), key=lambda r: r.doc_id)}
    assert Counter(r.doc_id for r in out.collect()) == Counter(last.values())

    out = stage["SimHash near-dedup"](spark, docs, D)
    assert out.columns == docs.columns
    low = plain_components({r.doc_id: plain_fingerprint(r.text) for r in docs.collect()})
    assert Counter(r.doc_id for r in out.collect()) == Counter(set(low.values()))


def test_run(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    kept = {r.doc_id for r in rows}
    assert kept <= docs and len(kept) > 0.6 * len(docs)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
