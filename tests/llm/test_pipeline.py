from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
from test_neardup import brute_force
from tokenizers import Tokenizer
from wareflow.llm import pii, shared


def test_stages_decide_as_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) > 0.9 * len(labels)

    one = corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {d for d, (_, _, k) in brute_force(rows, 5, 80).items() if k}

    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and not left & {d for d, t in rows if any(i in t for i in items)}

    redacted = corpus_pipeline.redact_personal_data(spark, docs, sf_dir)
    assert redacted.columns == columns and redacted.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in redacted.collect())
    found = pii.decide(pii.candidates(redacted.select("doc_id", "text")), None)
    assert found.where("size(spans) > 0").count() == 0


def test_the_run(spark, sf_dir):
    """The run's ids are those that the tokenizers library gives the texts that the other stages leave."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.saved(stage(spark, docs, sf_dir))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys() and rows
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(rows[doc].ids) == ids and rows[doc].n_tokens == len(ids)
        assert rows[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(corpus_pipeline.STAGES) == 5
