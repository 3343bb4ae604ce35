import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel.llm import crf_language, prefix_join, quality_classifier, queries, soft_mixing


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_each_stage_against_its_operators_decisions(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").cache()
    labels = queries.table(spark, sf_dir, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "duplicates", "mixing", "packing"]

    accepted = {r.doc_id for r in quality_classifier.score(docs, labels, sites=queries.page_sites(queries.table(spark, sf_dir, "pages"))).collect() if r.accepted}
    kept = stages["quality"](spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns and rows_of(kept) == Counter({tuple(r): 1 for r in docs.collect() if r.doc_id in accepted})
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(good - accepted) <= 0.01 * len(good)

    found = {r.doc_id: r for r in crf_language.label(kept, crf_language.fit(kept), evidence=True).collect()}
    named = stages["language"](spark, kept, sf_dir).cache()
    assert rows_of(named) == Counter({tuple(r): 1 for r in kept.collect() if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= corpus_pipeline.LEAST_LANGUAGE_SCORE and found[r.doc_id].evidence >= corpus_pipeline.LEAST_LANGUAGE_EVIDENCE})
    assert named.count() >= 0.98 * kept.count()

    single = stages["duplicates"](spark, named, sf_dir).cache()
    groups = {r.doc_id: r.component_id for r in prefix_join.near_documents(named, k=5, percent=80).collect()}
    assert {r.doc_id for r in single.collect()} == set(groups.values()) and single.columns == docs.columns

    mixed = stages["mixing"](spark, single, sf_dir).cache()
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    rates = {r.doc_id: r.rate for r in soft_mixing.mix(single, single, temper=corpus_pipeline.TEMPER, grow=True).collect()}
    assert set(times) == set(rates) and all(max(1, int(rates[i])) <= n <= int(rates[i]) + 1 for i, n in times.items())

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in single.collect()}
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    for i in list(text)[::25]:
        ids = tk.encode(text[i], add_special_tokens=False).ids + [1]
        assert whole[i] == len(ids) * times[i]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in packed if r.doc_id == i)


@pytest.mark.parametrize("name", ["quality", "language", "duplicates", "mixing", "packing"])
def test_odd_tables(spark, sf_dir, name):
    text = "the cat and the dog sat down on a mat by the door and then some more words came"
    rows = [(None, text, "en", "s", 3, 1), (-1, None, None, None, None, 1), (-2, "", "en", "s", 0, 1), (-3, text, "en", None, 10, 1), (-3, text, "en", None, 10, 1), (-4, text + " again", "en", "s", 11, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf_dir).count() == 0
