import random

import pytest

import corpus_pipeline
from evenkeel.llm import queries

POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"


@pytest.mark.parametrize("languages", [("en", "de", "es", "fr"), ("en", "de"), ("en",)])
def test_planted_texts_go_and_clean_ones_stay(spark, sf_dir, languages):
    docs = queries.table(spark, sf_dir, "documents").where(f"lang in {languages + ('',)}").select("doc_id", "text", "lang")
    clean = docs.where("length(text) between 900 and 1500")
    text = {r.lang: " ".join(r.text.split()[:60]) for r in clean.orderBy("doc_id").collect()}
    rng = random.Random(1)
    planted = [(-1, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(80)), None), (-2, POLISH, None)]
    if len(languages) > 1:
        planted.append((-3, f"{text['en']} {text['de']}", None))
    good = [(-10 - i, text[x], None) for i, x in enumerate(languages)]
    both = docs.union(spark.createDataFrame(planted + good, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, sf_dir).collect()}
    assert not kept & {i for i, *_ in planted}
    assert {i for i, *_ in good} <= kept
    assert len(kept) >= 0.98 * docs.count()
