import numpy as np

from evenkeel.llm import crf_language as cl


def words(i, n):
    rng = np.random.default_rng(i)
    own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)]
    return " ".join(rng.choice(own, n))


def test_every_label_is_learned(spark):
    rows = [(2 * i + j, words(i, 8), f"l{i:02d}") for i in range(70) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = cl.fit(docs)
    assert model.languages == [f"l{i:02d}" for i in range(70)]
    out = {r.doc_id: r.lang_pred for r in cl.label(docs, model).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows]) > 0.95


def test_labels_with_long_texts_or_one_id(spark):
    long = " 12 " * 200 + words(1, 300)
    rows = [(1, long, "long"), (2, words(2, 20), "short"), (3, words(2, 20), "short"), *((None, words(3, 20), "null") for _ in range(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = cl.fit(docs, per_language=2, most_chars=500)
    assert model.languages == ["long", "null", "short"]
    assert cl.label(docs.where("doc_id = 1"), model).first().lang_pred == "long"


def test_five_hundred_labels(spark):
    rows = [(4 * i + j, words(i, 7), f"l{i:03d}") for i in range(500) for j in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = cl.fit(docs.where("doc_id % 4 <> 3"))
    assert len(model.languages) == 500 and model.grams.nbytes <= 3 * 65536 * 128 * 4
    out = {r.doc_id: r.lang_pred for r in cl.label(docs, model).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows if i % 4 == 3]) > 0.9


def test_bounds_of_the_sample():
    assert cl.sample_bounds(4, 200, 20_000) == (200, 20_000) and cl.table_size(128) == 65536 and cl.table_size(129) == 32768 and cl.table_size(500) == 16384
    for k in (64, 200, 500, 2000):
        rows, chars = cl.sample_bounds(k, 200, 20_000)
        assert rows >= 20 and chars >= 40 and (rows * chars * k**3 <= 6 * cl.MOST_COST or (rows, chars) == (20, 40))


def test_parts_learn_what_the_whole_does(monkeypatch):
    texts, labels = [words(i % 5, 30) for i in range(60)], [f"l{i % 5}" for i in range(60)]
    whole = cl.train(texts, labels, epochs=4)
    monkeypatch.setattr(cl, "HELD", 5 * 100)
    parts = cl.train(texts, labels, epochs=4)
    assert np.allclose(whole.grams, parts.grams, atol=1e-3) and np.allclose(whole.moves, parts.moves, atol=1e-6) and (whole.lexicon == parts.lexicon).all()
