import zlib
from itertools import product

import numpy as np

from evenkeel.llm import crf_language as cl
from evenkeel.llm import queries
from evenkeel.llm.common import chunk_words, chunks, span_hashes


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    begins = np.array([0, 4, 4, 5, 11])
    scores, moves = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    pairs = np.zeros((3, 3))
    got = cl.marginals(scores, begins, moves, pairs)
    want, want_pairs = np.zeros((11, 3)), np.zeros((3, 3))
    for a, b in zip(begins, begins[1:]):
        total = 0
        own, own_pairs = np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=b - a):
            p = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                own[i, y] += p
            for x, y in zip(path, path[1:]):
                own_pairs[x, y] += p
        if b > a:
            want[a:b] = own / total
            want_pairs += own_pairs / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_emissions_against_a_plain_sum():
    rng = np.random.default_rng(3)
    model = cl.train(["uno dos tres", "one two three", "uno dos", "one two"], ["es", "en", "es", "en"], epochs=2)
    model.grams[:] = rng.normal(size=model.grams.shape)
    texts = ["One  two\tunoÉ", "", " x"]
    part = next(chunks(texts))
    buffer, starts, ends, first = chunk_words(part)
    got = cl.emissions(model, buffer, starts, ends)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert len(words) == len(got) == first[-1]
    for word, row in zip(words, got):
        padded = np.frombuffer(b" " + word + b" ", np.uint8)
        want = model.bias.copy()
        for order, codes, table in zip(cl._ORDERS, cl.gram_codes(padded), model.grams):
            want += table[codes].sum(axis=0) if len(padded) >= order else 0
        h = span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        want += (cl.lexicon_rows(model, h) @ model.lexical)[0]
        assert np.allclose(row, want, atol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    truth = {d.doc_id: d.lang for d in queries.table(spark, sf_dir, "documents").collect()}
    out = queries.op10_crf_language(spark, sf_dir).collect()
    assert len(out) == len(truth)
    apart = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in apart]) > 0.98


def test_code_switched_words_and_odd_texts(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    model = cl.fit(docs)
    clean = {r.lang: r.text for r in docs.where("n_chars between 900 and 1500 and lang in ('en', 'de')").collect()}
    en, de = (" ".join(clean[k].split()[:60]) for k in ("en", "de"))
    rows = [(1, f"{en} {de}", "a"), (2, None, "b"), (3, " 12 -- 3", "c"), (4, "", "d"), (None, en, "e"), (5, en, "f"), (5, en, "f"), (6, "x" * 100_000, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = {r.doc_id: r for r in cl.label(df, model, spans=True).collect()}
    mixed = out[1].spans
    words = {k: sum(s.n_words for s in mixed if s.lang == k) for k in ("en", "de")}
    assert words["en"] > 45 and words["de"] > 45 and out[1].n_switches == len(mixed) - 1 >= 1 and sum(s.n_words for s in mixed) == 120
    assert {out[i].lang_pred for i in (2, 3, 4)} == {"und"} and out[None].lang_pred == out[5].lang_pred == "en" and out[6].n_words == 1
    assert cl.label(df, model).count() == 8 and cl.label(df.limit(0), model).count() == 0
    assert cl.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in cl.label(df, None).collect()} == {"und"}


def test_long_texts_in_pieces_have_the_same_marginals():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 7, 8, 9, 50, 0, 333, 2]
    begins = np.concatenate(([0], np.cumsum(sizes)))
    scores, moves = 3 * rng.normal(size=(begins[-1], 4)), 2 * rng.normal(size=(4, 4))
    whole = cl.marginals(scores, begins, moves)
    for piece in (1, 2, 8, 100):
        assert np.allclose(cl.marginals(scores, begins, moves, piece=piece), whole)


def test_a_text_of_two_million_words(spark):
    import time

    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20)]
    model = cl.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    text = "the cat sat on a mat " * 250_000 + "le chat est la " * 150_000
    begun = time.time()
    r = cl.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.lang_pred == "en" and r.n_words == 2_100_000 and r.n_switches >= 1 and time.time() - begun < 60
