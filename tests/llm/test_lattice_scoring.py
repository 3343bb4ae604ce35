import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest

from evenkeel.llm import lattice_scoring as ls
from evenkeel.llm import queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = [b" ", b" a", b" ab", b"a", b"ab", b"b", b"ba", b"bab", b"\xc3\xa9"]


def all_segmentations(lattice, word, logp, at=0):
    """Every way to spell word[at:] as lists of piece numbers."""
    if at == len(word):
        yield []
        return
    options = [(1, lattice.bytes_at + word[at])] + [(len(p), i) for i, p in enumerate(PIECES) if word.startswith(p, at)]
    for k, piece in options:
        for rest in all_segmentations(lattice, word, logp, at + k):
            yield [piece, *rest]


@pytest.mark.parametrize("long", [192, 1])
def test_marginals_and_counts_against_enumeration(monkeypatch, long):
    monkeypatch.setattr(ls, "_LONG", long)
    lattice = ls.Lattice(PIECES)
    logp = lattice.weights(np.random.default_rng(1).random(lattice.size))
    words = [b"", b"a", b"abab", b"babab", b"b\xc3\xa9a", b"zz", b"aab"]
    weights = np.arange(1.0, len(words) + 1)
    total = np.zeros(lattice.size)
    for word, got, weight in zip(words, lattice.score(words, logp), weights):
        paths = list(all_segmentations(lattice, b" " + word, logp))
        p = np.exp([sum(logp[i] for i in path) + logp[lattice.stop] for path in paths])
        assert np.isclose(got, np.log(p.sum()))
        for path, share in zip(paths, p / p.sum()):
            for i in path:
                total[i] += share * weight
    assert np.allclose(lattice.score(words, logp, weights), total)


def test_weights_make_words_sum_to_at_most_one():
    lattice = ls.Lattice([b" a", b" b", b"a", b"b", b"ab"])
    counts = np.full(lattice.size, 1e-12)
    counts[:5] = 1
    counts[lattice.stop] = 2
    logp = lattice.weights(counts)
    from itertools import product

    words = [bytes(w) for n in range(1, 9) for w in product(b"ab", repeat=n)]
    total = np.exp(lattice.score(words, logp)).sum()
    assert 0.9 < total <= 1 + 1e-9


def test_base_and_counts_on_the_whole_table(spark, sf_dir):
    docs = {d.doc_id: d.text for d in queries.table(spark, sf_dir, "documents").collect()}
    train, n_train = Counter(), 0
    for i, text in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update((text or "").encode().lower().split())
            n_train += 1
    n, v = sum(train.values()) + n_train, len(train) + 1
    out = queries.op1_subword_lattice(spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        words = (docs[r.doc_id] or "").encode().lower().split()
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(train[w] > 0 for w in words) + 1, n)
        assert np.isclose(r.base_score, sum(log10((train[w] + 1) / (n + v + 1)) for w in words) + log10((n_train + 1) / (n + v + 1)))
        assert r.score < 0
    apart = [r for r in out if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


SMALL = ["the cat sat.", "the dog sat, sat.", "cat! cat? the", "le chat est la", "le chat est le la la.", "la le", None, "", "dog.", "the chat gnu!!", "..", "la la la the the zz,,"]
KINDS = ["en", "en", "en", "fr", "fr", "fr", None, "en", None, "en", "fr", None]


def plain_scores(texts, kinds, held, pieces, rounds):
    """The whole model in plain Python, with every segmentation listed: scores of all texts."""
    words = [(t or "").encode().lower().split() for t in texts]
    stem = lambda w: w.rstrip(ls.PUNCTUATION.encode())
    names = sorted(set(k for k, h in zip(kinds, held) if not h), key=str)

    def spell(w, weights):
        def paths(at, first):
            if at == len(w):
                yield [], weights["stop"]
            for end in range(at + 1, len(w) + 1):
                for name in ([w[at:end]] if w[at:end] in pieces else []) + ([("byte", w[at])] if end == at + 1 else []):
                    for rest, p in paths(end, False):
                        yield [name, *rest], p * weights[name]

        return list(paths(0, True))

    def initial(name):
        return name == ("byte", 32) or (isinstance(name, bytes) and name[:1] == b" ")

    symbols = [*pieces, *(("byte", b) for b in range(256)), "stop"]

    def weigh(counts):
        one, two = sum(v for k, v in counts.items() if initial(k)), sum(v for k, v in counts.items() if not initial(k))
        return {k: v / (one if initial(k) else two) for k, v in counts.items()}

    def discount(counts):
        n1, n2, n3, n4 = (max(sum(c == k for c in counts.values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [0, *(min(max(d, 0.1), top) for d, top in zip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.95, 1.95, 2.95]))]

    total = sum(not h for h in held)
    by_class = []
    for name in names:
        own = [w for w, k, h in zip(words, kinds, held) if not h and k == name]
        counts = Counter(x for w in own for x in w)
        stems = Counter(stem(x) for x in counts)
        n, ends, n_stems = sum(counts.values()) + len(own), len(own), sum(stems.values())
        weights = weigh(dict.fromkeys(symbols, 1.0))
        for _ in range(rounds):
            expected = dict.fromkeys(symbols, ls.SMOOTHING)
            for x in stems:
                ways = spell(b" " + x, weights)
                whole = sum(p for _, p in ways)
                for path, p in ways:
                    for piece in [*path, "stop"]:
                        expected[piece] += p / whole
            weights = weigh(expected)
        marks = ["", *ls.PUNCTUATION]
        steps = {(a, b): 0.05 for a in marks for b in marks}
        for x in counts:
            tail = ["", *x[len(stem(x)) :].decode(), ""]
            for pair in zip(tail, tail[1:]):
                steps[pair] += 1
        dw, ds = discount(counts), discount(stems)
        free_w, free_s = (max(sum(d[min(c, 3)] for c in cs.values()), 1e-9) for cs, d in ((counts, dw), (stems, ds)))
        n_stems = max(n_stems, free_s)

        def p_word(x):
            tail = 1.0
            for last, after in zip(["", *x[len(stem(x)) :].decode()], [*x[len(stem(x)) :].decode(), ""]):
                tail *= steps[last, after] / sum(steps[last, m] for m in marks)
            k = stems[stem(x)]
            p_stem = (k - ds[min(k, 3)] + free_s * sum(p for _, p in spell(b" " + stem(x), weights))) / n_stems
            return (counts[x] - dw[min(counts[x], 3)] + free_w * p_stem * tail) / n

        by_class.append([np.log(ends / total) + sum(np.log(p_word(x)) for x in w) + np.log(ends / n) for w in words])
    return np.logaddexp.reduce(np.array(by_class), axis=0) / np.log(10)


@pytest.mark.parametrize("head", [3, 1000])
def test_scores_of_texts_against_all_segmentations(spark, head):
    """Few and many frequent words, a null class, the real vocabulary."""
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(SMALL))]
    df = spark.createDataFrame([(i, t, k, "x") for i, (t, k) in enumerate(zip(SMALL, KINDS))], "doc_id long, text string, lang string, word string").repartition(3)
    out = {r.doc_id: r for r in ls.score(df, ls.held_out_by("doc_id", 7, 2), MODEL, class_col="lang", head=head).collect()}
    want = plain_scores(SMALL, KINDS, held, set(ls.vocabulary(MODEL)), ls.ROUNDS)
    assert any(held) and np.allclose([out[i].score for i in range(len(SMALL))], want)


def test_all_classes_take_part(spark):
    rows = [(i, f"w{i} w{i} common", f"k{i:03d}") for i in range(100)] + [(1000 + i, f"w{i} w{i}", None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = {r.doc_id: r.score for r in ls.score(df, F.col("doc_id") >= 1000, MODEL, class_col="lang", rounds=1).collect()}
    assert max(out[1000 + i] for i in range(100)) - min(out[1000 + i] for i in range(100)) < 1.5 and min(out.values()) > -5


def test_more_classes_than_weights(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ls, "MOST_CLASSES", 12)
    monkeypatch.setattr(ls, "SHARED", 4)
    # eight classes with two texts keep their weights, 492 with one share four
    rows = [(i, f"w{i % 500} w{i % 500} common", f"k{i % 500}") for i in range(508)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in ls.score(df, F.col("doc_id") % 100 == 99, MODEL, class_col="lang", rounds=1).collect()}
    assert len(out) == 508 and all(np.isfinite(r.score) and r.score < 0 for r in out.values())
    learned, number = ls._numbered(df.select((F.col("doc_id") % 100 == 99).alias("held_out"), F.col("lang").alias("kind")))
    numbers = {r.lang: r.n for r in df.select("lang", F.lit(False).alias("held_out"), F.col("lang").alias("kind")).select("lang", number.alias("n")).collect()}
    # the same as with the shared weights' numbers for classes
    told = df.join(spark.createDataFrame([(k, f"{n:02d}") for k, n in numbers.items()], "lang string, told string"), "lang")
    monkeypatch.undo()
    same = {r.doc_id: r.score for r in ls.score(told, F.col("doc_id") % 100 == 99, MODEL, class_col="told", rounds=1).collect()}
    held = {i for i in out if i % 100 == 99}
    assert np.allclose([out[i].score for i in out], [same[i] for i in out]) and held
    assert learned == 12 and set(numbers.values()) == set(range(12)) and len({numbers[f"k{i}"] for i in range(8)}) == 8


def test_long_texts_and_words(spark):
    df = spark.createDataFrame([(1, "the cat " * 300_000), (2, "q" * 200_000 + "!" * 100_000), (3, "the cat")], "doc_id long, text string")
    out = {r.doc_id: r for r in ls.score(df, ls.held_out_by("doc_id", 7, 2), MODEL, rounds=1).collect()}
    assert out[1].n_tokens == 600_001 and all(np.isfinite(r.score) for r in out.values())


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert {r.held_out for r in ls.score(df, ls.held_out_by("doc_id", 7, zlib.crc32(b"1") % 7), MODEL).collect()} == {False, True}
    from pyspark.sql import functions as F

    out = ls.score(df, F.lit(False), MODEL).collect()
    assert len(out) == 3 and {r.train_tokens for r in out} == {9} and all(np.isfinite(r.score) for r in out)
    assert ls.score(df.limit(0), ls.held_out_by("doc_id", 7, 2), MODEL).count() == 0
    none = ls.score(df, F.lit(True), MODEL).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)} and all(np.isfinite(r.score) for r in none)
