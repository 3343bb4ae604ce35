import importlib.util
import os
import random

import numpy as np
import pytest

from evenkeel.llm import oracles, queries
from evenkeel.llm import prefix_join as pj

spec = importlib.util.spec_from_file_location("llm_oracle", os.path.join(os.path.dirname(__file__), "oracle.py"))
oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracle)


def brute(docs, k, percent):
    """(size, component) of each id by all pairs that share a shingle."""
    sets, lists = {}, {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        found = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
        sets[i] = frozenset(found)
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    for s, i in reps.items():
        for x in s:
            lists.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    for i, s in sets.items():
        if s:
            join(i, reps[s])
    seen = {}
    for s, i in reps.items():
        shared = {}
        for x in s:
            for j in lists[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                join(i, j)
    del seen
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_at_90_on_three_words(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in queries.table(spark, sf_dir, "documents").collect()]
    assert got(queries.op5_grouped_prefix_join(spark, sf_dir)) == brute(docs, 3, 90)


def test_against_sql(spark, sf_dir):
    oracle.same(queries.op5_grouped_prefix_join(spark, sf_dir), sf_dir, oracles.OP5)


def family_docs():
    """Copies, near copies on both sides of the thresholds, chains, shared passages and short texts."""
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(40_000)
    passage = [word() for _ in range(60)]
    docs = []
    for n in (8, 20, 60, 150):
        base = [word() for _ in range(n)]
        docs += [base] * 3
        for edits in (0, 1, 1, 1, 2, 3, 5, 8):
            for _ in range(6):
                own = list(base)
                for _ in range(edits):
                    own[rng.randrange(n)] = word()
                docs.append(own)
        chain = list(base)
        for _ in range(12):
            chain = chain[2:] + [word(), word()]
            docs.append(chain)
    docs += [passage + [word() for _ in range(rng.randrange(5, 200))] for _ in range(60)]
    docs += [[word() for _ in range(rng.randrange(1, 6))] for _ in range(30)] + [["a"], ["A"], ["a", "b"], ["b", "a"], ["x"] * 50, ["x"] * 70]
    texts = [" ".join(d) for d in docs] + [None, "", " \n ", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 90)])
def test_families(spark, k, percent):
    docs = family_docs()
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, node int, n int, prefix string").repartition(5)
    assert got(pj.near_documents(df, k=k, percent=percent)) == brute(docs, k, percent)


def test_groups_of_equal_prefix_are_verified(spark, monkeypatch):
    """One level for every cell and few hash values force ties; groups may not be trusted without a check."""
    docs = [(0, "a b c d e f g h i j k l m n o p q r s t"), (1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(pj.near_documents(df, k=1, percent=80)) == brute(docs, 1, 80)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in pj.near_documents(df).collect()), key=str)
    assert out == [(3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, None)]
    assert pj.near_documents(df.limit(0)).count() == 0


def test_one_id_with_two_texts_is_an_error(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="id 1 "):
        pj.near_documents(df)


def paragraphs(n, rng, shared=40, own=12):
    texts = [" ".join(f"p{p}w{int(x)}" for x in rng.integers(0, 10**6, 40)) for p in range(shared)]
    return [[texts[i] for i in rng.permutation(shared)[:own]] for _ in range(n)]


def test_templated_pages_cost_no_square(spark, monkeypatch):
    """Pages of shared paragraphs: many meet in every list and nothing links. A list joined with itself had 240 pairs a page here."""
    counted = []
    real = pj._verified

    def counting(pairs, *rest):
        counted.append(pairs.distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(pj, "_verified", counting)
    docs = [(i, " ".join(p)) for i, p in enumerate(paragraphs(1600, np.random.default_rng(1600)))]
    out = pj.near_documents(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=90).collect()
    assert all(r.component_id == r.doc_id for r in out)
    # the star has a pair for each entry of a list at most; after it come few pairs a page
    assert counted[0] < 1600 * 2 * 60 and counted[1] < 400, counted


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 40)), dtype=np.uint64)]))
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in pj.sketch(a) ^ pj.sketch(b))
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0
        assert (pj.tokens_of(pj._signed(a)) == a).all()


@pytest.mark.parametrize(("percent", "crowd"), [(80, 1), (90, 6)])
def test_crowded_lists_lose_no_link(spark, monkeypatch, percent, crowd):
    monkeypatch.setattr(pj, "CROWD", crowd)
    rng = np.random.default_rng(percent)
    docs, made = [], paragraphs(60, rng, shared=14, own=5)
    for i, page in enumerate(made):
        words = " ".join(page).split()
        docs.append((3 * i, " ".join(words)))
        for j in (1, 2):  # a few words fewer, at the end or in the middle
            cut = int(rng.integers(1, 40))
            at = int(rng.integers(0, len(words) - cut))
            docs.append((3 * i + j, " ".join(words[:at] + words[at + cut :])))
    docs += [(1000 + i, " ".join(rng.permutation("a b c d e f g h".split())[: int(rng.integers(1, 8))])) for i in range(60)]
    out = {r.doc_id: r.component_id for r in pj.near_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), k=2, percent=percent).collect()}
    sets = {}
    for i, text in docs:
        w = text.split()
        sets[i] = {tuple(w[a : a + 2]) for a in range(len(w) - 1)} or {tuple(w)}
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(best)
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
        if best == before:
            break
    assert links and out == best
