import numpy as np
import pytest

from evenkeel.llm import queries
from evenkeel.llm import soft_mixing as sm


def totals(rows, domains):
    return {d: sum(r.rate * r.tokens * r.posteriors[d] for r in rows) for d in domains}


def test_whole_table_meets_equal_targets(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = sm.mix(docs, docs).collect()
    truth = {d.doc_id: d for d in docs.collect()}
    assert len(rows) == len(truth) and all(r.rate >= 0 for r in rows)
    for r in rows:
        assert r.tokens == len(truth[r.doc_id].text.encode().split()) and np.isclose(sum(r.posteriors.values()), 1)
    whole = sum(r.tokens for r in rows)
    assert all(np.isclose(t, whole / 4, rtol=1e-4) for t in totals(rows, rows[0].posteriors).values())
    assert np.mean([r.domain == truth[r.doc_id].lang for r in rows]) > 0.95
    assert len(queries.op9_soft_mixing(spark, sf_dir).collect()) == len(rows)


def test_posteriors_against_a_plain_recomputation(spark):
    labelled = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate([("A b b c", "x"), ("b c d", "x"), ("d e e", "y"), (None, "y"), ("z", None)])], "doc_id long, text string, lang string")
    model = sm.classifier(labelled, "doc_id", "text", "lang", sample=100)
    counts = {"x": {"a": 1, "b": 3, "c": 2, "d": 1}, "y": {"d": 1, "e": 2}}
    words = "abcde"
    logs = {d: {w: np.log((c.get(w, 0) + 0.5) / (sum(c.values()) + 0.5 * 5)) for w in words} for d, c in counts.items()}
    texts = ["a d e", "b b b b", "", None, "unseen words"]
    got = sm.posteriors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        seen = [w for w in (texts[r.doc_id] or "").split() if w in words]
        s = [np.log(0.5) + sum(logs[d][w] for w in seen) / np.sqrt(max(len(seen), 1)) for d in ("x", "y")]
        assert np.isclose(r.p0, 1 / (1 + np.exp(s[1] - s[0]))) and r.tokens == len((texts[r.doc_id] or "").split())


@pytest.mark.parametrize(("weights", "grow"), [({"a": 1, "b": 1, "c": 2}, False), ({"a": 5, "b": 1, "c": 1}, True), ({"a": 1, "b": 0, "c": 1}, False)])
def test_rates_are_the_least_squares_optimum(spark, weights, grow):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 300)
    t = rng.integers(0, 900, 300)
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "tokens long, p0 double, p1 double, p2 double")
    rate, target, expected, _ = sm.fit_rates(members, ["a", "b", "c"], weights, grow=grow)
    r = np.array([x[0] for x in members.select(rate).collect()])
    size = t @ p
    assert np.allclose((t * r) @ p, expected) and (r >= 0).all()
    if min(weights.values()) > 0:
        assert np.allclose(expected, target, rtol=1e-4, atol=1)
    else:  # not within reach for soft members: a hundredth of the first loss from the optimum of a long run
        loss = lambda r: (((t * r) @ p - target) ** 2 / size).sum()
        best = np.ones(300)
        start = loss(best)
        for _ in range(20_000):
            best = np.maximum(0, best - p @ (((t * best) @ p - target) / size))
        assert loss(best) - 1e-9 <= loss(r) <= loss(best) + 0.01 * start
    if grow:
        assert sum(target) >= t.sum() - 1e-6 and all(x >= s - 1e-6 for x, s in zip(target, size))


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, "en", 1), (1, "", None, 1), (1, "the cat", "en", 1), (1, "the cat", "en", 1), (2, "le chat " * 50_000, "fr", 1)], "doc_id long, text string, lang string, tokens int")
    rows = sm.mix(df, df).collect()
    assert len(rows) == 5 and {r.tokens for r in rows} == {0, 2, 100_000} and all(r.rate >= 0 for r in rows)
    assert {r.rate for r in sm.mix(df, df.limit(0)).collect()} == {1.0}
    assert sm.mix(df.limit(0), df).count() == 0 and sm.mix(df.limit(0), df.limit(0)).count() == 0
