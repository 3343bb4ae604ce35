import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from evenkeel.llm import quality_classifier as qc
from evenkeel.llm import queries


def strength(level):
    s = sum((g - n * m) ** 2 for n, g, m in level)
    a = sum(n * m * (1 - m) for n, _, m in level)
    b = sum(n * (n - 1) * m * (1 - m) for n, _, m in level)
    return 1 / min(max((s - a) / b if b else 0, 1 / 1001), 0.5) - 1


def test_site_rates_against_a_plain_recomputation(spark):
    rng = np.random.default_rng(1)
    rows = [(f"h{h}", p, int(rng.random() < 0.2 + 0.15 * h)) for h in range(5) for p in ("a", "b", None) for _ in range(int(rng.integers(1, 60)))] + [(None, "a", 1), ("sparse", "a", 0)]
    got, overall = qc.site_rates(spark.createDataFrame(rows, "host string, path string, good int"))
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, p, g in rows:
        for key, table in (((h, p), paths), (h, hosts)):
            table[key][0] += 1
            table[key][1] += g
    m = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    k = strength([(n, g, m) for n, g in hosts.values()])
    host_rate = {h: (g + k * m) / (n + k) for h, (n, g) in hosts.items()}
    k = strength([(n, g, host_rate[h]) for (h, _), (n, g) in paths.items()])
    assert np.isclose(overall, m)
    out = {(r.host, r.path): (r.host_rate, r.rate) for r in got.collect()}
    assert set(out) == set(paths)
    for (h, p), (n, g) in paths.items():
        assert np.allclose(out[h, p], (host_rate[h], (g + k * host_rate[h]) / (n + k)))
    assert abs(out["sparse", "a"][1] - m) < abs(0 - m)


def test_accuracy_on_labels_that_were_not_seen(spark, sf_dir):
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    out = {r.doc_id: r for r in qc.score(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(out) == docs.count()
    apart = labels.where("doc_id % 2 = 1").collect()
    good = [out[r.doc_id].accepted for r in apart if r.quality == 1]
    bad = [out[r.doc_id].accepted for r in apart if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25


def test_sites_move_documents(spark):
    texts = ["a plain sentence of words that says something here"] * 400
    docs = spark.createDataFrame([(i, t, "good" if i % 2 else "bad", "x") for i, t in enumerate(texts)] + [(1000, texts[0], "new", "x"), (1001, texts[0], "bad", "other")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    out = {r.doc_id: r for r in qc.score(docs, labels).collect()}
    assert out[1].quality > 0.95 and out[0].quality < 0.05 and 0.4 < out[1000].quality < 0.6 and out[1001].quality < 0.1


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "s", "l", 1), (1, "", "s", "l", 1), (2, "word " * 90_000, None, "l", 1), (3, "\x00\x01 é", "s", None, 1)], "doc_id long, text string, source string, lang string, rate int")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    out = qc.score(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.quality <= 1 for r in out)
    assert len(qc.score(docs, labels.limit(0)).collect()) == 5
    assert qc.score(docs.limit(0), labels).count() == 0


def plain_figures(text):
    raw = ("" if text is None else text).encode()
    out = np.zeros(qc.FIGURES)
    words = raw.split()
    if not words:
        out[11] = 1
        return out
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kind = lambda b: qc._KIND[b]
    letters, n, m = sum(kind(b) == 1 for b in raw), len(raw), len(words)
    out[:] = [letters / n, sum(kind(b) == 4 for b in raw) / n, sum(kind(b) == 2 for b in raw) / n, sum(65 <= b <= 90 for b in raw) / max(letters, 1), min(n / m, 30) / 30, len(set(words)) / m, max(Counter(words).values()) / m, 1 - len(set(lines)) / len(lines), sum(kind(w[-1]) == 4 for w in words) / m, sum(w.endswith(b"!") for w in words) / m, np.log1p(m) / 10, sum(a == b for a, b in zip(words, words[1:])) / m]
    return out


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aB1!$ \n\té日")), max_size=40)), max_size=6))
def test_figures_against_plain_ones(texts):
    assert np.allclose(qc.figures(texts), [plain_figures(t) for t in texts]) if texts else len(qc.figures(texts)) == 0


def test_figures_of_the_whole_table(spark, sf_dir):
    texts = [r.text for r in queries.table(spark, sf_dir, "documents").select("text").collect()]
    assert np.allclose(qc.figures(texts), [plain_figures(t) for t in texts])


def test_qualities_of_the_query_against_a_plain_recomputation(spark, sf_dir):
    """Sites of pages, rates, classifier and posterior again in one process, from the labels that aren't held out."""
    docs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    site = {i: (d.source, "") for i, d in docs.items()}
    pages: dict = {}
    for r in queries.table(spark, sf_dir, "pages").collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        number = m and re.search(r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", m[2])
        if number and int(number[1]) in docs:
            first = re.match("/[^/]*", re.sub(r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", "/", m[2]))
            own = (m[1].lower(), first[0] if first else "")
            pages[int(number[1])] = min(pages.get(int(number[1]), own), own)
    site.update(pages)
    labels = [(r.doc_id, int(r.quality > 0)) for r in queries.table(spark, sf_dir, "labels").collect() if r.doc_id in docs and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 2]
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i, good in labels:
        for key, of in ((site[i], paths), (site[i][0], hosts)):
            of[key][0] += 1
            of[key][1] += good
    overall = (sum(g for _, g in labels) + 1) / (len(labels) + 2)
    k = strength([(n, g, overall) for n, g in hosts.values()])
    host_rate = {h: (g + k * overall) / (n + k) for h, (n, g) in hosts.items()}
    k = strength([(n, g, host_rate[h]) for (h, _), (n, g) in paths.items()])
    rate = {s: (g + k * host_rate[s[0]]) / (n + k) for s, (n, g) in paths.items()}
    x = np.array([plain_figures(docs[i].text) for i, _ in labels])
    y = np.array([g for _, g in labels], float)
    x = np.hstack([x, np.sqrt(x), np.ones((len(x), 1))])
    penalty = np.array([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(200):  # damped Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        w += 0.5 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
    out = {r.doc_id: r for r in queries.op6_quality_classifier(spark, sf_dir).collect()}
    assert set(out) == set(docs) and len(pages) > 50
    for i, d in docs.items():
        f = plain_figures(d.text)
        r, evidence = out[i], float(np.concatenate([f, np.sqrt(f), [1]]) @ w)
        want = rate.get(site[i], host_rate.get(site[i][0], overall))
        odds = evidence - np.log(y.mean() / (1 - y.mean())) + np.log(want / (1 - want))
        assert (r.host, r.path) == site[i] and np.isclose(r.site_rate, want) and np.isclose(r.evidence, evidence, atol=1e-3)
        assert np.isclose(r.quality, 1 / (1 + np.exp(-odds)), atol=1e-3) and r.accepted == (r.quality >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 2)
    truth = [(out[r.doc_id].accepted, r.quality) for r in queries.table(spark, sf_dir, "labels").collect() if out[r.doc_id].held_out]
    assert np.mean([a for a, q in truth if q == 1]) > 0.97 and np.mean([a for a, q in truth if q == 0]) < 0.3


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word and " * 500_000, "s"), (2, "x" * 3_000_000, "s")], "doc_id long, text string, source string")
    assert qc.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 2
