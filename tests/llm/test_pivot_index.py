import importlib.util
import os

import numpy as np
import pytest

from evenkeel.llm import oracles, queries
from evenkeel.llm import pivot_index as pi

spec = importlib.util.spec_from_file_location("llm_oracle", os.path.join(os.path.dirname(__file__), "oracle.py"))
oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracle)


def brute(vectors, cosine=0.95):
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    ids = [i for i, _ in vectors]
    component = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(linked)):
            low = min(component[ids[a]], component[ids[b]])
            for i in (ids[a], ids[b]):
                if component[i] != low:
                    component[i], changed = low, True
    return {i: (int(n), component[i]) for i, n in zip(ids, linked.sum(1))}


def test_against_sql(spark, sf_dir):
    oracle.same(queries.op7_pivot_index(spark, sf_dir), sf_dir, oracles.OP7)


@pytest.mark.parametrize("block", [16, 2048])
def test_recall_and_precision_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = [v for v in rng.normal(size=(700, 32))]
    for target in (0.951, 0.96, 0.98):
        for base in rows[:120]:
            u = rng.normal(size=32)
            base = base / np.linalg.norm(base)
            u -= (u @ base) * base
            rows.append(target * base + np.sqrt(1 - target**2) * u / np.linalg.norm(u))
    rows += [rows[3]] * 90 + [rows[3] + 0.01 * rng.normal(size=32) for _ in range(150)]
    vectors = [(i, v.tolist()) for i, v in enumerate(rows)]
    want = brute(vectors)
    out = {r.vec_id: (r.n_links, r.component_id) for r in pi.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), block=block).collect()}
    assert set(out) == set(want)
    assert all(out[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in out.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(out[i][1] == want[i][1] for i in want) >= 0.95 * len(want)


def test_a_large_cloud_of_near_copies_keeps_its_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=48)
    rows = list(rng.normal(size=(500, 48))) + [base + 0.12 * rng.normal(size=48) for _ in range(300)]
    vectors = [(i, v.tolist()) for i, v in enumerate(rows)]
    want = brute(vectors)
    out = {r.vec_id: (r.n_links, r.component_id) for r in pi.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert sum(n for n, _ in out.values()) >= 0.98 * sum(n for n, _ in want.values()) > 10_000
    assert {i: c for i, (_, c) in out.items()} == {i: c for i, (_, c) in want.items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [1e300, 2e300])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, weight int")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pi.near_vectors(df).collect()), key=str)
    assert (7, 3, 7, True) in out and (10, 3, 7, False) in out and out.count((8, 3, 7, False)) == 2 and (9, 0, 9, True) in out and (None, 0, None, True) in out
    for i in (1, 2, 3, 4, 5, 6):
        assert (i, 0, i, True) in out
    assert pi.near_vectors(df.limit(0)).count() == 0


def planted(n, crowd, dims=48, seed=11):
    """Random vectors, copies at several cosines, and a crowd of near copies."""
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, dims)))
    for target in (0.955, 0.97, 0.99):
        for base in rows[: n // 5]:
            u, b = rng.normal(size=dims), base / np.linalg.norm(base)
            u -= (u @ b) * b
            rows.append(target * b + np.sqrt(1 - target**2) * u / np.linalg.norm(u))
    rows += [rows[0] + 0.05 * rng.normal(size=dims) for _ in range(crowd)] + [rows[1]] * 20
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def test_split_lists_find_what_whole_lists_find(spark):
    """Lists of 8 entries are split by a second and a third pivot and into blocks; nothing is lost or counted twice."""
    df = spark.createDataFrame(planted(400, 60), "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in pi.near_vectors(df, block=100_000).collect()}
    assert {tuple(r) for r in pi.near_vectors(df, block=8).collect()} == whole and max(r[1] for r in whole) >= 60


def test_the_query_on_a_table_with_planted_links(spark, tmp_path):
    """The registered query against its own SQL: the tables at hand hold hardly any links."""
    spark.createDataFrame(planted(1500, 200), "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.parquet"))
    (tmp_path / "sf").mkdir()
    part.rename(tmp_path / "sf" / "embeddings.parquet")
    out = {r.vec_id: r for r in queries.op7_pivot_index(spark, str(tmp_path / "sf")).collect()}
    names, want = oracle.duck(str(tmp_path / "sf"), oracles.OP7)
    want = {r[names.index("vec_id")]: dict(zip(names, r)) for r in want}
    assert set(out) == set(want) and all(out[i].n_links <= want[i]["n_links"] for i in want)
    assert sum(out[i].n_links for i in want) >= 0.97 * sum(w["n_links"] for w in want.values()) > 40_000
    assert sum(out[i].component_id == want[i]["component_id"] for i in want) >= 0.97 * len(want)
