import hashlib
import random
import zlib

import pytest

from evenkeel.llm import conversation_trie as ct
from evenkeel.llm import queries


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v, key=lambda r: r[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Every prefix by a dictionary."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in children.get(p, [])) or 1
        saved[p] = own + sum(saved[k] for k in children.get(p, []))
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(children.get(p, [])), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, n):
    """Few texts, so that prefixes are shared; a third of the conversations are copies of one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [("user", "same")] * 4 if rng.random() < 0.33 else [(rng.choice(["user", None]), rng.choice(["a", "bé", "", None, "c" * 50])) for _ in range(rng.randrange(0, 7))]
        rows += [(c - 20, t if t else None, *x) for t, x in enumerate(turns)]
    return rows


@pytest.mark.parametrize("parts", [1, 7, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_nodes(spark, seed, parts):
    rows = made(seed, 300) + [(None, 1, "user", "no conversation")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_convs", "'x' AS tokens", "2 AS depth")
        assert nodes(ct.trie(ct.rebuilt(ct.paths(df)))) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(ct, "LAST_ROUND", 30)
    rows = made(3, 400)
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(ct.trie(ct.paths(spark.createDataFrame(rows, SCHEMA)))) == brute(plain(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(v, key=lambda r: r[:2])] for c, v in out.items()}


def test_long_conversations_and_texts(spark):
    rows = [(c, t, "user", f"{t if t < 900 else (t, c)}") for c in range(3) for t in range(1000)] + [(7, 0, "user", "z" * 1_000_000), (8, 0, "user", "z" * 1_000_000)]
    assert nodes(ct.trie(ct.paths(spark.createDataFrame(rows, SCHEMA)))) == brute(plain(rows))


def test_empty_and_repeated(spark):
    assert ct.trie(ct.paths(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, 0, "u", "x")] * 3 + [(2, 0, "u", "x")] * 2 + [(3, 0, "ux", "")]
    assert nodes(ct.trie(ct.paths(spark.createDataFrame(rows, SCHEMA)))) == brute(plain(rows))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op13_lcp_forest(spark, sf_dir)) == brute(rebuilt(rows))


def test_query_against_sql(spark, sf_dir):
    import duckdb

    from evenkeel.llm import oracles

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    df = queries.op13_lcp_forest(spark, sf_dir)
    names = ", ".join(sorted(df.columns))
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == sorted(con.sql(f"select {names} from ({oracles.OP13})").fetchall(), key=repr)
