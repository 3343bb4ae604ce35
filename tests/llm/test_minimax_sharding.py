import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import minimax_sharding as ms
from evenkeel.llm import queries


def brute(sizes, shards):
    """The least largest part of a contiguous partition."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        parts, held = 1, 0
        for s in sizes:
            if held + s > mid:
                parts, held = parts + 1, 0
            held += s
        low, high = (low, mid) if parts <= shards else (mid + 1, high)
    return low


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120), st.integers(2, 7), st.integers(1, 9))
def test_refined_cells_reach_the_exact_minimum(sizes, shards, wide):
    keys = [f"{i:04d}" for i in range(len(sizes))]
    level = {i // wide: None for i in range(len(sizes))}
    cells = {f"{c * wide:04d}": (sum(sizes[c * wide : (c + 1) * wide]), len(sizes[c * wide : (c + 1) * wide])) for c in level}
    while True:
        seen = ms.Cells(cells)
        wanted = seen.open_cells(shards)
        if not wanted:
            break
        for k in wanted:
            begin, n = int(k), cells.pop(k)[1]
            half = n // 2
            cells[k] = (sum(sizes[begin : begin + half]), half)
            cells[f"{begin + half:04d}"] = (sum(sizes[begin + half : begin + n]), n - half)
    best = brute(sizes, shards)
    assert keys and seen.least(shards, True) == best
    cuts = [0, *seen.even(shards)[0], sum(sizes)]
    assert set(cuts) <= set(seen.ends) and all(0 <= b - a <= best for a, b in zip(cuts, cuts[1:]))
    prefix = [0]
    for x in sizes:
        prefix.append(prefix[-1] + x)
    assert set(cuts) <= set(prefix)


def validate(rows, docs):
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    shard_of = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(16)})


def test_whole_table(spark, sf_dir):
    docs = {d.doc_id: d.text for d in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op2_minimax_sharding(spark, sf_dir).collect()
    bytes_of = validate(rows, docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    groups = Counter()
    for r in rows:
        groups[r.group_key] += r.size
    assert len({(r.group_key, r.shard) for r in rows}) == len(groups)
    if max(groups.values()) * 16 <= sum(groups.values()):
        assert max(bytes_of.values()) == brute([groups[k] for k in sorted(groups)], 16)


@pytest.mark.parametrize("texts", [[], [None], [None, "", ""], ["same"] * 50, ["hot" * 100] * 40 + [f"t{i}" * 20 for i in range(60)]])
def test_odd_tables(spark, texts):
    df = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket string, size int")
    rows = ms.shard(df).collect()
    validate(rows, texts)
    if len(texts) == 100:
        assert len({r.shard for r in rows}) == 16


def test_repeated_rows_are_dealt_over_windows(spark):
    """All rows equal, ids too: slots are gapless and no bucket holds them all."""
    df = spark.range(4000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'same' AS text")
    out = ms.shard(df).collect()
    assert sorted(r.slot for r in out) == list(range(4000)) and len({r.shard for r in out}) == 1
