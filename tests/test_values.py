import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import geo, warehouse
from evenkeel.functions import variant as v
from evenkeel.functions.canonical import encode, hash_agg, row_hash
from evenkeel.operators import compare, reshape, sketches
from evenkeel.operators.recursion import recursive


def test_paths():
    for path in ("a:b[0]", "a.b[0]", "$.a.b[0]", " $a.b[0]"):
        assert v.json_path(path) == "$.a.b[0]"
    assert v.json_path("[1].x") == "$[1].x" and v.json_path("") == v.json_path("$") == "$"


def test_variants(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "x", null, 2.50, true, {}]}}',), ("[1,2",), (None,), ("7",), ("null",)], "t string").select(v.parse("t").alias("d"))
    rows = df.select(*(v.get("d", f"a.b[{i}]", k).alias(f"c{i}") for i, k in enumerate(("int", "string", "string", "decimal(5,2)", "boolean"))), *(v.type_of(v.get("d", f"a.b[{i}]")).alias(f"t{i}") for i in range(6)), v.get("d", "a.b[1]", "int").alias("bad"), v.type_of("d").alias("t")).collect()
    assert [rows[0][f"c{i}"] for i in range(5)] == [1, "x", None, rows[0].c3, True] and str(rows[0].c3) == "2.50" and rows[0].bad is None
    assert [rows[0][f"t{i}"] for i in range(6)] == ["INTEGER", "VARCHAR", "NULL_VALUE", "DECIMAL", "BOOLEAN", "OBJECT"]
    assert [r.t for r in rows] == ["OBJECT", None, None, "INTEGER", "NULL_VALUE"]
    same = spark.createDataFrame([('{"b":[1.50, {"z":1,"y":2}],"a":1}',), ('{"a":1.0,"b":[{"y":2,"z":1},1.5]}',), ('{"a":1,"b":[{"y":2,"z":1},1.25]}',)], "t string").select(v.parse("t").alias("d"))
    hashes = [r[0] for r in same.select(row_hash(same)).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    nulls = df.select(encode("d", T.VariantType())).collect()
    assert nulls[1][0] == "<NULL>" and nulls[4][0] == "null"
    assert "a" in v.schema_of(df.limit(1), "d").first().schema


def walked(value, path=""):
    """Every element of a JSON value at any depth."""
    if isinstance(value, dict):
        for k, x in value.items():
            at = f"{path}.{k}" if path and k.isalnum() else k if k.isalnum() else path + "['" + k.replace("'", "\\'") + "']"
            yield k, at, None, x
            yield from walked(x, at)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield None, f"{path}[{i}]", i, x
            yield from walked(x, f"{path}[{i}]")


def test_flatten(spark, tmp_path):
    texts = ['{"a":[1,[2,{"k":3}]],"b c":{"it\'s":null},"e":[],"f":{}}', "[]", "{}", "5", None, '{"a":{"a":{"a":{"a":[[[0]]]}}}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", v.parse("t").alias("d"))
    got = v.flatten(df, "d", ["id"], folder=f"{tmp_path}/r").select("id", "key", "path", "index", F.to_json("value").alias("value"), F.to_json("this").alias("this")).collect()
    want = [(i, k, p, n, x) for i, t in enumerate(texts) if t for k, p, n, x in walked(json.loads(t))]
    assert Counter((r.id, r.key, r.path, r["index"], json.dumps(json.loads(r.value), sort_keys=True)) for r in got) == Counter((*w[:4], json.dumps(w[4], sort_keys=True)) for w in want)
    assert all((json.loads(r.this)[r["index"]] if r["index"] is not None else json.loads(r.this)[r.key]) == json.loads(r.value) for r in got)
    outer = v.flatten(df, "d", ["id"], outer=True).collect()
    assert {r.id for r in outer} == set(range(6)) and sum(r.path is None for r in outer) == 4
    assert [r.path for r in v.flatten(df, "d", ["id"], path="a", mode="ARRAY").collect()] == ["a[0]", "a[1]"] and [r.key for r in v.flatten(df, "d", ["id"], path="a", mode="OBJECT").collect()] == ["a"]


def test_order_free_hash(spark):
    df = spark.createDataFrame([(i % 50, None if i % 7 == 0 else f"t{i % 50}", i * 0.5 if i % 3 else None) for i in range(300)], "g int, t string, x double")
    one = lambda d: d.agg(hash_agg(d).alias("h")).first().h
    base = one(df)
    assert base == one(df.orderBy(F.rand(1)).repartition(7))
    changes = [df.withColumn("t", F.when(F.col("x") == 5.0, "").otherwise(F.col("t"))), df.where("x IS NULL OR x <> 5.0"), df.unionByName(df.limit(1)), df.unionByName(df), df.withColumn("x", F.when(F.col("x") == 5.0, 5.5).when(F.col("x") == 5.5, 5.0).otherwise(F.col("x")))]
    assert len({base, *map(one, changes)}) == 6
    assert one(df.limit(0)) == one(df.where("g < 0")) != base


def test_heavy_items(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), f"i{int(rng.paretovariate(0.8))}", rng.random() * 5) for _ in range(60_000)] + [("a", "rare", 4000.0), ("z", "only", 1.0), ("a", None, 3000.0), ("a", "minus", -5.0)]
    df = spark.createDataFrame(rows, "g string, i string, w double").repartition(6)
    exact = Counter()
    for g, i, w in rows:
        exact[g, i] += max(w, 0)
    days = [sketches.top_sums(df.where(F.hash("i", "w") % 2 == k), "g", "i", "w", counters=60) for k in (0, 1, -1)]
    for k, day in enumerate(days):
        day.write.parquet(f"{tmp_path}/{k}")
    stored = spark.read.parquet(*(f"{tmp_path}/{k}" for k in range(3)))
    assert stored.count() <= 60 * 4 * 18
    top = sketches.top_of_sums(stored, 5).collect()
    for g in ("a", "b", None, "z"):
        own = sorted((r for r in top if r.group == g), key=lambda r: r.place)
        best = sorted(((w, i) for (x, i), w in exact.items() if x == g), key=lambda p: -p[0])[:5]
        assert len(own) == min(5, len([1 for (x, i), w in exact.items() if x == g and w > 0]))
        assert all(r.weight <= exact[g, r.item] + 1e-6 <= r.most + 2e-6 for r in own)
        assert own[0].item == best[0][1]
        total = sum(w for (x, _), w in exact.items() if x == g)
        assert max(r.most - r.weight for r in own) <= total / 60 * 4


def test_kept_sketches(spark):
    df = spark.range(60_000).selectExpr("id % 30 AS day", "id % 20000 AS user", "CAST(id AS DOUBLE) AS x")
    kept = sketches.kept_sketches(df, ["day"], "user", "x").withColumn("month", F.floor(F.col("day") / 15))
    for r in sketches.of_sketches(kept, ["month"], [0.1, 0.5, 0.9]).collect():
        lo = r.month * 15
        values = sorted(i for i in range(60_000) if lo <= i % 30 < lo + 15)
        users = len({i % 20000 for i in values})
        assert r.rows == len(values) and abs(r.distinct_values - users) < 0.04 * users
        assert all(abs(sum(y <= q for y in values) / len(values) - p) < 0.01 for p, q in zip((0.1, 0.5, 0.9), r.quantiles))


def test_pivots(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (1, None, 4), (2, "y", None), (3, "z", 7)], "k int, c string, n int")
    wide = reshape.pivot(df, ["k"], "c", {"n": F.sum("n")})
    assert wide.columns == ["k", "x", "y", "z", "null"] and {tuple(r) for r in wide.collect()} == {(1, 5, None, None, 4), (2, None, None, None, None), (3, None, None, 7, None)}
    assert reshape.pivot(df, ["k"], "c", {"n": F.sum("n"), "m": F.count("*")}, values=["y"]).columns == ["k", "y_n", "y_m"]
    with pytest.raises(ValueError, match="more than 3 values"):
        reshape.pivot(df, ["k"], "c", {"n": F.sum("n")}, most=3)
    back = reshape.pivot(reshape.unpivot(wide, ["k"], ["x", "y", "z", "null"], nulls=True), ["k"], "name", {"v": F.first("value")}, values=["x", "y", "z", "null"])
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, wide.collect()), key=repr)
    assert reshape.unpivot(wide, ["k"], ["x", "y"]).count() == 1


def test_collations(spark):
    s = spark.createDataFrame([("Ä", 1), ("b", 2), (None, 3)], "k string, n int")
    t = spark.createDataFrame([("ä", 1), ("B", 5), (None, 4)], "k string, n int")
    found = lambda c: {(r.k, r.source_value, r.target_value) for r in compare.column_differences(s, t, ["k"], collation=c).collect()}
    assert found(None) == {(None, "3", "4")} and found("UTF8_LCASE") == {("b", "2", "5"), (None, "3", "4")}
    a = spark.createDataFrame([("a", 9)], "k string, n int")
    assert compare.keys_missing(s, a, ["k"], collation="UNICODE_CI_AI").count() == 2 and compare.keys_missing(s, a, ["k"], collation="UTF8_LCASE").count() == 3
    assert compare.keys_missing(s, t, ["k"], collation="UTF8_LCASE").count() == 0 and compare.keys_missing(s, t, ["k"]).count() == 2


def test_recursion_ends_on_cycles(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "a int, b int")
    seed = edges.selectExpr("a AS x", "b AS y")
    step = lambda rows: rows.join(edges, F.col("y") == F.col("a")).select("x", "b")
    out = {tuple(r) for r in recursive(seed, step, f"{tmp_path}/r", new_by=["x", "y"]).collect()}
    assert out == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(5, 5)}
    chain = recursive(spark.createDataFrame([(0, 0)], "k int, step int"), lambda rows: rows.where("k < 104").selectExpr("k + 1", "step + 1"), f"{tmp_path}/c")
    assert chain.count() == 105  # more rounds than Spark's own limit


def test_networks(spark):
    urls = ["http://user:pw@WWW.Example.co.uk:80/a?b", "//x.org/p", "https://localhost", "mailto:a@b.c", "no url", None, " ftp://a.b.c.d ", "http://?x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(warehouse.net_host("u"), warehouse.net_public_suffix("u", ["co.uk"]), warehouse.net_reg_domain("u", ["co.uk"])).collect()]
    assert got == [("WWW.Example.co.uk", "co.uk", "example.co.uk"), ("x.org", "org", "x.org"), ("localhost", "localhost", None), (None,) * 3, (None,) * 3, (None,) * 3, ("a.b.c.d", "d", "c.d"), (None,) * 3]


def test_geography(spark):
    p = lambda x, y: geo.point(F.lit(x), F.lit(y))
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(p(181, 0)) is None and one(p(None, 0)) is None and one(geo.as_text(p(1.5, -2))) == "POINT(1.5 -2)"
    assert tuple(one(geo.from_text(F.lit("point( -1.5  2e1 )")))) == (-1.5, 20.0) and one(geo.from_text(F.lit("LINE(1 2)"))) is None
    assert abs(one(geo.distance(p(0, 0), p(180, 0))) - math.pi * geo.RADIUS) < 1 and one(geo.distance(p(3, 4), p(3, 4))) == 0
    assert one(geo.azimuth(p(0, 0), p(0, 5))) == 0 and abs(one(geo.azimuth(p(0, 0), p(-5, 0))) - 1.5 * math.pi) < 1e-9 and one(geo.azimuth(p(1, 1), p(1, 1))) is None
    assert abs(one(geo.length(F.array(p(0, 0), p(1, 0), p(1, 1)))) - 2 * math.radians(1) * geo.RADIUS) < 1 and one(geo.length(F.array(p(0, 0)))) == 0
    ring = F.array(*(p(x, y) for x, y in ((0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0))))
    assert [one(geo.contains(ring, p(x, y))) for x, y in ((1, 1), (5, 5), (9, 8), (11, 1), (-1, 0))] == [True, False, True, False, False]
