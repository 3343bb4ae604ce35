"""Near-duplicate documents by a grouped prefix join on word shingles.

A document is its set of distinct k-word shingles. Two link when the Jaccard similarity reaches a threshold t.

1. Shingles get one global order: by how often their hash cell occurs in the corpus (a table of fixed size over all
   documents, counted in one pass), then by hash. Any fixed order gives right results; rare first keeps lists short.
2. Equal sets become one. A set's prefix is its first n - ceil(t n) + 1 shingles: sets that link share one of them.
3. Sets with the same prefix and size become a group, and groups meet in the lists of their prefix shingles. Lists
   are split by size class (a factor 1/t), as sizes of a link differ no more. A pair has to pass the positional filter:
   what can still be shared from the two positions on must reach the overlap that t asks for.
4. Pairs are expanded to members and verified on whole sets, if their counts of shingles in 64 buckets let them link. First every list is tied to one group of it (the one with
   the earliest position); once components are known, only pairs that lie in different components are still formed.
   So a family of m near copies costs about m pairs, not m squared, and no pair that could join two components
   is left out: components are exact.
   A set's sketch is the parity of the numbers of its shingles in 256 cells. Two sets' sketches differ in no more cells than
   the sets differ in shingles, so a pair whose sketches differ in more can't link and isn't formed: exact, and enough to
   keep templated pages apart, which share rare paragraphs by the hundred without linking.
5. A list of more than CROWD groups that are still apart isn't joined with itself. Its members are split by what they hold in the parts of a second partition: two sets that link differ in
   no more than (1 - t) / (1 + t) of their sizes' sum, so of one part more than that, taken by the shingles' hashes, one is the same in
   both. Only members with an equal part meet, and those of a list's largest component only with others.

What a list's counts decide is written before the list's rows meet it, so that a list with a third of all rows is dealt
over tasks by the adaptive skew join.

Results that are defined: a null, empty or blank text has an empty set and links with nothing (its component is its
own id); fewer than k words count as one shingle; equal sets are one component whatever t; the component of a row
is the least id reachable; ids are integers, and rows that share an id hold the same text (else an error where both
texts have no lesser id); rows with a null id come back with a null
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import components, cut, discard, mix, shingles

CELLS, PARTS = 1 << 21, 512
SALTS, BUCKETS = 32, 64
#: Groups of a list that are held against one another; larger ones are split first.
CROWD = 1024
SKETCH = ("p0", "p1", "p2", "p3")


def least_size(n: int, percent: int) -> int:
    """ceil(t n): sizes and overlaps that t asks for, in whole numbers."""
    return -(-n * percent // 100)


# ---------------------------------------------------------------- global order


def _counting(k: int):
    """Each task's counts of hash cells, in PARTS pieces: low bytes, and the cells that need more with the rest."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            held, size = [], 0
            for _, found in shingles(batch.column(0).to_pylist(), k):
                held.append(found)
                size += len(found)
                if size > 1 << 20:
                    counts += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                    held, size = [], 0
            if size:
                counts += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if counts.any():
            pieces = counts.reshape(PARTS, -1)
            large = [np.flatnonzero(p > 255) for p in pieces]
            columns = [pa.array(range(PARTS), pa.int32()), pa.array([p.astype(np.uint8).tobytes() for p in pieces], pa.binary()), pa.array(large, pa.list_(pa.int64())), pa.array([p[i] >> 8 for p, i in zip(pieces, large)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "low", "cells", "high"])

    return run


def _adding(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS // PARTS, np.int64)
    for low, cells, high in zip(pdf["low"], pdf["cells"], pdf["high"]):
        total += np.frombuffer(low, np.uint8)
        total[np.asarray(cells, np.int64)] += np.asarray(high, np.int64) << 8
    levels = np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8)
    return pd.DataFrame({"part": [key[0]], "levels": [levels.tobytes()]})


def frequency_levels(texts: DataFrame, k: int) -> np.ndarray:
    """A level from 0 to 255 for each hash cell: eight to a doubling of the count. CELLS bytes, whatever the input."""
    rows = texts.mapInArrow(_counting(k), "part int, low binary, cells array<long>, high array<long>").groupBy("part").applyInPandas(_adding, "part int, levels binary").collect()
    levels = np.zeros(CELLS, np.uint8)
    step = CELLS // PARTS
    for r in rows:
        levels[r.part * step : (r.part + 1) * step] = np.frombuffer(r.levels, np.uint8)
    return levels


def tokens(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in global order: the level, then 56 bits of the hash."""
    ranked = (levels[(found & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
    return np.unique(ranked)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens in 256 cells, as four integers."""
    cells = (mix(own) & np.uint64(255)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)  # keeps the order


def tokens_of(signed: np.ndarray) -> np.ndarray:
    return signed.view(np.uint64) ^ np.uint64(1 << 63)


def _prefixes(k: int, percent: int, shared):
    def run(batches):
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 2048):
                sizes, digests, heads, prefixes, sketches = [], [], [], [], []
                for _, found in shingles(batch.column(1).slice(at, 2048).to_pylist(), k):
                    own = tokens(found, levels)
                    n = len(own)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                    head = own[: n - least_size(n, percent) + 1]
                    heads.append(hashlib.blake2b(head.tobytes(), digest_size=16).digest() if n else None)
                    prefixes.append(_signed(head) if n else None)
                    sketches.append(sketch(own))
                columns = [pa.array(np.ascontiguousarray(c)) for c in np.array(sketches, np.int64).reshape(-1, 4).T]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 2048), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(heads, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), *columns], names=["id", "n", "digest", "head", "prefix", *SKETCH])

    return run


def _sets(k: int, shared):
    """Whole sets, and how many of their shingles fall into each of BUCKETS."""

    def run(batches):
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [_signed(tokens(x, levels)) for _, x in shingles(batch.column(1).slice(at, 512).to_pylist(), k)]
                buckets = [np.bincount(x & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array([len(x) for x in found], pa.int32()), pa.array(buckets, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "buckets", "tokens"])

    return run


def parts_of(cls: int, percent: int) -> int:
    """One more than the shingles in which two linked sets of the size class can differ: sizes are below (1/t)^(cls + 1)."""
    most = (100 / percent) ** (cls + 1)
    return int(2 * most * (100 - percent) / (100 + percent) + 1e-6) + 1


def _parted(percent: int):
    """For each node and size class a row for each part: the part's number and class, and a hash of what the set holds in it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                nodes, classes, components = (some.column(c).to_pylist() for c in ("node", "cls", "component"))
                out: list[list[np.ndarray]] = [[] for _ in range(5 + len(SKETCH))]
                for node, cls, component, found in zip(nodes, classes, components, some.column("tokens").to_pylist()):
                    own = np.array(found, np.int64).view(np.uint64)
                    spread = mix(own)
                    parts = parts_of(cls, percent)
                    place = (spread % np.uint64(parts)).astype(np.int64)
                    held = np.zeros(parts, np.uint64)
                    np.add.at(held, place, mix(spread ^ np.uint64(0x5851F42D4C957F2D)))
                    number = np.bincount(place, minlength=parts).astype(np.uint64)
                    name = mix((np.uint64(cls) << np.uint64(32)) + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number * np.uint64(0xD1342543DE82EF95))
                    for column, values in zip(out, (np.full(parts, node), np.full(parts, component), np.full(parts, len(own)), held.view(np.int64), name.view(np.int64), *(np.full(parts, c) for c in sketch(tokens_of(own))))):
                        column.append(values)
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["node", "component", "n", "held", "part", *SKETCH])

    return run


# ---------------------------------------------------------------- candidates and links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that link, written. Rows of an `a` with many partners are dealt over salts."""
    pairs = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    # two sets share no more than the lesser count of each bucket, so most pairs go before whole sets move
    small = [sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("buckets").alias(f"b{c}")) for c in "xy"]
    most = F.aggregate(F.zip_with("bx", "by", lambda p, q: F.least(p, q)), F.lit(0), lambda total, c: total + c)
    pairs = cut(pairs.join(small[0], "x").join(small[1], "y").where(most * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent).select("x", "y"), "pairs")
    plain = pairs
    both = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).groupBy("node").agg(F.count("*").alias("partners"))
    pairs = cut(pairs.join(both.withColumnRenamed("node", "x").withColumnRenamed("partners", "px"), "x").join(both.withColumnRenamed("node", "y").withColumnRenamed("partners", "py"), "y"), "pairs")
    # a: the one with more partners; its set is repeated once for every 64 of them
    more = F.col("px") >= F.col("py")
    turned = pairs.select(F.when(more, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(more, F.col("y")).otherwise(F.col("x")).alias("b"), F.ceil(F.greatest("px", "py") / 64).cast("int").alias("salts"))
    turned = turned.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    copies = turned.groupBy("a").agg(F.max("salts").alias("salts")).join(sets, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("tokens").alias("ta"))
    joined = turned.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(copies, ["a", "salt"])
    shared = F.size(F.array_intersect("ta", "tb"))
    linked = joined.select("a", "b", shared.alias("s"), (F.size("ta") + F.size("tb") - shared).alias("u")).where(F.col("s") * 100 >= F.col("u") * percent)
    links = cut(linked.select("a", "b"), "links")
    discard(plain, pairs)
    return links


def _may_link(a: str, b: str, percent: int) -> Column:
    """Size and positional filter: n sizes, r what is left from the shared shingle on (itself included)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(F.col(f"{a}.r"), F.col(f"{b}.r")) >= need)


def _equal_parts(parted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that hold the same in one part and may link by their sizes.

    Where many nodes of one component share a part they meet only those of others, so a family of near copies costs no square.
    """
    key = ["held", "part"]
    sizes = parted.groupBy(*key, "component").agg(F.count("*").alias("own"))
    top = sizes.groupBy(*key).agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("own", "component")).alias("most")).where("kinds > 1").select(*key, "most")
    met = parted.join(top, key)
    first = met.where("component <> most").select(*key, F.struct("node", "component", "n", *SKETCH).alias("p"))
    second = met.select(*key, F.struct("node", "component", "n", "most", *SKETCH).alias("q"))
    once = (F.col("q.component") == F.col("q.most")) | (F.col("p.node") < F.col("q.node"))
    fit = F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * percent
    return first.join(second, key).where((F.col("p.component") != F.col("q.component")) & once & fit & _near("p", "q", percent)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two sets' sketches differ in no more cells than linked sets differ in shingles."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    need = F.ceil(both * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    return apart <= both - 2 * need


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id. percent: the threshold t in hundredths."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(frequency_levels(rows.select("text"), k).tobytes())
    about = cut(rows.mapInArrow(_prefixes(k, percent, shared), "id long, n int, digest binary, head binary, prefix array<long>, p0 long, p1 long, p2 long, p3 long"), "prefixes")

    # equal sets: one node each, named by the least id
    named = about.where("digest is not null and id is not null")
    nodes = cut(named.groupBy("digest", "head", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in SKETCH)), "sets")
    twice = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"rows with the id {twice.node} hold different texts")
    # groups: the same prefix and size
    members = cut(nodes.groupBy("head", "n").agg(F.min("node").alias("grp"), F.count("*").alias("members")).join(nodes.select("head", "n", "node"), ["head", "n"]).select("grp", "members", "node"), "members")
    heads = members.where("grp = node").select("grp")
    groups = cut(named.select("id", "n", "prefix").join(heads, F.col("id") == F.col("grp"), "left_semi").select(F.col("id").alias("grp"), "n", "prefix"), "groups")
    # most shingles of a prefix are in no other: they are dropped before anything wider is moved
    posted = groups.select("grp", "n", F.posexplode("prefix").alias("at", "token")).select("token", "grp", "n", (F.col("n") - F.col("at")).alias("r"))
    common = cut(posted.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1").select("token"), "common")
    posted = cut(posted.join(common, "token"), "postings")
    discard(groups, common)
    # a size class and the next: two sizes that differ by no more than 1/t meet in the class of the larger
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent)) + F.lit(1e-9)).cast("int")
    lists = posted.withColumn("own", own).withColumn("cls", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    # lists with a native member and another one
    busy = lists.groupBy("token", "cls").agg(F.count("*").alias("size"), F.max(F.col("own") == F.col("cls")).alias("native"), F.max(F.struct(F.col("r") / F.col("n"), -F.col("grp"))).alias("top")).where("size > 1 and native")
    busy = cut(busy.select("token", "cls", (-F.col("top.col2")).alias("pivot")), "busy")
    lists = cut(lists.join(busy, ["token", "cls"]).select("token", "cls", "grp", "n", "r", "pivot"), "lists")
    discard(posted, busy)

    group_classes = members.where("grp = node").join(nodes.select("node", "n"), "node").select("grp", own.alias("cls"))
    candidates = lists.select(F.col("grp").alias("g")).distinct()
    wanted = members.join(candidates, F.col("grp") == F.col("g"), "left_semi").select("node").union(members.where("members > 1").select("node")).distinct()
    texts = rows.join(wanted, F.col("id") == F.col("node"), "left_semi")
    sets = cut(texts.mapInArrow(_sets(k, shared), "node long, n int, buckets array<int>, tokens array<long>"), "whole-sets")

    def expand(group_pairs: DataFrame) -> DataFrame:
        """Group pairs (g, h): the head of each with all members of the other."""
        one = group_pairs.join(members, F.col("h") == F.col("grp")).select(F.col("g").alias("a"), F.col("node").alias("b"))
        return one.union(group_pairs.join(members.where("members > 1"), F.col("g") == F.col("grp")).select(F.col("h").alias("a"), F.col("node").alias("b")))

    pivots = lists.where("grp = pivot").select("token", "cls", F.struct("grp", "n", "r").alias("p"))
    star = lists.where("grp <> pivot").select("token", "cls", F.struct("grp", "n", "r").alias("q")).join(pivots, ["token", "cls"]).where(_may_link("p", "q", percent))
    star = expand(star.select(F.col("p.grp").alias("g"), F.col("q.grp").alias("h")).distinct())
    within = members.where("members > 1 and grp <> node").select(F.col("grp").alias("a"), F.col("node").alias("b"))
    links = _verified(star.union(within), sets, percent)
    first_labels = cut(components(links), "labels")

    # what lies in different components and may still link
    known = cut(members.join(nodes.select("node", "n", *SKETCH), "node").join(first_labels, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("component"), "n", *SKETCH), "known")
    spread = known.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).join(known.where("grp = node").select("grp", *SKETCH), "grp")
    open_lists = lists.select("token", "cls", "grp", "n", "r").join(spread, "grp")
    mixed = cut(open_lists.groupBy("token", "cls").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count("*").alias("size")).where("l <> h").select("token", "cls", "size"), "mixed")
    open_lists = cut(open_lists.join(mixed, ["token", "cls"]), "open-lists")
    split = spread.where("low <> high").select("grp", "members")
    crowded = open_lists.where(F.col("size") > CROWD).select("grp", "cls").union(split.where(F.col("members") > CROWD).join(group_classes, "grp").select("grp", "cls"))
    crowded = cut(crowded.distinct(), "crowded")
    side = F.struct("grp", "n", "r", "low", "high", "crowd", "members", *SKETCH)
    apart = (F.col("p.low") != F.col("q.low")) | (F.col("p.low") != F.col("p.high")) | (F.col("q.low") != F.col("q.high"))
    # two that are split in this size class meet by their parts
    few = open_lists.where(F.col("size") <= CROWD).join(crowded.withColumn("crowd", F.lit(True)), ["grp", "cls"], "left").withColumn("crowd", F.col("crowd").isNotNull())
    # a group's sketch is that of its only member
    near = (F.col("p.members") > 1) | (F.col("q.members") > 1) | _near("p", "q", percent)
    first, second = few.select("token", "cls", side.alias("p")), few.select("token", "cls", side.alias("q"))
    rest = first.join(second, ["token", "cls"]).where((F.col("p.grp") < F.col("q.grp")) & ~(F.col("p.crowd") & F.col("q.crowd")) & apart & _may_link("p", "q", percent) & near).select(F.col("p.grp").alias("g"), F.col("q.grp").alias("h")).distinct()
    rest = rest.union(split.where(F.col("members") <= CROWD).select(F.col("grp").alias("g"), F.col("grp").alias("h")))
    left, right = known.select(F.col("grp").alias("g"), F.col("node").alias("a"), F.col("component").alias("ca"), F.struct("n", *SKETCH).alias("x")), known.select(F.col("grp").alias("h"), F.col("node").alias("b"), F.col("component").alias("cb"), F.struct("n", *SKETCH).alias("y"))
    rest = rest.join(left, "g").join(right, "h").where((F.col("ca") != F.col("cb")) & _near("x", "y", percent)).select("a", "b")
    parted = None
    if not crowded.isEmpty():
        parted = cut(crowded.join(known.select("grp", "node", "component"), "grp").join(sets.select("node", "tokens"), "node").select("node", "cls", "component", "tokens").mapInArrow(_parted(percent), "node long, component long, n long, held long, part long, p0 long, p1 long, p2 long, p3 long"), "parts")
        rest = rest.union(_equal_parts(parted, percent))
    more = _verified(rest, sets, percent)
    labels = cut(components(more.union(first_labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))), "labels")
    discard(members, lists, sets, links, first_labels, known, mixed, open_lists, more, crowded, *([parted] if parted is not None else []))

    # back to rows: sets with copies over salts, so that no group of copies meets in one task
    done = nodes.join(labels, "node", "left").select("digest", "n", "node", "copies", F.coalesce("component", "node").alias("component"))
    several = done.where("copies > 1").select("digest", "n", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = about.where("digest is not null and id is not null").select("id", "n", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    copied = salted.join(several, ["digest", "n", "salt"]).select("id", "n", "component")
    single = done.where("copies = 1").select(F.col("node").alias("id"), "n", "component")
    lone = about.where("digest is null or id is null").select("id", "n", F.col("id").alias("component"))
    return copied.unionByName(single).unionByName(lone).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
