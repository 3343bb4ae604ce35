"""Near duplicates among vectors by a pivot-permutation index.

Each vector is described by its nearest reference points in order (the first `depth` of its permutation). An inverted
list for each pivot holds the vectors that it describes. Two vectors of a list are candidates if they share at least
`shared` pivots; candidates are verified by their cosine in double precision. A pair that shares enough pivots
must share one of the rarest `depth - shared + 1` of either, so a vector enters only those lists, and a pair is
counted in the list of its rarest shared pivot alone. A list of more than `block` entries is split by a second pivot, and
one that is still longer by a third, each among the pivots that come after in popularity: a pair is then counted in the
list of its two or three rarest shared pivots. So lists stay short when rows grow beyond what the pivots tell apart: their number
goes up to the third power of the pivots'.

Equal vectors become one first. A list of three pivots that is still long is a crowd of vectors that mostly do link; it is split
into blocks of rows and a task gets two blocks, so no list has to fit into one task. Counting every link of a crowd takes time
with the square of its size. Tasks return counts of links and a spanning forest of what they linked, never all pairs.

The reference points are a bounded sample of the vectors (their number grows with the square root of the rows, to
MAX_PIVOTS at most); all vectors are indexed. Recall is measured in the tests against brute force.

Results that are defined: a vector that is null, empty, all zero or holds null or non-finite components links with
nothing and is kept, and so is a row with a null id; vectors of different lengths don't link; rows that share an id
share its links; ties of distance go to the lower pivot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import components, cut, first_by_hash

COSINE, DEPTH, SHARED, BLOCK, MAX_PIVOTS, APART, SALTS = 0.95, 8, 3, 2048, 2048, 0.7, 64


def pivot_count(rows: int) -> int:
    return int(min(max(32, 2 ** round(np.log2(max(rows, 1)) / 2 + 0.5)), MAX_PIVOTS))


def unit(rows) -> np.ndarray:
    found = np.stack([np.asarray(r, np.float64) for r in rows])
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def apart(vectors: np.ndarray, wanted: int, nearest: float = APART) -> np.ndarray:
    """The first vectors, at most `wanted`, of which no two have a cosine above `nearest`.

    Pivots from one cloud of near copies would fill the lists of all that is near it, in an order that is noise.
    """
    kept: list[int] = []
    for i, v in enumerate(vectors):
        if len(kept) < wanted and (not kept or (vectors[kept] @ v).max() <= nearest):
            kept.append(i)
    return vectors[kept]


def describe(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the `depth` nearest pivots of unit vectors, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, : min(depth, len(pivots))]


def _describing(pivots: np.ndarray, depth: int):
    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                yield pd.DataFrame({"node": part["node"], "weight": part["weight"], "v": part["v"], "pivots": list(describe(unit(part["v"]), pivots, depth).astype(np.int16))})

    return run


def _verifying(cosine: float, shared: int):
    """Of two blocks of a list: each row's weight of links to the other block (b is null), and edges (n is 0) that span what is linked."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *named, low, high = key
        named = [p for p in named if p >= 0]
        left = pdf[pdf["block"] == low]
        right = pdf[pdf["block"] == high]
        found: list[tuple] = []
        if len(left) and len(right):
            x, y = unit(left["v"]), unit(right["v"])
            p, q = np.stack(left["pivots"].to_numpy()), np.stack(right["pivots"].to_numpy())
            rows_, cols_ = [], []
            for i in range(0, len(x), 256):
                a = p[i : i + 256]
                count, rare = (np.zeros((len(a), len(q)), np.int8) for _ in range(2))
                for c in range(a.shape[1]):
                    for d in range(q.shape[1]):
                        equal = a[:, c, None] == q[None, :, d]
                        count += equal
                        rare += equal & (a[:, c, None] <= named[-1])
                # here and nowhere else: the list's pivots are the rarest that the two share
                r, s = np.nonzero((count >= min(shared, p.shape[1])) & (rare == len(named)))
                if low == high:
                    r, s = r[r + i < s], s[r + i < s]
                near = np.einsum("ij,ij->i", x[i + r], y[s]) >= cosine
                rows_.append(i + r[near])
                cols_.append(s[near])
            rows, cols = np.concatenate(rows_), np.concatenate(cols_)
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            for nodes, count in ((a, np.bincount(rows, right["weight"].to_numpy()[cols], len(a))), (b, np.bincount(cols, left["weight"].to_numpy()[rows], len(b)))):
                found += [(u, None, int(n)) for u, n in zip(nodes.tolist(), count.tolist()) if n]
            label: dict[int, int] = {}

            def root(v: int) -> int:
                while label.setdefault(v, v) != v:
                    label[v] = label[label[v]]
                    v = label[v]
                return v

            for u, v in zip(a[rows].tolist(), b[cols].tolist()):
                ru, rv = root(u), root(v)
                if ru != rv:
                    label[max(ru, rv)] = min(ru, rv)
                    found.append((u, v, 0))
        return pd.DataFrame({c: pd.array([f[i] for f in found], "Int64") for i, c in enumerate("abn")})

    return run


def _links(nodes: DataFrame, cosine: float, depth: int, shared: int, block: int) -> DataFrame:
    """a, b, n as _verifying returns them, for distinct vectors of one length."""
    total = nodes.count()
    wanted = pivot_count(total)
    sample = first_by_hash(nodes, 3 * wanted, total, "v", "node").select("v").collect()
    pivots = apart(unit([r.v for r in sample]), wanted)
    kind = nodes.schema["v"].dataType.simpleString()
    described = cut(nodes.select("node", "weight", "v").mapInPandas(_describing(pivots, depth), f"node long, weight long, v {kind}, pivots array<short>"), "described")
    popular = {r.p: r.n for r in described.select(F.explode("pivots").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}  # MAX_PIVOTS at most
    ranks = {p: i for i, p in enumerate(sorted(popular, key=lambda p: (popular[p], p)))}
    by_rank = F.array(*(F.lit(ranks.get(p, 0)) for p in range(len(pivots)))) if ranks else F.array(F.lit(0))
    # lists are named by popularity from here on: 0 is the rarest pivot
    ranked = described.withColumn("pivots", F.array_sort(F.transform("pivots", lambda p: by_rank[p].cast("short"))))
    prefix = max(1, min(depth, len(pivots)) - min(shared, len(pivots)) + 1)
    names = ["p1", "p2", "p3"]
    entries = ranked.select("*", F.posexplode(F.slice("pivots", 1, prefix)).alias("at", "p1"))
    entries = entries.withColumns({"p2": F.lit(-1).cast("short"), "p3": F.lit(-1).cast("short")})
    dealt = None
    for level in range(1, max(1, min(3, shared, len(pivots))) + 1):
        sizes = cut(entries.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > block), "long-lists")
        last = level == min(3, shared, len(pivots)) or sizes.isEmpty()
        met = entries.join(sizes, names, "left")
        short = (met if last else met.where("n is null")).withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")).drop("n", "at")
        dealt = short if dealt is None else dealt.unionByName(short)
        if last:
            break
        # the next pivot: one of those after the last, as long as enough are left to make up the shared ones
        entries = met.where("n is not null").drop("n", names[level]).withColumn("begin", F.col("at") + 1).drop("at").select("*", F.posexplode(F.slice("pivots", F.col("begin") + 1, F.greatest(F.lit(prefix + level) - F.col("begin"), F.lit(0)))).alias("step", names[level]))
        entries = entries.withColumn("at", F.col("begin") + F.col("step")).drop("begin", "step")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*names, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "weight", "v", "pivots", "block")
    return pairs.groupBy(*names, "low", "high").applyInPandas(_verifying(cosine, shared), "a long, b long, n long")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    depth: int = DEPTH,
    shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept. Ids are integers."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v")), "vectors")
    nodes = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vector-nodes")
    found = [_links(nodes.where(F.size("v") == r.n), cosine, depth, shared, block) for r in nodes.select(F.size("v").alias("n")).distinct().collect()]
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not found:
        return lone.withColumn("kept", F.lit(True))
    counted = found[0]
    for more in found[1:]:
        counted = counted.unionByName(more)
    counted = cut(counted, "vector-links")
    linked = counted.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    labels = components(counted.where("b is not null").select("a", "b"))
    about = nodes.join(linked, "node", "left").join(labels, "node", "left").select("v", "node", "weight", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    about = cut(about, "vector-about")
    # Rows that share a vector are dealt over salts; the vector's result is there for each salt.
    several = about.where("weight > 1").drop("node", "weight").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = rows.where("v is not null").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(several, ["v", "salt"]).select("vec_id", "n_links", "component_id")
    single = about.where("weight = 1").select(F.col("node").alias("vec_id"), "n_links", "component_id")
    return copies.unionByName(single).unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
