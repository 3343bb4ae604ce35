"""Row hashes of two tables compared down a tree: equal parts of the tables never move.

Every row belongs to a bucket, the first BITS bits of its hash, and to a smaller one inside, the next BITS bits. A first pass adds up each
bucket's hashes where rows are read, so a task sends 2^BITS rows at most, whatever it reads. Only rows of buckets with
unequal sums are read on: a second pass adds up their smaller buckets, and only rows of unequal ones are compared one by one.
Equal tables move kilobytes. Each level reads the tables again instead of moving them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.canonical import row_hash
from evenkeel.operators.compare import SAMPLE_ROWS, aligned

BITS = 12
#: Unequal smaller buckets that are sent to every task (12 bytes each); with more of them the first level alone is used.
MOST_SENT = 100_000


def _bucket(level: int) -> Column:
    """So many hexadecimal digits of the hash as a number."""
    digits = BITS // 4
    return F.conv(F.substring("row_hash", digits * level + 1, digits), 16, 10).cast("int").alias(f"bucket{level}")


def _sums() -> list[Column]:
    """Count and order-free sum of the rows of each side. Halves of 60-bit lanes are summed apart, which can't overflow."""
    out = [F.sum(side).alias(f"n_{side}") for side in "st"]
    for lane in range(2):
        value = F.conv(F.substring("row_hash", 15 * lane + 1, 15), 16, 10).cast("long")
        for name, half in (("high", F.shiftright(value, 30)), ("low", value.bitwiseAND(F.lit((1 << 30) - 1)))):
            out += [F.sum(F.col(side) * half).alias(f"{side}_{name}{lane}") for side in "st"]
    return out


_UNEQUAL = " OR ".join(["n_s <> n_t", *(f"s_{name}{lane} <> t_{name}{lane}" for lane in range(2) for name in ("high", "low"))])


class _Tree:
    def __init__(self, source: DataFrame, target: DataFrame, columns: Sequence[str] | None, options: dict):
        left, right = aligned(source, target, columns)
        self.columns = left.columns
        side = lambda df, s: df.select(row_hash(df, **options).alias("row_hash"), F.lit(1 - s).alias("s"), F.lit(s).alias("t"), *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(df.columns)))
        self.sides = side(left, 0), side(right, 1)
        self.both = self._hashes()
        # 2^BITS rows at most
        top = self.both.groupBy(_bucket(0)).agg(*_sums())
        rows = top.select("bucket0", "n_s", "n_t", F.expr(_UNEQUAL).alias("unequal")).collect()
        self.total = sum(r.n_s for r in rows), sum(r.n_t for r in rows)
        self.buckets = sorted(r.bucket0 for r in rows if r.unequal)
        #: By how many of the first unequal buckets they are in.
        self.found: dict[int, list] = {}

    def _hashes(self) -> DataFrame:
        return self.sides[0].select("row_hash", "s", "t").unionAll(self.sides[1].select("row_hash", "s", "t"))

    def _in_buckets(self, df: DataFrame, buckets: Sequence[int]) -> DataFrame:
        """Rows of some buckets: a lookup in a list of 2^BITS flags."""
        wanted = set(buckets)
        marked = "".join("1" if b in wanted else "0" for b in range(1 << BITS))
        return df.where(F.substring(F.lit(marked), _bucket(0) + 1, F.lit(1)) == "1")

    def smaller(self, buckets: Sequence[int]) -> list:
        """The unequal smaller buckets of some buckets: bucket0, bucket1, n_s, n_t; MOST_SENT + 1 at most. The tables are read for it once."""
        if len(buckets) in self.found:
            return self.found[len(buckets)]
        sums = self._in_buckets(self.both, buckets).groupBy(_bucket(0), _bucket(1)).agg(*_sums()).where(_UNEQUAL)
        self.found[len(buckets)] = sums.select("bucket0", "bucket1", "n_s", "n_t").limit(MOST_SENT + 1).collect()
        return self.found[len(buckets)]

    def within(self, df: DataFrame, chosen: Sequence[tuple[int, int]]) -> DataFrame:
        """Rows of some smaller buckets, of MOST_SENT at most."""
        sent = F.broadcast(df.sparkSession.createDataFrame([tuple(x) for x in chosen], "b0 int, b1 int"))
        near = self._in_buckets(df, sorted({x[0] for x in chosen}))
        return near.join(sent, (_bucket(0) == F.col("b0")) & (_bucket(1) == F.col("b1")), "left_semi")

    def narrowed(self) -> list[DataFrame]:
        """Both sides' hashes of unequal buckets (row_hash, s, t)."""
        sides = [df.select("row_hash", "s", "t") for df in self.sides]
        if not self.buckets:
            return [df.limit(0) for df in sides]
        if len(self.buckets) <= 1 << BITS - 1:  # where most differ a second level would read everything for little
            small = self.smaller(self.buckets)
            if len(small) <= MOST_SENT:
                return [self.within(df, [(r.bucket0, r.bucket1) for r in small]) for df in sides]
        return [self._in_buckets(df, self.buckets) for df in sides]

    def first_of(self, side: int, most: int) -> list[tuple[int, int]] | None:
        """Smaller buckets that hold the `most` least unmatched hashes of a side, from the first unequal bucket on; None if more than MOST_SENT are needed.

        An unequal smaller bucket in which a side has no fewer rows than the other has an unmatched row of that side.
        """
        some = 16
        while True:
            small = self.smaller(self.buckets[:some])
            if len(small) > MOST_SENT:
                return None
            chosen, sure = [], 0
            for r in sorted(small, key=lambda r: (r.bucket0, r.bucket1)):
                own, other = (r.n_s, r.n_t) if side == 0 else (r.n_t, r.n_s)
                if own:
                    chosen.append((r.bucket0, r.bucket1))
                    sure += own >= other
                if sure >= most:
                    return chosen
            if some >= len(self.buckets):
                return chosen
            some *= 8


def row_hashes(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = None, **options) -> DataFrame:
    """What compare.row_hashes returns: counts of matched and unmatched rows, similarity and a status."""
    tree = _Tree(source, target, columns, options)
    n_s, n_t = tree.total
    left, right = tree.narrowed()
    sides = left.unionAll(right).groupBy("row_hash").agg(F.sum("s").alias("n_s"), F.sum("t").alias("n_t"))
    more = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0))
    out = sides.agg(more("n_s", "n_t").alias("source_not_in_target_count"), more("n_t", "n_s").alias("target_not_in_source_count"))
    matched = F.lit(n_s).cast("long") - F.col("source_not_in_target_count")
    most = matched + F.col("source_not_in_target_count") + F.col("target_not_in_source_count")
    out = out.select(F.lit(n_s).cast("long").alias("source_hash_count"), F.lit(n_t).cast("long").alias("target_hash_count"), matched.alias("matched_hash_count"), "source_not_in_target_count", "target_not_in_source_count", F.coalesce(F.try_divide(matched, most), F.lit(1.0)).alias("similarity"))
    perfect = (F.col("source_not_in_target_count") == 0) & (F.col("target_not_in_source_count") == 0)
    return out.withColumn("status", F.when(perfect | (F.lit(bool(threshold)) & (F.col("similarity") >= (threshold or 2))), F.lit("PASS")).otherwise(F.lit("FAIL")))


def unmatched_rows(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, most: int = SAMPLE_ROWS, **options) -> DataFrame:
    """Up to `most` whole rows of each side that have no equal on the other: those with the least hashes.

    side (source or target), row_hash, surplus (how many more of it the side has) and the columns under the source's names. The first unequal
    buckets hold them, so rows of those alone are read on, and travel with their hash: none is encoded again. Only where that
    takes more buckets than may be sent are the hashes compared first and their rows looked up.
    """
    tree = _Tree(source, target, columns, options)
    out = []
    for side, name in enumerate(("source", "target")):
        own, other = tree.sides[side], tree.sides[1 - side].select("row_hash")
        values = F.struct(*(F.col(f"v{i}") for i in range(len(tree.columns))))
        chosen = tree.first_of(side, most) if tree.buckets else []
        if chosen is None:
            sides = own.select("row_hash", F.lit(1).alias("n")).unionAll(other.select("row_hash", F.lit(-1).alias("n")))
            first = sides.groupBy("row_hash").agg(F.sum("n").alias("surplus")).where("surplus > 0").orderBy("row_hash").limit(most)
            rows = own.select("row_hash", values.alias("row")).join(F.broadcast(first), "row_hash")
            first = rows.groupBy("row_hash", "surplus").agg(F.first("row").alias("row"))
        else:
            near = [tree.within(df, chosen) if chosen else df.limit(0) for df in (own.select("row_hash", values.alias("row")), other)]
            kind = near[0].schema["row"].dataType
            both = near[0].select("row_hash", F.lit(1).alias("n"), "row").unionAll(near[1].select("row_hash", F.lit(-1).alias("n"), F.lit(None).cast(kind).alias("row")))
            first = both.groupBy("row_hash").agg(F.sum("n").alias("surplus"), F.first("row", ignorenulls=True).alias("row")).where("surplus > 0").orderBy("row_hash").limit(most)
        out.append(first.select(F.lit(name).alias("side"), "row_hash", "surplus", *(F.col(f"row.v{i}").alias(c) for i, c in enumerate(tree.columns))))
    return out[0].unionByName(out[1])
