"""Contiguous sharding with the least largest shard (DataFrame functions only).

Groups of equal texts are atomic and stand in the order of their MD5. The smallest feasible shard capacity is
found by binary search; a capacity is feasible if greedy filling needs no more than the given number of shards.
Cuts then go as near to equal shares as that capacity lets them, so no shard at the end stays short.
Greedy filling only needs the ordered prefix sums of group sizes, so the driver works on a coarse histogram
(4,096 cells of key prefixes) and refines just the cells in which a cut can still fall, 256-fold each time:
a few hundred cells for each round, whatever the size of the corpus. The cuts are then 15 key literals.

Groups above the mean of the shards that are left (at most one for each shard) first get a shard of their own;
no contiguous order could place them better. Slots are numbered by the counts of 1,024 buckets of row numbers
(written with the rows) in each shard, so no window sees a whole shard, a group of copies or repeated rows.

Results that are defined: a null text has no bytes and counts as an empty text; a null id is a value like any other;
repeated rows each get a slot; an empty table gives no rows; fewer groups than shards leave shards empty; other
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

SHARDS, BUCKETS = 16, 1024


class Cells:
    """Ordered key prefixes with their bytes and numbers of groups; a cell of one group is atomic."""

    def __init__(self, cells: dict[str, tuple[int, int]]) -> None:
        self.keys = sorted(cells)
        self.atomic = [cells[k][1] == 1 for k in self.keys]
        self.ends = [0, *accumulate(cells[k][0] for k in self.keys)]

    def cuts(self, capacity: int, shards: int, fluid: bool) -> tuple[list[int], bool]:
        """Greedy ends of shards in bytes, and if all fits. fluid: cells of several groups can be cut anywhere, else nowhere."""
        at, found, total = 0, [], self.ends[-1]
        for _ in range(shards - 1):
            end = min(at + capacity, total)
            if end < total:
                cell = bisect_right(self.ends, end) - 1
                if self.atomic[cell] or not fluid:
                    end = max(self.ends[cell], at)
            at = end
            found.append(at)
        return found, total - at <= capacity

    def least(self, shards: int, fluid: bool) -> int:
        low, high = -(-self.ends[-1] // shards), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, fluid)[1]:
                high = mid
            else:
                low = mid + 1
        return low

    def mirrored(self) -> Cells:
        """The same cells from the end."""
        out = object.__new__(Cells)
        out.keys, out.atomic = self.keys[::-1], self.atomic[::-1]
        out.ends = [self.ends[-1] - e for e in reversed(self.ends)]
        return out

    def even(self, shards: int) -> tuple[list[int], set[str]]:
        """Cuts of the least capacity that lie as near below equal shares as it lets them, and cells to refine first.

        A cut must not lie before the point from which the shards behind it can hold the rest.
        """
        capacity, total = self.least(shards, True), self.ends[-1]
        behind = self.mirrored().cuts(capacity, shards, True)[0]
        found, at, wanted = [], 0, set()
        for i in range(1, shards):
            end = min(at + capacity, i * total // shards)
            cell = bisect_right(self.ends, end) - 1
            if end < total and self.ends[cell] < end and not self.atomic[cell]:
                wanted.add(self.keys[cell])
            at = max(self.ends[cell] if end < total else total, total - behind[shards - 1 - i])
            found.append(at)
        return found, wanted

    def open_cells(self, shards: int) -> list[str]:
        """Cells of several groups that a cut may still fall into."""
        both = self._open(shards) | self.mirrored()._open(shards)
        return sorted(both or self.even(shards)[1])

    def _open(self, shards: int) -> set[str]:
        first = self.cuts(self.least(shards, True), shards, False)[0]
        last = self.cuts(self.least(shards, False), shards, True)[0]
        found = set()
        for a, b in zip(first, last):
            cell = bisect_right(self.ends, a) - 1
            while cell < len(self.keys) and (self.ends[cell] < b or cell == bisect_right(self.ends, a) - 1):
                if not self.atomic[cell]:
                    found.add(self.keys[cell])
                cell += 1
        return found


def boundaries(groups: DataFrame, shards: int) -> list[str]:
    """Least keys of the shards after the first; groups has key (32 hex digits) and bytes. Fewer if the rest is empty."""
    if shards < 2:
        return []
    digits = 3

    def histogram(part: DataFrame) -> dict:
        rows = part.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        return {r.cell: (r.bytes, r.n) for r in rows}

    cells = histogram(groups)
    while cells:
        seen = Cells(cells)
        wanted = seen.open_cells(shards)
        if not wanted:
            ends = seen.even(shards)[0]
            starts = dict(zip(seen.ends, seen.keys))
            return [starts[e] for e in ends if e in starts]
        width = {len(k) for k in wanted}
        digits = max(width) + 2
        within = groups.where(F.coalesce(*(F.when(F.substring("key", 1, w).isin([k for k in wanted if len(k) == w]), F.lit(True)) for w in sorted(width)), F.lit(False)))
        for k in wanted:
            del cells[k]
        cells |= histogram(within)
    return []


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), group_key (MD5 of the text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for g in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if g.bytes * (shards - len(alone)) <= left:
            break
        alone.append(g.key)
        left -= g.bytes
    starts = boundaries(groups.where(~F.col("key").isin(alone)) if alone else groups, shards - len(alone))
    number = F.lit(len(alone))
    for i, start in enumerate(starts):
        number = F.when(F.col("key") >= start, len(alone) + i + 1).otherwise(number)
    for i, key in enumerate(alone):
        number = F.when(F.col("key") == key, i).otherwise(number)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # shards x buckets rows at most
    within = W.partitionBy("shard", "bucket").orderBy("row")
    return (
        placed.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(base), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("key").alias("group_key"))
    )
