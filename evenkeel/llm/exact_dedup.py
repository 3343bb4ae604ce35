"""Exact duplicates by a tree merge of sorted digest runs.

Texts don't move: a row is its digests and its identifier. Every partition sorts its rows into a run in which equal texts are one
entry with their best identifier and their number. Runs then meet in rounds, as in a binomial reduce-scatter with FAN in
place of two: in round r the runs of FAN^r neighbouring partitions come together, each task for one more hexadecimal digit
of the digest, and are merged again. After the last round a task holds one slice of all digests and every entry is
final. A text that a third of all rows share is one entry in each run, so no task ever sees its rows.

Two entries are one text if their SHA-256, their number of bytes and a second, independent hash all agree, which every
merge verifies; texts that agree in one of them alone stay apart.

Results that are defined: a null text counts as empty; of equal texts the row with the largest (keep="smallest": smallest)
identifier stays, and of rows that repeat that identifier exactly one; a null identifier stays only where all are null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

FAN = 16
_ENTRY = "part int, sha binary, size long, other long, best_id long, best_row long, n long"
_COLUMNS = ("part", "sha", "size", "other", "best_id", "best_row", "n")
_ARROW = pa.schema([(c, pa.int32() if c == "part" else pa.binary() if c == "sha" else pa.int64()) for c in _COLUMNS])
_KEY = ("sha", "size", "other")


def _merged(batches):
    """Entries of sorted runs, equal texts of a part as one: the last one's identifier and the sum of the numbers."""
    held = None
    for batch in batches:
        table = pa.Table.from_arrays(batch.columns, schema=_ARROW)
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        rows = table.num_rows
        if not rows:
            continue
        sha = np.frombuffer(pa.array(table.column("sha").to_pylist(), pa.binary(32)).buffers()[1], np.uint64).reshape(rows, 4)
        verified = (sha[1:] == sha[:-1]).all(1)
        for c in ("part", "size", "other"):
            values = table.column(c).to_numpy()
            verified &= values[1:] == values[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~verified)))
        last = table.take(np.append(starts[1:], rows) - 1)
        last = last.set_column(_COLUMNS.index("n"), "n", pa.array(np.add.reduceat(table.column("n").to_numpy(), starts), pa.int64()))
        # the last group may go on in the next batch
        yield from last.slice(0, len(starts) - 1).to_batches()
        held = last.slice(len(starts) - 1)
    if held is not None:
        yield from held.to_batches()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("other"))
    digests = cut(digests.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "digests")
    # the best identifier is the last of a sorted group
    best = [F.asc_nulls_first("best_id") if keep == "largest" else F.desc_nulls_first("best_id"), F.asc("best_row")]
    runs = digests.select("part", *_KEY, F.col("id").alias("best_id"), F.col("row").alias("best_row"), F.lit(1).cast("long").alias("n"))
    runs = runs.sortWithinPartitions("part", *_KEY, *best).mapInArrow(_merged, _ENTRY)
    parts = (digests.agg(F.max("part")).first()[0] or 0) + 1
    digits, span = 0, 1
    while span < parts:
        digits, span = digits + 1, span * FAN
        met = runs.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition(F.col("part"), F.substring(F.hex("sha"), 1, digits))
        runs = met.sortWithinPartitions("part", *_KEY, *best).mapInArrow(_merged, _ENTRY)
    several = runs.where("n > 1").select(*_KEY, "best_id", "best_row", "n")
    met = digests.join(several, list(_KEY), "left")
    alone = F.col("n").isNull()
    return met.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
