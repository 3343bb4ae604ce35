"""Comparisons of a source and a target DataFrame, each as one plan over the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.canonical import encode, hash_value, row_hash
from evenkeel.functions.types import canonical, compatible, family

SAMPLE_ROWS, GROUP_SAMPLE = 50, 5


def ratio_status(s: Column, t: Column, threshold: float | None) -> Column:
    """PASS if equal, or if both have one sign and the smaller is at least the threshold's share of the larger."""
    same = s.eqNullSafe(t)
    if threshold:
        least, most = F.least(F.abs(s), F.abs(t)), F.greatest(F.abs(s), F.abs(t))
        same = same | F.coalesce((least >= most * threshold) & ((s < 0) == (t < 0)), F.lit(False))
    return F.when(same, F.lit("PASS")).otherwise(F.lit("FAIL"))


def row_counts(source: DataFrame, target: DataFrame, threshold: float | None = None) -> DataFrame:
    """source_count, target_count, difference, status: both sides counted in one aggregation."""
    both = source.select(F.lit(0).alias("side")).unionAll(target.select(F.lit(1).alias("side")))
    counted = both.agg(F.count_if(F.col("side") == 0).alias("source_count"), F.count_if(F.col("side") == 1).alias("target_count"))
    return counted.withColumn("difference", F.col("source_count") - F.col("target_count")).withColumn("status", ratio_status(F.col("source_count"), F.col("target_count"), threshold))


def schema_rows(df: DataFrame) -> DataFrame:
    """ordinal_position, column_name, data_type, canonical_type, is_nullable."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), canonical(f.dataType), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "ordinal_position int, column_name string, data_type string, canonical_type string, is_nullable boolean")


def filled(df: DataFrame) -> DataFrame:
    """column_name, filled (values that aren't null), distinct_values. Complex types have no distinct_values.

    A scan of each column alone, in one plan: counts of distinct values of many columns in one aggregation would repeat every row for each.
    """
    out = None
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        plain = family(f.dataType) != "COMPLEX"
        row = df.select(c.alias("c")).agg(F.count("c").alias("filled"), (F.countDistinct("c") if plain else F.lit(None).cast("long")).alias("distinct_values")).select(F.lit(f.name).alias("column_name"), "filled", "distinct_values")
        out = row if out is None else out.unionAll(row)
    return out


def schemas(source: DataFrame, target: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """A row for each column of either side: names, types, MATCH or NOT MATCH. Schemas are small and known to the driver."""
    fold = (lambda n: n) if case_sensitive else str.lower
    left, right = ({fold(f.name): f for f in df.schema} for df in (source, target))
    if not left or not right:
        raise ValueError("a side has no columns")
    rows = []
    for name in sorted(left.keys() | right.keys()):
        s, t = left.get(name), right.get(name)
        same = s is not None and t is not None and compatible(s.dataType, t.dataType)
        rows.append((s and s.name, t and t.name, s and s.dataType.simpleString(), t and t.dataType.simpleString(), "MATCH" if same else "NOT MATCH"))
    return source.sparkSession.createDataFrame(rows, "column_name_src string, column_name_tgt string, source_type string, target_type string, status string")


def common_columns(source: DataFrame, target: DataFrame, include_timestamp: bool = True, include_complex: bool = False) -> list[tuple[str, str]]:
    """Pairs of names that are equal without case, in order; complex types and, if asked, timestamps are left out."""
    left, right = ({f.name.lower(): f for f in df.schema} for df in (source, target))

    def wanted(f: T.StructField) -> bool:
        return (include_complex or family(f.dataType) != "COMPLEX") and (include_timestamp or family(f.dataType) != "TIMESTAMP")

    return [(left[n].name, right[n].name) for n in sorted(left.keys() & right.keys()) if wanted(left[n]) and wanted(right[n])]


def aligned(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Both sides with the common (or the given) columns, under the source's names."""
    pairs = common_columns(source, target, **options)
    if columns is not None:
        wanted = {c.lower() for c in columns}
        pairs = [p for p in pairs if p[0].lower() in wanted]
    return source.select(*(F.col(f"`{s}`") for s, _ in pairs)), target.select(*(F.col(f"`{t}`").alias(s) for s, t in pairs))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _unpivoted(row: DataFrame, columns: Sequence[str], figures: dict[str, str]) -> DataFrame:
    """One row of aggregates `figure_i` to a row for each column."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{f}_{i}").cast(kind).alias(f) for f, kind in figures.items())) for i, c in enumerate(columns)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, null_count, min, max, avg of all numeric columns, in one pass."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, null_count long, min double, max double, avg double")
    c = [F.col(f"`{n}`") for n in columns]
    row = df.agg(*(f(x).alias(f"{name}_{i}") for i, x in enumerate(c) for name, f in (("null_count", lambda x: F.count_if(x.isNull())), ("min", F.min), ("max", F.max), ("avg", lambda x: F.avg(x.cast("double"))))))
    return _unpivoted(row, columns, {"null_count": "long", "min": "double", "max": "double", "avg": "double"})


def _paired(source: DataFrame, target: DataFrame, columns: Sequence[str], figures) -> DataFrame:
    """One row with aggregates of both sides from one pass. figures: (column of the source, of the target, index) to aggregates.

    Each side keeps its own types, so that nothing is rounded on the way.
    """
    kinds = [{f.name: f.dataType for f in df.schema} for df in (source, target)]
    none = lambda side, c: F.lit(None).cast(kinds[side][c])
    left = source.select(F.lit(0).alias("side"), *(x for i, c in enumerate(columns) for x in (F.col(f"`{c}`").alias(f"s{i}"), none(1, c).alias(f"t{i}"))))
    right = target.select(F.lit(1).alias("side"), *(x for i, c in enumerate(columns) for x in (none(0, c).alias(f"s{i}"), F.col(f"`{c}`").alias(f"t{i}"))))
    return left.unionAll(right).agg(*figures)


def _extremes(columns: Sequence[str]) -> list[Column]:
    return [f(x).alias(f"{side}_{name}_{i}") for i in range(len(columns)) for side, x in (("source", F.col(f"s{i}")), ("target", F.col(f"t{i}"))) for name, f in (("min", F.min), ("max", F.max), ("avg", lambda x: F.avg(x.cast("double"))))]


def stats_status(pairs: Sequence[tuple[Column, Column]], threshold: float | None) -> Column:
    """PASS if each pair of figures does."""
    passed = F.lit(True)
    for s, t in pairs:
        passed = passed & (ratio_status(s, t, threshold) == "PASS")
    return F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))


def numeric_stats_compare(source: DataFrame, target: DataFrame, threshold: float | None = None, digits: int = 4) -> DataFrame:
    """Statistics of the common numeric columns side by side, with a status.

    Figures are shown as rounded doubles. The status compares the extremes of whole numbers and decimals as they are, and rounds only doubles and averages.
    """
    left, right = aligned(source, target)
    columns = [c for c in numeric_columns(left) if c in numeric_columns(right)]
    shown = [f"{side}_{f}" for side in ("source", "target") for f in ("min", "max", "avg")]
    if not columns:
        return source.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{n} double" for n in ("source_null_count", *shown[:3], "target_null_count", *shown[3:])) + ", status string")
    nulls = [F.count_if((F.col("side") == side) & F.col(f"{x}{i}").isNull()).alias(f"{name}_null_count_{i}") for i in range(len(columns)) for side, (x, name) in enumerate((("s", "source"), ("t", "target")))]
    row = _paired(left, right, columns, [*_extremes(columns), *nulls])
    kinds = {f.name: f.dataType for f in row.schema}
    exact = lambda n: F.round(n, digits) if isinstance(kinds[n], (T.DoubleType, T.FloatType)) else F.col(n)
    each = []
    for i, c in enumerate(columns):
        status = stats_status([(exact(f"source_{f}_{i}"), exact(f"target_{f}_{i}")) for f in ("min", "max", "avg")], threshold)
        figures = [F.round(F.col(f"{n}_{i}").cast("double"), digits).alias(n) for n in shown]
        each.append(F.struct(F.lit(c).alias("column"), F.col(f"source_null_count_{i}").alias("source_null_count"), *figures[:3], F.col(f"target_null_count_{i}").alias("target_null_count"), *figures[3:], status.alias("status")))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def null_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """column, source_null_count, target_null_count where either side has nulls."""
    left, right = aligned(source, target, include_complex=True)

    def counted(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"{name}_{i}") for i, c in enumerate(df.columns)))
        return _unpivoted(row, df.columns, {name: "long"})

    both = counted(left, "source_null_count").join(counted(right, "target_null_count"), "column")
    return both.where((F.col("source_null_count") > 0) | (F.col("target_null_count") > 0))


def profile(source: DataFrame, target: DataFrame) -> list[dict]:
    """For the source and for the target: rows, nulls of each common column, and min, max and avg of numeric ones.

    One aggregation over both sides; one row comes to the driver. Extremes keep their types, so whole numbers and decimals are exact.
    """
    left, right = aligned(source, target, include_complex=True)
    columns = left.columns
    numeric = [i for i, c in enumerate(columns) if c in numeric_columns(left) and c in numeric_columns(right)]
    figures = [F.count_if(F.col("side") == side).alias(f"rows{side}") for side in range(2)]
    figures += [F.count_if((F.col("side") == side) & F.col(f"{x}{i}").isNull()).alias(f"{x}n{i}") for i in range(len(columns)) for side, x in enumerate("st")]
    figures += [f(F.col(f"{x}{i}")).alias(f"{x}{name}{i}") for i in numeric for x in "st" for name, f in (("min", F.min), ("max", F.max), ("avg", lambda c: F.avg(c.cast("double"))))]
    r = _paired(left, right, columns, figures).first()
    return [{"rows": r[f"rows{side}"], "nulls": {c: r[f"{x}n{i}"] for i, c in enumerate(columns)}, "stats": {columns[i]: {k: r[f"{x}{k}{i}"] for k in ("min", "max", "avg")} for i in numeric}} for side, x in enumerate("st")]


def hash_counts(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """row_hash, n: the table as a multiset. Equal rows are counted before the shuffle, so repeated rows don't skew it."""
    return df.select(row_hash(df, columns, **options).alias("row_hash")).groupBy("row_hash").agg(F.count("*").alias("n"))


def _sides(source: DataFrame, target: DataFrame, columns: Sequence[str] | None, **options) -> DataFrame:
    """row_hash, n_s, n_t from one shuffle of both sides' hashes."""
    left, right = aligned(source, target, columns)
    both = left.select(row_hash(left, **options).alias("row_hash"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(right.select(row_hash(right, **options).alias("row_hash"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    return both.groupBy("row_hash").agg(F.sum("s").alias("n_s"), F.sum("t").alias("n_t"))


def row_hashes(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = None, **options) -> DataFrame:
    """Counts of matched, source-only and target-only rows (with repeats), their similarity and a status."""
    sides = _sides(source, target, columns, **options)
    matched = F.sum(F.least("n_s", "n_t"))
    out = sides.agg(
        F.coalesce(F.sum("n_s"), F.lit(0)).alias("source_hash_count"),
        F.coalesce(F.sum("n_t"), F.lit(0)).alias("target_hash_count"),
        F.coalesce(matched, F.lit(0)).alias("matched_hash_count"),
        F.coalesce(F.sum(F.greatest(F.col("n_s") - F.col("n_t"), F.lit(0))), F.lit(0)).alias("source_not_in_target_count"),
        F.coalesce(F.sum(F.greatest(F.col("n_t") - F.col("n_s"), F.lit(0))), F.lit(0)).alias("target_not_in_source_count"),
        F.coalesce(matched / F.sum(F.greatest("n_s", "n_t")), F.lit(1.0)).alias("similarity"),
    )
    perfect = (F.col("source_not_in_target_count") == 0) & (F.col("target_not_in_source_count") == 0)
    return out.withColumn("status", F.when(perfect | (F.lit(bool(threshold)) & (F.col("similarity") >= (threshold or 2))), F.lit("PASS")).otherwise(F.lit("FAIL")))


def rows_only(source: DataFrame, target: DataFrame, side: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """row_hash and how many more of it one side ('source' or 'target') has."""
    more = F.col("n_s") - F.col("n_t") if side == "source" else F.col("n_t") - F.col("n_s")
    return _sides(source, target, columns, **options).select("row_hash", more.alias("surplus")).where("surplus > 0")


def rows_with_hashes(df: DataFrame, hashes: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The rows whose hash is in hashes (row_hash; case and padding don't count)."""
    wanted = hashes.select(F.upper(hash_value(F.col("row_hash"))).alias("row_hash")).distinct()
    return df.withColumn("row_hash", row_hash(df, columns, **options)).join(wanted, "row_hash", "left_semi")


def group_hashes(df: DataFrame, groups: Sequence[str], columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A count and a hash for each group that don't depend on the order of rows.

    A group's hash is the MD5 of two sums, of 60-bit lanes of its rows' hashes, so rows are added up where they are
    read and only one row for each task and group moves. Halves of lanes are summed apart, which can't overflow.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    own = [c for c in (columns or df.columns) if c not in groups]
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*(encode(g, kinds[g], **options).alias(n) for n, g in zip(names, groups)), row_hash(df, own, **options).alias("h"))
    rows = rows.select(*names, *(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("long").alias(f"lane{i}") for i in range(2)))
    halves = [F.sum(half).alias(f"{name}{i}") for i in range(2) for name, half in (("high", F.shiftright(f"lane{i}", 30)), ("low", F.col(f"lane{i}").bitwiseAND(F.lit((1 << 30) - 1))))]
    total = rows.groupBy(*names).agg(F.count("*").alias("row_count"), *halves)
    lanes = [(F.col(f"high{i}").cast("decimal(20,0)") * (1 << 30) + F.col(f"low{i}")).cast("decimal(38,0)").cast("string") for i in range(2)]
    return total.select(*(F.col(n).alias(g) for n, g in zip(names, groups)), "row_count", F.upper(F.md5(F.concat_ws(":", *lanes))).alias("group_hash"))


def group_compare(source: DataFrame, target: DataFrame, groups: Sequence[str], columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Each group of either side with counts, hashes and MATCH or MISMATCH."""
    left, right = aligned(source, target, None if columns is None else [*columns, *groups])
    folded = {c.lower(): c for c in left.columns}
    own = [folded[g.lower()] for g in groups]
    names = [f"g{i}" for i in range(len(groups))]
    s, t = (group_hashes(df, own, **options).toDF(*names, f"{side}_row_count", f"{side}_hash") for df, side in ((left, "source"), (right, "target")))
    both = s.join(t, names, "full_outer")
    return both.select(*(F.col(n).alias(g) for n, g in zip(names, groups)), *both.columns[len(names) :], F.when(F.col("source_hash") == F.col("target_hash"), F.lit("MATCH")).otherwise(F.lit("MISMATCH")).alias("status"))


def group_totals(compared: DataFrame) -> DataFrame:
    """Rows in matching groups, and each side's rows in the others."""
    match = F.col("status") == "MATCH"
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return compared.agg(total("source_row_count", match).alias("matched_rows"), total("source_row_count", ~match).alias("source_mismatched_rows"), total("target_row_count", ~match).alias("target_mismatched_rows"))


def group_sample(df: DataFrame, group: dict, columns: Sequence[str] | None = None, n: int = GROUP_SAMPLE, **options) -> DataFrame:
    """The first n rows of a group by hash."""
    for name, value in group.items():
        df = df.where(F.col(f"`{name}`").eqNullSafe(F.lit(value)))
    return df.withColumn("row_hash", row_hash(df, columns, **options)).orderBy("row_hash").limit(n)


def _met(a: str, b: str, kind: T.DataType, collation: str | None) -> Column:
    """Whether two keys are the same; null keys are."""
    x, y = F.col(a), F.col(b)
    if collation is not None and isinstance(kind, T.StringType):
        x, y = F.collate(x, collation), F.collate(y, collation)
    return x.eqNullSafe(y)


def column_differences(source: DataFrame, target: DataFrame, keys: Sequence[str], collation: str | None = None, **options) -> DataFrame:
    """keys, column, source_value, target_value of every difference between rows of equal keys (text forms). Null keys are equal.

    collation: how texts of keys are compared, e.g. UTF8_LCASE or UNICODE_CI (without it: byte by byte); keys are shown as the source has them.
    Values move as they are, which is smaller than their text, and get their text forms where rows of equal keys meet.
    """
    left, right = aligned(source, target)
    folded = {k.lower() for k in keys}
    own = [c for c in left.columns if c.lower() not in folded]
    kinds = [{f.name: f.dataType for f in df.schema} for df in (left, right)]
    named = {k.lower(): k for k in keys}
    on = [c for c in left.columns if c.lower() in folded]
    s, t = (df.select(*(F.col(f"`{k}`").alias(f"{x}k{i}") for i, k in enumerate(on)), *(F.col(f"`{c}`").alias(f"{x}{i}") for i, c in enumerate(own))) for df, x in ((left, "s"), (right, "t")))
    met = s.join(t, [_met(f"sk{i}", f"tk{i}", kinds[0][k], collation) for i, k in enumerate(on)])
    # values of one type that are equal have one text, so only the others get theirs
    apart = [F.lit(True) if kinds[0][c] != kinds[1][c] or isinstance(kinds[0][c], (T.MapType, T.VariantType, T.ArrayType, T.StructType)) else ~F.col(f"s{i}").eqNullSafe(F.col(f"t{i}")) for i, c in enumerate(own)]
    met = met.where(reduce(lambda x, y: x | y, apart, F.lit(False)))
    values = [(c, x, encode(f"s{i}", kinds[0][c], **options), encode(f"t{i}", kinds[1][c], **options)) for i, (c, x) in enumerate(zip(own, apart))]
    each = F.filter(F.array(*(F.when(x & (a != b), F.struct(F.lit(c).alias("column"), a.alias("source_value"), b.alias("target_value"))) for c, x, a, b in values)), lambda x: x.isNotNull())
    return met.select(*(F.col(f"sk{i}").alias(named[k.lower()]) for i, k in enumerate(on)), F.explode(each).alias("x")).select(*(F.col(f"`{named[k.lower()]}`") for k in on), "x.*")


def mismatched_columns(source: DataFrame, target: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """column and the number of rows in which it differs."""
    return column_differences(source, target, keys, **options).groupBy("column").agg(F.count("*").alias("rows"))


def column_fingerprints(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Which columns differ where rows have no keys, from the rows that have no equal on the other side.

    column, source_fingerprint and target_fingerprint (of the column's values in those rows, in no order), and rows: how many
    rows meet when the column alone doesn't count, so it is where they differ. No join: a row's hash is the XOR of
    its columns' hashes, which gives the hash without a column at once, and everything is added up.
    """
    left, right = aligned(source, target, columns)
    names = left.columns
    lanes = range(2)

    def hashed(df: DataFrame, side: int) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema}
        texts = [encode(c, kinds[c], **options) for c in names]
        own = [F.array(*(F.xxhash64(F.lit(f"{i}/{lane}"), t) for i, t in enumerate(texts))).alias(f"own{lane}") for lane in lanes]
        rows = df.select(*own)
        whole = [F.aggregate(f"own{lane}", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(f"row{lane}") for lane in lanes]
        return rows.select(*whole, "own0", "own1", F.lit(1 - side).alias("s"), F.lit(side).alias("t"))

    both = hashed(left, 0).unionAll(hashed(right, 1)).groupBy("row0", "row1", "own0", "own1").agg((F.sum("s") - F.sum("t")).alias("more")).where("more <> 0")
    each = both.select("more", "row0", "row1", F.posexplode(F.arrays_zip("own0", "own1")).alias("at", "h"))
    without = [F.col(f"row{lane}").bitwiseXOR(F.col(f"h.own{lane}")).alias(f"rest{lane}") for lane in lanes]
    # a value's lane counts as often as its row is over; halves are summed apart, which can't overflow
    halves = [F.sum(F.greatest(sign * F.col("more"), F.lit(0)) * half).alias(f"{side}_{name}{lane}") for side, sign in (("source", 1), ("target", -1)) for lane in lanes for name, half in (("high", F.shiftright(f"h.own{lane}", 32)), ("low", F.col(f"h.own{lane}").bitwiseAND(F.lit((1 << 32) - 1))))]
    over = [F.sum(F.greatest(sign * F.col("more"), F.lit(0))).alias(side) for side, sign in (("source", 1), ("target", -1))]
    rested = each.select("at", "more", "h", *without).groupBy("at", "rest0", "rest1").agg(*over, *halves)
    total = rested.groupBy("at").agg(F.sum(F.least("source", "target")).alias("rows"), *(F.sum(f"{side}_{name}{lane}").alias(f"{side}_{name}{lane}") for side in ("source", "target") for lane in lanes for name in ("high", "low")))
    mark = lambda side: F.md5(F.concat_ws(":", *((F.col(f"{side}_high{lane}").cast("decimal(38,0)") * (1 << 32) + F.col(f"{side}_low{lane}")).cast("decimal(38,0)").cast("string") for lane in lanes)))
    return total.select(F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("column"), mark("source").alias("source_fingerprint"), mark("target").alias("target_fingerprint"), "rows")


def mismatched_without_keys(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """column and the number of rows that differ in it alone. Where no row differs in one column alone: the columns with unequal fingerprints, and 0."""
    found = column_fingerprints(source, target, columns, **options)
    any_row = F.max("rows").over(Window.partitionBy())
    judged = found.withColumn("any_row", any_row)
    return judged.where((F.col("rows") > 0) | ((F.col("any_row") == 0) & (F.col("source_fingerprint") != F.col("target_fingerprint")))).select("column", "rows")


def keys_missing(source: DataFrame, target: DataFrame, keys: Sequence[str], collation: str | None = None) -> DataFrame:
    """Rows of the source whose keys the target hasn't. Null keys are equal; collation as in column_differences."""
    kinds = {f.name: f.dataType for f in source.schema}
    there = target.select(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys))).distinct()
    return source.join(there, [_met(f"`{k}`", f"__key{i}", kinds.get(k), collation) for i, k in enumerate(keys)], "left_anti")
