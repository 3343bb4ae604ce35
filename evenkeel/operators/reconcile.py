"""A whole validation of one or many table pairs: options, checks, record and details."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import compare, hash_tree
from evenkeel.sources.tables import materialised

CHECKS = ("row_count", "schema", "numeric", "hash")
ROW_GUARD = 1_000_000

#: A record with the messages of what couldn't run, one for each check or for the whole pair.
ERRORS = "array<struct<check: string, message: string>>"
RECORD = "validation_id string, validation_ts timestamp, validation_type string, src_table_name string, tgt_table_name string, row_count string, schema_check string, numeric_check string, hash_validation string, run_by string"


class GuardExceeded(ValueError):
    """More rows than the guard allows for a row hash without categorical columns."""


@dataclass(frozen=True)
class Options:
    row_count: bool = True
    schema: bool = True
    numeric: bool = False
    hash: bool = False
    threshold: float | None = None
    include_timestamp: bool = False
    case_sensitive: bool = False
    categorical_columns: tuple[str, ...] = ()
    primary_keys: tuple[str, ...] = ()
    column_differences: bool = False
    row_guard: int | None = None
    #: Spaces around texts don't count.
    trim: bool = True
    #: So many whole rows of each side without an equal on the other are in details["row_examples"]; the job runners ask for 50.
    examples: int = 0

    def with_metrics(self, metrics: str | Sequence[str]) -> Options:
        """Checks by name; `all` is all of them; separated by comma or semicolon."""
        names = [m.strip().lower() for m in (re.split("[,;]", metrics) if isinstance(metrics, str) else metrics)]
        wanted = set(CHECKS) if "all" in names else set(names) - {""}
        if unknown := wanted - set(CHECKS):
            raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
        return replace(self, **{c: c in wanted for c in CHECKS})

    def of_type(self, kind: str) -> Options:
        """`shallow` is counts and schema, whatever the metrics; `deep` is the metrics."""
        if kind not in ("shallow", "deep"):
            raise ValueError(f"validation type must be shallow or deep, not {kind!r}")
        return replace(self, row_count=True, schema=True, numeric=False, hash=False) if kind == "shallow" else self


@dataclass(frozen=True)
class TablePair:
    source: DataFrame
    target: DataFrame
    source_name: str = "source"
    target_name: str = "target"
    where: str = "1=1"
    source_where: str | None = None
    target_where: str | None = None
    options: Options = field(default_factory=Options)

    def sides(self) -> tuple[DataFrame, DataFrame]:
        return self.source.where(F.expr(self.source_where or self.where)), self.target.where(F.expr(self.target_where or self.where))


def column_list(text: str | Sequence[str] | None) -> list[str]:
    """Column names from a list, a comma list, or the text of a list."""
    if text is None:
        return []
    parts = text.strip().strip("[]").split(",") if isinstance(text, str) else text
    return [p for p in (str(x).strip().strip("'\"").strip() for x in parts) if p]


def threshold_of(value) -> float | None:
    """A share; numbers above 1 are percentages."""
    if value in (None, ""):
        return None
    share = float(value)
    return share / 100 if share > 1 else share


def _status(passed: bool | None) -> str | None:
    return None if passed is None else "PASS" if passed else "FAIL"


def _same(s, t, threshold: float | None) -> bool:
    """ratio_status for two figures on the driver; whole numbers and decimals are compared as they are."""
    if s is None or t is None or s == t or s != s and t != t:
        return s is None and t is None or s is not None and t is not None
    least, most = sorted((abs(s), abs(t)))
    return bool(threshold) and float(least) >= float(most) * threshold and (s < 0) == (t < 0)


def _profiled(source: DataFrame, target: DataFrame, threshold: float | None) -> dict[str, DataFrame]:
    """row_count, numeric and null_counts as compare's operators return them, all from one pass over both sides."""
    spark = source.sparkSession
    s, t = compare.profile(source, target)
    counts = spark.createDataFrame([(s["rows"], t["rows"], s["rows"] - t["rows"])], "source_count long, target_count long, difference long")
    digits = lambda x: None if x is None else round(float(x), 4)
    exact = lambda x: digits(x) if isinstance(x, float) else x
    rows = []
    for c in s["stats"]:
        mine, other = s["stats"][c], t["stats"][c]
        passed = all(_same(exact(mine[k]), exact(other[k]), threshold) for k in ("min", "max", "avg"))
        rows.append((c, s["nulls"][c], *(digits(mine[k]) for k in ("min", "max", "avg")), t["nulls"][c], *(digits(other[k]) for k in ("min", "max", "avg")), "PASS" if passed else "FAIL"))
    numeric = spark.createDataFrame(rows, "column string, " + ", ".join(f"{x}_null_count long, {x}_min double, {x}_max double, {x}_avg double" for x in ("source", "target")) + ", status string")
    nulls = [(c, n, t["nulls"][c]) for c, n in s["nulls"].items() if n or t["nulls"][c]]
    return {
        "row_count": counts.withColumn("status", compare.ratio_status(F.col("source_count"), F.col("target_count"), threshold)),
        "numeric": numeric,
        "null_counts": spark.createDataFrame(nulls, "column string, source_null_count long, target_null_count long"),
    }


def validate(pair: TablePair, run_by: str | None = None, validation_type: str = "deep") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The record (one row) and a DataFrame for each facet. Only verdicts and a row of figures for each column come to the driver.

    A check that fails to run has the status ERROR and a row in details["errors"] (check, message); the others go on.
    A broken row guard is raised.
    """
    spark = pair.source.sparkSession
    options = pair.options.of_type(validation_type)
    details: dict[str, DataFrame] = {}
    status: dict[str, str | None] = dict.fromkeys(CHECKS)
    errors: list[tuple[str, str]] = []
    found: dict[str, DataFrame] = {}

    def sides() -> tuple[DataFrame, DataFrame]:
        return pair.sides()

    def figures() -> dict[str, DataFrame]:
        if not found:
            found.update(_profiled(*sides(), options.threshold))
        return found

    def row_count() -> str | None:
        if options.numeric:
            details["row_count"] = figures()["row_count"]
        else:
            details["row_count"] = compare.row_counts(*sides(), options.threshold)
        return details["row_count"].first().status

    def schema() -> str | None:
        details["schema"] = compare.schemas(*sides(), options.case_sensitive)
        return _status(details["schema"].where("status <> 'MATCH'").isEmpty())

    def numeric() -> str | None:
        details["numeric"], details["null_counts"] = figures()["numeric"], figures()["null_counts"]
        seen = {r.status for r in details["numeric"].select("status").distinct().collect()}
        return _status(seen == {"PASS"} if seen else None)

    def hashes() -> str | None:
        source, target = sides()
        columns = [s for s, _ in compare.common_columns(source, target, options.include_timestamp)]
        if options.row_guard and not options.categorical_columns and source.limit(options.row_guard + 1).count() > options.row_guard:
            raise GuardExceeded(f"more than {options.row_guard} rows and no categorical columns")
        if options.column_differences and options.primary_keys:
            details["mismatched_columns"] = compare.mismatched_columns(source, target, options.primary_keys, trim=options.trim)
        if options.categorical_columns:
            details["groups"] = compare.group_compare(source, target, options.categorical_columns, columns, trim=options.trim)
            return _status(details["groups"].where("status <> 'MATCH'").isEmpty())
        details["row_hash"] = compare.row_hashes(source, target, columns, options.threshold, trim=options.trim)
        verdict = details["row_hash"].first()
        if verdict.source_not_in_target_count or verdict.target_not_in_source_count:
            if options.examples:
                details["row_examples"] = hash_tree.unmatched_rows(source, target, columns, options.examples, trim=options.trim)
            if options.column_differences and not options.primary_keys:
                details["mismatched_columns"] = compare.mismatched_without_keys(source, target, columns, trim=options.trim)
        return verdict.status

    for name, check in zip(CHECKS, (row_count, schema, numeric, hashes)):
        if getattr(options, name):
            try:
                status[name] = check()
            except GuardExceeded:
                raise
            except Exception as e:  # whatever ends one check: the others still have their say
                status[name] = "ERROR"
                errors.append((name, str(e)[:2000]))
    if errors:
        details["errors"] = spark.createDataFrame(errors, "check string, message string")
    row = (str(uuid.uuid4()), datetime.now(timezone.utc).replace(tzinfo=None), validation_type, pair.source_name, pair.target_name, status["row_count"], status["schema"], status["numeric"], status["hash"], run_by)
    return spark.createDataFrame([row], RECORD), details


def validate_queries(spark: SparkSession, source_sql: str, target_sql: str, options: Options | None = None, run_by: str | None = None, folder: str | None = None, **frames: DataFrame):
    """Compare the results of two queries. {name} in a query stands for the frame of that name.

    folder: a shared folder in which both results are kept while they are compared, so each query runs once; details are then
    only the record's.
    """
    source, target = spark.sql(source_sql, **frames), spark.sql(target_sql, **frames)
    options = options or Options().with_metrics("all")
    names = ("source query", "target query")
    if folder is None:
        return validate(TablePair(source, target, *names, options=options), run_by)
    with materialised(folder, source, target) as (source, target):
        return validate(TablePair(source, target, *names, options=options), run_by)[0], {}


def _record(spark: SparkSession, names: Sequence[str], kind: str, status: Sequence[str | None], errors: Sequence[tuple[str, str]], run_by: str | None) -> tuple:
    return (str(uuid.uuid4()), datetime.now(timezone.utc).replace(tzinfo=None), kind, *names, *status, run_by, [tuple(e) for e in errors])


def _message(e: Exception) -> str:
    return (str(e) or type(e).__name__)[:2000]


def _run(spark: SparkSession, job: Callable[[], tuple[Sequence[str], str, Options, dict]], run_by: str | None) -> tuple[tuple, dict[str, DataFrame]]:
    """A record with its messages, and the details, of one row of a job file or a config. Whatever is wrong with the row ends this row alone."""
    names, kind, options = ("", ""), "", Options()
    try:
        names, kind, options, filters = job()
        pair = TablePair(spark.table(names[0]), spark.table(names[1]), *names, options=options, **filters)
        found, details = validate(pair, run_by, kind)
        r = found.first()
        errors = [(e.check, e.message) for e in details["errors"].collect()] if "errors" in details else []
        return (*r, errors), details
    except Exception as e:  # one bad pair doesn't end the others' run
        named = e.args[0] if isinstance(e, _BadRow) else None
        names, kind, options = (named.names, named.kind, named.options) if named else (names, kind, options)
        cause = named.cause if named else e
        asked = ["ERROR" if getattr(options, c) else None for c in CHECKS]
        return _record(spark, names, kind, asked if any(asked) else ["ERROR"] * len(CHECKS), [("pair", _message(cause))], run_by), {}


@dataclass(frozen=True)
class _Named:
    names: tuple[str, str]
    kind: str
    options: Options
    cause: Exception


class _BadRow(ValueError):
    """What was known of a row before it failed."""


def _options(row: dict) -> Options:
    base = Options(threshold=threshold_of(row.get("row_threshold")), include_timestamp=bool(row.get("include_timestamp", False)), case_sensitive=bool(row.get("case_sensitive", False)), categorical_columns=tuple(column_list(row.get("categorical_columns"))), primary_keys=tuple(column_list(row.get("primary_keys"))), examples=compare.SAMPLE_ROWS)
    return base.with_metrics(row.get("metrics") or "row_count,schema")


def _table_name(row: dict, side: str) -> str:
    """Its name, or catalog, schema and table."""
    parts = [row.get(f"{side}_{p}") for p in ("catalog", "schema", "table")]
    name = row.get(side) or (".".join(parts) if all(parts) else parts[2] if parts[2] and f"{side}_catalog" not in row else "")
    if not name:
        raise ValueError(f"no {side} table")
    return name


def _job(row: dict):
    """What a row asks for. A failure keeps what is known of the row, for its record."""

    def parsed():
        names, kind, options = ["", ""], str(row.get("validation_type") or "deep").strip().lower(), Options()
        try:
            for i, side in enumerate(("source", "target")):
                names[i] = str(row.get(side) or row.get(f"{side}_table") or "")
            names = [_table_name(row, side) for side in ("source", "target")]
            if row.get("problem"):
                raise ValueError(row["problem"])
            options = _options(row).of_type(kind)
            apart = "use_separate_where" not in row or row["use_separate_where"]
            filters = {"where": row.get("where") or row.get("where_clause") or "1=1", "source_where": row.get("source_where") if apart else None, "target_where": row.get("target_where") if apart else None}
        except Exception as e:
            raise _BadRow(_Named(tuple(names), kind, options, e)) from e
        return names, kind, options, filters

    return parsed


def _tables(spark: SparkSession, rows: Iterable[dict], run_by: str | None) -> tuple[DataFrame, list[dict[str, DataFrame]]]:
    found = [_run(spark, _job(row), run_by) for row in rows]
    return spark.createDataFrame([r for r, _ in found], f"{RECORD}, errors {ERRORS}"), [d for _, d in found]


def run_config_detailed(spark: SparkSession, config: dict, run_by: str | None = None) -> tuple[DataFrame, list[dict[str, DataFrame]]]:
    """run_config's records, and the details of each in the same order (none for a pair that can't be read)."""
    rows = [row if isinstance(row, dict) else {"source": str(row)} for row in config.get("tables") or []]
    return _tables(spark, ({"use_separate_where": False} | row for row in rows), run_by)


def run_config(spark: SparkSession, config: dict, run_by: str | None = None) -> DataFrame:
    """Records for a config: {"tables": [{"source", "target", "validation_type", "metrics", "where", ...}]}; none for no tables.

    A row that is wrong in any way has ERROR and its message in `errors`; the others go on.
    """
    return run_config_detailed(spark, config, run_by)[0]


def run_jobs_detailed(spark: SparkSession, jobs: DataFrame, run_by: str | None = None) -> tuple[DataFrame, list[dict[str, DataFrame]]]:
    """run_jobs' records, and the details of each in the same order."""
    return _tables(spark, (row.asDict(recursive=True) for row in jobs.toLocalIterator()), run_by)


def run_jobs(spark: SparkSession, jobs: DataFrame, run_by: str | None = None) -> DataFrame:
    """Records for the rows of a job file (sources.jobs.table_jobs or coordinate_jobs), in their order. A wrong row is an ERROR with its message."""
    return run_jobs_detailed(spark, jobs, run_by)[0]
