"""Shared helpers: tables in the cluster's shared folder, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-evenkeel-")
    return _LOCAL[app]


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession):
    """Spark deletes a query's shuffle files when it has ended; a table that is written needs them no more."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evenkeel-{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_their_query(spark):
        df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.evenkeel_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing unwritten reads any more."""
    for df in tables:
        _WRITTEN.remove(df.evenkeel_path)
        _delete(df.sparkSession, df.evenkeel_path)


def first_by_hash(df: DataFrame, rows: int, total: int, *columns: str) -> DataFrame:
    """The `rows` rows with the least hash of the columns. total: the rows of df.

    Only the part of the hash range that holds about twice as many is sorted, so tasks send few rows to the last one.
    """
    key = F.xxhash64(*columns)
    bound = min(2.0 * rows / max(total, 1), 1.0) * 2.0**64 - 2.0**63
    return df.where(key.cast("double") <= bound).orderBy(key, *columns).limit(rows)


def written() -> int:
    """How many tables of cut() there are: a mark for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete every table that cut() has written in this process since a mark, but for one. Call it when no result that reads them is needed any more."""
    kept = [keep.evenkeel_path] if keep is not None else []
    for path in _WRITTEN[since:]:
        if path not in kept:
            _delete(spark, path)
    _WRITTEN[since:] = kept


# ---------------------------------------------------------------- words

_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(_PRIME), np.uint64(pow(_PRIME, -1, 1 << 64))
        found = [np.cumprod(up), np.cumprod(down)]
        if size > 1 << 20:
            return found[0], found[1]
        _POWERS[:] = found
    return _POWERS[0], _POWERS[1]


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a byte array."""
    inside = np.empty(len(buffer) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buffer]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte spans in order, equal for equal bytes wherever they stand. Blocks of `most` bytes bound the memory."""
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        low = starts[begin]
        end = max(int(np.searchsorted(ends, low + most, "right")), begin + 1)
        part, s, e = buffer[low : ends[end - 1]], starts[begin:end] - low, ends[begin:end] - low
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        out[begin:end] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        begin = end
    return out


def chunks(texts: list, most: int = 1 << 20, encode=lowered):
    """Lists of (index, bytes) of about `most` bytes; a longer text stands alone, whole."""
    part, size = [], 0
    for i, text in enumerate(texts):
        raw = encode(text)
        if part and size + len(raw) > most:
            yield part
            part, size = [], 0
        part.append((i, raw))
        size += len(raw) + 1
    if part:
        yield part


def chunk_words(part: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: its bytes, the words' starts and ends, and for each of its texts the index of its first word (with an end)."""
    buffer = np.frombuffer(b"\n".join(raw for _, raw in part) + b"\n", np.uint8)
    starts, ends = word_spans(buffer)
    sizes = np.fromiter((len(raw) + 1 for _, raw in part), np.int64, len(part))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return buffer, starts, ends, np.searchsorted(starts, edges)


def distinct_words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of texts as a buffer with starts and ends; each word's place among them; where each text's words begin (with an end)."""
    raws, hashes, starts, ends, begins = [], [], [], [], [np.zeros(1, np.int64)]
    size = 0
    for part in chunks(texts):
        buffer, s, e, first = chunk_words(part)
        raws.append(buffer)
        hashes.append(span_hashes(buffer, s, e))
        starts.append(s + size)
        ends.append(e + size)
        begins.append(first[1:] + begins[-1][-1])
        size += len(buffer)
    raw, starts, ends = (np.concatenate(x) for x in (raws, starts, ends))
    _, index, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    starts, n = starts[index], (ends - starts)[index]
    to = np.cumsum(n + 1) - n - 1
    out = np.full(int((n + 1).sum()), 32, np.uint8)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + step] = raw[np.repeat(starts, n) + step]
    return out, to, to + n, place, np.concatenate(begins)


def text_groups(texts: list, words: int = 1_500_000):
    """(begin, end) of parts with about so many words at most; a longer text stands alone, whole."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "") // 5 + 1
        if i > begin and size + n > words:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def shingles(texts: list, k: int):
    """(index, hashes of the text's k-word shingles, repeats included). Fewer words: the whole sequence as one; none: empty."""
    factors = [np.uint64(pow(_PRIME, 2 * j + 3, 1 << 64)) for j in range(k)]
    for part in chunks(texts):
        buffer, starts, ends, first = chunk_words(part)
        words = span_hashes(buffer, starts, ends)
        n = len(words)
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for j, factor in enumerate(factors):
            rolled += words[j : j + len(rolled)] * factor
        rolled = mix(rolled)
        for (i, _), a, b in zip(part, first[:-1], first[1:]):
            if b - a >= k:
                yield i, rolled[a : b - k + 1]
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        whole = whole * np.uint64(_PRIME) + w
                yield i, mix(np.array([whole], np.uint64))
            else:
                yield i, np.zeros(0, np.uint64)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): component is the smallest node reachable.

    Large-star and small-star steps in turn. A step is a grouped minimum, which partial aggregation splits, and an equi-join
    with it; the minimum is written first, so that the adaptive skew join can deal the edges of one star over tasks.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def state(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "edges")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        spent = [edges, low, large, least]
        edges = cut(small, "edges")
        discard(*spent)
        after = state(edges)
        if after == before:
            break
        before = after
    leaves = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
