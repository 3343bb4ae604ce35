"""Document quality by a classifier whose evidence meets the record of the document's site (hierarchical empirical Bayes).

1. Evidence: twelve figures of a text's form (shares of letters, symbols and capitals, line and word statistics,
   repetition) and a logistic model of them, fitted on a sample of labelled rows with a fixed bound.
2. Record: the labelled good and bad documents of each host and of each path below it (the first segment of a url's path). A
   document's site is that of its page; one without a page has the host column as its host and no path. A path's rate of good documents is
   shrunk towards its host's, the host's towards the corpus's; the strength of each prior comes from the spread of the
   counts at its level (method of moments), so sparse sites stay near their parents.
3. A document's posterior log odds: the classifier's, less the corpus's prior odds that it was fitted with, plus those of
   its path.

The text is read once, by a map; labels, sites and scores meet as narrow rows. The rates of sites that hold a thousandth of all
rows or more are broadcast, so one site with a third of all rows is no single task.

Results that are defined: a null text is an empty one; a null host or path is a value like any other; a null label or
one without a document counts for nothing; several labels of a document all count; without labelled rows of both kinds
the classifier says nothing and all documents have the prior; repeated rows are scored each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import chunk_words, chunks, cut, first_by_hash, span_hashes

SAMPLE, HEAVY, THRESHOLD = 20_000, 1000, 0.5
FIGURES = 12
_KIND = np.zeros(256, np.int8)  # 1 letter (bytes of other scripts included), 2 digit, 3 space, 4 symbol, 5 plain punctuation
_KIND[:] = 4
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 3
_KIND[list(b".,;:'\"!?()-")] = 5


def _shares(owner: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many different things it holds, and how often the most frequent one. owner: the text of each thing."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    begins = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))) if len(owner) else np.zeros(0, np.int64)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, owner[begins], np.diff(np.append(begins, len(owner))))
    return np.bincount(owner[begins], minlength=texts), top


def figures(texts: list) -> np.ndarray:
    """texts x FIGURES numbers, most of them shares; a text without words has zeros but for the last."""
    out = np.zeros((len(texts), FIGURES))
    for part in chunks(texts, encode=lambda t: b"" if t is None else t.encode("utf-8", "surrogatepass")):
        at = np.array([i for i, _ in part])
        buffer, starts, ends, first = chunk_words(part)
        size = np.array([len(raw) for _, raw in part])
        begin = np.cumsum(size + 1) - size - 1
        k, n, m = len(part), np.maximum(size, 1), np.diff(first)
        words, owner = np.maximum(m, 1), np.repeat(np.arange(k), m)

        def within(found: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(found)))
            return total[begin + size] - total[begin]

        kinds = _KIND[buffer]
        letters, digits, symbols = (within(kinds == x) for x in (1, 2, 4))
        hashes = span_hashes(buffer, starts, ends)
        different, top = _shares(owner, hashes, k)
        # lines with a word in them: from a break to the next
        breaks = np.flatnonzero(buffer == 10)
        line = np.searchsorted(breaks, starts)
        lines = np.unique(line)
        low = np.concatenate(([0], breaks + 1))[lines]
        of_text = np.searchsorted(begin, low, "right") - 1
        n_lines = np.maximum(np.bincount(of_text, minlength=k), 1)
        same, _ = _shares(of_text, span_hashes(buffer, low, breaks[lines]), k)
        tail = buffer[ends - 1] if len(ends) else buffer[:0]
        twice = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))) if len(hashes) else np.zeros(0, bool)
        mean = lambda found: np.bincount(owner, found, k) / words
        rows = [letters / n, symbols / n, digits / n, within((buffer >= 65) & (buffer <= 90)) / np.maximum(letters, 1), np.minimum(size / words, 30) / 30, different / words, top / words, 1 - same / n_lines, mean(_KIND[tail] == 4), mean(tail == ord("!")), np.log1p(m) / 10, mean(twice)]
        found = np.stack(rows, axis=1)
        found[m == 0] = [0.0] * (FIGURES - 1) + [1.0]
        out[at] = found
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Figures, their square roots and a one."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), np.ones((len(x), 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by iteratively reweighted least squares."""
    x = expanded(x)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _measuring(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            found = pa.FixedSizeListArray.from_arrays(pa.array(figures(part.column(2).to_pylist()).ravel()), FIGURES)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found.cast(pa.list_(pa.float64()))], names=["doc_id", "host", "x"])


def _strength(level: DataFrame) -> float:
    """Pseudo-count of a level's prior from n, good and m (the prior mean): 1 to 1000."""
    v = F.col("m") * (1 - F.col("m"))
    s = level.agg(F.sum((F.col("good") - F.col("n") * F.col("m")) ** 2).alias("s"), F.sum(F.col("n") * v).alias("a"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("b")).first()
    share = (s.s - s.a) / s.b if s.b else 0.0
    return 1 / min(max(share, 1 / 1001), 1 / 2) - 1


def site_rates(outcomes: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, rate) from host, path and good (0 or 1), and the corpus's rate. Hosts without the path get path rows of their own."""
    paths = cut(outcomes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total.good or 0) + 1) / ((total.n or 0) + 2)
    hosts = cut(hosts.withColumn("m", F.lit(overall)), "hosts")
    k = _strength(hosts)
    hosts = hosts.select("host", ((F.col("good") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    paths = cut(paths.join(hosts, paths.host.eqNullSafe(hosts.host)).select(paths.host, "path", "n", "good", "m"), "paths")
    k = _strength(paths)
    return paths.select("host", "path", F.col("m").alias("host_rate"), ((F.col("good") + k * F.col("m")) / (F.col("n") + k)).alias("rate")), overall


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    sites: DataFrame | None = None,
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, host, path, evidence (log odds of the classifier), site_rate, quality (posterior probability), accepted.

    sites: doc_id, host and path of documents that have a page; of several pages the least counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = cut(rows.mapInArrow(_measuring, f"doc_id {kind}, host string, x array<double>"), "figures")
    if sites is not None:
        paged = sites.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_doc")).agg(F.min(F.struct("host", "path")).alias("site"))

    def sited(df: DataFrame) -> DataFrame:
        """With the document's own site, where it has one."""
        if sites is None:
            return df.withColumn("path", F.lit(""))
        met = df.join(paged, F.col("doc_id") == F.col("page_doc"), "left").drop("page_doc")
        own = F.col("site").isNotNull()
        return met.withColumns({"host": F.when(own, F.col("site.host")).otherwise(F.col("host")), "path": F.when(own, F.col("site.path")).otherwise("")}).drop("site")

    known = labels.where(F.col(label_col).isNotNull()).select(F.col(label_id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("good"))
    labelled = cut(sited(measured.join(known, "doc_id")), "labelled")
    drawn = first_by_hash(labelled, sample, labelled.count(), "doc_id", "good").select("x", "good").collect()
    y = np.array([r.good for r in drawn], float)
    learned = len(set(y)) == 2
    weights = logistic(np.array([r.x for r in drawn]), y) if learned else np.zeros(2 * FIGURES + 1)
    rates, overall = site_rates(labelled.select("host", "path", "good"))
    fitted_prior = np.log(y.mean() / (1 - y.mean())) if learned else 0.0

    x = F.col("x")
    evidence = F.lit(float(weights[-1]))
    for i in range(FIGURES):
        evidence = evidence + float(weights[i]) * x[i] + float(weights[FIGURES + i]) * F.sqrt(F.greatest(x[i], F.lit(0.0)))
    scored = cut(sited(measured.select("doc_id", "host", evidence.alias("evidence"))), "scored")
    # a path without labels takes its host's rate, a host without any the corpus's
    found = scored.groupBy("host", "path").agg(F.count("*").alias("rows"))
    own = rates.select(F.col("host").alias("h1"), F.col("path").alias("p1"), F.col("rate").alias("own_rate"))
    by_host = rates.groupBy("host").agg(F.first("host_rate").alias("only_host")).withColumnRenamed("host", "h2")
    found = found.join(own, F.col("host").eqNullSafe(F.col("h1")) & F.col("path").eqNullSafe(F.col("p1")), "left").join(by_host, F.col("host").eqNullSafe(F.col("h2")), "left")
    found = cut(found.select(F.col("host").alias("h"), F.col("path").alias("p"), "rows", F.coalesce("own_rate", "only_host", F.lit(overall)).alias("rate")), "sites")
    # sites with a thousandth of all rows are a thousand at most; in all others a task has few rows of one site
    often = F.col("rows") * HEAVY >= scored.count()
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    heavy, light = F.broadcast(found.where(often)), found.where(~often)
    met = scored.join(heavy, same).unionByName(scored.join(heavy, same, "left_anti").join(light, same))
    rate = F.col("rate")
    odds = F.col("evidence") - float(fitted_prior) + F.log(rate / (1 - rate))
    quality = 1 / (1 + F.exp(-odds))
    return met.select("doc_id", "host", "path", "evidence", rate.alias("site_rate"), quality.alias("quality")).withColumn("accepted", F.col("quality") >= threshold)
