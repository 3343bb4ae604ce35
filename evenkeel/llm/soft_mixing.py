"""Mixing by soft domain membership (DataFrame functions only).

1. A naive Bayes classifier of words is fitted on a labelled table: a sample of about SAMPLE rows, shared out evenly over
   the domains (LEAST rows for each at least) and drawn by a hash of the id and text; priors from all labelled rows;
   word counts for each domain, every one of them, and the VOCABULARY words that tell most (count times spread of log probability).
   All documents are read whole: words meet the vocabulary (a fixed number of rows, broadcast), and log evidence is
   summed for each document before any shuffle. Evidence is divided by the square root of the number of words met,
   which keeps posteriors soft.
2. Rates r >= 0 for documents are fitted so that the expected tokens of each domain, sum of r t p(domain), meet targets:
   least squares in relative units (errors divided by the square root of the domain's tokens), by projected gradient in
   y = r sqrt(t). In these units the Hessian's eigenvalues are at most 1, so the step is 1. Rounds end when targets are met
   to TOLERANCE of the total, which takes a few; where nonnegative rates can't meet them, after ROUNDS, near the optimum. A round is one aggregation over
   narrow rows that returns a number for each domain; r is an expression of the rounds so far, so nothing is written.

Targets: shares for each domain of the total, given or (None) proportional to its tokens to the power `temper`; 0 makes
all equal; a share for a domain that no row is labelled with raises an error. The total is the corpus's tokens, or with `grow` the least total in which no domain shrinks.

Results that are defined: a null or empty text has no tokens, the prior as posterior, and the rate that follows; a text
with no word of the vocabulary too; without labelled rows there is one domain, '', and all rates are 1; domains without
tokens can't be met and are left out of the fit; repeated rows each get a rate; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

SAMPLE, LEAST, VOCABULARY, ROUNDS, TOLERANCE = 4_000, 100, 1_000, 50, 1e-6
_NO_WORD = ""


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; null and blank: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != _NO_WORD)


def classifier(labelled: DataFrame, id_col: str, text_col: str, domain_col: str, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> tuple[list[str], list[float], DataFrame | None]:
    """Domains, their log priors, and (word, l0, l1, ...): log p(word | domain) less its mean over domains."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"), F.col(text_col).cast("string").alias("text")).where("domain is not null")
    # rows with words can be drawn, and the one with the least hash always is
    rows = rows.withColumn("h", F.when(F.col("text").rlike(r"[^ \t-\r]"), F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(1 << 30))))
    sized = cut(rows.groupBy("domain").agg(F.count("*").alias("n"), F.count("h").alias("usable"), F.min("h").alias("least")), "domain-sizes")
    sizes = sized.select("domain", "n").collect()
    if not sizes:
        return [_NO_WORD], [0.0], None
    domains = sorted(r.domain for r in sizes)
    total, count = sum(r.n for r in sizes), {r.domain: r.n for r in sizes}
    priors = [log(count[d] / total) for d in domains]
    share = F.least(F.lit(1.0), F.lit(float(max(sample // len(domains), LEAST))) / F.col("usable")) * float(1 << 30)
    bounds = sized.where("usable > 0").select(F.col("domain").alias("of"), F.greatest(share, F.col("least") + 1.0).alias("bound"))
    chosen = rows.join(F.broadcast(bounds), F.col("domain") == F.col("of")).where(F.col("h") < F.col("bound"))
    # the outer form, as Spark would else ask every row for words before it draws
    counts = chosen.select("domain", F.explode_outer(words_of(F.col("text"))).alias("word")).groupBy("word").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)))
    counts = cut(counts, "domain-words")
    sums = counts.agg(F.count("*").alias("v"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(domains)))).first()
    if not sums.v:
        return domains, priors, None
    logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit(float((sums[f"n{i}"] or 0) + 0.5 * sums.v))) for i in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    spread = F.greatest(*logs) - F.least(*logs) if len(domains) > 1 else F.lit(0.0)
    uses = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0"))
    table = counts.select("word", *((x - mean).alias(f"l{i}") for i, x in enumerate(logs)), (uses * spread).alias("tells"))
    return domains, priors, cut(table.orderBy(F.desc("tells"), "word").limit(vocabulary).drop("tells"), "vocabulary")


def posteriors(docs: DataFrame, model: tuple[list[str], list[float], DataFrame | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, p0, p1, ... (in the order of the domains)."""
    domains, priors, vocabulary = model
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    n = len(domains)
    if vocabulary is None:
        biggest = sum(2.718281828459045**p for p in priors)
        return rows.select("doc_id", F.size("words").cast("long").alias("tokens"), *(F.lit(2.718281828459045**p / biggest).alias(f"p{i}") for i, p in enumerate(priors)))
    # every text also has the empty word, which no vocabulary holds: no text is lost in the join
    empty = vocabulary.sparkSession.range(1).select(F.lit(_NO_WORD).alias("word"), *(F.lit(0.0).alias(f"l{i}") for i in range(n)))
    weights = vocabulary.withColumn("met", F.lit(1)).unionByName(empty.withColumn("met", F.lit(0)))  # VOCABULARY + 1 rows
    uses = rows.select("row", "doc_id", F.size("words").cast("long").alias("tokens"), F.explode(F.concat(F.array(F.lit(_NO_WORD)), "words")).alias("word"))
    met = uses.join(F.broadcast(weights), "word").groupBy("row", "doc_id", "tokens").agg(F.sum("met").alias("met"), *(F.sum(f"l{i}").alias(f"l{i}") for i in range(n)))
    scores = [F.col(f"l{i}") / F.sqrt(F.greatest(F.col("met"), F.lit(1))) + priors[i] for i in range(n)]
    met = met.select("doc_id", "tokens", *(s.alias(f"s{i}") for i, s in enumerate(scores)))
    top = F.greatest(*(F.col(f"s{i}") for i in range(n))) if n > 1 else F.col("s0")
    shares = [F.exp(F.col(f"s{i}") - top) for i in range(n)]
    total = sum(shares[1:], shares[0])
    return met.select("doc_id", "tokens", *((s / total).alias(f"p{i}") for i, s in enumerate(shares)))


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float] | None, temper: float = 0.0, grow: bool = False, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[Column, list[float], list[float], int]:
    """The rate as an expression of members' columns (tokens, p0, ...), targets, expected tokens, rounds used."""
    if unknown := sorted(set(weights or ()) - set(domains)):
        raise ValueError(f"weights for domains that no row is labelled with: {unknown}")
    n = len(domains)
    p = [F.col(f"p{i}") for i in range(n)]
    first = members.agg(*(F.sum(F.col("tokens") * x).alias(f"s{i}") for i, x in enumerate(p))).first()
    size = [first[f"s{i}"] or 0.0 for i in range(n)]
    live = [i for i in range(n) if size[i] > 0]
    if not live:
        return F.lit(1.0), [0.0] * n, [0.0] * n, 0
    share = [max(weights.get(d, 0.0), 0.0) if weights is not None else (size[i] ** temper if size[i] > 0 else 0.0) for i, d in enumerate(domains)]
    whole = sum(share[i] for i in live)
    if whole <= 0:
        raise ValueError("no domain that has tokens has a weight")
    share = [share[i] / whole if i in live else 0.0 for i in range(n)]
    total = max(size[i] / share[i] for i in live if share[i] > 0) if grow else sum(size)
    target = [s * total for s in share]
    rate = sum((p[i] * (target[i] / size[i]) for i in live[1:]), p[live[0]] * (target[live[0]] / size[live[0]]))
    for used in range(rounds + 1):
        row = members.agg(*(F.sum(F.col("tokens") * rate * x).alias(f"e{i}") for i, x in enumerate(p))).first()
        expected = [row[f"e{i}"] or 0.0 for i in range(n)]
        if used == rounds or max(abs(expected[i] - target[i]) for i in live) <= tolerance * total:
            break
        slope = sum((p[i] * ((expected[i] - target[i]) / size[i]) for i in live[1:]), p[live[0]] * ((expected[live[0]] - target[live[0]]) / size[live[0]]))
        rate = F.greatest(F.lit(0.0), rate - slope)
    return rate, target, expected, used


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
    weights: dict[str, float] | None = None,
    temper: float = 0.0,
    grow: bool = False,
) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior (its probability), posteriors (a map), rate (expected repeats)."""
    model = classifier(labelled, id_col, text_col, domain_col)
    domains = model[0]
    members = cut(posteriors(docs, model, id_col, text_col), "posteriors")
    rate, *_ = fit_rates(members, domains, weights, temper, grow)
    p = [F.col(f"p{i}") for i in range(len(domains))]
    best = F.greatest(*p) if len(p) > 1 else p[0]
    domain = F.coalesce(*(F.when(x == best, F.lit(d)) for d, x in zip(domains, p)))
    pairs = [c for d, x in zip(domains, p) for c in (F.lit(d), x)]
    return members.select("doc_id", "tokens", domain.alias("domain"), best.alias("posterior"), F.create_map(*pairs).alias("posteriors"), rate.alias("rate"))
