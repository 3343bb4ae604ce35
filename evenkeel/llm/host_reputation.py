"""Host reputation by empirical Bayes (DataFrame functions only).

Labelled page outcomes are counted for each host, registered domain and suffix. From the top down, each level's
rate of bad pages gets a beta prior whose mean is the posterior mean of the level above and whose strength comes
from the spread of the level's own counts (method of moments for the beta-binomial). A page without a rule is
blocked if the lower bound of its host's posterior rate (normal approximation) is above a threshold.

Rules are few (a list); the longest that fits decides. Rates join back to the pages in two parts: hosts with at
least a thousandth of all pages are at most a thousand and are broadcast, the others meet by a shuffle.

Results that are defined: a null url, or one without `://`, has an empty host and path, fits no rule and shares the
reputation of the empty host; without outcomes every page without a rule is allowed; repeated pages each get a
verdict; outcomes that are null count for nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]

HEAVY = 1000
THRESHOLD, Z = 0.5, 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The suffix and one label more; an address of digits, or a host with no more labels, is its own domain."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    suffix_labels = F.when(F.concat_ws(".", F.slice(labels, -2, 2)).isin(TWO_LABEL_SUFFIXES) & (F.size(labels) >= 2), 2).otherwise(1)
    keep = F.least(F.size(labels), suffix_labels + 1)
    return F.when(host.rlike(r"^[0-9.]+(:[0-9]*)?$"), host).otherwise(F.concat_ws(".", F.slice(labels, -keep, keep)))


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+(:[0-9]*)?$"), F.lit("")).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host and path prefix) that fits the host or a parent of it and the path's beginning."""
    fits = []
    for rule in sorted({r for _, r in rules}, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


def _strength(level: DataFrame) -> float:
    """Pseudo-count of a level's prior, from columns n, bad and m (the prior mean): 1 to 1000."""
    v = F.col("m") * (1 - F.col("m"))
    s = level.agg(F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2).alias("s"), F.sum(F.col("n") * v).alias("a"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("b")).first()
    share = (s.s - s.a) / s.b if s.b else 0.0
    return 1 / min(max(share, 1 / 1001), 1 / 2) - 1


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    return level.withColumn("alpha", F.col("bad") + strength * F.col("m")).withColumn("beta", F.col("n") - F.col("bad") + strength * (1 - F.col("m")))


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts: host, pages, n (labelled pages), bad. Adds domain, suffix, rate (posterior mean) and low (its lower bound)."""
    hosts = cut(hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = cut(hosts.groupBy("domain", "suffix").agg(*counts), "domains")
    suffixes = domains.groupBy("suffix").agg(*counts)
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 1) / ((total.n or 0) + 2)
    top = suffixes.withColumn("m", F.lit(overall))
    top = _shrunk(top, _strength(top)).select("suffix", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m"))
    middle = cut(domains.join(top, "suffix"), "domains")
    middle = _shrunk(middle, _strength(middle)).select("domain", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m"))
    bottom = cut(hosts.join(middle, "domain"), "hosts")
    done = _shrunk(bottom, _strength(bottom))
    size = F.col("alpha") + F.col("beta")
    done = done.withColumn("rate", F.col("alpha") / size)
    return done.withColumn("low", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))).drop("m", "alpha", "beta")


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = THRESHOLD,
    z: float = Z,
) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, low. outcomes: host and bad (0 or 1), one row for each labelled page."""
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    seen = cut(seen.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)), "pages")
    own = seen.groupBy("host").agg(F.count("*").alias("pages"))
    known = outcomes.where("bad is not null and host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = own.join(known, "host", "full_outer").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "n", "bad")))
    known_hosts = cut(reputations(hosts, z).select("host", "pages", "rate", "low"), "reputations")
    least = (known_hosts.agg(F.sum("pages")).first()[0] or 0) / HEAVY
    heavy = known_hosts.where((F.col("pages") >= least) & (F.col("pages") > 0)).drop("pages")  # HEAVY rows at most
    light = known_hosts.where(F.col("pages") < least).drop("pages")
    judged = seen.join(F.broadcast(heavy), "host").unionByName(seen.join(F.broadcast(heavy.select("host")), "host", "left_anti").join(light, "host"))
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for v, r in rules), F.lit(None).cast("string"))
    by_rate = F.when(F.col("low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_rate).alias("verdict"), "rate", "low")
