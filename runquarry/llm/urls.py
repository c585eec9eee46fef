"""URL filter: explicit rules first, then a shrunken reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runquarry.llm.common import ascii_lower

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule ``host/path`` fits its host and all subdomains of it, if the path starts with its own. ``rules`` is a
    short list that becomes one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without port. The suffix is the last label, or the longest of
    ``suffixes`` (such as ``co.uk``) that ends the host."""
    bare = F.regexp_replace(host, r":\d*$", "")
    labels = F.lit(1)
    for s in sorted(suffixes, key=len):
        labels = F.when((bare == s) | bare.endswith("." + s), F.lit(s.count(".") + 1)).otherwise(labels)
    parts = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return last(labels + 1), last(labels)


def _strength(groups: DataFrame, lowest: float = 1.0, highest: float = 1000.0) -> float:
    """Labelled pages that the prior of a level counts for, from the spread of the rates between its groups.

    The analysis-of-variance estimate of the intraclass correlation r gives (1 - r) / r. Four sums over the
    groups; one number comes back.
    """
    p = F.col("_k") / F.col("_n")
    seen = groups.where("_n > 0")
    s = seen.agg(F.count("*").alias("g"), F.sum("_n").alias("n"), F.sum("_k").alias("k"), F.sum(F.col("_k") * p).alias("kp"),
                 F.sum(F.col("_n") * F.col("_n") / F.lit(1.0)).alias("nn")).first()
    if not s["g"] or s["g"] < 2 or s["n"] <= s["g"]:
        return highest
    mean = s["k"] / s["n"]
    between = (s["kp"] - s["n"] * mean * mean) / (s["g"] - 1)
    within = (s["k"] - s["kp"]) / (s["n"] - s["g"])
    each = (s["n"] - s["nn"] / s["n"]) / (s["g"] - 1)
    spread = between + (each - 1) * within
    r = (between - within) / spread if spread > 0 else 0.0
    return highest if r <= 0 else min(highest, max(lowest, (1 - r) / r))


def host_reputation(pages: DataFrame, host: str, good: str, suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """One row per host: labelled pages, good ones, posterior mean and the bounds of the rate of good pages.

    ``good`` is 1, 0 or null (no label). The overall rate is the prior of a suffix, the posterior of the suffix that
    of a registered domain, that of the domain the prior of a host; each level has its own strength. The beta
    posterior's bounds are mean -/+ z standard deviations. Every group is summed by a partial aggregate, so a host
    with a third of all pages is no burden; no table is held by the driver.
    """
    hosts = pages.groupBy(F.col(host).alias("_host")).agg(F.count(good).alias("_n"), F.coalesce(F.sum(good), F.lit(0)).cast("double").alias("_k"))
    domain, suffix = registered_domain(F.col("_host"), suffixes)
    hosts = hosts.withColumn("_domain", domain).withColumn("_suffix", suffix)
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    tops = domains.groupBy("_suffix").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    total = tops.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0.0)).alias("k")).first()
    rate = (total["k"] + 1) / (total["n"] + 2)

    def shrunk(prior: Column, strength: float) -> Column:
        return (prior * strength + F.col("_k")) / (F.lit(strength) + F.col("_n"))

    tops = tops.select("_suffix", shrunk(F.lit(rate), _strength(tops)).alias("_suffix_mean"))
    s_domain, s_host = _strength(domains), _strength(hosts)
    domains = domains.join(tops, "_suffix").select("_domain", "_suffix", shrunk(F.col("_suffix_mean"), s_domain).alias("_domain_mean"))
    out = hosts.join(domains, ["_domain", "_suffix"]).withColumn("_mean", shrunk(F.col("_domain_mean"), s_host))
    sd = F.sqrt(F.col("_mean") * (1 - F.col("_mean")) / (F.col("_n") + s_host + 1))
    return out.select("_host", "_n", "_k", "_mean", (F.col("_mean") - z * sd).alias("_low"), (F.col("_mean") + z * sd).alias("_high"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], outcomes: DataFrame, url: str = "url", key: str = "page_id",
               outcome_key: str = "page_id", outcome: str = "good", suffixes: Sequence[str] = (), least_rate: float = 0.5,
               z: float = 1.645) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, and the posterior of the host, for every url.

    ``outcomes`` holds labelled pages (1 good, 0 bad). Without a fitting rule a page is blocked where the upper
    posterior bound of its host's rate of good pages stays below ``least_rate``, that is where the labels are
    evidence enough against the host; else it is allowed. Joins and sums only, all of them DataFrame functions.

    Null url or no ``://``: empty host and path, judged like any host. Labels: null ids and null outcomes count for
    nothing, several labels of one page are averaged; a null page key has no label. Repeated rows are judged each.
    No labels at all: the prior is 1/2 and all is allowed at the default rate. Columns of ``pages`` called like an
    output are replaced.
    """
    made = ["host", "path", "rule", "verdict", "host_pages", "host_mean", "host_low", "host_high"]
    labels = outcomes.where(F.col(outcome_key).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(outcome_key).alias("_label_key")).agg(
        F.avg(F.col(outcome).cast("double")).alias("_good"))
    pages = pages.withColumn("_rq_host", url_host(F.col(url))).withColumn("_rq_path", url_path(F.col(url)))
    labelled = pages.select(F.col(key).alias("_key"), "_rq_host").join(labels, F.col("_key") == F.col("_label_key"), "left")
    hosts = host_reputation(labelled, "_rq_host", "_good", suffixes, z)
    kept = [c for c in pages.columns if c not in [*made, "_rq_host", "_rq_path"]]
    rule, verdict = matching_rule(F.col("_rq_host"), F.col("_rq_path"), rules)
    by_host = F.when(F.col("_high") < least_rate, F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(hosts, F.col("_rq_host") == F.col("_host"), "left").select(
        *[pages[c] for c in kept], F.col("_rq_host").alias("host"), F.col("_rq_path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, by_host).alias("verdict"), F.col("_n").alias("host_pages"), F.col("_mean").alias("host_mean"),
        F.col("_low").alias("host_low"), F.col("_high").alias("host_high"))
