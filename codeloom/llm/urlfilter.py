"""URL filtering by host-suffix and path-prefix expressions, with Spark functions only.

Every rule is the digest of its expression host + path. A URL is expanded into the expressions that could equal a rule: each
suffix of its host of as many labels as some rule has, with each prefix of its path of as many characters as some rule has.
The expansion meets the rules on a short prefix of the digest; a match is confirmed on the full digest and on the host. The
longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://`` and for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, by position: a url of any length is searched once."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """``rules(host, path, verdict)`` with digests; of repeated rules, ``block`` stays. Rules with a null part are none."""
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    full = _digest(F.col("host"), F.col("path"))
    return known.select(
        F.substring(full, 1, 8).alias("__r_short"),
        full.alias("__r_full"),
        F.concat("host", "path").alias("__r_rule"),
        (F.length("host") + F.length("path")).alias("__r_size"),
        F.col("host").alias("__r_host"),
        F.length("host").alias("__r_host_size"),
        F.col("verdict").alias("__r_verdict"),
    )


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``urls`` with host, path, rule and verdict added.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins, the one with the
    longer host among equals. Without a rule: null and ``default``. Null urls have empty host and path. Columns of ``urls``
    of the same names are replaced; other columns are never moved with the expansion. Rows may repeat; each is judged on its
    own, and an empty table or no rules at all are fine. Two numbers a rule can have are read first: the lengths of paths and
    the numbers of labels, each a set bounded by the longest rule. Each distinct host and path is expanded once.
    """
    sizes = rules.where("host is not null and path is not null and verdict is not null").agg(F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels")).first()
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rows = urls.select(*keep, host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    named = [*keep, F.col("__host").alias("host"), F.col("__path").alias("path")]
    if not sizes.labels:
        return rows.select(*named, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    most = max(sizes.labels)
    tail = F.slice(F.reverse(F.split(F.substring_index("__host", ".", -most), r"\.")), 1, most)
    suffixes = F.array(*[F.when(F.size("__tail") >= n, F.array_join(F.reverse(F.slice("__tail", 1, n)), ".")) for n in sorted(sizes.labels)])
    prefixes = F.array(*[F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in sorted(sizes.paths)])
    each = lambda h: F.transform(F.array_compact(prefixes), lambda p: F.struct(h.alias("host"), _digest(h, p).alias("full")))
    parts = urls.select(host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path")).where("__host <> ''").distinct().withColumn("__tail", tail)
    wide = parts.select("__host", "__path", F.explode(F.flatten(F.transform(F.array_compact(suffixes), each))).alias("__e"))
    # the short prefix brings rules and expressions together; digest and host say whether they are the same
    met = wide.join(prepared(rules), F.substring("__e.full", 1, 8) == F.col("__r_short")).where((F.col("__e.full") == F.col("__r_full")) & (F.col("__e.host") == F.col("__r_host")))
    best = F.max_by(F.struct(F.col("__r_rule").alias("rule"), F.col("__r_verdict").alias("said")), F.struct("__r_size", "__r_host_size")).alias("__best")
    found = rows.join(met.groupBy("__host", "__path").agg(best), ["__host", "__path"], "left")
    return found.select(*named, F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.said"), F.lit(default)).alias("verdict"))
