r"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a host, a path and a verdict.  It fits its host and all subdomains if the URL's path starts with the rule's
path; of the rules that fit, the longest wins (then the smaller rule, then the smaller verdict).  A rule is filed under
the one of its literal tokens that is rarest among the URLs.  The tokens of a URL fetch candidate rules by a join, and
only those run their regular expression.

Defined results: a null URL, or one without ``://``, has an empty host and path; a URL that no rule fits gets the
default verdict and a null rule; repeated rows are judged alike; an empty table gives an empty result.  Input columns
other than those named by ``keep`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts tokens: every ASCII character but digits and letters.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda i: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, PARTS), lambda t: t != ""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def rule_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """(token, rule, pattern, verdict): each rule under its rarest token.

    The last token of a path that ends within a token may go on in the URL, so it is left out.  A rule without any
    whole token is filed under the empty token, which every URL has.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    table = rules.select(
        F.concat(host, path).alias("rule"),
        "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host), F.lit("(?=/|$)"), quoted(path)).alias("pattern"),
        tokens(F.concat(host, F.regexp_replace(path, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", ""))).alias("own"),
    ).distinct()
    seen = url_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    own = table.select("rule", "verdict", "pattern", F.explode_outer("own").alias("token"))
    own = own.withColumn("token", F.coalesce("token", F.lit("")))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token"))
    return (
        own.join(seen, "token", "left")
        .groupBy("rule", "verdict", "pattern")
        .agg(F.min(rarity).alias("rarest"))
        .select(F.col("rarest.token").alias("token"), "rule", "pattern", "verdict")
    )


def filter_urls(urls: DataFrame, rules: DataFrame, keep: tuple[str, ...], default: str = "allow", url: str = "url") -> DataFrame:
    """``keep`` columns of each row of ``urls`` with its host, path, the rule that decided, and the verdict."""
    host, path = host_and_path(F.col(url))
    cut = urls.select(*keep, host.alias("host"), path.alias("path"))
    places = cut.select("host", "path").distinct()
    spread = places.select("*", F.explode(F.array_union(tokens(F.concat("host", "path")), F.array(F.lit("")))).alias("token"))
    index = rule_index(rules, spread)
    fits = spread.join(index, "token").where(F.expr("concat(host, path) rlike pattern"))
    best = (
        fits.groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("shortness"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("found"))
    )
    return cut.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict")
    )
