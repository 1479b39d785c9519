"""URL rules: host suffixes and path prefixes of each URL meet the rules on short hash prefixes; full digests confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm.common import LOWER, UPPER, cut

#: (verdict, host, path) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The verdict on a URL that no rule fits.
DEFAULT_VERDICT = "allow"
#: Hexadecimal digits of the digest that are joined on.
SHORT = 8
#: Most rules that are sent to every task; more are joined by a shuffle.
BROADCAST_RULES = 5_000
#: Copies of each rule in that shuffle, so that rules which very many URLs meet (such as a top-level domain) are spread.
SALTS = 16


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """From after the first :// to the next /, ? or # or the end, A-Z lower-cased; empty without :// or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to the next ? or # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A rule (verdict, host, path) fits its host and all subdomains of it if the URL's path starts with the rule's; the longest rule
    (host and path together) wins, of equally long ones that with the longer host, then block before allow. rule is null and the
    verdict `default` where none fits. Null URLs and URLs without :// have an empty host and path. Null ids and repeated rows are
    kept as they are; empty tables of pages or rules work; other columns aren't read. Rules that hold a null are passed over.
    """
    known = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("verdict is not null and host is not null and path is not null")
    known = cut(known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select((F.concat("host", "path")).alias("rule"), F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("digest"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), F.size(F.split("host", r"\.", -1)).alias("labels"), "verdict"))
    lengths = sorted(r[0] for r in known.select("path_length").distinct().collect())  # at most as many as the longest rule has characters
    # Suffixes of more labels than any rule's host fit no rule.
    labels = known.agg(F.max("labels")).first()[0]
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    url = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return url.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = known.withColumn("short", F.substring("digest", 1, SHORT))
    rank = F.when(F.col("digest").isNotNull(), F.struct(F.col("host_length") + F.col("path_length"), F.col("host_length"), F.col("verdict"), F.col("rule")))
    if few:
        # No page moves but for the last step, in which a page's expressions are combined before they are exchanged.
        asked = _expressions(url, lengths, labels)
        met = asked.join(F.broadcast(known), (asked["short"] == known["short"]) & (F.col("full") == F.col("digest")), "left")
        won = met.groupBy("row", "page_id", "host", "path").agg(F.max(rank).alias("best"))
    else:
        url = cut(url)
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = _expressions(url, lengths, labels).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["short", "salt"]).where("full = digest")
        won = url.join(met.groupBy("row").agg(F.max(rank).alias("best")), "row", "left")
    return won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _expressions(url: DataFrame, lengths: list[int], most: int) -> DataFrame:
    """url with full and short for each host suffix of at most `most` labels with each path prefix of one of the lengths; null where a page has none."""
    # The last labels, found from the end: a host of very many labels isn't taken apart.
    end = F.when(F.size(F.split("host", r"\.", -1)) > most, F.substring_index("host", ".", -most)).otherwise(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split(end, r"\.", -1))), lambda i: F.call_function("substring_index", end, F.lit("."), -i))
    prefixes = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path"))
    wide = url.select("*", F.explode(suffixes).alias("suffix")).select("*", F.explode_outer(prefixes).alias("n"))
    full = F.sha2(F.concat("suffix", F.lit("\x00"), F.expr("substring(path, 1, n)")), 256)
    return wide.select(*url.columns, full.alias("full")).withColumn("short", F.substring("full", 1, SHORT))
