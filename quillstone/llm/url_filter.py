"""URL filter: host-suffix and path-prefix expressions joined on short hash prefixes.

Every URL is expanded into the expressions ``host suffix + path prefix`` that a
rule could equal, each expression is reduced to a 32-bit prefix of its SHA-256,
candidates come from an equi-join on that prefix, and the full digests decide.
Of several fitting rules the longest wins.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule sets up to this many rows are broadcast (about 200 bytes a row); larger ones are shuffled.
MAX_BROADCAST_RULES = 100_000
#: A hot host's rows are spread over so many salts when the rules are shuffled.
SALTS = 32
#: Stands between host and path in an expression; neither part of a URL has it, so that no host runs on into a path.
SEPARATOR = "?"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """Text from the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _keyed(df: DataFrame, expression: str) -> DataFrame:
    return df.withColumn("_digest", F.sha2(F.col(expression), 256)).withColumn(
        "_key", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has (action string, host string, path string); a rule fits its host
    and all subdomains when the URL's path starts with the rule's path (an empty or null
    rule path fits every path; an empty or null rule host fits URLs without a host only, and a rule with ``?`` fits none).  The longest rule string wins; of equally long
    ones the one with the longer host, then ``block``.  Rows without a fitting rule, null
    and malformed URLs included, get a null rule and the verdict ``default``.
    Repeated rows stay; columns of ``pages`` with the names of results are replaced.

    The numbers of labels in rule hosts and the lengths of rule paths bound what a
    URL expands to, so a URL of any length gives few expressions, and no rule is
    missed.  Only those two sets of small integers come to the driver.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rules = rules.select(
        "action",
        F.translate(F.coalesce(F.col("host"), F.lit("")), _UPPER, _LOWER).alias("rule_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("rule_path"),
    ).withColumns({"_rule": F.concat("rule_host", "rule_path"), "_expression": F.concat("rule_host", F.lit(SEPARATOR), "rule_path")})
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", "\\.", -1))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    small = shape["n"] <= MAX_BROADCAST_RULES

    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
        url_host(F.col(url_col)).alias("_host"),
        url_path(F.col(url_col)).alias("_path"),
    ).withColumn("_uid", F.monotonically_increasing_id())
    labels = F.split("_host", "\\.", -1)
    hosts = F.array_compact(
        F.array(
            *[
                F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))
                for n in sorted(shape["labels"])
            ]
        )
    ) if shape["labels"] else F.array().cast("array<string>")
    paths = F.array_compact(
        F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in sorted(shape["lengths"])])
    ) if shape["lengths"] else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(F.col("_hosts"), lambda h: F.transform(F.col("_paths"), lambda p: F.concat(h, F.lit(SEPARATOR), p))))
    exploded = _keyed(
        rows.withColumn("_hosts", hosts)
        .withColumn("_paths", paths)
        .withColumn("_expression", F.explode_outer(pairs))
        .drop("_hosts", "_paths"),
        "_expression",
    )
    side = _keyed(rules, "_expression").select(
        "_key",
        F.col("_digest").alias("_rule_digest"),
        F.struct(
            F.length("_rule").alias("n"),
            F.length("rule_host").alias("h"),
            (F.col("action") == "block").alias("b"),
            F.col("_rule").alias("rule"),
            F.col("action").alias("action"),
        ).alias("_hit"),
    )
    on = ["_key"]
    if small:
        side = F.broadcast(side)
    else:
        on = ["_key", "_salt"]
        side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        exploded = exploded.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int"))
    joined = exploded.join(side, on, "left").withColumn(
        "_hit", F.when(F.col("_digest") == F.col("_rule_digest"), F.col("_hit"))
    )
    best = joined.groupBy("_uid").agg(
        F.first("_row").alias("_row"),
        F.first("_host").alias("host"),
        F.first("_path").alias("path"),
        F.max("_hit").alias("_hit"),
    )
    return best.select(
        *[F.col("_row").getField(c).alias(c) for c in keep],
        "host",
        "path",
        F.col("_hit.rule").alias("rule"),
        F.coalesce(F.col("_hit.action"), F.lit(default)).alias("verdict"),
    )
