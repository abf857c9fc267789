"""Operator 4: URL rules by hash-prefix lookups.

A URL is expanded into host-suffix and path-prefix expressions. The expressions
of all distinct (host, path) pairs are joined with the rules on a short hash
prefix; what agrees is confirmed by the full SHA-256 digest, and the longest
rule decides. The prefixes keep the join key small, as in a shared blocklist
of which a client holds only prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8              # 32 bits of the digest
DEFAULT_VERDICT = "allow"   # a URL that no rule fits

#: The rules of the registered query: host, path, verdict. Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT_VERDICT) -> DataFrame:
    """``<id_col>, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest rule (host and path together) wins; of equally long ones
    the longer host, then ``block``, then the smaller text. Rules with a null
    in host, path or verdict are left out, repeated rules count once. A null
    URL or one without ``://`` has an empty host, which no rule fits. Rows are
    kept one to one; an empty rule table gives every URL the default verdict.
    Other columns are left out.
    """
    own = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"),
                       path_of(F.col(f"`{url_col}`")).alias("path"))
    known = (rules.select("host", "path", "verdict").dropna().where("host <> ''").distinct()
             .select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict",
                     _digest(F.col("host"), F.col("path")).alias("full")))
    known = known.withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    # paths are cut where some rule's path ends: there are no more such lengths than a path has characters
    lengths = F.array(*[F.lit(r[0]) for r in known.select(F.length("r_path")).distinct().collect()]).cast("array<int>")

    # and hosts where some rule's host begins: suffixes of as many labels as a rule has
    labels = 1 + F.length("host") - F.length(F.translate("host", ".", ""))
    rule_labels = 1 + F.length("r_host") - F.length(F.translate("r_host", ".", ""))
    counts = [r[0] for r in known.select(rule_labels).distinct().collect()]
    hosts = F.array_compact(F.array(*[F.when(labels >= n, F.substring_index("host", ".", -n)) for n in counts]).cast("array<string>"))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    distinct = own.select("host", "path").where("host <> ''").distinct()
    expressions = (distinct.select("host", "path", F.explode(hosts).alias("e_host"), paths.alias("paths"))
                   .select("host", "path", "e_host", F.explode("paths").alias("e_path"))
                   .withColumn("e_full", _digest(F.col("e_host"), F.col("e_path")))
                   .withColumn("prefix", F.substring("e_full", 1, PREFIX_HEX)))
    fits = (expressions.join(known, "prefix").where("e_full = full and e_host = r_host and e_path = r_path")
            .select("host", "path", F.struct((F.length("r_host") + F.length("r_path")).alias("size"),
                                             F.length("r_host").alias("host_size"), (F.col("verdict") == "block").alias("hard"),
                                             F.concat("r_host", "r_path").alias("rule"), "verdict").alias("fit")))
    best = fits.groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return (own.join(best, ["host", "path"], "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.verdict", F.lit(default)).alias("verdict")))
