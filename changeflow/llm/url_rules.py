"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into expressions ``host suffix + path prefix``: the suffixes of its host at dots,
with the prefixes of its path that end in ``/``, and the empty one. A rule is filed under its host and
its path up to the last ``/``. URLs and rules meet in an equi-join on the first four bytes of the
SHA-256 digests of those expressions; full digests and the rest of the rule's path then confirm a hit.
Of all rules that fit, the longest (host and path together) wins; of equally long ones a block, then
the first in order of the rule's text.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule names an empty
host, so it gets the default verdict. Repeated rows each get their row. Only the id and URL columns are
read, whatever else the table holds. Hosts of very many labels and very long paths are expanded only as deep
as the deepest rule, which loses nothing: a longer suffix or prefix equals no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that may be sent to every executor: about 64 MB of digests and texts.
BROADCAST_RULES = 200_000
#: Characters of a rule that counts towards that bound; longer ones are shuffled.
BROADCAST_CHARS = 256


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    def __post_init__(self):
        if not self.host or self.host != self.host.lower() or self.host.strip(".") != self.host:
            raise ValueError(f"not a host in lower case: {self.host!r}")
        if self.path and not self.path.startswith("/"):
            raise ValueError(f"a rule's path is empty or begins with /: {self.path!r}")
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"allow or block, not {self.verdict!r}")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows; a table with these columns serves as well."""
    rows = [(r.host, r.path, r.verdict) for r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#``; A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _last_slash(path: Column) -> Column:
    return F.length(path) - F.instr(F.reverse(path), "/") + 1


def _prefixed(expression: Column) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [F.substring(digest, 1, 8).alias("_prefix"), digest.alias("_digest")]


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _host_suffixes(host: Column, depth: int) -> Column:
    """The suffixes of at most ``depth`` labels."""
    return F.transform(
        F.sequence(F.lit(1), F.least(_labels(host), F.lit(max(depth, 1)))),
        lambda i: F.call_function("substring_index", host, F.lit("."), -i),
    )


def _path_prefixes(path: Column, depth: int) -> Column:
    """The empty prefix, and those that end in ``/`` with at most ``depth`` of them."""
    parts = F.split(path, "/", depth + 1)
    n = F.size(parts) - 1
    whole = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )
    return F.concat(F.array(F.lit("")), whole)


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row a page: ``key``, ``host``, ``path``, the winning ``rule`` or null, ``verdict``.

    The rule table is read twice: once for its depth and size, which is one row, and in the join.
    """
    rules = rules.select("host", "path", "verdict").distinct()
    cut = F.when(F.col("path").contains("/"), _last_slash(F.col("path"))).otherwise(F.lit(0))
    filed = rules.select(
        *_prefixed(F.concat(F.col("host"), F.lit("|"), F.substring("path", F.lit(1), cut))),
        F.col("path").alias("_rule_path"),
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_verdict"),
    )
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    size = rules.agg(
        F.count("*"),
        F.coalesce(F.max(slashes), F.lit(0)),
        F.coalesce(F.max(F.length(F.concat("host", "path"))), F.lit(0)),
        F.coalesce(F.max(_labels(F.col("host"))), F.lit(0)),
    ).first()
    few = size[0] <= BROADCAST_RULES and size[2] <= BROADCAST_CHARS

    u = pages.select(
        F.col(key).alias("_key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    expanded = (
        u.select("host", "path")
        .distinct()  # so that a hot URL is expanded once
        .withColumn("_host", F.explode(_host_suffixes(F.col("host"), size[3])))
        .withColumn("_start", F.explode(_path_prefixes(F.col("path"), size[1])))
        .select("host", "path", *_prefixed(F.concat("_host", F.lit("|"), "_start")))
        .alias("e")
    )
    met = expanded.join((F.broadcast(filed) if few else filed).alias("r"), "_prefix")
    hits = met.where(
        (F.col("e._digest") == F.col("r._digest")) & F.startswith(F.col("path"), F.col("_rule_path"))
    )
    order = F.struct(
        (-F.length("_rule")).alias("n"),
        F.when(F.col("_verdict") == "block", 0).otherwise(1).alias("b"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )
    best = hits.groupBy("host", "path").agg(F.min(order).alias("_best"))
    return u.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
