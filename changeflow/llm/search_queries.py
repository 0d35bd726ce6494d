"""Queries over ``pages`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.llm.learned_partitions import search
from changeflow.llm.queries import query, table
from changeflow.llm.url_rules import Rule, judge_urls, rule_table

RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]

OP2_SQL = """
WITH parts AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rule_host, rule_path, v)),
hits AS (SELECT DISTINCT p.host, p.path, rule_host || rule_path AS rule, v FROM parts p JOIN rules
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)),
best AS (SELECT host, path, rule, v FROM (SELECT *, row_number() OVER (PARTITION BY host, path
    ORDER BY length(rule) DESC, v DESC, rule) AS k FROM hits) WHERE k = 1)
SELECT page_id, p.host, p.path, rule, coalesce(v, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


@query("op2_url_filters", OP2_SQL)
def op2(spark, sf_dir):
    """The winning rule and the verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


@query("op1_learned_partitions")
def op1(spark, sf_dir):
    """The five nearest rows of every fiftieth embedding."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
