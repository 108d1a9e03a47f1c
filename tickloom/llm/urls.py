"""URL filter: pattern rules found through their rarest literal token.

A pattern rule is a text with ``*`` (anything), ``^`` (a separator or the end), ``||`` (start of a host label) and ``|``
(start or end of the url); a leading ``@@`` allows instead of blocking. Whole alphanumeric tokens of a pattern must occur
as whole tokens of any url it fits, so each rule is filed under the one of its tokens that the fewest urls have. Tokens of
a url fetch the rules filed under them; only those run their regular expression. Patterns without a whole token are run on every url.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path) of the base list.
BASE_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Pattern rules of the query.
PATTERN_RULES = (
    "||spam-farm.*^", "||ads.*^", "||adserver.", "||tracker.", "||casino-*.", "/wp-admin/", "/cgi-bin/*.pl^", "/wp-login.php^", "^replytocom=",
    "^sessionid=", "^phpsessid=", "/trackback/|", "/tag/*/page/", "^sort=*&dir=", "*.exe|", "*.apk|", "/calendar/*/day/", "^utm_source=feed|",
    "||blog.*/es/*#top|", "||m.*.example.net/de/", "^page=2&ref=x|", "://www.*.html|", "@@||tionsh.example.net/en/", "@@/fr/*^page=2^",
)
#: A rule list up to this many rules is small enough (at most 1 kB each) to go to every task.
BROADCAST_RULES = 10_000
RULE_BYTES = 1000
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _A_Z, _a_z)


def host(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; of equally long ones the first in the alphabet."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def regex_of(pattern: str) -> str:
    body = pattern.removeprefix("@@").lower()
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    parts = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    return "(?s)" + head + "".join(parts.get(c) or (c if c.isalnum() else "\\" + c) for c in body) + tail


def tokens_of(pattern: str) -> list[str]:
    """Tokens that any url fitting the pattern has as whole tokens."""
    body = pattern.removeprefix("@@").lower()
    # an open end or a star may continue a token, anything else ends it
    marked = ("|" if body.startswith("|") else "*") + body.strip("|") + ("|" if body.endswith("|") else "*")
    return sorted(set(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", marked)))


def rule_table(spark: SparkSession, patterns=PATTERN_RULES) -> DataFrame:
    if any(len(p.encode()) > RULE_BYTES for p in patterns):
        raise ValueError(f"a pattern has at most {RULE_BYTES} bytes")
    rows = [(i, p, regex_of(p), "allow" if p.startswith("@@") else "block", tokens_of(p)) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "rule_id int, pattern string, regex string, verdict string, tokens array<string>")


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def judge(urls: DataFrame, patterns=PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """One row per distinct url that some pattern fits: url, verdict, pattern.

    An allowing pattern outweighs blocking ones; ``pattern`` is the first in the list that decides. A url that nothing
    fits, and a null url, has no row.
    """
    spark = urls.sparkSession
    small = len(patterns) <= BROADCAST_RULES
    sent = F.broadcast if small else (lambda df: df)
    rules = rule_table(spark, patterns)
    distinct = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    token = distinct.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    asked = rules.select("rule_id", F.explode("tokens").alias("token"))
    count = token.join(sent(asked.select("token").distinct()), "token").groupBy("token").count()
    filed = asked.join(count, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = rules.drop("tokens").join(filed, "rule_id")
    fits = F.expr("lower_url RLIKE regex")
    indexed = token.join(sent(index), "token").withColumn("lower_url", lower(F.col("url"))).where(fits).select("url", "rule_id", "pattern", "verdict")
    bare = rules.where(F.size("tokens") == 0).drop("tokens")
    open_rules = [p for p in patterns if not tokens_of(p)]
    hits = indexed
    if open_rules:
        each = distinct.withColumn("lower_url", lower(F.col("url"))).withColumn("ids", F.array_compact(F.array(*[F.when(F.col("lower_url").rlike(regex_of(p)), F.lit(patterns.index(p))) for p in open_rules])))
        hits = hits.unionByName(each.select("url", F.explode("ids").alias("rule_id")).join(sent(bare), "rule_id").select("url", "rule_id", "pattern", "verdict"))
    best = F.struct(F.when(F.col("verdict") == "allow", 0).otherwise(1).alias("rank"), "rule_id", "verdict", "pattern")
    return hits.groupBy("url").agg(F.min(best).alias("b")).select("url", "b.verdict", "b.pattern")


def filter_urls(pages: DataFrame, patterns=PATTERN_RULES, base=BASE_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, pattern, verdict.

    The base list decides where a rule of it fits; else the patterns do; else the url is allowed. A null url, or
    one without ``://``, has an empty host and path. Repeated rows are judged once and returned each. Other columns
    are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    found = judge(rows.withColumnRenamed("url", "u"), patterns, "u").withColumnRenamed("verdict", "said")
    based = base_rule(F.col("host"), F.col("path"), base)
    return (
        rows.join(found, "url", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("base", based)
        .select("page_id", "url", "host", "path", F.col("base.rule").alias("rule"), F.when(F.col("base").isNull(), F.col("pattern")).alias("pattern"), F.coalesce("base.verdict", "said", F.lit("allow")).alias("verdict"))
    )
