"""URL filtering by rules that are found through their rarest token (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
RULE_TYPE = "rule string, verdict string, pattern string, tokens array<string>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; a null, or no ``://``, gives two empty texts."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def url_tokens(host: Column, path: Column) -> Column:
    """Labels of the host as ``h:label``, whole segments of the path as ``p:segment``, and ``*``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit("*"))))


def rule_rows(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str, list[str]]]:
    """(rule, verdict, pattern, tokens) per rule. The pattern runs on host + ``#`` + path; neither holds a ``#``.

    Tokens are those that every fitting url must contain: the labels of the host, and the path segments that a slash
    closes. A segment without one may be the front of a longer one, so it is no token.
    """
    out = []
    for verdict, host, path in rules:
        host = host.translate(str.maketrans(UPPER, LOWER))
        fits = rf"(?s)^(?:.*\.)?{_literal(host)}#{_literal(path)}" if host else rf"(?s)^[^#]*#{_literal(path)}"
        tokens = [f"h:{x}" for x in host.split(".") if host] + [f"p:{x}" for x in path.split("/")[:-1] if x]
        out.append((host + path, verdict, fits, tokens or ["*"]))
    return out


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule (verdict, host, path) fits its host and the subdomains of it if the path starts with its own. Each rule is
    filed under that of its tokens which the fewest distinct urls of ``pages`` contain (a tie: the first by name); the
    tokens of a url fetch the rules filed under them, and only those run their regular expression. A rule without tokens
    is filed under ``*``, which every url has. The longest rule that fits wins; of equally long ones block, then the smaller text.

    Urls are judged once per distinct (host, path), so a host or url on a third of all rows costs one row per task. The
    index is a DataFrame: Spark broadcasts it below its size limit and shuffles by token above.
    A null url, or one without ``://``, has an empty host and path and can be fitted only by rules without a host.
    Repeated rows are judged alike. Columns called host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col("_url"))
    parsed = pages.select(*kept, F.col("url").alias("_url")).withColumns({"host": host, "path": path}).drop("_url")
    urls = parsed.select("host", "path").distinct()

    listed = spark.createDataFrame(rule_rows(rules), RULE_TYPE)
    named = listed.select("rule", "verdict", "pattern", F.explode("tokens").alias("token"))
    tokens = urls.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    # only tokens that some rule has are counted, and the counts are folded before the shuffle
    seen = (
        tokens.join(named.select("token").distinct(), "token", "left_semi")
        .groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    )
    index = (
        named.join(seen, "token", "left").fillna(0, ["urls"])
        .groupBy("rule", "verdict", "pattern")
        .agg(F.min_by("token", F.struct("urls", "token")).alias("token"))
    )
    fitting = tokens.join(index, "token").filter(F.expr("rlike(concat(host, '#', path), pattern)"))
    best = fitting.groupBy("host", "path").agg(F.min_by(
        F.struct("rule", "verdict"),
        F.struct(-F.length("rule"), F.col("verdict") != "block", F.col("rule"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
