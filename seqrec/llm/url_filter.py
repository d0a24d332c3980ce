"""URL filter with redirect equivalence (operator 6). DataFrame functions only.

Method: a rule (host, path) fits a url if the url's host is the rule's or a subdomain of it and the
url's path starts with the rule's; the longest fitting rule decides. Urls that no rule fits inherit:
pages are joined to the targets of their canonical links and meta refreshes, connected components of
these edges are found by distributed star contraction, and a component that holds a url which a rule
blocks, and none which a rule allows, is blocked; an explicit allow takes precedence. A rule that
fits a url itself always wins over what its aliases say. Targets count with their own verdicts, also
where no page of the table has their address.

Urls are compared by host and path: the scheme, query and fragment make no difference, so that
http, https and tracking variants are one address. Relative targets are resolved against the page.

Scale: few rules are a chain of conditions; more than MANY are joined by the url's host suffixes.
Only addresses that take part in an edge are shuffled, and hubs are reduced before the shuffle.

Defined results: a url that is null or has no ``://`` has an empty host and path, which no rule
fits, and verdict allow; null html has no edges; equal urls get equal verdicts; extra columns are
ignored; a null page_id stays null.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from seqrec.llm.common import connected_components, materialise

MANY = 200


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substr(url, F.instr(url, F.lit("://")) + 3))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substr(url, F.instr(url, F.lit("://")) + 3))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (with columns host and path) plus rule (host + path of the longest that fits) and
    rule_verdict; both null where none fits. rules: (verdict, host, path)."""
    order = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    if len(order) <= MANY:
        found = F.lit(None).cast("struct<rule:string,verdict:string>")
        for verdict, host, path in reversed(order):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
        return urls.withColumn("rule__", found).withColumn("rule", F.col("rule__.rule")).withColumn("rule_verdict", F.col("rule__.verdict")).drop("rule__")
    table = urls.sparkSession.createDataFrame([(v, h, p, k) for k, (v, h, p) in enumerate(order)], "v string, rule_host string, rule_path string, k long")
    keys = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = keys.select("host", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where("startswith(path, rule_path)")
    best = hits.groupBy("host", "path").agg(F.min(F.struct("k", F.concat("rule_host", "rule_path").alias("rule"), "v")).alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict"))
    return urls.join(best, ["host", "path"], "left")


def link_edges(pages: DataFrame) -> DataFrame:
    """(host, path, to_host, to_path) of canonical links and meta refreshes in pages' html."""
    html = F.coalesce("html", F.lit(""))
    canonical = F.regexp_extract(F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    seen = F.lower(html)
    has = seen.contains("canonical") | seen.contains("refresh")
    found = pages.where(has & (F.col("host") != "")).select("host", "path", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    to = F.replace("to", F.lit("&amp;"), F.lit("&"))
    full = (
        F.when(F.instr(to, F.lit("://")) > 0, to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(F.lit("http://"), F.col("host"), to))
        .otherwise(F.concat(F.lit("http://"), F.col("host"), F.regexp_replace("path", "[^/]*$", ""), F.when(F.col("path") == "", F.lit("/")).otherwise(F.lit("")), to))
    )
    found = found.withColumn("full", full).select("host", "path", host_of(F.col("full")).alias("to_host"), path_of(F.col("full")).alias("to_path"))
    return found.where("to_host <> '' and (to_host <> host or to_path <> path)").distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html)."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = with_rules(base.select("page_id", "host", "path"), rules)
    edges = materialise(link_edges(base), "url-edges")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    node = lambda h, p: F.concat(h, F.when(F.startswith(p, F.lit("/")), F.lit("")).otherwise(F.lit("/")), p)
    parts = materialise(connected_components(edges.select(node("host", "path").alias("a"), node("to_host", "to_path").alias("b"))), "url-parts")
    at = F.instr("node", F.lit("/"))
    named = with_rules(parts.select("node", "component", F.substr("node", F.lit(1), at - 1).alias("host"), F.substr("node", at).alias("path")), rules)
    fate = named.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    blocked = materialise(parts.join(fate.where("blocked and not coalesce(allowed, false)"), "component").select(F.col("node").alias("node")), "url-blocked")
    judged = judged.withColumn("node", node("host", "path")).join(blocked.withColumn("aliased", F.lit(True)), "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("aliased"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
