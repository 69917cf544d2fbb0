"""URL filter by rules and, where no rule fits, by the path templates of each host.

Native: DataFrame functions only.  Rules (host, path, verdict) fit their host and its
subdomains if the path starts with the rule's; the longest wins.  The pages that rules
judge are the labels of the tree.

The template tree of a host grows level by level over path segments.  Digits in a
segment become #; where a node has more than ``MAX_CHILDREN`` children, those with less
than ``MIN_SHARE`` of its pages are variable and become one wildcard *.  Branches whose
labelled share of blocked pages does not differ from that of their labelled siblings
(|z| below ``MERGE_Z``) are merged into one branch ~.  Segments that are a * or ~ of their
own get a backslash.  The levels end at ``DEPTH``: what
remains of a path is one last segment.

A template's purity is its share of blocked labels, smoothed by the host's share with
the weight of ``PRIOR`` labels, which is smoothed by the share over all hosts in the same
way.  A template of purity ``REJECT`` or more is rejected: its pages are blocked.

The tree is built over distinct host and path shapes with their counts, so a host that
holds a third of all pages is a few rows; pages meet their verdict in one join on host
and shape, where Spark may split a large key.

Defined cases: a null URL or one without :// has an empty host and path and is judged by
the template of that host; without labels the share over all hosts is one half, and a
half is allowed; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing

DEPTH, MAX_CHILDREN, MIN_SHARE, MERGE_Z, PRIOR, REJECT = 4, 8, 0.05, 2.0, 4.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for where, start, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(where + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path with digits generalised, as one string."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9]+", "#"), "/+", "/")


def templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, template) from (host, shape, n, allow, block), one row per host and shape."""
    segments = F.split(F.trim(F.col("shape"), F.lit("/")), "/", depth)
    tree = packing.written(shapes.withColumn("segments", segments).withColumn("node", F.lit("")), "shapes")
    for level in range(depth):
        here = tree.withColumn("segment", F.get("segments", F.lit(level)))
        children = here.where("segment IS NOT NULL").groupBy("host", "node", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
        nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        labels, others = F.col("allow") + F.col("block"), F.col("all_allow") + F.col("all_block") - F.col("allow") - F.col("block")
        pooled = (F.col("all_block") + 0.5) / (F.col("all_allow") + F.col("all_block") + 1)
        z = F.abs(F.col("block") / labels - (F.col("all_block") - F.col("block")) / others) / F.sqrt(pooled * (1 - pooled) * (1 / labels + 1 / others))
        # a segment that reads like a wildcard or a merged branch is none
        literal = F.regexp_replace("segment", r"^(\\*[*~])$", r"\\$1")
        name = (
            F.when((F.col("children") > MAX_CHILDREN) & (F.col("n") < MIN_SHARE * F.col("all_n")), "*")
            .when((labels > 0) & (others > 0), F.when(z < MERGE_Z, "~").otherwise(literal))
            .otherwise(literal)
        )
        names = children.join(nodes, ["host", "node"]).select(F.col("host").alias("_h"), F.col("node").alias("_n"), F.col("segment").alias("_s"), name.alias("name"))
        joined = here.join(names, (here["host"] == names["_h"]) & (here["node"] == names["_n"]) & (here["segment"] == names["_s"]), "left")
        tree = packing.written(joined.withColumn("node", F.when(F.col("name").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.col("name")))).drop("_h", "_n", "_s", "name", "segment"), "shapes")
    return tree.select("host", "shape", F.col("node").alias("template"), "n", "allow", "block")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", depth: int = DEPTH) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    seen = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("by_rule", by_rule).withColumn("shape", shape_of(F.col("path")))
    shapes = seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allow"), F.count_if(F.col("by_rule") == "block").alias("block"))
    tree = packing.written(templates(shapes, depth), "templates")
    whole = tree.agg(((F.coalesce(F.sum("block"), F.lit(0)) + PRIOR / 2) / (F.coalesce(F.sum("allow") + F.sum("block"), F.lit(0)) + PRIOR)).alias("base")).first()["base"]
    hosts = tree.groupBy("host").agg(((F.sum("block") + PRIOR * whole) / (F.sum("allow") + F.sum("block") + PRIOR)).alias("host_purity"))
    pure = tree.groupBy("host", "template").agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).join(hosts, "host")
    pure = pure.select("host", "template", ((F.col("b") + PRIOR * F.col("host_purity")) / (F.col("a") + F.col("b") + PRIOR)).alias("purity"))
    verdicts = tree.select("host", "shape", "template").join(pure, ["host", "template"])
    method = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return seen.join(verdicts, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "purity")


def allowed(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Ids of the pages that pass."""
    return judged(pages, rules, page_id, url).where("verdict = 'allow'").select(F.col("page_id").alias(page_id))
