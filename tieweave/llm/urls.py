"""URL filters by a tree of path templates for each host, in DataFrame functions alone.

Rules given by hand (host and path prefix, block or allow) decide what they fit, and
their decisions are the labels from which the method judges all other URLs:

1. Per host the paths form a tree of segments, whole paths of any length. Level by level,
   a segment becomes the wildcard ``*`` if its node has VARIABLE_KINDS different segments or
   more and it holds at most one in VARIABLE_SHARE of the node's URLs, or if it has a digit
   and is not the node's only one. Where all that goes on below a node is one path, that
   path is one segment, as no rule could change it; so there are as many levels as paths
   have in common, whatever their length.
2. From the lowest level up, branches that are statistically similar are merged into one,
   ``{}``: the total variation distance between what lies below a branch and what lies
   below all its node's branches together is at most MERGE_DISTANCE + 1 / sqrt(its URLs).
   A branch under which fewer than half the URLs go on is not compared.
3. A template of a host is rejected if its smoothed labelled purity is over one half:
   bad / (bad + good + unlabelled / UNLABELLED + PRIOR). Unlabelled URLs are weak evidence
   of a good template, so a few bad ones among many don't condemn it.

URLs are reduced to (host, path) counts first, and to (node, segment) counts for each level,
so the shuffles of a hot host carry one row for each different segment and task; what is
known of a hot node is broadcast (HOT_GROUPS nodes at most), so its segments and paths
don't meet in one task. The counts are checkpointed after each level. Nothing but "does any path go on" is collected.

Defined results: a URL that is null or has no ``://`` has empty host and path, fits no
rule, and is judged with its like by the same method; a very long URL is read whole;
repeated rows and null ids are URLs like any other; an empty table gives no rows; other
columns are not read, and an id column that has the name of a result comes back with
``_id`` after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_name
from .exact import HOT_GROUPS, LOWER, UPPER

VARIABLE_KINDS = 8
VARIABLE_SHARE = 10
MERGE_DISTANCE = 0.1
UNLABELLED = 4
PRIOR = 2


@dataclass(frozen=True)
class Rule:
    """``text``, a host and a path prefix such as ``example.net/en/``; fits subdomains too."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or without ``://``."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def first_fit(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        found = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(found)
    return found


def _after(column: str, k: int) -> Column:
    """The elements of an array from place ``k`` on, counted from 1."""
    return F.slice(column, k, F.greatest(F.size(column) - (k - 1), F.lit(0)))


def _to_nodes(rows: DataFrame, nodes: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined to their nodes; nodes with more than one in HOT_GROUPS of ``total`` rows, HOT_GROUPS at most, by broadcast.

    size: the column of ``nodes`` with the number of their rows.
    """
    hot = F.col(size) > total // HOT_GROUPS
    large, small = F.broadcast(nodes.where(hot)), nodes.where(~hot)
    return rows.join(large, on).unionByName(rows.join(large.select(*on), on, "left_anti").join(small, on))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` with the templates ``t`` of their segments, an array, instead of ``rest``.

    ``urls`` has host, rest (the segments) and n, the number of URLs, and other columns. A
    node of the tree is a host with the templates down to it, so joins have two keys or three.
    """
    depth, urls = 0, checkpointed(urls.withColumn("t", F.array().cast("array<string>")))
    total = urls.count()
    while not urls.where(F.size("rest") > 0).isEmpty():
        depth += 1
        own = urls.withColumn("s", F.get("rest", F.lit(0))).withColumn("rest", _after("rest", 2))
        kinds = own.where("s is not null").groupBy("host", "t", "s").agg(F.sum("n").alias("own"))
        whole = kinds.groupBy("host", "t").agg(F.count("*").alias("kinds"), F.sum("own").alias("whole"))
        many = (F.col("kinds") >= VARIABLE_KINDS) & (VARIABLE_SHARE * F.col("own") <= F.col("whole"))
        numbered = F.col("s").rlike("[0-9]") & (F.col("kinds") >= 2)
        named = _to_nodes(kinds, whole, ["host", "t"], "kinds", total).select("host", "t", "s", F.when(many | numbered, "*").otherwise(F.col("s")).alias("next"))
        grown = F.when(F.col("next").isNull(), F.col("t")).otherwise(F.concat("t", F.array("next")))
        own = checkpointed(own.join(named, ["host", "t", "s"], "left").withColumn("t", grown).drop("s", "next"))
        path = F.array_join("rest", "/")
        ways = own.where(F.size("t") == depth).groupBy("host", "t").agg(F.min(path).alias("least"), F.max(path).alias("most"))
        # With the path itself as a key, the many different paths of a hot node are dealt out.
        single = ways.where("least = most").select("host", "t", F.col("least").alias("path"), F.lit(True).alias("single"))
        longer = F.size("rest") > 1
        joined = own.where(longer).withColumn("path", path).join(single, ["host", "t", "path"], "left")
        joined = joined.withColumn("rest", F.when(F.col("single"), F.array("path")).otherwise(F.col("rest"))).select(*own.columns)
        urls = checkpointed(own.where(~longer).unionByName(joined))
    for k in range(depth - 1, 0, -1):
        urls = checkpointed(_merge(urls, k, total))
    return urls.drop("rest")


def _merge(urls: DataFrame, k: int, total: int) -> DataFrame:
    """Similar branches at level k get the template ``{}``."""
    own = urls.withColumn("node", F.slice("t", 1, k - 1)).withColumn("branch", F.get("t", F.lit(k - 1)))
    below = F.array_join(_after("t", k + 1), "/").alias("below")
    ways = checkpointed(own.where("branch is not null").groupBy("host", "node", "branch", below).agg(F.sum("n").alias("n")))
    branch = ways.groupBy("host", "node", "branch").agg(F.count("*").alias("ways"), F.sum("n").alias("n_branch"), F.sum(F.when(F.col("below") != "", F.col("n")).otherwise(0)).alias("n_on"))
    pooled = ways.groupBy("host", "node", "below").agg(F.sum("n").alias("n_pooled"))
    whole = branch.groupBy("host", "node").agg(F.sum("ways").alias("size"), F.sum("n_branch").alias("n_node"), F.count("*").alias("branches"))
    joined = ways.join(branch.drop("ways"), ["host", "node", "branch"]).join(pooled, ["host", "node", "below"])
    joined = _to_nodes(joined, whole, ["host", "node"], "size", total)
    more = F.greatest(F.col("n") / F.col("n_branch") - F.col("n_pooled") / F.col("n_node"), F.lit(0.0))
    compared = joined.groupBy("host", "node", "branch").agg(
        F.sum(more).alias("distance"), F.first("n_branch").alias("n_branch"), F.first("n_on").alias("n_on"), F.first("branches").alias("branches")
    )
    alike = F.round("distance", 9) <= F.round(MERGE_DISTANCE + 1 / F.sqrt("n_branch"), 9)
    merged = compared.where(alike & (F.col("branches") > 1) & (2 * F.col("n_on") >= F.col("n_branch"))).select("host", "node", "branch", F.lit(True).alias("merged"))
    out = own.join(merged, ["host", "node", "branch"], "left")
    t = F.when(F.col("merged"), F.concat("node", F.array(F.lit("{}")), _after("t", k + 1))).otherwise(F.col("t"))
    return out.withColumn("t", t).drop("node", "branch", "merged")


def judged(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: id, host, path, rule, verdict, template, n_bad, n_good, n_unlabelled."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_tw_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", first_fit(rules, F.col("host"), F.col("path"), lambda r: r.text))
    rows = rows.withColumn("ruled", first_fit(rules, F.col("host"), F.col("path"), lambda r: r.verdict))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.withColumn("way", F.array_join(segments, "/"))
    counts = rows.groupBy("host", "way").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count_if(F.col("ruled") == "allow").alias("good")
    )
    named = templates(counts.withColumn("rest", F.filter(F.split("way", "/"), lambda x: x != "")))
    named = named.withColumn("template", F.concat_ws("/", F.lit(""), "t"))
    totals = named.groupBy("host", "template").agg(F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good"), F.sum(F.col("n") - F.col("bad") - F.col("good")).alias("n_unlabelled"))
    known = named.select("host", "way", "template").join(totals, ["host", "template"])
    found = rows.join(known, ["host", "way"])
    rejected = UNLABELLED * F.col("n_bad") > UNLABELLED * (F.col("n_good") + PRIOR) + F.col("n_unlabelled")
    verdict = F.coalesce("ruled", F.when(rejected, "block").otherwise("allow"))
    own = id_name(id_col, ["host", "path", "rule", "verdict", "template", "n_bad", "n_good", "n_unlabelled"])
    return found.select(F.col("_tw_id").alias(own), "host", "path", "rule", verdict.alias("verdict"), "template", "n_bad", "n_good", "n_unlabelled")
