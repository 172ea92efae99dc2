"""URL filters: host and path rules, then trust and distrust along the link graph, in Spark expressions and joins only.

A rule (host, path, verdict) fits the urls of its host and of all its subdomains whose path begins with
the rule's path; of several the longest (host and path together) wins, of equally long ones the later in
code point order, of one text with two verdicts ``block``. Rules are joined to the distinct hosts by the
hosts' suffixes, so a page meets the rules of its own host only.

Pages without a rule are judged by their host. Seeds are the hosts of pages that rules decide: a host is
trusted by the share of its pages that rules allow and distrusted by the share that rules block. Edges lead
from a page's host to the other hosts that its ``a`` and ``area`` elements name (``//host`` or
``scheme://host``), each pair once. Trust walks along the edges, in equal parts to all hosts that a host
links to; distrust walks backwards, in equal parts to all hosts that link to one. Each step keeps DAMPING
hundredths, and the seeds keep what a personalised PageRank gives them. Masses are whole numbers (MASS is
one host's whole seed), so their sums do not depend on any order, and the walk ends by itself when no
mass is left, or after ROUNDS steps (what is then still under way is below a fifteenth of the seeds).
A host is blocked if more than THRESHOLD hundredths of its trust and distrust are distrust; a host
that no seed reaches is allowed.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to
``?``, ``#`` or the end. A null url, or one without ``://``, has both empty, meets no rule and no edge. Null and
empty html have no links; a long page is read whole. Repeated rows are judged one by one and all
count in the shares of their host; a null page_id is kept. Extra columns are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stage, sized_broadcast

#: The rules of the query, (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ROUNDS, DAMPING, MASS, THRESHOLD = 16, 85, 10_000_000, 50
#: The host that a link element names; the same in Java's and other engines' expressions.
LINK = r"""<[aA](?:[rR][eE][aA])?[\x20\x09-\x0D][^>]*?[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\x00-\x20]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(name: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: array<struct<size, rule, verdict, path>> of those hosts that have rules at all."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("on"), "path", "verdict")
    text = F.concat("on", "path")
    rules = rules.select("on", F.struct(F.char_length(text).alias("size"), text.alias("rule"), "verdict", "path").alias("r")).distinct()
    return hosts.select("host", F.explode(suffixes(F.col("host"))).alias("on")).join(sized_broadcast(rules), "on").groupBy("host").agg(F.collect_list("r").alias("rules"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls (host, path) with the rule that fits best, or nulls."""
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return urls.join(sized_broadcast(rules), "host", "left").withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: the distinct pairs of different hosts that pages (url, html) link."""
    links = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    found = pages.select(host(F.col("url")).alias("src"), F.explode(links).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst").distinct()


def propagate(stage: Stage, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust after the walk. seeds: (host, trust, distrust) masses; edges: (src, dst)."""
    # both walks in one: trust from src to dst, distrust from dst to src, with the parts that a host deals out
    both = edges.select(F.lit(True).alias("good"), F.col("src").alias("from"), F.col("dst").alias("to"))
    both = both.unionByName(edges.select(F.lit(False).alias("good"), F.col("dst").alias("from"), F.col("src").alias("to")))
    both = stage.write(both, "both")
    parts = stage.write(both.groupBy("good", "from").agg(F.count("*").alias("parts")), "parts")
    moving = seeds.select("host", F.explode(F.array(F.struct(F.lit(True).alias("good"), F.col("trust").alias("mass")), F.struct(F.lit(False).alias("good"), F.col("distrust").alias("mass")))).alias("m"))
    moving = stage.write(moving.select("host", "m.good", "m.mass").where("mass > 0"), "moving0")
    reached = [moving]
    for turn in range(1, ROUNDS + 1):
        dealt = moving.join(parts.withColumnRenamed("from", "host"), ["good", "host"])
        share = F.call_function("div", F.col("mass") * DAMPING, F.col("parts") * 100)
        dealt = dealt.select("good", F.col("host").alias("from"), share.alias("mass")).where("mass > 0")
        moving = dealt.join(both, ["good", "from"]).groupBy(F.col("to").alias("host"), "good").agg(F.sum("mass").alias("mass"))
        moving = stage.write(moving, f"moving{turn}")
        if moving.isEmpty():
            break
        reached.append(moving)
    whole = reached[0]
    for step in reached[1:]:
        whole = whole.unionByName(step)
    kept = F.call_function("div", F.col("mass") * (100 - DAMPING), F.lit(100))
    of = lambda good: F.sum(F.when(F.col("good") == good, kept).otherwise(0))
    return whole.groupBy("host").agg(of(True).alias("trust"), of(False).alias("distrust"))


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (the host's masses, 0 where no seed reaches it)."""
    stage = Stage(spark, "urls")
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = stage.write(host_rules(urls.select("host").distinct(), rules), "rules")
    judged = stage.write(ruled(urls, known), "ruled")
    share = lambda verdict: F.call_function("div", F.count_if(F.col("ruled") == verdict) * MASS, F.count("*"))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    masses = stage.write(propagate(stage, seeds, stage.write(host_edges(pages), "edges")), "masses")
    mass = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = judged.join(sized_broadcast(masses), "host", "left").select("page_id", "host", "path", "rule", "ruled", mass("trust"), mass("distrust"))
    own = F.when(F.col("distrust") * 100 > (F.col("trust") + F.col("distrust")) * THRESHOLD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
