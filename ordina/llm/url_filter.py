"""URL filter: host and path rules, then trust and distrust propagated over the host graph.

Rules seed the hosts they judge: one for the whole host (path '/') makes it a
trusted or a blocked seed, others seed it with the shares of its pages that they
allow and block; pages without a rule count for trust by ``benefit``.  Personalised
PageRank carries trust along links, and distrust against them (who links to a
blocked host is suspect); between a domain and its subdomains both go both ways.
A url that no rule fits is judged by its host: blocked if more distrust than trust
arrives there.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import discard, materialise, named

#: (verdict, host, path) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In an html text: the host of an absolute or protocol-relative reference. What a page's base names counts as one, as relative references go there.
LINK = r"(?i)<(?:a|area|base|link|i?frame)\s[^<>]*?(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s<>]+)"
#: Hosts that can have domains above them: dotted names of which the last part is a word, as long as names may be.
NAMED = r"^(?=.{1,253}$)[^.:@\[\]]+(?:\.[^.:@\[\]]+)*\.[a-z][a-z0-9\-]*$"
#: A step's share, the share of all mass that scores may lack, and what a page without a rule counts for trust.
DAMPING, RESIDUAL, BENEFIT = 0.5, 1e-4, 0.2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first '://' up to '/', '?', '#' or end, A-Z lower-cased; path up to '?', '#' or end; both '' without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Distinct links (src, dst) between different hosts."""
    found = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), 1))).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").distinct()


def domain_links(hosts: DataFrame) -> DataFrame:
    """Distinct links (src, dst) of each host to the domain above it, and of that to the next, while they have two parts at least."""
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    chains = hosts.where(F.col("host").rlike(NAMED)).select(above.alias("up"))
    steps = F.transform(F.slice("up", 1, F.size("up") - 1), lambda d, i: F.struct(d.alias("src"), F.get("up", i + 1).alias("dst")))
    return chains.select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct()


def rounds_for(damping: float = DAMPING, residual: float = RESIDUAL) -> int:
    """How many steps leave at most that share of the seeds' mass: each passes on ``damping`` of the last, damping / (1 - damping) in all after it."""
    return max(0, math.ceil(math.log(residual * (1 - damping)) / math.log(damping)) - 1)


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """(kind, host, score): personalised PageRank by kind, of walks over links (kind, src, dst) from seeds (kind, host, mass).

    A host's score is what arrives over all walks, a step passing on ``damping`` of
    a mass in equal shares; walks end where no link leaves.  So scores are linear
    in the seeds and those of two kinds can be compared.  Steps are taken until
    what is left can add no more than ``residual`` of all mass.  Each is a join and an aggregation with partial sums, written to the shared
    folder; hosts that no walk meets have no row.
    """
    degrees = links.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    steps = materialise(links.join(degrees, ["kind", "src"]), "steps")
    moved = [materialise(seeds.select("kind", "host", "mass"), "moved")]
    if not steps.isEmpty():
        for _ in range(rounds_for(damping, residual)):
            last = moved[-1].withColumnRenamed("host", "src")
            share = F.sum(F.col("mass") / F.col("degree")) * damping
            moved.append(materialise(last.join(steps, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(share.alias("mass")), "moved"))
    every = reduce(DataFrame.unionAll, moved)
    out = materialise(every.groupBy("kind", "host").agg(F.sum("mass").alias("score")), "scores")
    discard(steps, *moved)
    return out


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, benefit: float = BENEFIT, ratio: float = 1.0) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's trust and distrust.

    A null url, or one without '://', has host and path ''; no rule fits it and it
    is allowed, as is any host that neither trust nor distrust reaches.  Null html
    has no links.  Repeated rows are judged alike; a null id stays null.  Columns
    besides the three named are not read.  A host that owns a third of all pages
    is one row of the graph; its pages meet its scores by a join that Spark can
    split or broadcast.  Host names are taken as they are: without a list of public
    suffixes, hosts below one like co.uk are taken for subdomains of one domain.
    """
    host, path = host_and_path(named(url_col))
    names = ("_id", "_host", "_path", "_html")
    read = pages.select(named(id_col).alias(names[0]), host.alias(names[1]), path.alias(names[2]), named(html_col).alias(names[3]))
    text, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    judged = read.select("_id", "_host", "_path", text.alias("_rule"), verdict.alias("_ruled"))
    shares = judged.where("_host <> ''").groupBy(F.col("_host").alias("host")).agg(*((F.count_if(F.col("_ruled") == v) / F.count(F.lit(1))).alias(v) for v in ("allow", "block")))
    whole = rule_of(F.col("host"), F.lit("/"), rules)[1]
    trust = F.when(whole == "allow", 1.0).when(whole == "block", 0.0).otherwise(F.col("allow") + benefit * (1 - F.col("allow") - F.col("block")))
    distrust = F.when(whole == "allow", 0.0).when(whole == "block", 1.0).otherwise(F.col("block"))
    hosts = materialise(shares.select("host", trust.alias("trust"), distrust.alias("distrust")), "hosts")
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass")).where("mass > 0")

    links = materialise(host_links(read, "_host", "_html"), "hostlinks")
    ends = links.select(F.col("dst").alias("host")).unionAll(hosts.select("host")).distinct()
    up = materialise(domain_links(ends), "domains")
    pair = lambda kind, a, b: [F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst")]
    steps = links.select(*pair("trust", "src", "dst")).unionAll(links.select(*pair("distrust", "dst", "src")))
    for kind in ("trust", "distrust"):
        steps = steps.unionAll(up.select(*pair(kind, "src", "dst"))).unionAll(up.select(*pair(kind, "dst", "src")))
    found = propagate(steps.distinct(), seeds)
    scores = found.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    out = judged.join(scores, judged["_host"] == scores["host"], "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    # Sums differ in their last digits with the order of their terms, which mustn't decide.
    by_host = F.when(F.col("distrust") > ratio * F.col("trust") * (1 + 1e-9), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_ruled", by_host).alias("verdict"), "trust", "distrust")
