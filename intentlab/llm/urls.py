"""URL verdicts by rules and by a path-template tree per host.

Rules (host and path prefix) decide what they fit; the longest wins. Pages
that a rule decides are the labels of the tree. The tree grows level by
level over the segments of distinct (host, path) pairs, counted first, so a host
with a third of all pages is summed before it is shuffled. At each
node (host, template so far):

* variable segments are generalised: a run of digits becomes ``{n}``, a
  long hexadecimal one ``{h}``, other text that is no branch of its own ``*``;
* a segment is a branch of its own when its share of blocked or of allowed
  pages exceeds that of its siblings by ``MIN_Z`` standard errors; below
  ``MIN_PAGES`` pages the exact (hypergeometric) chance of such a share decides, at
  the same level. Statistically similar branches thus merge in the wildcard;
* the tree goes on as long as a node holds pages of different labels; further
  segments cannot be branches and are generalised at once.

A template is rejected when its smoothed purity, (blocked + PRIOR * share of
blocked pages overall) / (pages + PRIOR), reaches ``PURITY``: pages that no
rule blocks count against it, so one blocked branch does not
condemn its siblings.

Defined results: a null url or one without ``://`` has empty host and path,
no rule, and the verdict of that pair; an empty table gives no rows;
repeated rows are judged alike, each in a row of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import materialize

#: (rule, verdict); a rule is a host and a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_PAGES, MIN_Z, PRIOR, PURITY = 20, 3.0, 10.0, 0.5
#: The one-sided normal tail beyond MIN_Z.
MAX_CHANCE = math.erfc(MIN_Z / math.sqrt(2)) / 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, prefix = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """The wildcard that stands for a segment."""
    general = F.regexp_replace(F.regexp_replace(segment, "[0-9a-f]{12,}", "{h}"), "[0-9]+", "{n}")
    return F.when(segment.isNull() | (segment == ""), segment).when(general != segment, general).otherwise(F.lit("*"))


def _exceeds(share: str, pages: Column, all_pages: Column) -> Column:
    """z of a branch's share over its siblings' together (no siblings: 0)."""
    own, rest = F.col(share) / pages, (F.col(f"all_{share}") - F.col(share)) / F.greatest(all_pages - pages, F.lit(1))
    pooled = F.col(f"all_{share}") / all_pages
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / pages + 1 / F.greatest(all_pages - pages, F.lit(1))))
    return F.when(all_pages > pages, (own - rest) / error).otherwise(F.lit(0.0))


def _chance(share: str, pages: Column, all_pages: Column) -> Column:
    """The chance that a branch of fewer than ``MIN_PAGES`` pages has so many of its node's labels or more."""
    got, labels = F.col(share), F.col(f"all_{share}")

    def drawn(k: Column) -> Column:
        # k labelled pages, then the others, each without replacement; times their orders
        one = F.lit(1.0)
        with_label = F.aggregate(F.sequence(F.lit(1), k), one, lambda p, i: p * (labels - i + 1) / (all_pages - i + 1) * (pages - i + 1) / i)
        others = F.when(k < pages, F.aggregate(F.sequence(F.lit(1), (pages - k).cast("int")), one, lambda p, i: p * F.greatest(
            all_pages - labels - i + 1, F.lit(0)) / (all_pages - k - i + 1))).otherwise(one)
        return with_label * others

    most = F.least(pages, labels).cast("int")
    tail = F.aggregate(F.sequence(got.cast("int"), most), F.lit(0.0), lambda p, k: p + drawn(k))
    return F.when((pages < MIN_PAGES) & (got > 0), tail).otherwise(F.lit(1.0))


def _stands_alone(share: str, pages: Column, all_pages: Column) -> Column:
    exact = (all_pages > pages) & (_chance(share, pages, all_pages) <= MAX_CHANCE)
    return F.when(pages < MIN_PAGES, exact).otherwise(_exceeds(share, pages, all_pages) >= MIN_Z)


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, pages, blocked, allowed; one row a pair) with its template."""
    rows = paths.withColumn("segments", F.split("path", "/")).withColumn("template", F.lit(""))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    level = 1
    while level < deepest:
        rows = materialize(rows, "url-level")
        at = F.get("segments", F.lit(level))
        here = rows.where(F.size("segments") > level).withColumn("segment", at)
        branch = here.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("pages", "blocked", "allowed")])
        node = branch.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "blocked", "allowed")])
        pages, all_pages = F.col("pages"), F.col("all_pages")
        mixed = node.where("0 < all_blocked and all_blocked < all_pages or 0 < all_allowed and all_allowed < all_pages")
        if mixed.isEmpty():
            break
        own = (branch.join(mixed, ["host", "template"])
               .where(_stands_alone("blocked", pages, all_pages) | _stands_alone("allowed", pages, all_pages))
               .select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("segment").alias("_s")))
        met = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (at == F.col("_s"))
        rows = rows.join(own, met, "left")
        label = F.coalesce(F.col("_s"), shape(at))
        rows = rows.withColumn("template", F.when(F.size("segments") > level, F.concat("template", F.lit("/"), label))
                               .otherwise(F.col("template"))).drop("_h", "_t", "_s")
        level += 1
    rest = F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), shape(s)))
    return rows.withColumn("template", F.concat("template", F.array_join(rest, ""))).drop("segments")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity; one row per input row."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else None
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("by_rule", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    blocked, allowed = (F.sum(F.when(F.col("by_rule") == v, 1).otherwise(0)) for v in ("block", "allow"))
    counted = rows.groupBy("host", "path").agg(F.count("*").alias("pages"), blocked.alias("blocked"), allowed.alias("allowed"))
    tree = materialize(templates(counted), "url-tree")
    total = tree.agg(F.sum("blocked"), F.sum("pages")).first()  # one row
    share = (total[0] or 0) / max(total[1] or 0, 1)
    pure = tree.groupBy("host", "template").agg(F.sum("pages").alias("n"), F.sum("blocked").alias("b"))
    pure = pure.select("host", "template", ((F.col("b") + PRIOR * share) / (F.col("n") + PRIOR)).alias("purity"))
    found = tree.select("host", "path", "template").join(pure, ["host", "template"])
    out = rows.join(found, ["host", "path"])
    method = F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "purity")
