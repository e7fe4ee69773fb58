"""URL filters: listed rules first; for other pages, association rules over URL tokens that FP-growth mines from
the pages the list decides."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SMALL_LIST
from .common import materialised

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.8
CLASS = "verdict="
Rules = list[tuple[str, str, str]]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule `(verdict, host, path)` that fits, as text, and its verdict; null where none fits. A rule
    fits its host and all subdomains, for paths that start with the rule's. Of equally long ones the first in
    order of text is taken."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), *(-ord(c) for c in r[1] + r[2]))):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        text, verdict = F.when(fits, at + below).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The different labels of the host, segments of the path, and parameters, each marked with its place."""
    def marked(mark: str, text: Column, between: str) -> Column:
        return F.transform(F.filter(F.split(text, between), lambda t: t != ""), lambda t: F.concat(F.lit(mark), t))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    return F.array_distinct(F.concat(marked("h:", host, r"\."), marked("p:", path, "/"), marked("q:", query, "&")))


def token_classes(pages: DataFrame, least: int) -> DataFrame:
    """`token, class` of the tokens that at least `least` rows of `pages(_row, tokens)` have: tokens of exactly the same
    rows are one class, named by the smallest. Rows are known by two hashes and their number."""
    uses = pages.select("_row", F.explode(F.array_distinct("tokens")).alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "_row")).alias(f"_x{i}") for i in range(2)]
    seen = uses.groupBy("token").agg(F.count("*").alias("_n"), *marks).where(F.col("_n") >= least)
    together = ["_n", "_x0", "_x1"]
    named = seen.groupBy(*together).agg(F.min("token").alias("class"))
    return seen.join(named, together).select("token", "class", F.col("_n").alias("n"))


def classes_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """`rows(_row, tokens, ...)` with `_held`, a map from each class that a row has a token of to the smallest such
    token; null where there is none."""
    n = classes.count()
    uses = rows.select("_row", F.explode("tokens").alias("token"))
    held = uses.join(F.broadcast(classes) if n <= SMALL_LIST else classes, "token").groupBy("_row", "class").agg(F.min("token").alias("token"))
    held = held.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("class", "token"))).alias("_held"))
    return rows.join(held, "_row", "left")


def mined_rules(pages: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Rules `tokens, verdict, strength` over token classes from `pages(tokens, verdict)`, and the classes; the
    smallest `strength` is the strongest.

    Tokens that stand in exactly the same pages are mined as one: a rule of several of them says no more than
    that of any one. So segments that a source's URLs share cost one item, not a power of two of itemsets.
    Tokens that every page has are left out: they tell nothing. A rule is pruned where a rule of one class
    less is stronger: every page that has its tokens meets that one. The number of rules is not bounded."""
    pages = materialised(pages.withColumn("_row", F.monotonically_increasing_id()), "listed-pages")
    n = pages.count()
    classes = materialised(token_classes(pages, max(1, math.ceil(min_support * n))).where(F.col("n") < n).drop("n"), "token-classes")
    label = F.array(F.concat(F.lit(CLASS), "verdict"))
    items = F.concat(F.coalesce(F.map_keys("_held"), F.array().cast("array<string>")), label)
    baskets = classes_of(pages, classes).select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith(CLASS))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(CLASS) + 1, 100).alias("verdict"), "confidence", "support")
    strength = F.struct((-F.col("confidence")).alias("confidence"), (-F.col("support")).alias("support"), F.size("tokens").alias("size"))
    rules = materialised(found.select("tokens", "verdict", strength.alias("strength")), "mined-rules")
    smaller = rules.select("tokens", "verdict", "strength", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("_fewer"))
    stronger = rules.select(F.col("tokens").alias("_fewer"), F.col("strength").alias("_stronger"))
    pruned = smaller.join(stronger, "_fewer").where("_stronger < strength").select("tokens", "verdict").distinct()
    return rules.join(pruned, ["tokens", "verdict"], "left_anti"), classes


def best_rule(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """`pages(tokens, ...)` with `_mined`, the verdict of the strongest rule whose classes a page has a token of each,
    or null. Of equally strong ones the rule whose tokens on the page come first in order is taken.

    The rules are an inverted index: each stands under its rarest class in the rules, so that a page meets a
    rule once, and is then compared class by class. An index of up to `SMALL_LIST` rules is sent to every
    task, a longer one is joined by a shuffle on the class."""
    uses = rules.select(F.explode("tokens").alias("token"), "tokens", "verdict", "strength")
    counts = uses.groupBy("token").agg(F.count("*").alias("n"))
    rarest = uses.join(counts, "token").groupBy("tokens", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("_class"), F.first("strength").alias("_strength"))
    index = materialised(rarest.select("_class", F.col("tokens").alias("_classes"), "_strength", F.col("verdict").alias("_verdict")), "rule-index")
    n_rules = index.count()
    if not n_rules:
        return pages.withColumn("_mined", F.lit(None).cast("string"))
    rows = classes_of(pages.withColumn("_row", F.monotonically_increasing_id()), classes)
    rows = rows.withColumn("_class", F.explode_outer(F.map_keys("_held")))
    met = rows.join(F.broadcast(index) if n_rules <= SMALL_LIST else index, "_class", "left")
    shown = F.array_sort(F.transform("_classes", lambda c: F.element_at("_held", c)))
    all_there = F.forall("_classes", lambda c: F.map_contains_key("_held", c))
    fits = F.when(all_there, F.struct("_strength", shown.alias("_shown"), "_verdict"))
    kept = [F.first(c).alias(c) for c in pages.columns]
    return met.groupBy("_row").agg(*kept, F.min(fits)["_verdict"].alias("_mined")).drop("_row")


def listed_pages(pages: DataFrame, rules: Rules) -> DataFrame:
    """`page_id, url, host, path, rule, listed` of every row of `pages(page_id, url, ...)`: what the list says, without
    any learning; the last two are null where no rule fits."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    return rows.select("*", rule.alias("rule"), verdict.alias("listed"))


def judged_pages(pages: DataFrame, rules: Rules, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """`page_id, host, path, rule, verdict` for every row of `pages(page_id, url, ...)`.

    `verdict` is the listed rule's, else that of the strongest mined rule, else `allow`. Null URLs and those
    without `://` have an empty host and path and are allowed; null and repeated ids keep a row each; an
    empty table gives an empty result; other columns are ignored. A very long URL has many tokens, of which
    only those that enough listed pages share are worked on.
    """
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    rows = materialised(listed_pages(pages, rules).select("page_id", "host", "path", "rule", "listed", tokens), "judged-pages")
    listed = rows.where("listed IS NOT NULL").select("tokens", F.col("listed").alias("verdict"))
    judged = rows.withColumn("_mined", F.lit(None).cast("string")) if listed.isEmpty() else best_rule(rows, *mined_rules(listed, min_support, min_confidence))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", "_mined", F.lit("allow")).alias("verdict"))
