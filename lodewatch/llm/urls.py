"""URL filters: fixed host and path rules first, then association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that go with the label to block. Tokens that
always occur together are one item, so a long URL that repeats adds one item and not all subsets
of its tokens. An item that is a rule by itself, or stands in every labelled URL, can be in no other
shortest rule and is not mined; nor is an item under the least support. What FP-growth then finds
in the blocked URLs is counted in all labelled ones; combinations with enough confidence are rules,
and of those only the ones that no shorter rule already implies. An inverted index from each rule's
rarest item finds the few rules that can fit a URL; a rule fits if the URL has all its tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, table

#: (verdict, host, path prefix); the longest that fits wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Least support as a share of the labelled URLs and as a number of blocked ones, and least confidence.
SUPPORT, LEAST, CONFIDENCE = 0.002, 5, 0.6
#: Labelled URLs that mining looks at, at most (an expected number, chosen by a hash).
SAMPLE = 200_000
#: A scheme, the authority up to a slash, question mark or number sign, the path up to the last two.
HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    ascii_lower = F.translate(F.regexp_extract(url, f"(?s){HOST}", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(url.contains("://"), ascii_lower).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, f"(?s){PATH}", 1)).otherwise("")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Host labels with their suffixes, path segments without digits, and query keys, each once."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    segments = F.filter(F.split(path, r"[/._-]"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$"))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)="), F.lit(1))
    named = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(F.concat(named("host", labels), named("word", words), named("path", segments), named("key", keys)))


def parts(pages: DataFrame) -> DataFrame:
    """Adds host, path, rule and rule_verdict; a null url or one without `://` has empty parts."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    best: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, prefix in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(prefix)
        best = F.when(fits, F.struct(F.lit(host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return rows.withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "rule_verdict": F.col("__best.verdict")}).drop("__best")


def items_of(labelled: DataFrame) -> DataFrame:
    """(token, item, n, n_blocked) from (row, tokens, blocked): item is the least token with the same rows."""
    each = labelled.select("row", "blocked", F.explode("tokens").alias("token"))
    # equal digests of the rows mean equal sets of rows
    digest = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"digest{k}") for k in range(2)]
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"), *digest)
    group = ["n", "n_blocked", "digest0", "digest1"]
    return settle(seen.join(seen.groupBy(*group).agg(F.min("token").alias("item")), group).select("token", "item", "n", "n_blocked"))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule_id, antecedent, pivot): the shortest rules that lead to blocking, from (tokens, blocked).

    A rule's tokens occur together in at least `least` blocked URLs and a share `support` of all
    labelled ones, and a share `confidence` of the URLs with these tokens is blocked.
    """
    labelled = settle(labelled.select("tokens", "blocked").withColumn("row", F.monotonically_increasing_id()))
    total, blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    enough = max(least, math.ceil(support * total))
    items = items_of(labelled)
    sure = F.col("n_blocked") >= confidence * F.col("n")
    frequent = items.where((F.col("n_blocked") >= enough) & (F.col("n") < total))
    alone = frequent.where(sure & (F.col("token") == F.col("item"))).select(F.array("item").alias("items"))
    open_ = frequent.where(~sure).select("token", "item", "n")
    baskets = labelled.select("row", "blocked", F.explode("tokens").alias("token")).join(open_.where("token = item"), "token")
    baskets = settle(baskets.groupBy("row", "blocked").agg(F.collect_set("item").alias("items")))
    rules = alone
    if not baskets.where("blocked").isEmpty():
        n = baskets.where("blocked").count()
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, (enough - 0.5) / n)).fit(baskets.where("blocked").select("items")).freqItemsets.where("size(items) > 1")
        found = settle(found.select("items", F.col("freq").alias("n_blocked")).withColumn("set_id", F.monotonically_increasing_id()))
        # An itemset is counted where its rarest item stands.
        rarest = found.select("set_id", F.explode("items").alias("item")).join(open_.where("token = item").select("item", "n"), "item").groupBy("set_id").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
        indexed = found.join(rarest, "set_id").select("set_id", "item", F.col("items").alias("wanted"))
        met = baskets.select("items", F.explode("items").alias("item")).join(indexed, "item").where(F.size(F.array_except("wanted", "items")) == 0)
        counts = met.groupBy("set_id").agg(F.count("*").alias("n"))
        rules = rules.union(found.join(counts, "set_id").where(sure).select("items"))
    rules = settle(rules.select("items").withColumn("rule_id", F.monotonically_increasing_id()))
    # A rule goes if another's items are among its own; the pairs meet by the other's rarest item.
    sizes = items.where("token = item").select("item", "n")
    of_rule = rules.select("rule_id", F.explode("items").alias("item"))
    pivots = of_rule.join(sizes, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("pivot"))
    shorter = rules.join(pivots, "rule_id").select(F.col("items").alias("less"), F.col("pivot").alias("item"))
    longer = of_rule.join(rules.where("size(items) > 1"), "rule_id").join(shorter, "item")
    implied = longer.where((F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0)).select("rule_id").distinct()
    # Back from items to all the tokens they stand for.
    antecedents = of_rule.join(implied, "rule_id", "left_anti").join(items.select("item", "token"), "item").groupBy("rule_id").agg(F.sort_array(F.collect_set("token")).alias("antecedent"))
    return settle(antecedents.join(pivots, "rule_id").select("rule_id", "antecedent", "pivot"))


def judged(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Rules are mined from about `sample` labelled pages at most, chosen by a hash of page_id.

    A page is labelled by the row of `labels` with its id: low quality or toxic means block.
    Where no fixed rule fits, the verdict is block if a mined rule fits and allow otherwise;
    without labels nothing is mined. Repeated rows are judged each.
    """
    rows = parts(pages.select(F.col("page_id"), "url")).withColumn("tokens", tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")).where("blocked is not null")
    labelled = rows.select("page_id", "tokens").join(bad, "page_id").select("page_id", "tokens", "blocked")
    share = F.pmod(F.xxhash64("page_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    labelled = settle(labelled)
    n = labelled.count()
    verdict = F.col("rule_verdict")
    if n:
        rules = mined(labelled.where(share * n < sample), support, confidence, least)
        # Each URL's distinct token set meets the rules by pivot token; equal sets are judged once.
        sets = rows.where("rule is null").select(F.array_sort("tokens").alias("set")).distinct()
        met = sets.select("set", F.explode("set").alias("pivot")).join(rules, "pivot")
        hit = met.where(F.size(F.array_except("antecedent", "set")) == 0).select("set").distinct().withColumn("__hit", F.lit(True))
        rows = rows.withColumn("set", F.array_sort("tokens")).join(hit, "set", "left")
        verdict = F.coalesce(verdict, F.when(F.col("__hit"), "block"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
