"""URL filter by association rules, in DataFrame and SQL functions only.

Listed rules decide first.  For all other pages, Spark's FP-growth mines combinations of URL tokens that go with a bad
label; rules pruned by support, confidence and by shorter rules that say as much form an inverted index from their
tokens, and a page is blocked where all tokens of a rule are found.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import materialize

LOT = 4096  # equal baskets unfolded from one row

# The listed rules, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels, their parts, path segments that aren't numbers, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")
    steps = F.filter(F.split(_lower(path), r"[/._-]+"), lambda x: ~x.rlike(r"^[0-9]*$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(tag("host:", labels), tag("part:", parts), tag("path:", steps), tag("key:", keys)))


def mined(pages: DataFrame, min_support: float, min_confidence: float, z: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, confidence) of token combinations with a bad label, from rows (tokens, bad), and the tokens (token, item) of items.

    Spark's FP-growth mines the baskets of bad rows; good rows are counted for the combinations found.  Support counts bad rows as a share of
    all.  Baskets are whole: tokens with fewer bad rows than the support asks for go first, and tokens found on exactly the same
    rows are one item, whichever of them a page has; neither changes a rule.  With ``z`` above 0 a rule must also beat chance:
    the lower end of its confidence's Wilson interval, ``z`` deviations wide, lies above the share of bad rows among all.  FP-growth gives every
    combination with enough support, so the support bounds the work.
    """
    seen = materialize(pages.groupBy(F.array_sort("tokens").alias("set")).agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")), "url-sets")
    total = seen.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    least = max(1, math.ceil(min_support * (total.good + total.bad)))
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]

    at = [F.bit_xor(F.xxhash64("set", F.lit(i))).alias(f"at{i}") for i in (1, 2)]
    often = seen.select("set", "good", "bad", F.explode("set").alias("token")).groupBy("token").agg(*sums, *at).where(F.col("bad") >= least)
    often = materialize(often, "url-tokens")
    same = ["good", "bad", "at1", "at2"]
    items = often.join(often.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item")

    rows = seen.select("set", "good", "bad", F.explode("set").alias("token")).join(items, "token")
    rows = rows.groupBy("set", "good", "bad").agg(F.array_sort(F.collect_set("item")).alias("basket"))
    rows = materialize(rows.groupBy("basket").agg(*sums), "url-baskets")

    # one basket per bad row, in lots so that no row grows with the table; FP-growth merges equal ones before it shuffles
    lots = rows.where("bad > 0").select("basket", F.col("bad"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bad") - 1) / LOT))).alias("lot"))
    lots = lots.select("basket", F.least(F.lit(LOT), F.col("bad") - F.col("lot") * LOT).cast("int").alias("n"), "lot").repartition("basket", "lot")
    baskets = lots.select(F.explode(F.array_repeat("basket", F.col("n"))).alias("items"))
    in_baskets = rows.agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]
    if in_baskets < least:
        found = rows.where("false").select(F.col("basket").alias("items"), "bad")
    else:
        # half a row below, so that its ceiling is the count itself
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / in_baskets, minConfidence=1.0).fit(baskets)
        found = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("bad"))
    found = materialize(found, "url-found")

    # good rows by an index on the item with the fewest of them
    goods = often.join(items, "token").groupBy("item").agg(F.max("good").alias("good"))
    rarest = found.select("items", F.explode("items").alias("item")).join(goods, "item").groupBy("items").agg(F.min(F.struct("good", "item")).alias("least"))
    rarest = rarest.select(F.col("items"), F.col("least.item").alias("item"))
    holds = rows.where("good > 0").select("basket", "good", F.explode("basket").alias("item")).join(rarest, "item").where(F.size(F.array_except("items", "basket")) == 0)
    rules = found.join(holds.groupBy("items").agg(F.sum("good").alias("good")), "items", "left").fillna(0, ["good"])

    n, p = F.col("good") + F.col("bad"), F.col("bad") / (F.col("good") + F.col("bad"))
    rules = rules.withColumns({"confidence": p, "lower": (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)})
    rules = rules.where(F.col("confidence") >= min_confidence)
    if z > 0:
        rules = rules.where(F.col("lower") > total.bad / max(1, total.good + total.bad))
    rules = rules.select("items", "confidence")
    # a longer rule goes if a part of it is a rule that is as sure: subsets of its items, looked up by equality
    drop = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.filter("items", lambda x, j: i != j))
    less = rules.where(F.size("items") > 1).select("items", "confidence", F.explode(drop).alias("part"))
    short = rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    worse = less.join(short, "part").where("sure >= confidence").select("items").distinct()
    return rules.join(worse, "items", "left_anti").withColumn("rule_id", F.xxhash64("items")), items


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.6,
    z: float = 0.0,
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict, mined.

    ``labels`` holds doc_id, quality, toxic: a page is labelled by the row of its id, and bad if toxic or of low quality (several
    rows: if any says so).  A listed rule fits its host and all subdomains if the path starts with its own; of those that fit the longest
    decides, and rule names it.  Otherwise a page with all tokens of a mined rule is blocked (mined is its
    highest confidence), and any other is allowed.  A null url, or one without ``://``, has empty host and path and is allowed.
    Without labels nothing is mined; with ``z`` (see ``mined``) above 0, nothing from labels that don't depend on the url either.  Pages are judged row by row, so repeated and null page_ids stay; other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    fits = [
        F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    empty = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    rows = rows.withColumn("fit", F.greatest(*fits, empty) if fits else empty)
    rows = rows.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))

    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    model, items = mined(rows.select("page_id", "tokens").join(known, "page_id"), min_support, min_confidence, z)

    index = model.select("rule_id", F.col("confidence").alias("sure"), F.size("items").alias("size"), F.explode("items").alias("item")).join(items, "item")
    # hosts repeat: distinct token sets are looked up once, whatever the number of their pages
    sets = rows.where("fit is null and size(tokens) > 0").select(F.array_sort("tokens").alias("set")).distinct()
    hits = sets.select("set", F.explode("set").alias("token")).join(index, "token").groupBy("set", "rule_id", "size", "sure").agg(F.count_distinct("item").alias("found"))
    hits = hits.where("found = size").groupBy("set").agg(F.max("sure").alias("mined"))
    out = rows.withColumn("set", F.array_sort("tokens")).join(hits, "set", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fit").isNull(), F.col("mined")).alias("mined"))
