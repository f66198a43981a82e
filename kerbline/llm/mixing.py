"""Mixing of sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The targets are shares of all words.  Words are handed out in blocks of equal size: the sources with the highest
quotients target / (2 k - 1) get the blocks, then the shards of a source get its blocks by their sizes in the
same way.  A shard's documents stand in a seeded order; its quota takes whole passes over them, then the
first words of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import materialize

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters that are no ASCII white space; 0 for null.

    Bytes that continue a character can't be white space, so counting the starts of runs on a text squeezed to two
    letters is enough.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seat_order(seed: int, doc_id: Column) -> Column:
    """The seeded order of documents: md5 of seed and doc_id, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def apportion(df: DataFrame, votes: str, seats: str, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with column got: the Sainte-Lague seats of each row by ``votes``; every ``group`` shares out ``seats``.

    With n members of a group, a member's seats differ from its share q by less than q * n / (2 * seats) + 1 (its divisor's
    bound), so only the quotients inside that band are ranked: about four a member, whatever the number of seats.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    df = df.withColumn("__votes", F.sum(votes).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    share = F.when(F.col("__votes") > 0, F.col(votes) / F.col("__votes")).otherwise(F.lit(0.0))
    quota = share * F.col(seats)
    band = share * (F.col("__n") / 2 + 1) + 1
    sure = F.greatest(F.floor(quota - band), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(quota + band).cast("long"), sure + 1)
    df = df.withColumn("__sure", sure).withColumn("__last", last)
    rest = F.col(seats) - F.sum("__sure").over(w)
    df = df.withColumn("__rest", rest).withColumn("__k", F.explode(F.sequence(F.col("__sure") + 1, F.col("__last"))))
    quotient = F.col(votes) / (2 * F.col("__k") - 1)
    place = F.row_number().over(w.orderBy(quotient.desc(), *order, F.col("__k")))
    won = F.when((place <= F.col("__rest")) & (F.col(votes) > 0), 1).otherwise(0)
    keep = [c for c in df.columns if not c.startswith("__")]
    df = df.withColumn("__won", won)
    return df.groupBy(*keep).agg((F.first("__sure") + F.sum("__won")).cast("long").alias("got"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size, source_rows, target.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at ``most`` times its
    source's size, and the excess goes to the others by weight until none is above.  That is: the sources that stop first are
    those of least size per weight, so one pass in that order finds the share per weight of all that don't stop.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    row = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(row.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight.cast("long"))
    # in exact whole numbers: stop_i before stop_j if size_i * weight_j < size_j * weight_i
    by = row.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), F.col("source").cast("binary"))
    up_to = by.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum("source_size").over(up_to), F.lit(0)) * most
    open_weight = F.sum("weight").over(row) - F.coalesce(F.sum("weight").over(up_to), F.lit(0))
    table = table.withColumn("rest", F.sum("source_size").over(row) - stopped).withColumn("open", open_weight)
    fits = F.col("weight") * F.col("rest") <= most * F.col("source_size") * F.col("open")
    share = F.min(F.when(fits, F.struct((-F.col("open")).alias("o"), F.col("open"), F.col("rest")))).over(row)
    table = table.withColumn("share", share)
    target = F.col("weight") * F.col("share.rest") / F.col("share.open")
    capped = F.col("share").isNull() | (F.col("open") > F.col("share.open"))
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(target)
    return table.select("source", "source_size", "source_rows", target.alias("target"))


def mix(docs: DataFrame, block: int = 8, shard: int = 1_000_000, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, source, __row (a hash of the text), size, source_size, target, taken.

    size is the number of words (null: 0).  Blocks of ``block`` words are apportioned to sources, then to shards of about
    ``shard`` words of a source.  No document is taken more than ``most`` times its size, so a small shard may give a few words less
    than its blocks.  A null source is a source; a null doc_id has its own place in the seeded order; rows
    of one doc_id follow each other.  Where no word exists nothing is taken and targets are 0.  An empty
    table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("__row"))
    sizes = materialize(plain, "sizes")
    goal = targets(sizes, weights, most)
    all_words = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    goal = goal.withColumn("seats", F.floor(all_words / block + F.lit(0.5)))
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    goal = apportion(goal, "target", "seats", [], order).withColumnRenamed("got", "blocks")
    goal = materialize(goal.withColumn("shards", F.ceil((F.col("source_size") + 20 * F.col("source_rows")) / shard).cast("long")), "goal")

    seat = seat_order(seed, F.col("doc_id"))
    same = sizes["source"].eqNullSafe(F.col("of"))
    rows = sizes.join(goal.select(F.col("source").alias("of"), "source_size", "target", "blocks", "shards"), same).drop("of")
    rows = rows.withColumn("seat", seat)
    number = F.conv(F.substring("seat", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("shard", number % F.greatest("shards", F.lit(1)))
    cells = rows.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("cell"))
    cells = cells.withColumn("votes", F.col("cell").cast("double"))
    cells = apportion(cells, "votes", "blocks", ["source"], [F.col("shard")])
    cells = cells.select(F.col("source").alias("of"), F.col("shard").alias("at"), "cell", F.least(F.col("got") * block, most * F.col("cell")).alias("quota"))
    rows = rows.join(cells, rows["source"].eqNullSafe(F.col("of")) & (rows["shard"] == F.col("at"))).drop("of", "at")
    up_to = Window.partitionBy("source", "shard").orderBy("seat", "doc_id", "__row", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(up_to), F.lit(0))
    passes = F.when(F.col("cell") > 0, F.floor(F.col("quota") / F.col("cell"))).otherwise(F.lit(0))
    rest = F.col("quota") - passes * F.col("cell") - before
    taken = passes * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "__row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a document for every whole time it is taken, and its first words
    for the rest.  Documents of which nothing is taken go; so do texts without words, unless their source has none at all.

    Rows of equal doc_id, source and text count as rows of their own; which of them is cut where they differ in other columns is open.
    Other columns may have any names that don't begin with two underscores.
    """
    same = ["__doc", "__source", "__row", "__copy"]
    ident = Window.partitionBy("__doc", "__source", "__row").orderBy(F.lit(0))
    taken = mix(docs, **settings).select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), "__row", F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    taken = taken.where("__taken > 0").withColumn("__copy", F.row_number().over(ident))
    full = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__row": F.xxhash64("text")})
    full = full.withColumn("__copy", F.row_number().over(ident))
    keys = [full[c].eqNullSafe(taken[c]) for c in same]
    joined = full.join(taken, keys[0] & keys[1] & keys[2] & keys[3]).select(*[full["`" + c.replace("`", "``") + "`"] for c in docs.columns], "__size", "__taken")
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    part = (F.col("__taken") % F.col("__size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    joined = joined.withColumn("__part", F.explode(times))
    # words with the white space after each; the white space around the kept ones goes
    white = r"[\x20\x09-\x0D]"
    words = F.split(F.regexp_replace("text", f"^{white}+", ""), f"(?<={white})(?!{white})")
    start = F.regexp_replace(F.array_join(F.slice(words, 1, F.col("__part")), ""), f"{white}+$", "")
    text = F.when(F.col("__part") == 0, F.col("text")).otherwise(start)
    return joined.withColumn("text", text).select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
