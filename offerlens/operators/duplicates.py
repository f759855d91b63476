"""Clusters of offers that are probably one, across the partners of a source: reported, never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.text import fold_excerpt, folded_words
from offerlens.operators.links import linked_groups
from offerlens.sources.tables import unwritten, written

#: Two texts are similar if the words they share weigh at least 3/4 of the words of either.
SHARE, OF = 3, 4
NEAR_DAYS = 30


def _similar(common: Column, one: Column, two: Column) -> Column:
    """common / (one + two - common) >= SHARE / OF, in whole numbers."""
    return (OF + SHARE) * common >= SHARE * (one + two)


def _near(first: Column, last: Column, other_first: Column, other_last: Column, days: int) -> Column:
    return (F.datediff(other_first, last) <= days) & (F.datediff(first, other_last) <= days)


def _weighted_words(classes: DataFrame) -> DataFrame:
    """`class, block, classes, every, total, listed` of the classes that are not alone in their block; `listed` holds
    the codes of their words, the rarest first.

    A word weighs the bit length of (number of classes) / (classes that hold it): 1 for a word of more than half of
    them, one more for every halving. Whole numbers make every comparison exact. Words are dealt out as (id, word) and
    come back as one array of codes a class; all later steps work on these. A code is the number of the word by rarity,
    its weight (six bits), and whether two classes hold it (one bit).
    """
    own = F.explode(F.split("words", " ")).alias("word")
    frequency = classes.filter("words <> ''").select(own).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    every = classes.agg(F.count(F.lit(1))).scalar()
    numbered = written(frequency.orderBy("df", "word").withColumn("number", F.monotonically_increasing_id()), "offer-vocabulary")
    # numbers of the sorted parts leave gaps: without them they are short. One row a part is summed up
    part, place = F.shiftright("number", 33), F.col("number").bitwiseAND(2**33 - 1)
    parts = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.length(F.bin(F.floor(F.col("every") / F.col("df")))).cast("long")
    code = ((F.col("before") + place) * 64 + weight) * 2 + (F.col("df") > 1).cast("long")
    codes = numbered.withColumns({"part": part, "every": every}).join(F.broadcast(before), "part").select("word", code.alias("code"))
    several = classes.groupBy("block").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    # joined as whole classes: only words of those that are not alone are dealt by word
    words = classes.filter("words <> ''").join(several, "block").select("id", own)
    listed = words.join(codes, "word").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("listed"))
    known = classes.select("id", "class", "block").join(several, "block").join(listed, "id")
    return known.select("class", "block", "classes", every.alias("every"), _sum("listed").alias("total"), "listed")


def _weight(code: Column) -> Column:
    return F.shiftright(code, 1).bitwiseAND(63)


def _sum(codes: Column | str) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: s + _weight(c))


def _shared(codes: Column | str) -> Column:
    """Words that two classes hold."""
    return F.filter(codes, lambda c: c.bitwiseAND(1) == 1)


def _prefix() -> Column:
    """The words that a class is looked up by.

    Words are ordered by rarity. The first word that two similar classes share leaves, with the words after it, at
    least SHARE / OF of either total; so only words up to that point are joined. One that no other class holds is not.
    """
    upto = lambda s, c: F.struct(
        (s["before"] + _weight(c)).alias("before"), (s["n"] + F.when(OF * s["before"] <= (OF - SHARE) * F.col("total"), 1).otherwise(0)).alias("n")
    )
    n = F.aggregate("listed", F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("n")), upto, lambda s: s["n"])
    return _shared(F.slice("listed", F.lit(1), n))


def _core(words: DataFrame) -> DataFrame:
    """`class, block, total, prefix, is_close`: whether the class differs so little from the core of its block that
    it is similar to every other such class.

    The core holds the words of more than half of a block's classes. With `d` the weight of a class's difference
    from the core, two classes differ by at most `d + d'`, and they are similar if that is at most
    (OF - SHARE) / (OF + SHARE) of `total + total'`. A word of weight w is in at most every / 2^(w - 1) classes, so
    heavier words than a block's number of classes allows are not counted.
    """
    may = F.filter("listed", lambda c: 2 * F.col("every") > F.col("classes") * F.pow(F.lit(2.0), _weight(c) - 1))
    slim = words.select("class", "block", "classes", "total", _prefix().alias("prefix"), may.alias("may"))
    each = slim.select("block", "classes", F.explode("may").alias("word")).groupBy("block", "word").agg(F.count(F.lit(1)).alias("n"), F.any_value("classes").alias("classes"))
    core = each.filter(2 * F.col("n") > F.col("classes")).groupBy("block").agg(F.collect_list("word").alias("core"))
    own = slim.join(core, "block", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    differs = F.col("total") + _sum("core") - 2 * _sum(F.array_intersect("may", "core"))
    return own.select("class", "block", "total", "prefix", ((OF + SHARE) * differs <= (OF - SHARE) * F.col("total")).alias("is_close"))


def _similar_classes(words: DataFrame, close: DataFrame) -> DataFrame:
    """(a, b) of similar classes of one block, but for pairs of two close ones: those that share a word of their
    prefixes and whose totals fit are compared on all words that two classes hold.
    """
    prefix = close.select("block", F.explode("prefix").alias("word"), "class", "total", "is_close")
    left = prefix.select("block", "word", F.col("class").alias("a"), F.col("total").alias("a_total"), F.col("is_close").alias("a_close"))
    right = prefix.select("block", "word", F.col("class").alias("b"), F.col("total").alias("b_total"), F.col("is_close").alias("b_close"))
    fits = (OF * F.least("a_total", "b_total") >= SHARE * F.greatest("a_total", "b_total")) & ~(F.col("a_close") & F.col("b_close"))
    pairs = left.join(right, ["block", "word"]).filter((F.col("a") < F.col("b")) & fits).select("a", "b", "a_total", "b_total").distinct()
    sets = words.select("class", _shared("listed").alias("words"))
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("words").alias("a_words")), "a")
    both = both.join(sets.select(F.col("class").alias("b"), F.col("words").alias("b_words")), "b")
    return both.filter(_similar(_sum(F.array_intersect("a_words", "b_words")), F.col("a_total"), F.col("b_total"))).select("a", "b")


def _close_links(dated: DataFrame, close: DataFrame, days: int) -> DataFrame:
    """(a, b) nodes of close classes: all are similar, so neighbouring days of a block are chained."""
    own = dated.join(close.filter("is_close").select("class"), "class").select("block", "day", "node")
    daily = own.groupBy("block", "day").agg(F.min("node").alias("chief"))
    inside = own.join(daily, ["block", "day"]).select(F.col("node").alias("a"), F.col("chief").alias("b"))
    ordered = Window.partitionBy("block").orderBy("day")
    before = daily.withColumns({"b": F.lag("chief").over(ordered), "gap": F.datediff("day", F.lag("day").over(ordered))})
    return inside.unionByName(before.filter(F.col("gap") <= days).select(F.col("chief").alias("a"), "b"))


def probable_duplicates(offers: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """`offer_id, cluster_id, cluster_size` of offers in a cluster of two or more.

    Two offers are linked if their folded title, company, commune and contract are equal (the block), their dates
    are at most `days` apart and their texts are similar: the words they share, weighted by rarity, make up 3/4 of
    the words of either. Clusters are chains of links, named by their least offer. A null is a value of its own; a
    missing date counts as 1970-01-01.

    Offers with equal words are one class, and a class with days at most `days` apart is one node, so copies cost a
    row each. Classes that differ little from the core of their block are chained by date, without pairs; other
    pairs come from a join on rare words (see `_similar_classes`) and are checked on all words.
    """
    keys = F.struct(fold_excerpt(F.col("title")).alias("t"), "company_name", "commune_code", "contract_kind")
    block = F.md5(F.to_json(keys, {"ignoreNullFields": "false"}))
    words = F.array_sort(F.array_distinct(folded_words(F.coalesce("description_text", F.lit("")))))
    day = F.coalesce(F.to_date("source_published_at"), F.lit("1970-01-01").cast("date"))
    rows = offers.select("offer_id", block.alias("block"), day.alias("day"), F.array_join(words, " ").alias("words"))
    keyed = {"class": F.unhex(F.md5(F.concat_ws(" ", "block", "words"))), "block": F.unhex("block")}
    texts = written(rows.withColumns(keyed), "offer-words")
    classes = texts.groupBy("class").agg(F.any_value("block").alias("block"), F.any_value("words").alias("words"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "offer-classes")
    rows = written(texts.select("offer_id", "class", "block", "day"), "offer-days")
    unwritten(texts)  # a text's words are kept once, with its class

    daily = rows.groupBy("class", "day").agg(F.any_value("block").alias("block"), F.count(F.lit(1)).alias("n"), F.min("offer_id").alias("least"))
    ordered = Window.partitionBy("class").orderBy("day")
    starts = F.coalesce(F.datediff("day", F.lag("day").over(ordered)) > days, F.lit(True))
    runs = daily.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(ordered))
    dated = written(runs.withColumn("node", F.min("least").over(Window.partitionBy("class", "run"))), "offer-nodes")
    nodes = dated.groupBy("class", "node").agg(F.sum("n").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))

    weighted = written(_weighted_words(classes), "offer-weights")
    unwritten(classes)
    close = written(_core(weighted), "offer-cores")
    pairs = _similar_classes(weighted, close)
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("class").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("node", "first", "last"))), side)
    near = pairs.filter(_near(F.col("a_first"), F.col("a_last"), F.col("b_first"), F.col("b_last"), days))
    links = near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionByName(_close_links(dated, close, days))

    groups = linked_groups(links)
    named = nodes.join(groups, F.col("node") == F.col("member"), "left").withColumn("cluster_id", F.coalesce("group", "node"))
    sizes = named.groupBy("cluster_id").agg(F.sum("n").alias("cluster_size")).filter("cluster_size > 1")
    clustered = named.join(sizes, "cluster_id").select("node", "cluster_id", "cluster_size")
    placed = dated.select("class", "day", "node").join(clustered, "node")
    return rows.select("offer_id", "class", "day").join(placed, ["class", "day"]).select("offer_id", "cluster_id", "cluster_size")
