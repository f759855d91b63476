"""Evaluation of the rules against labels: samples, joins with checks, scores and gates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.text import content_fingerprint, fold_excerpt, redact_text
from offerlens.functions import rates as R
from offerlens.operators.metrics import literal_rows
from offerlens.operators.skew import bucketed_rank, hash_slice

STATUSES = ("classified", "ambiguous", "unclassified")
COMPARED = ("status", "claims_junior", "minimum_experience_months", "beginner_friendly", "contradictory_junior")
# Sizes and thresholds of the protocols.
VALIDATION_SHARE = 0.3
SAMPLE_PER_STRATUM, SAMPLE_PER_GROUP = 10, 30
STRATA = ("keyword-only", "occupation-only", "overlap")
PRECISION_GATE, RECALL_GATE, MONTHS_GATE = 0.92, 0.85, 0.90
GROUP_COVERAGE, GROUP_PRECISION, OVERALL_COVERAGE, OVERALL_PRECISION = 0.90, 0.70, 0.90, 0.80
EVIDENCE_COVERAGE = 1.0


# ---------------------------------------------------------------- samples


def stratified_hash_split(rows: DataFrame, group: str, identity: str) -> DataFrame:
    """Per group, the upper 30 percent of the ids by hash (at least one) are the validation part."""
    hashed = rows.withColumn("_hash", F.sha2(identity, 256))
    ranked = bucketed_rank(hashed, [group], [F.col("_hash"), F.col(identity)], hash_slice(F.col("_hash")))
    # Half up, as the sizes were fixed.
    size = F.greatest(F.lit(1), F.floor(F.col("group_size") * VALIDATION_SHARE + 0.5))
    split = F.when(F.col("rank") > F.col("group_size") - size, "validation").otherwise("dev")
    return ranked.withColumn("split", split).drop("_hash", "rank", "group_size")


def discovery_stratum(channels: Column) -> Column:
    """Exclusive stratum of the channels through which an offer was found."""
    return (
        F.when(F.array_contains(channels, "overlap"), "overlap")
        .when(F.array_contains(channels, "keyword-only") & ~F.array_contains(channels, "occupation-only"), "keyword-only")
        .otherwise("occupation-only")
    )


def blind_stratified_sample(candidates: DataFrame, seed: str, per_stratum: int = SAMPLE_PER_STRATUM, per_group: int = SAMPLE_PER_GROUP) -> DataFrame:
    """Per group: the first ten of each stratum by hash, then the rest by hash until thirty are chosen.

    At most `per_group` rows of each stratum can matter. The limit on the row number is cut inside every task before
    the shuffle, so a hot group sends that many rows a task.
    """
    digest = F.sha2(F.concat_ws("\u0000", "offer_id", "group_id", F.lit(seed)), 256)
    hashed = candidates.withColumn("_hash", digest)
    rank = F.row_number().over(Window.partitionBy("group_id", "stratum").orderBy("_hash"))
    short = hashed.withColumn("stratum_rank", rank).filter(F.col("stratum_rank") <= per_group)
    # From here on a group holds at most three times thirty rows.
    reserved = short.withColumn("reserved", F.col("stratum_rank") <= per_stratum)
    rest = reserved.withColumn("rest_rank", F.row_number().over(Window.partitionBy("group_id", "reserved").orderBy("_hash")))
    taken = F.count_if("reserved").over(Window.partitionBy("group_id"))
    chosen = rest.withColumn("taken", taken).filter(F.col("reserved") | (F.col("rest_rank") <= per_group - F.col("taken")))
    return chosen.select(*candidates.columns)


def holdout(rows: DataFrame, excluded: DataFrame, seed: str, size: int) -> DataFrame:
    """New sample by hash order without any text used before; of equal texts the first is kept."""
    redacted = rows.withColumn("title", redact_text(F.col("title"))).withColumn("description_text", redact_text(F.col("description_text")))
    marked = redacted.withColumn("_order", F.sha2(F.concat(F.lit(seed), "offer_id"), 256))
    marked = marked.withColumn("fingerprint", content_fingerprint(F.col("title"), F.col("description_text")))
    fresh = marked.join(excluded.select("fingerprint").distinct(), "fingerprint", "left_anti")
    first = fresh.groupBy("fingerprint").agg(F.min_by(F.struct("offer_id", "_order"), "_order").alias("kept"))
    return first.select("kept.*", "fingerprint").orderBy("_order").limit(size).drop("_order")


def challenge_sample(reference: DataFrame, offers: DataFrame, size: int = 100) -> DataFrame:
    """Ambiguous junior offers of the period as a second cohort beside the reference rows."""
    wanted = offers.filter(F.col("claims_junior") & (F.col("status") == "ambiguous"))
    recent = wanted.filter(F.col("source_published_at") >= F.col("source_cutoff_at") - F.make_dt_interval(F.lit(30)))
    challenge = recent.orderBy("offer_id").limit(size).select(F.substring(F.sha2("offer_id", 256), 1, 16).alias("review_id"), F.lit("challenge").alias("cohort"))
    return reference.select("review_id", F.lit("reference").alias("cohort")).unionByName(challenge)


# ---------------------------------------------------------------- joins with checks


def label_join(predictions: DataFrame, labels: DataFrame, key: str = "review_id") -> DataFrame:
    """Predictions with their labels, one to one; a missing or repeated id on either side is an error.

    Both sides are counted per key before they meet, so a repeated id never multiplies rows.
    """
    columns = [c for c in predictions.columns if c != key]
    others = [c for c in labels.columns if c != key]
    left = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*columns)).alias("_p"))
    right = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.any_value(F.struct(*others)).alias("_l"))
    joined = left.join(right, key, "full_outer")
    sound = F.coalesce((F.col("_n") == 1) & (F.col("_m") == 1), F.lit(False))
    problem = F.concat(F.lit("prediction and label do not match one to one: "), F.col(key).cast("string"))
    checked = F.when(sound, F.col(key)).otherwise(F.raise_error(problem).cast(predictions.schema[key].dataType))
    return joined.select(checked.alias(key), "_p.*", "_l.*")


def disjoint_corpora(left: DataFrame, right: DataFrame, key: str = "review_id") -> DataFrame:
    """Ids that are in both corpora; must be empty."""
    return left.select(key).intersect(right.select(key))


def label_amendments(labels: DataFrame, reviewed: DataFrame, columns: list[str], key: str = "review_id") -> DataFrame:
    """Reviewed values over the original ones, both kept, with a flag per amended label."""
    review = reviewed.select(key, F.struct(*columns).alias("_review"))
    joined = labels.join(review, key, "left")
    amended = F.col("_review").isNotNull()
    return joined.select(
        *[c for c in labels.columns if c not in columns],
        *[F.col(c).alias(f"original_{c}") for c in columns],
        *[F.when(amended, F.col("_review")[c]).otherwise(F.col(c)).alias(c) for c in columns],
        amended.alias("amended"),
    )


def unexpected_reviews(reviewed: DataFrame, selected: DataFrame, key: str = "review_id") -> DataFrame:
    """Reviewed ids that were not selected and selected ids without a review; must be empty."""
    extra = reviewed.select(key).join(selected.select(key), key, "left_anti").withColumn("problem", F.lit("not_selected"))
    missing = selected.select(key).join(reviewed.select(key), key, "left_anti").withColumn("problem", F.lit("not_reviewed"))
    return extra.unionByName(missing)


def excerpt_containment(rows: DataFrame, text: Column, excerpts: Column) -> DataFrame:
    """Excerpts and whether their text holds them, exactly and after folding to letters and digits.

    A row has a handful of excerpts; everything happens where the row is, without a join.
    """
    prepared = rows.withColumn("_text", text).withColumn("_folded", fold_excerpt(text)).withColumn("_excerpt", F.explode(excerpts))
    return prepared.select(
        *rows.columns,
        F.col("_excerpt").alias("excerpt"),
        F.contains(F.col("_text"), F.col("_excerpt")).alias("exact"),
        F.contains(F.col("_folded"), fold_excerpt(F.col("_excerpt"))).alias("folded"),
    )


# ---------------------------------------------------------------- scores


def status_confusion(rows: DataFrame, reference: str, predicted: str) -> DataFrame:
    """The three by three status matrix, one row per reference status."""
    cells = [F.count_if(F.col(predicted) == s).alias(s) for s in STATUSES]
    return rows.groupBy(F.col(reference).alias("reference_status")).agg(*cells)


def binary_counts(rows: DataFrame, predicted: Column, reference: Column, *keys: str) -> DataFrame:
    """TP, FP, FN and TN; rows without a reference are left out."""
    known = rows.withColumn("_p", F.coalesce(predicted, F.lit(False))).withColumn("_r", reference).filter(F.col("_r").isNotNull())
    p, r = F.col("_p"), F.col("_r")
    return known.groupBy(*keys).agg(
        F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"), F.count_if(~p & ~r).alias("tn")
    )


def gate(numerator: Column, denominator: Column, threshold: float) -> Column:
    """passed, failed, or not_evaluable when there is nothing to divide by."""
    value = F.try_divide(numerator, denominator)
    return F.when(denominator == 0, "not_evaluable").when(value >= threshold, "passed").otherwise("failed")


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the gate over both; it passes only if both pass."""
    tp, predicted, actual = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    scored = counts.withColumn("precision", F.try_divide(tp, predicted)).withColumn("recall", F.try_divide(tp, actual))
    total = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", F.when(total != 0, F.try_divide(2 * F.col("precision") * F.col("recall"), total)))
    scored = scored.withColumn("precision_status", gate(tp, predicted, PRECISION_GATE))
    scored = scored.withColumn("recall_status", gate(tp, actual, RECALL_GATE))
    both = (F.col("precision_status") == "passed") & (F.col("recall_status") == "passed")
    return scored.withColumn("gate", F.when(both, "passed").otherwise("blocked"))


def exact_months_precision(rows: DataFrame, status: str, predicted: str, reference: str) -> DataFrame:
    """Exact months among classified predictions that give months."""
    asked = (F.col(status) == "classified") & F.col(predicted).isNotNull()
    counted = rows.agg(
        F.count_if(asked & F.col(predicted).eqNullSafe(F.col(reference))).alias("exact"), F.count_if(asked).alias("predicted")
    )
    value = F.try_divide(F.col("exact"), F.col("predicted"))
    return counted.withColumn("precision", value).withColumn("status", gate(F.col("exact"), F.col("predicted"), MONTHS_GATE))


def cohort_scores(rows: DataFrame, predicted: Column, reference: Column, exact: Column) -> DataFrame:
    """Scores and exact matches per cohort. A reference that is not known counts as not positive here."""
    marked = rows.withColumn("_exact", exact)
    counts = binary_counts(marked, predicted, F.coalesce(reference, F.lit(False)), "cohort")
    matches = marked.groupBy("cohort").agg(F.count(F.lit(1)).alias("count"), F.count_if("_exact").alias("exact"))
    return precision_recall(counts.join(matches, "cohort"))


def denominator_agreement(rows: DataFrame, included: Column, expected: Column) -> DataFrame:
    """Agreement on who belongs to the denominator at all."""
    return precision_recall(binary_counts(rows, included, F.coalesce(expected, F.lit(False)))).drop("f1", "gate")


def version_delta(before: DataFrame, after: DataFrame, labels: DataFrame, key: str = "review_id") -> DataFrame:
    """Per field: rows changed between two versions, and matches with the label before and after."""
    rows = (
        before.select(key, *[F.col(c).alias(f"b_{c}") for c in COMPARED])
        .join(after.select(key, *[F.col(c).alias(f"a_{c}") for c in COMPARED]), key)
        .join(labels.select(key, *[F.col(c).alias(f"l_{c}") for c in COMPARED]), key)
    )
    pairs = (("changed", "b", "a", True), ("before_matches", "b", "l", False), ("after_matches", "a", "l", False))

    def count(field: str, x: str, y: str, differ: bool) -> Column:
        same = F.col(f"{x}_{field}").eqNullSafe(F.col(f"{y}_{field}"))
        return F.count_if(~same if differ else same)

    wide = rows.agg(*[F.struct(*[count(f, x, y, d).alias(n) for n, x, y, d in pairs]).alias(f) for f in COMPARED])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f)[n].alias(n) for n, *_ in pairs]) for f in COMPARED])))


def changed_ids(before: DataFrame, after: DataFrame, key: str = "review_id") -> DataFrame:
    """Ids with any field changed, flagged when they became ambiguous."""
    rows = before.select(key, F.struct(*COMPARED).alias("b")).join(after.select(key, F.struct(*COMPARED).alias("a")), key)
    became = (F.col("b.status") != "ambiguous") & (F.col("a.status") == "ambiguous")
    return rows.filter(~F.col("a").eqNullSafe(F.col("b"))).select(key, became.alias("became_ambiguous"))


def reclassify_audit(before: DataFrame, after: DataFrame, key: str = "offer_id") -> DataFrame:
    """Rates before and after over the frozen population, with the number of changed rows."""
    compared = ("status", "claims_junior", "minimum_experience_months")
    changed = (
        before.select(key, F.struct(*compared).alias("b"))
        .join(after.select(key, F.struct(*compared).alias("a")), key)
        .agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))))
    )
    sides = [
        R.rates(side, conditions).withColumn("side", F.lit(name))
        for name, side, conditions in (
            ("before", before, R.contradiction_v1()),
            ("candidate", after, R.contradiction_v1()),
            ("observation_candidate", after, R.contradiction_v2()),
        )
    ]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).withColumn("changed", changed.scalar())


def _resolved() -> Column:
    return (F.col("label_status") == "classified") & F.col("relevant").isNotNull()


def query_relevance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Per search group, also one without a row: size, coverage and precision of the labelled sample, each with its gate."""
    counted = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("sample"), F.count_if(_resolved()).alias("resolved"), F.count_if(_resolved() & F.col("relevant")).alias("relevant")
    )
    listed = groups.select("group_id").distinct().join(counted, "group_id", "left").fillna(0, ["sample", "resolved", "relevant"])
    return (
        listed.withColumn("size_gate", F.when(F.col("sample") >= SAMPLE_PER_GROUP, "passed").otherwise("failed"))
        .withColumn("coverage_gate", gate(F.col("resolved"), F.col("sample"), GROUP_COVERAGE))
        .withColumn("precision_gate", gate(F.col("relevant"), F.col("resolved"), GROUP_PRECISION))
    )


def relevance_gate(rows: DataFrame, groups: DataFrame, collection: DataFrame) -> DataFrame:
    """The verdict on a query set, one row: overall metrics, evidence, collection and groups must all pass."""
    overall = rows.agg(
        F.count(F.lit(1)).alias("sample"),
        F.count_if(_resolved()).alias("resolved"),
        F.count_if(_resolved() & F.col("relevant")).alias("relevant"),
        F.count_if(F.col("evidence") > 0).alias("with_evidence"),
    )
    by_group = query_relevance(rows, groups)
    gates = [F.col(c) == "passed" for c in ("size_gate", "coverage_gate", "precision_gate")]
    groups_passed = by_group.agg(F.coalesce(F.bool_and(reduce(and_, gates)), F.lit(False)).alias("groups_passed"))
    facts = collection.select(
        ((F.col("complete") == F.col("queries")) & (F.col("over_cap") == 0) & (F.col("incomplete") == 0)).alias("pagination"),
        (F.coalesce("quarantined", F.lit(0)) == 0).alias("quarantine"),
        (F.col("warnings") == "").alias("contract"),
    )
    joined = overall.join(groups_passed, F.lit(True)).join(facts, F.lit(True))
    named = {
        "coverage_gate": gate(F.col("resolved"), F.col("sample"), OVERALL_COVERAGE),
        "precision_gate": gate(F.col("relevant"), F.col("resolved"), OVERALL_PRECISION),
        "evidence_gate": gate(F.col("with_evidence"), F.col("sample"), EVIDENCE_COVERAGE),
        **{f"{c}_gate": F.when(F.col(c), "passed").otherwise("failed") for c in ("pagination", "quarantine", "contract", "groups_passed")},
    }
    judged = joined.withColumns(named)
    verdict = F.when(reduce(and_, [F.col(c) == "passed" for c in named]), "passed").otherwise("blocked")
    return judged.select("sample", "resolved", "relevant", "with_evidence", *named, verdict.alias("gate_status"))


def relevance_by_stratum(rows: DataFrame) -> DataFrame:
    """Relevance by exclusive stratum of discovery, also where a stratum holds no resolved row."""
    spark, resolved = rows.sparkSession, rows.filter(_resolved())
    counted = resolved.groupBy("stratum").agg(F.count(F.lit(1)).alias("resolved"), F.count_if("relevant").alias("relevant"))
    listed = literal_rows(spark, [(s,) for s in STRATA], "stratum").join(counted, "stratum", "left").fillna(0, ["resolved", "relevant"])
    return listed.withColumn("rate", F.try_divide(F.col("relevant"), F.col("resolved")))


def relevance_by_query(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Relevance of the labelled rows that each single query found; 0 rows for a query that found none."""
    found = rows.withColumn("query_id", F.explode(F.array_distinct("query_ids")))
    classified = F.col("label_status") == "classified"
    counted = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sample"), F.count_if(classified).alias("resolved"), F.count_if(classified & F.coalesce("relevant", F.lit(False))).alias("relevant")
    )
    listed = queries.select("query_id", "kind").join(counted, "query_id", "left").fillna(0, ["sample", "resolved", "relevant"])
    return listed.withColumn("rate", F.try_divide(F.col("relevant"), F.col("resolved")))


def false_positive_reasons(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNotNull()).groupBy("reason").count()


# ---------------------------------------------------------------- overlap of queries


def pairwise_overlap(hits: DataFrame) -> DataFrame:
    """Intersection, union and Jaccard of every pair of queries that found a common offer.

    Offers are first reduced to their set of queries and equal sets are counted, so pairs are built per
    distinct set, weighted by its count, and never per offer. All other pairs have no common offer.
    """
    sets = hits.distinct().groupBy("offer_id").agg(F.array_sort(F.collect_set("query_id")).alias("queries"))
    weighted = sets.groupBy("queries").agg(F.count(F.lit(1)).alias("offers"))
    sizes = weighted.select(F.explode("queries").alias("query_id"), "offers").groupBy("query_id").agg(F.sum("offers").alias("size"))
    common = weighted.select(_ordered_pairs("queries"), "offers").groupBy("left_id", "right_id").agg(F.sum("offers").alias("intersection"))
    side = lambda name: sizes.select(F.col("query_id").alias(f"{name}_id"), F.col("size").alias(f"{name}_size"))
    joined = common.join(side("left"), "left_id").join(side("right"), "right_id")
    joined = joined.withColumn("union", F.col("left_size") + F.col("right_size") - F.col("intersection"))
    return joined.select("left_id", "right_id", "intersection", "union", F.try_divide("intersection", "union").alias("jaccard"))


def _ordered_pairs(column: str) -> Column:
    """All pairs i < j of a sorted array."""
    items = F.col(column)
    pairs = F.flatten(
        F.transform(
            items,
            lambda left, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda right: F.struct(left.alias("left_id"), right.alias("right_id"))),
        )
    )
    return F.inline(pairs)


def overlap_summary(overlaps: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean Jaccard over occupation and keyword pairs of a same group; a pair without a common offer counts as 0."""
    member = queries.select("query_id", "kind", F.explode("group_ids").alias("group_id"))
    kind = lambda name, column: member.filter(F.col("kind") == name).select(F.col("query_id").alias(column), "group_id")
    pairs = kind("occupation-only", "x").join(kind("keyword-only", "y"), "group_id").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
    rows = pairs.distinct().join(overlaps, ["left_id", "right_id"], "left")
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("intersection") > 0).alias("non_zero_pairs"),
        F.avg(F.coalesce("jaccard", F.lit(0.0))).alias("mean_jaccard"),
    )


def union_channels(sightings: DataFrame) -> DataFrame:
    """Each offer once, with all channels and queries that found it; sets hold at most the number of queries."""
    return sightings.groupBy("offer_id").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"), F.array_sort(F.collect_set("query_id")).alias("query_ids")
    )


def collection_summary(query_runs: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries by status, reported totals, quarantined items and distinct offers of a collection."""
    counted = query_runs.agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "over_cap", "incomplete")],
        F.sum("total").alias("total_reported"),
        F.sum("quarantined").alias("quarantined"),
        F.array_join(F.array_sort(F.collect_set("warning")), ",").alias("warnings"),
    )
    offers = hits.select("offer_id").distinct().agg(F.count(F.lit(1)))
    return counted.withColumn("unique_offers", offers.scalar())


def group_offers(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct offers of each group of queries, 0 for a group whose queries found none."""
    groups = queries.select("query_id", F.explode("group_ids").alias("group_id")).distinct()
    found = groups.join(hits.select("query_id", "offer_id").distinct(), "query_id", "left")
    pairs = found.select("group_id", "offer_id").distinct()
    return pairs.groupBy("group_id").agg(F.count("offer_id").alias("unique_offers"))


# ---------------------------------------------------------------- labels


def annotator_agreement(first: DataFrame, second: DataFrame, key: str = "review_id") -> DataFrame:
    """Fields on which two passes differ, per row."""
    rows = first.select(key, *[F.col(c).alias(f"a_{c}") for c in COMPARED]).join(second.select(key, *[F.col(c).alias(f"b_{c}") for c in COMPARED]), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in COMPARED]))
    return rows.select(key, differ.alias("disagreements"), (F.size(differ) == 0).alias("agree"))


def label_semantics(labels: DataFrame, key: str = "review_id") -> DataFrame:
    """Labels whose values contradict each other, one row per code; must be empty."""
    months, claims, status = F.col("minimum_experience_months"), F.col("claims_junior"), F.col("status")
    answers = F.coalesce(claims.cast("string"), months.cast("string"), F.col("beginner_friendly").cast("string"), F.col("contradictory_junior").cast("string"))
    contradiction = F.when(claims, months >= 24).when(~claims, False)
    codes = [
        F.when((status == "unclassified") & answers.isNotNull(), "unclassified_values_not_null"),
        F.when((status == "ambiguous") & F.col("beginner_friendly").isNotNull(), "ambiguous_beginner_not_null"),
        F.when((status == "ambiguous") & F.col("contradictory_junior").isNotNull(), "ambiguous_contradiction_not_null"),
        F.when((status == "classified") & ~F.col("beginner_friendly").eqNullSafe(months <= 12), "beginner_mismatch"),
        F.when((status == "classified") & ~F.col("contradictory_junior").eqNullSafe(contradiction), "contradiction_mismatch"),
    ]
    return labels.select(key, F.explode_outer(F.array_compact(F.array(*codes))).alias("code")).filter(F.col("code").isNotNull())


def exact_overlap_count(cohort: DataFrame, other: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows of one cohort whose content is in the other as well."""
    shared = cohort.join(other.select(fingerprint).distinct(), fingerprint, "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("overlaps"))


def review_selection(rows: DataFrame, deltas: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows with a delta go to review."""
    return rows.join(deltas.select(key).distinct(), key, "left_semi")
