"""Quality metrics: scorecards of extraction against expected values, accuracy, rates and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def matches(got_num: Column, got_text: Column, want_num: Column, want_text: Column) -> Column:
    """Numbers match within a relative 1e-9 or an absolute 1e-6; texts if equal."""
    close = F.abs(got_num - want_num) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(got_num), F.abs(want_num)), F.lit(1e-6))
    return F.coalesce(F.when(got_num.isNotNull() & want_num.isNotNull(), close).otherwise(got_text == want_text), F.lit(False))


def outcomes(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """expected (case_id, vendor, category, attribute_key, want_num, want_text) with got values, status and tier.

    Of the facts (case_id, attribute_key, value_num, value_text, tier, tier_pos, place) of a key the first counts.
    """
    order = F.struct("tier_pos", "place")
    first = facts.groupBy("case_id", "attribute_key").agg(F.min_by(F.struct("value_num", "value_text", "tier"), order).alias("got"))
    rows = expected.join(first.hint("merge"), ["case_id", "attribute_key"], "left")  # facts may be many more than their estimated size says
    same = matches(F.col("got.value_num"), F.col("got.value_text"), F.col("want_num"), F.col("want_text"))
    status = F.when(F.col("got").isNull(), "missing").when(same, "correct").otherwise("wrong")
    return rows.select("case_id", "vendor", "category", "attribute_key", "want_num", "want_text", "got.value_num", "got.value_text", status.alias("status"), "got.tier")


def scorecard(rows: DataFrame) -> DataFrame:
    """Counts and ratios over all cases, by vendor, by category and by both, in one pass. A null in vendor or category stands for all."""
    sets = [["vendor", "category"], ["vendor"], ["category"], []]
    counted = {f"n_{x}": F.count_if(F.col("status") == x) for x in ("correct", "wrong", "missing")}
    found = counted["n_correct"] + counted["n_wrong"]
    return rows.groupingSets(sets, "vendor", "category").agg(
        F.grouping_id().cast("int").alias("level"), F.count_distinct("case_id").alias("n_cases"), F.count("*").alias("n_expected"), *(v.alias(k) for k, v in counted.items()),
        F.round(ratio(counted["n_correct"], found), 4).alias("accuracy"), F.round(ratio(found, F.count("*")), 4).alias("coverage"),
    )


def tier_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.where("tier IS NOT NULL AND status <> 'missing'").groupBy(*by, "tier").agg(F.count("*").alias("n"))


def ratio(hits: Column, total: Column) -> Column:
    """0 of nothing is 0."""
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))


def auto_map_rate(normalized: DataFrame) -> DataFrame:
    """The share of candidates whose attribute was known."""
    return normalized.agg(ratio(F.count_if(F.col("reason") != "unmapped"), F.count("*")).alias("auto_map_rate"))


def grounding_rate(extracted: DataFrame, grounded: Column) -> DataFrame:
    """The share of extracted facts for which `grounded` holds."""
    return extracted.agg(ratio(F.count_if(F.coalesce(grounded, F.lit(False))), F.count("*")).alias("grounding_rate"))


def answer_accuracy(pairs: DataFrame, got: str, want: str) -> DataFrame:
    return pairs.agg(ratio(F.count_if(F.col(got).eqNullSafe(F.col(want))), F.count("*")).alias("accuracy"))


def distribution(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of each value."""
    counts = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / rows.agg(F.count("*")).scalar())


def coverage_drops(pages: DataFrame, domain: str, at: str, share: float = 0.5) -> DataFrame:
    """(domain, day, n, before): days with less than `share` of the domain's pages of the last day before that had any."""
    days = pages.groupBy(F.col(domain).alias("domain"), F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("domain").orderBy("day"))  # a row a day
    return days.withColumn("before", before).where(F.col("n") < share * F.col("before"))


def ingest_counts(normalized: DataFrame) -> DataFrame:
    """Candidates, facts, unmapped and failed ones of each page."""
    return normalized.groupBy("raw_artifact_id").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("reason") == "ok").alias("facts_written"),
        F.count_if(F.col("reason") == "unmapped").alias("facts_unmapped"), F.count_if(F.col("reason") != "ok").alias("failed"),
    )


def text_report(card: DataFrame) -> str:
    """The scorecard as text: a line a group, with a bar for its accuracy. Groups are few."""
    lines = []
    for r in sorted(card.collect(), key=lambda r: (-r["level"], r["vendor"] or "", r["category"] or "")):
        name = "/".join(x for x in (r["vendor"], r["category"]) if x) or "overall"
        bar = "#" * round(20 * r["accuracy"])
        lines.append(f"{name:<32} {bar:<20} {r['accuracy']:.2%} of {r['n_expected']}, coverage {r['coverage']:.2%}, wrong {r['n_wrong']}, missing {r['n_missing']}")
    return "\n".join(lines)
