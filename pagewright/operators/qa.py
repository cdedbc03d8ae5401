"""Quality scan over page logs: issues, risk scores, summary, gates, failure runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C


def unchanged_ratio() -> Column:
    blocks = F.col("changed_blocks") + F.col("unchanged_blocks")
    return F.when(blocks > 0, F.bround(F.col("unchanged_blocks") / blocks, 4)).otherwise(0.0)


def with_leaks(log: DataFrame, output: DataFrame) -> DataFrame:
    """log with `leak`: whether the page's text in the output (page, text) still holds a placeholder."""
    leaks = output.where(F.col("text").rlike(C.LEAK)).select("page").distinct().withColumn("leak", F.lit(True))
    return log.join(leaks, "page", "left").fillna(False, ["leak"])


def page_scores(log: DataFrame, ratio: float = 0.85, min_chars: int = 300) -> DataFrame:
    """log with high_unchanged, score (0 to 100; a leak is 100) and sorted reasons. A log without `leak` has none."""
    blocks = F.col("changed_blocks") + F.col("unchanged_blocks")
    high = (F.col("native_char_count") >= min_chars) & (blocks > 0) & (F.col("unchanged_blocks") / F.greatest(blocks, F.lit(1)) >= ratio)
    leak = F.col("leak") if "leak" in log.columns else F.lit(False)
    bad = ~F.coalesce(F.col("status"), F.lit("")).isin("ok", "ok_no_text")
    score = F.when(bad, 20).otherwise(0) + F.least(F.lit(40), 10 * F.col("n_errors")) + F.least(F.lit(20), 5 * F.col("n_warnings")) + F.when(high, 10).otherwise(0)
    rules = ((bad, "status_not_ok"), (F.col("n_errors") > 0, "page_errors"), (F.col("n_warnings") > 0, "page_warnings"), (high, "high_unchanged_ratio"), (leak, "zxq_leak"))
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules])))
    return log.select(*[c for c in log.columns if c != "leak"], leak.alias("leak"), high.alias("high_unchanged"), F.when(leak, 100).otherwise(F.least(F.lit(100), score)).cast("bigint").alias("score"), reasons.alias("reasons"))


def top_risky(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.select("page", "high_unchanged", "score", F.array_join("reasons", ",").alias("reasons")).orderBy(F.desc("score"), "page").limit(n)


def rejected_ratio(rejected: Column, candidates: Column) -> Column:
    """Share of rejected post-edits; 0 without candidates."""
    return F.when(candidates > 0, F.bround(rejected / candidates, 4)).otherwise(0.0)


def summary(scored: DataFrame) -> DataFrame:
    total = scored.agg(
        F.count("*").alias("pages"), F.count_if(F.col("status") == "ok").alias("ok_pages"), F.count_if(F.col("n_errors") > 0).alias("pages_with_errors"),
        F.sum("n_warnings").alias("warnings"), F.sum("n_errors").alias("errors"), F.count_if("high_unchanged").alias("high_unchanged_pages"), F.count_if("leak").alias("zxq_leak_pages"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("llm_candidates", "llm_changed", "llm_rejected")])
    return total.withColumn("llm_rejected_ratio", rejected_ratio(F.col("llm_rejected"), F.col("llm_candidates")))


def issues(scored: DataFrame, fail_on_leak: bool = True) -> DataFrame:
    """issue, severity, page, ratio, n: a row for each page that stayed largely unchanged, and one for all leaks."""
    high = scored.where("high_unchanged").select(F.lit("high_unchanged_ratio").alias("issue"), F.lit("warning").alias("severity"), "page", unchanged_ratio().alias("ratio"), F.lit(None).cast("bigint").alias("n"))
    leaks = scored.where("leak").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("zxq_leak").alias("issue"), F.lit("error" if fail_on_leak else "warning").alias("severity"), F.lit(None).cast("bigint").alias("page"), F.lit(None).cast("double").alias("ratio"), "n")
    return high.unionByName(leaks)


def gates(scored: DataFrame, threshold: int = 0, fail_on_leak: bool = True) -> DataFrame:
    """max_score, score_failed (never with a threshold of 0) and leak_failed."""
    most = F.coalesce(F.max("score"), F.lit(0))
    leak = F.coalesce(F.bool_or("leak"), F.lit(False)) & F.lit(fail_on_leak)
    return scored.agg(most.alias("max_score"), ((most >= threshold) & F.lit(threshold > 0)).alias("score_failed"), leak.alias("leak_failed"))


def failure_runs(attempts: DataFrame, in_a_row: int = 3, in_all: int = 10) -> DataFrame:
    """Attempts up to the one at which a run is given up, with the counters."""
    w = W.partitionBy("run_id").orderBy("ts", "event_id")
    x = attempts.withColumns({"n": F.row_number().over(w), "total": F.sum(F.col("failed").cast("int")).over(w)})
    x = x.withColumn("last_ok", F.max(F.when(~F.col("failed"), F.col("n"))).over(w)).withColumn("streak", F.when(F.col("failed"), F.col("n") - F.coalesce("last_ok", F.lit(0))).otherwise(0))
    x = x.withColumn("fatal", F.col("failed") & ((F.col("streak") >= in_a_row) | (F.col("total") >= in_all)))
    before = F.coalesce(F.max(F.col("fatal").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("before", before).where("before = 0").select("run_id", "event_id", "total", F.col("streak").cast("int").alias("streak"), "fatal")
