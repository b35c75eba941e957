"""Registered queries of problems 2, 3 and 5 to 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.llm.canonical import mapped_values
from tidewell.llm.cutoff import kept_signals
from tidewell.llm.leakage import leaked_items, removal_spans
from tidewell.llm.packing import packed_documents
from tidewell.llm.pairs import defective_answers
from tidewell.llm.reading import grader_of, reading_levels
from tidewell.llm.variants import linked_answers
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()

@plans.query("p5_found")
def p5_found(spark, folder):
    return defective_answers(load(spark, folder, "answers"))


_CUTOFF_SQL = """
    WITH s AS (SELECT DISTINCT source, signal_id, score FROM p_plus20_current WHERE score IS NOT NULL AND NOT isnan(score)),
    r AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY score DESC) AS kept, count(*) OVER (PARTITION BY source) AS n FROM s),
    c AS (SELECT source, max(score) AS cutoff, min(kept) AS kept FROM r JOIN score_targets USING (source)
          WHERE 100 * kept >= target_percent * n GROUP BY source)
"""


@plans.query("p6_found", _CUTOFF_SQL + "SELECT source, signal_id FROM s JOIN c USING (source) WHERE score >= cutoff")
def p6_found(spark, folder):
    return kept_signals(load(spark, folder, "p_plus20_current"), load(spark, folder, "score_targets"))[0]


@plans.query("p6_cutoffs", _CUTOFF_SQL + "SELECT source, cutoff, kept FROM c")
def p6_cutoffs(spark, folder):
    return kept_signals(load(spark, folder, "p_plus20_current"), load(spark, folder, "score_targets"))[1]


@plans.query("p2_found")
def p2_found(spark, folder):
    return linked_answers(load(spark, folder, "answers"), load(spark, folder, "answer_key"), load(spark, folder, "universe"))


@plans.query("p3_found")
def p3_found(spark, folder):
    aliases = load(spark, folder, "alias_golden").where("kind is null").select("alias_id", "name").distinct()
    mapped = mapped_values(aliases, load(spark, folder, "universe"))
    return aliases.join(mapped, "name", "left").select("alias_id", F.coalesce("cik", F.lit("unmatched")).alias("cik"))


@plans.query("p7_containers")
def p7_containers(spark, folder):
    return packed_documents(load(spark, folder, "documents"))


def _leaks(spark, folder):
    return leaked_items(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


@plans.query("p8_found")
def p8_found(spark, folder):
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


@plans.query("p8_removal_spans")
def p8_removal_spans(spark, folder):
    return removal_spans(_leaks(spark, folder))


@plans.query("p9_reading_level")
def p9_reading_level(spark, folder):
    return reading_levels(load(spark, folder, "documents"), load(spark, folder, "reading_labels"))


@plans.query("p9_source_profile")
def p9_source_profile(spark, folder):
    """How demanding the English texts of each source are, with the graded documents and the mean held-out error behind that."""
    documents, labels = load(spark, folder, "documents"), load(spark, folder, "reading_labels")
    grader = grader_of(documents, labels)
    levels = reading_levels(documents, labels, grader)
    mine = F.when(F.col("english"), F.col("grade"))
    profile = levels.groupBy("source").agg(
        F.count("grade").alias("documents"), F.count(mine).alias("english"), F.avg(mine).alias("mean_grade"),
        F.percentile_approx(mine, 0.5, 1000).alias("median_grade"), F.percentile_approx(mine, 0.9, 1000).alias("p90_grade"))
    known = [(n, grader.graded[n], grader.report[n]) for n in sorted(grader.graded)] if grader else []
    report = spark.createDataFrame(known, "name string, graded int, held_out_error double")
    return profile.join(F.broadcast(report), F.coalesce("source", F.lit("")) == F.col("name"), "left").drop("name")  # one row a source


def queries():
    return dict(plans.queries)


def oracle_sql():
    return dict(plans.sql)
