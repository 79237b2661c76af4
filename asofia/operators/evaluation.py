"""Retrieval and answer evaluation over tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.functions import temporal

DEPTHS = (1, 5, 10)
METRICS = [*(f"{m}_{k}" for k in DEPTHS for m in ("hit", "recall")), "mrr"]


def question_metrics(relevant: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hit and recall at 1, 5 and 10 and the reciprocal rank, per question that has relevant documents."""
    rows = relevant.select("qid", "doc_id").distinct().join(ranked.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    within = {k: F.count(F.when(F.col("rank") <= k, 1)) for k in DEPTHS}
    scores = [x for k in DEPTHS for x in ((within[k] > 0).cast("int").cast("double").alias(f"hit_{k}"), (within[k] / F.count(F.lit(1))).alias(f"recall_{k}"))]
    return rows.groupBy("qid").agg(*scores, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"))


def checked_golden(golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with the reason: a missing field, a date that is none, no relevant ids, an id met twice."""
    day = F.try_to_date("as_of_text", "yyyy-MM-dd")
    twice = golden.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    rows = golden.join(twice, "id", "left").withColumn(
        "reason",
        F.when(F.col("id").isNull() | F.col("question").isNull(), "missing field").when(F.col("as_of_text").isNotNull() & day.isNull(), "bad date")
        .when(F.coalesce(F.size("relevant"), F.lit(0)) <= 0, "no relevant ids").when(F.col("rows") > 1, "duplicate id"),
    )
    return rows.filter("reason is null").drop("reason", "rows").withColumn("as_of", day), rows.filter("reason is not null")


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(*(F.round(F.avg(m), 9).alias(m) for m in METRICS))


def by_tag(metrics: DataFrame, tags: DataFrame) -> DataFrame:
    """Means per tag, a question counting under each of its own, and over all."""
    rows = metrics.join(tags, "qid", "left").withColumn("tag", F.explode(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit("all"))))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 9).alias(m) for m in METRICS))


def long_results(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot("qid", METRICS, "metric", "score")


def unknown_relevant(relevant: DataFrame, docs: DataFrame) -> DataFrame:
    return relevant.join(docs.select("doc_id"), "doc_id", "left_anti").select("qid", "doc_id")


def misses(metrics: DataFrame, relevant: DataFrame, ranked: DataFrame, depth: int = 10) -> DataFrame:
    """Questions without a hit, with what was wanted and the first five that were found."""
    missed = metrics.filter(F.col(f"hit_{depth}") == 0).select("qid")
    wanted = relevant.groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("wanted"))
    got = ranked.filter("rank <= 5").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("got"))
    return missed.join(wanted, "qid").join(got, "qid", "left").select("qid", "wanted", F.coalesce("got", F.array().cast("array<long>")).alias("got"))


def in_force_rate(questions: DataFrame, ranked: DataFrame, docs: DataFrame, today: str, depth: int = 5) -> DataFrame:
    """Share of the first documents that are in force on the question's day; 1 where none was found."""
    windows = docs.select("doc_id", "valid_from", "valid_to", "is_withdrawn")
    rows = questions.select("qid", "as_of").join(ranked.filter(F.col("rank") <= depth), "qid", "left").join(windows, "doc_id", "left")
    ok = temporal.counted_in_force(F.col("valid_from"), F.col("valid_to"), F.coalesce("is_withdrawn", F.lit(False)), F.col("as_of"), F.lit(today).cast("date"))
    return rows.groupBy("qid").agg(F.coalesce(F.avg(F.when(F.col("doc_id").isNotNull(), ok.cast("int"))), F.lit(1.0)).alias("in_force"))


RUN_CONFIG = "git_dirty boolean, retriever string, apply_as_of boolean, questions int, summary map<string,double>"


def runs(table: DataFrame) -> DataFrame:
    """Lift the fields of the JSON configuration, missing ones to null, false or an empty map, and mark the headline run."""
    c = F.from_json("config", RUN_CONFIG)
    rows = table.select("run_id", "git_sha", c.alias("c")).select("run_id", "git_sha", "c.git_dirty", "c.retriever", F.coalesce("c.apply_as_of", F.lit(False)).alias("apply_as_of"), "c.questions", F.coalesce("c.summary", F.create_map().cast("map<string,double>")).alias("summary"))
    last = rows.agg(F.max_by("run_id", F.struct("apply_as_of", "run_id")).alias("headline_id"))
    return rows.join(F.broadcast(last)).withColumn("headline", F.col("run_id") == F.col("headline_id")).drop("headline_id")


def run_record(metrics: DataFrame, config: dict[str, str]) -> DataFrame:
    """One row: the configuration with the summary, as JSON."""
    fields = [F.lit(v).alias(k) for k, v in config.items()]
    return summary(metrics).select(F.to_json(F.struct(*fields, F.struct(*METRICS).alias("summary"))).alias("config"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """``answered, grounded, cites_relevant, cites_in_force`` per question; a failed one scores 0 for answered.

    ``answers``: ``qid, answered, kept, dropped, cited`` (ids), ``relevant`` (ids), ``in_force`` (ids among the cited).
    """
    cited = F.array_distinct("cited")
    share = F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, "in_force")) / F.size(cited)).otherwise(0.0)
    total = F.col("kept") + F.col("dropped")
    return answers.select(
        "qid", F.coalesce(F.col("answered").cast("int"), F.lit(0)).alias("answered"), F.when(total > 0, F.col("kept") / total).otherwise(0.0).alias("grounded"),
        F.arrays_overlap(cited, "relevant").cast("int").alias("cites_relevant"), share.alias("cites_in_force"),
    )


def answer_summary(scores: DataFrame) -> DataFrame:
    """Answered over all questions, the rest over the answered ones, 0 if there are none."""
    over = lambda c: F.coalesce(F.avg(F.when(F.col("answered") == 1, F.col(c))), F.lit(0.0)).alias(c)
    return scores.agg(F.coalesce(F.avg("answered"), F.lit(0.0)).alias("answered"), *map(over, ("grounded", "cites_relevant", "cites_in_force")))
