"""Validation of benchmark, task and answer tables; every problem is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.evaluate import quantiles
from lodestar.operators.nested import key_paths


def problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, problem: one row for each failed check of each row."""
    tests = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return rows.select(key, F.explode(tests).alias("problem"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"))


def validate_benchmark(questions: DataFrame, expected: int | None = None) -> DataFrame:
    """qid, problem. questions: qid, options array<struct<label,text>>, gold_label."""
    labels = F.transform("options", lambda o: o["label"])
    checks = {"fewer than two options": F.size("options") >= 2, "repeated label": F.size(F.array_distinct(labels)) == F.size(labels), "gold label not among options": F.array_contains(labels, F.col("gold_label"))}
    found = problems(questions, "qid", checks).unionByName(duplicate_keys(questions, "qid"))
    if expected is None:
        return found
    kind = questions.schema["qid"].dataType
    wrong = questions.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return found.unionByName(wrong.select(F.lit(None).cast(kind).alias("qid"), F.lit("unexpected number of questions").alias("problem")))


def gold_paths(rows: DataFrame, key: str, json: str, word: str = "gold") -> DataFrame:
    """key, path (`$.a[3].gold_x`) of JSON keys that name the gold, at any depth; text that isn't JSON has none."""
    return key_paths(rows.select(key, F.try_parse_json(json).alias("node")), key, "node", word=word)


def validate_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, problem: unknown or repeated questions, labels not offered, latencies that aren't finite and non-negative."""
    offered = questions.select("qid", F.transform("options", lambda o: o["label"]).alias("labels"))
    rows = answers.join(offered, "qid", "left")
    latency = F.col("latency_seconds")
    checks = {"unknown question": F.col("labels").isNotNull(), "label not offered": F.array_contains("labels", F.col("selected_label")), "bad latency": latency.isNotNull() & ~F.isnan(latency) & (latency >= 0) & (latency < float("inf"))}
    missing = questions.select("qid").join(answers.select("qid"), "qid", "left_anti").select("qid", F.lit("missing answer").alias("problem"))
    return reduce(DataFrame.unionByName, [problems(rows, "qid", checks), duplicate_keys(answers, "qid"), missing])


def remaining(tasks: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def release_files(files: DataFrame, forbidden: tuple[str, ...], required: tuple[str, ...], path: str = "path") -> DataFrame:
    """path, problem: files that match a forbidden pattern, and required ones that are missing."""
    bad = files.where(F.col(path).rlike("|".join(f"(?:{p})" for p in forbidden))).select(path, F.lit("forbidden").alias("problem"))
    need = files.sparkSession.createDataFrame([(p,) for p in required], f"{path} string")
    return bad.unionByName(need.join(files.select(path), path, "left_anti").withColumn("problem", F.lit("missing")))


def host_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: n, accuracy, citation rate, latency statistics. answers: qid, selected_label, n_citations, latency_seconds."""
    rows = questions.select("qid", "gold_label").join(answers, "qid")
    hit = F.coalesce(F.col("selected_label") == F.col("gold_label"), F.lit(False))
    plain = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.count_if(hit) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("accuracy"),
        F.round(F.count_if(F.col("n_citations") > 0) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("citation_rate"),
        F.round(F.avg("latency_seconds"), 6).alias("mean_latency"),
    )
    places = quantiles(rows, "latency_seconds", {"median_latency": (0.5, False), "p95_latency": (0.95, True)}, [])
    one = F.lit(True)  # without latencies there is no row of quantiles
    return plain.join(places.select(F.round("median_latency", 6).alias("median_latency"), "p95_latency"), one, "left")
