"""Benchmark generators: questions from catalogs, assets and raw exam rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import phrase, slug_words
from lodestar.sources.shared import fresh_folder, saved

# Question templates by kind.
TEMPLATES = (("scope", "What does {title} cover?"), ("guidance", "Which guidance does {title} give?"), ("definition", "What is {topic} according to {title}?"), ("locator", "Which section of {title} discusses {topic}?"), ("comparison", "Compare {title} with similar reports on {topic}."))


def topic_questions(catalog: DataFrame, controls: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Every template for every source (doc_id, title, pos), then the controls (pos, question), numbered in order."""
    rows = catalog.select("doc_id", "title", "pos", F.posexplode(F.array(*(F.struct(F.lit(k).alias("type"), F.lit(t).alias("text")) for k, t in templates))).alias("at", "t"))
    text = F.replace(F.replace(F.col("t.text"), F.lit("{title}"), F.col("title")), F.lit("{topic}"), slug_words("title", 3))
    inside = rows.select(F.lit(0).alias("side"), "pos", "at", text.alias("question"), F.col("t.type").alias("type"), F.col("doc_id").alias("report_id"), F.lit(False).alias("expected_abstain"))
    outside = controls.select(F.lit(1).alias("side"), "pos", F.lit(0).alias("at"), "question", F.lit("control").alias("type"), F.lit(None).cast("string").alias("report_id"), F.lit(True).alias("expected_abstain"))
    return numbered(inside.unionByName(outside), ["side", "pos", "at"], "q")


def numbered(rows: DataFrame, order: list[str], mark: str) -> DataFrame:
    """Sequential qids in the order of `order`, which has to be unique.

    Rows are sorted by ranges and stored; a row's number is its place in its range and the
    rows of the ranges before, of which there are as many as partitions.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = saved(placed, fresh_folder(rows.sparkSession, "numbered"), "rows")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return out.withColumn("qid", F.format_string(f"{mark}%04d", number)).drop("side", "at", "_part", "_base", "_place")


def asset_questions(assets: DataFrame, n: int = 60) -> DataFrame:
    """Round-robin over documents: tables of two or more rows and images, n of each."""
    usable = assets.where("asset_type <> 'table' OR rows >= 2")
    turn = F.row_number().over(Window.partitionBy("doc_id", "asset_type").orderBy("page", "asset_id"))
    place = F.row_number().over(Window.partitionBy("asset_type").orderBy("turn", "doc_id"))
    rows = usable.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= n)
    label = F.when(F.trim(F.coalesce("caption", F.lit(""))) != "", phrase("caption")).when(F.col("asset_type") == "table", F.format_string("detected table with %d rows and %d columns", "rows", "columns")).otherwise("detected image")
    text = F.concat(F.lit("Which page shows the "), F.col("asset_type"), F.lit(" on "), label, F.lit("?"))
    return rows.select("doc_id", "asset_id", "asset_type", F.col("page").alias("expected_page"), F.lit(1).alias("expected_page_window"), text.alias("question"), "place")


def with_required(targets: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Targets joined with their assets; raises if one has none."""
    missing = [r[0] for r in targets.join(assets.select(key), key, "left_anti").select(key).limit(20).collect()]
    if missing:
        raise ValueError(f"targets without {key}: {', '.join(map(str, missing))}")
    return targets.join(assets, key)


def gold_targets(external: DataFrame, targets: DataFrame, catalog: DataFrame, marks: tuple[str, str] = ("external", "report")) -> DataFrame:
    """Answer targets as questions: external ones (pos, question, groups), then those of reports (pos, doc_id, question, groups) with their catalog's source.

    Gives qid, question, profile, expected_answer_groups, expected_doc_ids, source_urls, expected_abstain.
    """
    none = F.array().cast("array<string>")
    a = external.select(F.lit(0).alias("side"), "pos", F.lit(0).alias("at"), "question", F.lit(marks[0]).alias("profile"), F.col("groups").alias("expected_answer_groups"), none.alias("expected_doc_ids"), none.alias("source_urls"))
    b = targets.join(catalog.select("doc_id", "source_url"), "doc_id", "left")
    b = b.select(F.lit(1).alias("side"), "pos", F.lit(0).alias("at"), "question", F.lit(marks[1]).alias("profile"), F.col("groups").alias("expected_answer_groups"), F.array("doc_id").alias("expected_doc_ids"), F.array(F.coalesce("source_url", F.lit(""))).alias("source_urls"))
    return numbered(a.unionByName(b).withColumn("expected_abstain", F.lit(False)), ["side", "pos", "at"], "gold_q")


def agent_tasks(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Task rows: those in scope (pos, task, mode, question, expected_doc_ids, ...), which cite, then controls to be refused."""
    a = inside.withColumns({"side": F.lit(0), "at": F.lit(0), "expected_citations": F.lit(True), "expected_abstain": F.lit(False), "profile": F.lit("agent_task")})
    b = outside.withColumns({"side": F.lit(1), "at": F.lit(0), "expected_doc_ids": F.array().cast("array<string>"), "expected_abstain": F.lit(True), "profile": F.lit("agent_task_hard_ood")})
    return numbered(a.unionByName(b, allowMissingColumns=True), ["side", "pos", "at"], "agent_task_q")


def host_view(questions: DataFrame) -> DataFrame:
    """Questions without any gold column."""
    return questions.select(*(c for c in questions.columns if "gold" not in c and not c.startswith("expected_")))


def exam_questions(raw: DataFrame) -> DataFrame:
    """question, options, gold_label, n_gold from rows (question, pos, choice, correct); valid if n_gold = 1."""
    label = F.char(F.lit(64) + F.row_number().over(Window.partitionBy("question").orderBy("pos")))
    rows = raw.withColumn("label", label)
    per = rows.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("label", F.col("choice").alias("text")))).alias("options"), F.min(F.when(F.col("correct"), F.col("label"))).alias("gold_label"), F.count_if("correct").alias("n_gold"))
    return per.withColumn("valid", F.col("n_gold") == 1)
