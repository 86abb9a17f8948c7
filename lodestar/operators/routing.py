"""Routing of questions to retrieval strategies, with a memory of what worked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.predicates import scene
from lodestar.functions.rules import STRATEGIES
from lodestar.operators.retrieve import top_k


def with_scene(questions: DataFrame) -> DataFrame:
    report = F.col("report_id") if "report_id" in questions.columns else None
    return questions.withColumn("scene", scene(F.col("question"), report))


def memory_matches(scenes: DataFrame, memory: DataFrame, limit: int = 3) -> DataFrame:
    """qid, pos, strategy_used, retrieval_backend, evidence_top_k, score, rank.

    2 for the same task type and 1 for each shared domain tag; records count only if their
    evidence was sufficient. A record scores above 0 exactly if it shares the task type or
    a tag, so both are joined by equality instead of crossing questions with the log. Only
    task and tags matter, so distinct combinations of them meet (some hundreds), each with
    its first `limit` records.
    """
    q = scenes.select("qid", F.col("scene.task_type").alias("task"), F.array_sort("scene.domain_tags").alias("tags"))
    kinds = q.select("task", "tags").distinct()
    m = memory.where("evidence_status = 'sufficient'").select("pos", F.col("task_type").alias("m_task"), F.array_sort(F.array_distinct("domain_tags")).alias("m_tags"))
    m = top_k(m, limit, ["m_task", "m_tags"], [F.col("pos")], "of_kind")
    have = m.select("m_task", "m_tags").distinct()
    by_task = kinds.join(have, F.col("task") == F.col("m_task")).select("task", "tags", "m_task", "m_tags", F.lit(2).alias("points"))
    tagged = have.select("m_task", "m_tags", F.explode("m_tags").alias("tag"))
    by_tag = kinds.select("task", "tags", F.explode("tags").alias("tag")).join(tagged, "tag").select("task", "tags", "m_task", "m_tags", F.lit(1).alias("points"))
    scored = by_task.unionAll(by_tag).groupBy("task", "tags", "m_task", "m_tags").agg(F.sum("points").alias("score"))
    of_kind = top_k(scored.join(m, ["m_task", "m_tags"]), limit, ["task", "tags"], [F.col("score").desc(), F.col("pos")]).select("task", "tags", "pos", "score", "rank")
    best = q.join(of_kind, ["task", "tags"]).select("qid", "pos", "score", "rank")
    return best.join(memory.select("pos", "strategy_used", "retrieval_backend", "evidence_top_k"), "pos")


def select_strategy(scenes: DataFrame, dense_available: bool, matches: DataFrame | None = None) -> DataFrame:
    """qid, strategy, backend, evidence_top_k, memory_match_count.

    The best usable remembered strategy, else the table's by scope and task type. A
    remembered hybrid becomes sparse where there is no dense index.
    """
    task = F.col("scene.task_type")
    synthesis = "synthesis_dense" if dense_available else "synthesis_sparse"
    key = F.when(task == "out_of_scope", "out_of_scope").when(F.col("scene.has_report_scope"), "scoped").when(task.isin("comparison", "multi_report_synthesis"), synthesis).when(task.isin(*STRATEGIES), task).otherwise("direct_fact")
    row = lambda i: F.coalesce(*(F.when(F.col("key") == k, F.lit(v[i])) for k, v in STRATEGIES.items()))
    rows = scenes.select("qid", key.alias("key")).select("qid", row(0).alias("strategy"), row(1).alias("backend"), row(2).alias("evidence_top_k"))
    if matches is None:
        return rows.withColumn("memory_match_count", F.lit(0).cast("long"))
    usable = (F.col("strategy_used") != "") & F.col("retrieval_backend").isin("sparse", "hybrid")
    per = matches.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("strategy_used", "retrieval_backend", "evidence_top_k"), F.when(usable, F.col("rank"))).alias("m"))
    backend = F.col("m.retrieval_backend") if dense_available else F.lit("sparse")
    rows = rows.join(per, "qid", "left")
    known = F.col("m").isNotNull()
    return rows.select(
        "qid",
        F.when(known, F.col("m.strategy_used")).otherwise(F.col("strategy")).alias("strategy"),
        F.when(known, backend).otherwise(F.col("backend")).alias("backend"),
        F.when(known, F.col("m.evidence_top_k")).otherwise(F.col("evidence_top_k")).alias("evidence_top_k"),
        F.when(known, F.col("n")).otherwise(0).cast("long").alias("memory_match_count"),
    )


BACKENDS = ("sparse", "hybrid", "auto", "routed")


def dense_status(meta: DataFrame | None, allow_hash: bool = False) -> str:
    """missing, unreadable, hash or semantic, from a dense index's one-row metadata."""
    if meta is None:
        return "missing"
    if "embedding_backend" not in meta.columns:
        return "unreadable"
    row = meta.first()
    if row is None:
        return "missing"
    backend = (row["embedding_backend"] or "").lower()
    name = (row["embedding_model_name"] or "").lower() if "embedding_model_name" in meta.columns else ""
    hashed = backend in ("hash", "hash_fallback") or name in ("hash", "hash-fallback", "hash_fallback")
    return "hash" if hashed and not allow_hash else "semantic"


def backends(requested: str, status: str) -> tuple[str, list[tuple[str, str]]]:
    """The backend to use for a request, and warnings (code, message): auto falls back to sparse without a semantic index."""
    if requested not in BACKENDS:
        raise ValueError(f"unknown retrieval backend: {requested}")
    if requested == "hybrid" and status == "missing":
        raise ValueError("hybrid retrieval needs a dense index")
    if requested == "auto":
        return ("hybrid", []) if status == "semantic" else ("sparse", [("hybrid_retrieval_unavailable", f"The dense index is {status}; sparse retrieval is used.")])
    return requested, []
