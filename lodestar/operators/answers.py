"""Extractive answers with citations from ranked evidence.

Evidence rows have qid, question, rank, chunk_id, section, text (and what reranking needs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.rules import LISTING_QUERY, WEAK_SECTIONS
from lodestar.functions.text import UNKNOWN, answer_sentences, collapse_ws, enumeration_bonus, jaccard, query_terms, share_of, token_set
from lodestar.operators.rerank import lexical_score, minmax

SHORTEST, LONGEST = 40, 700
STOP, SAME = 0.08, 0.82


def sentence_candidates(evidence: DataFrame, weak: tuple[str, ...] = WEAK_SECTIONS) -> DataFrame:
    """Scored sentences; those of weak sections only where a question has no others."""
    rows = evidence.select("qid", "question", "rank", "chunk_id", "title", "section", "subsection", F.posexplode(answer_sentences("text")).alias("sentence_idx", "sentence"))
    rows = rows.where(F.char_length("sentence").between(SHORTEST, LONGEST))
    section = F.upper(F.coalesce("section", F.lit("")))
    overlap = share_of(F.array_distinct(query_terms("question")), token_set("sentence"))
    score = overlap + 0.20 / F.col("rank") - F.when(section.isin(*weak), 0.65).otherwise(0.0) - F.when(section == UNKNOWN, 0.03).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("body", ~section.isin(*weak))
    rows = rows.withColumn("any_body", F.max("body").over(Window.partitionBy("qid")))
    return rows.where("body OR NOT any_body").drop("body", "any_body")


def semantic_order(candidates: DataFrame, model: Column | None = None) -> DataFrame:
    """Scores sentences as the reranker scores chunks, the prior being 1/rank, plus the listing bonus."""
    from lodestar.functions.predicates import blend_weights

    text = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("section", F.lit(UNKNOWN)), F.nullif("subsection", F.lit(UNKNOWN)), "sentence")
    raw = model if model is not None else lexical_score(F.col("question"), text)
    rows = candidates.withColumn("m", raw).withColumn("p", 1.0 / F.col("rank")).withColumn("w", blend_weights(F.col("question")))
    rows = rows.withColumn("mn", minmax(F.col("m"))).withColumn("pn", minmax(F.col("p")))
    score = F.col("w.model") * F.col("mn") + F.col("w.prior") * F.col("pn") + enumeration_bonus(F.col("question"), F.col("sentence"), LISTING_QUERY)
    return rows.withColumn("score", F.round(score, 6)).drop("m", "p", "w", "mn", "pn")


def greedy(candidates: DataFrame, most: int = 4, per_chunk: int | None = 2, same: float | None = SAME) -> DataFrame:
    """Selected sentences by question, in order of selection.

    Best first; skipped are repeats, scores under the stop value once something is chosen,
    a chunk's third sentence and near repeats of chosen ones. A fold over one question's
    candidates (a bounded list: its evidence has few chunks).
    """
    item = F.struct((-F.col("score")).alias("minus"), "rank", "sentence_idx", "chunk_id", "sentence", token_set("sentence").alias("set"))
    lists = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = lists.schema["all"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        skip = (F.size(acc) >= most) | F.exists(acc, lambda s: F.lower(s["sentence"]) == F.lower(x["sentence"])) | ((F.size(acc) > 0) & (-x["minus"] < STOP))
        if per_chunk is not None:
            skip = skip | ((x["chunk_id"] != "") & (F.size(F.filter(acc, lambda s: s["chunk_id"] == x["chunk_id"])) >= per_chunk))
        if same is not None:
            skip = skip | F.exists(acc, lambda s: jaccard(s["set"], x["set"]) >= same)
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(x)))

    chosen = lists.select("qid", F.posexplode(F.aggregate("all", F.array().cast(kind), step)).alias("at", "s"))
    return chosen.select("qid", (F.col("at") + 1).alias("place"), F.col("s.rank").alias("rank"), F.col("s.chunk_id").alias("chunk_id"), F.col("s.sentence").alias("sentence"), (-F.col("s.minus")).alias("score"))


def with_fallback(chosen: DataFrame, evidence: DataFrame) -> DataFrame:
    """Questions without a chosen sentence get the head of their first evidence."""
    text = collapse_ws("text")
    head = F.when(F.char_length(text) > LONGEST, F.concat(F.rtrim(F.substring(text, 1, LONGEST)), F.lit("..."))).otherwise(text)
    first = evidence.where("rank = 1").join(chosen.select("qid").distinct(), "qid", "left_anti")
    return chosen.unionByName(first.select("qid", F.lit(1).alias("place"), "rank", "chunk_id", head.alias("sentence"), F.lit(0.0).alias("score")))


def excerpt(text: Column, sentence: Column, before: int = 220, after: int = 480) -> Column:
    """The sentence with its surroundings, dots where the text goes on."""
    whole = collapse_ws(text)
    at = F.greatest(F.instr(F.lower(whole), F.lower(sentence)) - 1, F.lit(0))
    start = F.greatest(at - before, F.lit(0))
    end = F.least(F.char_length(whole), at + F.char_length(sentence) + after)
    body = F.trim(F.substring(whole, start + 1, end - start))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.char_length(whole), "...").otherwise(""))


def assemble(chosen: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, answer, used_evidence_ids: bullets with E-ids, then excerpts of the first two used rows."""
    rows = chosen.join(evidence.select("qid", "rank", "text"), ["qid", "rank"])
    item = F.struct("place", "rank", "sentence", excerpt(F.col("text"), F.col("sentence")).alias("excerpt"))
    per = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    eid = lambda r: F.concat(F.lit("E"), r.cast("string"))
    per = per.withColumn("used", F.array_distinct(F.transform("all", lambda x: x["rank"])))
    firsts = F.transform(F.slice("used", 1, 2), lambda r: F.get(F.filter("all", lambda x: x["rank"] == r), F.lit(0)))
    bullets = F.array_join(F.transform("all", lambda x: F.concat(F.lit("- "), x["sentence"], F.lit(" ["), eid(x["rank"]), F.lit("]"))), "\n")
    extra = F.filter(firsts, lambda x: (x["excerpt"] != "") & (x["excerpt"] != x["sentence"]))
    more = F.array_join(F.transform(extra, lambda x: F.concat(F.lit("["), eid(x["rank"]), F.lit("] "), x["excerpt"])), "\n\n")
    answer = F.concat(F.lit("Evidence-grounded extractive summary:\n"), bullets, F.when(F.size(extra) > 0, F.concat(F.lit("\n\nSupporting evidence excerpts:\n"), more)).otherwise(""))
    return per.select("qid", answer.alias("answer"), F.transform("used", eid).alias("used_evidence_ids"))


def gathered(evidence: DataFrame) -> DataFrame:
    """The same rows, through one exchange by question that all that is read from them shares: a question's evidence is a few rows."""
    columns = [c for c in ("rank", "chunk_id", "title", "section", "subsection", "text") if c in evidence.columns]
    held = evidence.groupBy("qid", "question").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return held.select("qid", "question", F.inline("rows"))


def extractive_answers(evidence: DataFrame, selector: str = "auto", model: Column | None = None) -> DataFrame:
    if selector not in ("auto", "semantic_coverage", "lexical"):
        raise ValueError(f"unknown selector: {selector}")
    evidence = gathered(evidence)
    candidates = sentence_candidates(evidence)
    chosen = greedy(candidates, 3, None, None) if selector == "lexical" else greedy(semantic_order(candidates, model))
    return assemble(with_fallback(chosen, evidence), evidence)


def asset_answers(evidence: DataFrame, nearby: DataFrame, most: int = 5, width: int = 1800) -> DataFrame:
    """For questions about tables and figures: up to five distinct assets near the evidence.

    nearby: chunk_id, asset_id, asset_type, asset_page, caption, text_preview, rank.
    """
    n = nearby.withColumnRenamed("rank", "near").withColumn("said", F.concat_ws("; ", F.nullif(collapse_ws("caption"), F.lit("")), F.nullif(collapse_ws("text_preview"), F.lit(""))))
    rows = evidence.select("qid", "rank", "chunk_id").join(n, "chunk_id").where("asset_id <> '' AND said <> ''")
    first = rows.groupBy("qid", "asset_id").agg(F.min_by(F.struct("rank", "near", "asset_type", "asset_page", F.substring("said", 1, width).alias("said")), F.struct("rank", "near")).alias("a"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("a.rank", "a.near"))
    rows = first.withColumn("place", place).where(F.col("place") <= most)
    page = F.when(F.col("a.asset_page") > 0, F.concat(F.lit("p. "), F.col("a.asset_page").cast("string"))).otherwise("page unknown")
    line = F.concat(F.lit("[E"), F.col("a.rank").cast("string"), F.lit("] "), F.col("a.asset_type"), F.lit(" "), F.col("asset_id"), F.lit(" ("), page, F.lit("): "), F.col("a.said"))
    per = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), F.concat(F.lit("E"), F.col("a.rank").cast("string")).alias("eid")))).alias("all"))
    return per.select("qid", F.concat(F.lit("Evidence-grounded asset extract:\n\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n\n")).alias("answer"), F.array_distinct(F.transform("all", lambda x: x["eid"])).alias("used_evidence_ids"))


def grounded_prompt(evidence: DataFrame) -> DataFrame:
    """qid, prompt: the question and its numbered evidence, for a generator to answer from."""
    block = F.concat(F.lit("[E"), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"))
    per = evidence.groupBy("qid", "question").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["block"]), "\n\n")
    return per.select("qid", F.concat(F.lit("Answer from the evidence alone and cite it as [E1], [E2].\n\nQuestion: "), F.col("question"), F.lit("\n\nEvidence:\n"), body).alias("prompt"))


def generated(prompts: DataFrame, generate) -> DataFrame:
    """qid, raw: the hook for generators; `generate` maps a list of prompts to a list of texts."""

    def run(batches):
        for pdf in batches:
            yield pdf[["qid"]].assign(raw=generate(pdf["prompt"].tolist()))

    return prompts.select("qid", "prompt").mapInPandas(run, f"qid {prompts.schema['qid'].dataType.simpleString()}, raw string")


def model_answers(raw: DataFrame, citations: DataFrame) -> DataFrame:
    """Parses generated JSON and keeps evidence ids that exist. raw: qid, raw; citations: qid, evidence_ids."""
    from lodestar.functions.text import json_object

    rows = raw.withColumn("v", json_object("raw")).join(citations, "qid", "left")
    ids = F.coalesce(F.try_variant_get("v", "$.used_evidence_ids", "array<string>"), F.array().cast("array<string>"))
    return rows.select("qid", F.try_variant_get("v", "$.answer", "string").alias("answer"), F.array_intersect(ids, F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("used_evidence_ids"), F.col("v").isNotNull().alias("parsed"))


# Error codes and the exit codes of the command line.
ERRORS = {
    "missing_index": 2,
    "out_of_scope": 3,
    "insufficient_evidence": 4,
    "missing_model_path": 5,
    "empty_corpus": 6,
    "ocr_required": 7,
    "runtime_failure": 1,
}


def failure(tests: list[tuple[Column, str, Column | str]]) -> Column:
    """Struct code, message of the first test that holds; null if none does."""
    text = lambda m: m if isinstance(m, Column) else F.lit(m)
    for _, code, _ in tests:
        if code not in ERRORS:
            raise ValueError(f"unknown error code: {code}")
    return F.coalesce(*(F.when(test, F.struct(F.lit(code).alias("code"), text(message).alias("message"))) for test, code, message in tests))


def blank_question(question: Column) -> tuple[Column, str, str]:
    return F.trim(F.coalesce(question, F.lit(""))) == "", "out_of_scope", "A non-empty question is required."


def envelope(questions: DataFrame, answers: DataFrame, sufficient: DataFrame) -> DataFrame:
    """One row a question: ok, code, message, answer, abstained. An error is a row, not an exception.

    A question whose evidence isn't sufficient gets the code insufficient_evidence.
    """
    rows = questions.join(answers, "qid", "left").join(sufficient.select("qid", "sufficient"), "qid", "left")
    weak = ~F.coalesce("sufficient", F.lit(False))
    rows = rows.withColumn("error", failure([blank_question(F.col("question")), (weak, "insufficient_evidence", "The evidence is insufficient to answer this question.")]))
    fine = F.col("error").isNull()
    return rows.select("qid", fine.alias("ok"), F.col("error.code").alias("code"), F.col("error.message").alias("message"), F.when(fine, F.col("answer")).alias("answer"), (~fine).alias("abstained"))


def response_schema(labels: Column) -> Column:
    """JSON schema of a host's answer: one of the distinct labels, and citations. Null without labels or with an empty one."""
    names = F.array_distinct(labels)
    choice = F.struct(F.lit("string").alias("type"), names.alias("enum"))
    cited = F.struct(F.lit("array").alias("type"), F.struct(F.lit("string").alias("type")).alias("items"))
    whole = F.struct(F.lit("object").alias("type"), F.lit(False).alias("additionalProperties"), F.struct(choice.alias("selected_label"), cited.alias("citations")).alias("properties"), F.array(F.lit("selected_label"), F.lit("citations")).alias("required"))
    usable = (F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0) & ~F.array_contains(names, "")
    return F.when(usable, F.to_json(whole))


def parse_response(text: Column, labels: Column) -> Column:
    """Struct selected_label, citations, problem: the strict check of a host's answer; a problem voids the rest."""
    v = F.try_parse_json(F.trim(F.coalesce(text, F.lit(""))))
    whole = F.from_json(F.to_json(v), "map<string,string>")
    label = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.selected_label", "variant")), F.lit("STRING")), F.try_variant_get(v, "$.selected_label", "string"))
    kinds = F.schema_of_variant(F.try_variant_get(v, "$.citations", "variant"))
    cited = F.when(kinds.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(v, "$.citations", "array<string>"))
    problem = (
        F.when(v.isNull(), "not JSON")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) | (F.array_join(F.array_sort(F.map_keys(whole)), ",") != "citations,selected_label"), "violates the schema")
        .when(~F.coalesce(F.array_contains(labels, label), F.lit(False)), "invalid label")
        .when(cited.isNull() | F.exists(cited, lambda c: c.isNull()), "invalid citations")
    )
    return F.struct(F.when(problem.isNull(), label).alias("selected_label"), F.when(problem.isNull(), cited).alias("citations"), problem.alias("problem"))
