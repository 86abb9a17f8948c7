"""Predicates and heuristic scores over question and chunk columns.

Chunk columns are named as in the chunk table (section, subsection, text, tags, ...). Sums
of small bonuses are plain sums of CASE terms, so Catalyst folds what is constant.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import rules
from lodestar.functions.text import UNKNOWN, collapse_ws, keyword_terms, normalize_ws, plain_sentences, query_focus, query_terms, report_cues, share_of, terms_ratio, text_or_empty, title_terms, tokens


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def any_match(c: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive match of any pattern."""
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def any_phrase(c: Column, phrases: Iterable[str]) -> Column:
    """Case-insensitive match of any phrase between word edges. Plain words are first looked for as they are, which is far cheaper than a pattern."""
    phrases = tuple(phrases)
    found = any_match(c, [rf"\b{p}\b" for p in phrases])
    return holds_any(F.lower(c), phrases) & found if all(re.fullmatch("[a-z ]+", p) for p in phrases) else found


def holds_any(c: Column, terms: Iterable[str]) -> Column:
    return any_of(F.contains(c, F.lit(t)) for t in terms)


# --- questions ----------------------------------------------------------------


def query_type(query: Column, kinds: dict[str, tuple[str, ...]] = rules.QUERY_TYPES) -> Column:
    """The first kind, in order, one of whose patterns is found."""
    q = normalize_ws(query)
    return F.coalesce(*(F.when(any_match(q, patterns), F.lit(kind)) for kind, patterns in kinds.items()), F.lit("general"))


def domain_tags(query: Column, vocabulary: dict[str, tuple[str, ...]] = rules.DOMAIN_TERMS, whole_words: bool = False) -> Column:
    """Tags with a term inside the question; by plain substring unless `whole_words`."""
    low = F.lower(query)
    test = (lambda terms: low.rlike(r"\b(?:" + "|".join(terms) + r")\b")) if whole_words else (lambda terms: holds_any(low, terms))
    return F.array_compact(F.array(*(F.when(test(terms), F.lit(tag)) for tag, terms in vocabulary.items())))


def matched(query: Column, patterns: dict[str, str] = rules.QUESTION_PATTERNS) -> Column:
    return F.array_compact(F.array(*(F.when(any_match(query, [p]), F.lit(name)) for name, p in patterns.items())))


def out_of_scope(query: Column, boundaries: tuple[str, ...] = rules.BOUNDARIES, foreign: tuple[str, ...] = rules.OUT_OF_DOMAIN) -> Column:
    return any_match(query, boundaries) | (holds_any(F.lower(query), foreign) & (F.size(domain_tags(query)) == 0))


def scene(query: Column, report_id: Column | None = None) -> Column:
    """A struct that describes the question for routing."""
    tags, found, low = domain_tags(query), matched(query), F.lower(query)
    length = F.size(F.filter(F.split(collapse_ws(query), " "), lambda w: w != ""))
    task = (
        F.when(out_of_scope(query), "out_of_scope")
        .when(F.array_contains(found, "table_or_figure"), "asset_lookup")
        .when(F.array_contains(found, "calculation"), "calculation_or_formula")
        .when(F.array_contains(found, "definition"), "definition")
        .when(F.array_contains(found, "comparison"), "comparison")
        .when(F.array_contains(found, "procedure"), "procedure_or_qa")
        .when((F.size(tags) >= 2) | low.rlike(rules.BROAD), "multi_report_synthesis")
        .otherwise("direct_fact")
    )
    effort = F.when((length >= 22) | (F.size(tags) >= 3), "high").when(task.isin("comparison", "multi_report_synthesis", "procedure_or_qa"), "medium").otherwise("low")
    return F.struct(
        task.alias("task_type"),
        tags.alias("domain_tags"),
        found.alias("matched_patterns"),
        F.size(F.array_compact(F.array(*(F.when(any_match(query, [p]), F.lit(p)) for p in rules.BOUNDARIES)))).alias("n_boundary_matches"),
        (F.coalesce(report_id, F.lit("")) != "" if report_id is not None else F.lit(False)).alias("has_report_scope"),
        length.alias("query_length_tokens"),
        effort.alias("complexity"),
        F.when(F.contains(query, F.lit("?")), "question").otherwise("instruction").alias("query_style"),
    )


def asset_query(query: Column) -> Column:
    return query.rlike(rules.ASSET_QUERY)


# --- chunks -------------------------------------------------------------------


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == tag.lower()), F.lit(False))


def front_matter(section: Column, subsection: Column, text: Column, page_start: Column, plain: Column | None = None) -> Column:
    """`plain` is the text normalised before, here and below."""
    upper, low = F.upper(text_or_empty(section)), F.lower(normalize_ws(text) if plain is None else plain)
    early = (upper == UNKNOWN) & (F.upper(text_or_empty(subsection)) == UNKNOWN) & (F.coalesce(page_start, F.lit(999)) <= 6)
    return (upper == "FRONT_MATTER") | (early & (low.rlike(r"\.{3,}\s*\d{1,3}") | F.contains(low, F.lit("contents"))))


def references(section: Column) -> Column:
    return F.startswith(F.upper(text_or_empty(section)), F.lit("REFERENCES"))


def modality_specific(tags: Column, section: Column, subsection: Column, text: Column, hints: tuple[str, ...] = rules.MODALITIES, plain: Column | None = None) -> Column:
    if plain is None:
        plain = normalize_ws(text)
    hay = F.lower(F.concat_ws(" ", *(F.when(c != "", c) for c in (normalize_ws(section), normalize_ws(subsection), plain))))
    return has_tag(tags, "modality_specific") | holds_any(hay, hints)


def recommendation_chunk(tags: Column, section: Column, subsection: Column) -> Column:
    return has_tag(tags, "recommendation") | F.contains(F.lower(F.concat_ws(" ", section, subsection)), F.lit("recommend"))


def summary_like(section: Column, text: Column, heads: tuple[str, ...] = rules.SUMMARY_SECTIONS, phrases: tuple[str, ...] = rules.SUMMARY_PHRASES, plain: Column | None = None) -> Column:
    upper = F.upper(normalize_ws(section))
    return any_of(F.startswith(upper, F.lit(h)) for h in heads) | any_phrase(normalize_ws(text) if plain is None else plain, phrases)


def definition_cue(text: Column, cues: tuple[str, ...] = rules.DEFINITION_CUES, plain: Column | None = None) -> Column:
    return any_phrase(normalize_ws(text) if plain is None else plain, cues)


def cued_sentences(text: Column, cues: tuple[str, ...] = rules.DEFINITION_CUES, plain: Column | None = None) -> Column:
    """The sentences that hold a cue, lower-cased; a text without a cue isn't cut into sentences."""
    if plain is None:
        plain = normalize_ws(text)
    found = F.transform(F.filter(plain_sentences(plain), lambda s: any_match(s, [rf"\b{c}\b" for c in cues])), lambda s: F.lower(s))
    return F.when(definition_cue(text, cues, plain), found).otherwise(F.array().cast("array<string>"))


def holds_focus(cued: Column, focus: Column) -> Column:
    return F.coalesce(F.exists(cued, lambda s: F.contains(s, focus)), F.lit(False))


def focus_definition(text: Column, focus: Column, cues: tuple[str, ...] = rules.DEFINITION_CUES) -> Column:
    """A single sentence holds both the focus and a cue."""
    return holds_focus(cued_sentences(text, cues), focus)


def report_match(query: Column, source: Column) -> Column:
    """Identifier overlap or conflict, then title words in common."""
    return _report_match(report_cues(query), report_cues(source), title_terms(query), title_terms(source))


def _report_match(asked: Column, have: Column, wanted: Column, named: Column) -> Column:
    shared = F.size(F.array_intersect(asked, have))
    cues = F.when(shared > 0, 0.46 + F.least(F.lit(0.10), shared * 0.03)).when((F.size(asked) > 0) & (F.size(have) > 0), -0.18).otherwise(0.0)
    ratio = F.when(F.size(named) == 0, F.lit(0.0)).otherwise(share_of(wanted, named))
    return cues + F.when(ratio >= 0.45, F.least(F.lit(0.18), 0.08 + ratio * 0.15)).when(ratio >= 0.25, 0.05).otherwise(0.0)


def _sum(terms: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(test, weight).otherwise(0.0) for test, weight in terms), F.lit(0.0))


# Weights of the retrieval bonus and of the rerank adjustment.
RETRIEVAL_WEIGHTS = {"front": -0.18, "references": -0.12, "intro": 0.18, "micro": 0.22, "cue": 0.18, "tag": 0.06, "focus": 0.10, "focus_sentence": 0.24, "modality": -0.20, "recommendation": -0.10, "summary": -0.14, "no_cue": -0.10, "long": -0.05, "long_tokens": 420, "front_definition": -0.08, "recommend_head": 0.18, "recommend_like": 0.10, "locator_ratio": 0.20, "locator": 0.15, "locator_known": 0.03, "versus": 0.10, "comparison_section": 0.04, "caption": -0.10}
RERANK_WEIGHTS = {"front": -0.22, "references": -0.16, "intro": 0.24, "micro": 0.26, "cue": 0.16, "tag": 0.08, "focus": 0.08, "focus_sentence": 0.24, "modality": -0.30, "recommendation": -0.16, "summary": -0.24, "no_cue": -0.20, "long": -0.05, "long_tokens": 360, "front_definition": -0.12, "recommend_head": 0.18, "recommend_like": 0.08, "locator_ratio": 0.25, "locator": 0.12, "locator_known": 0.0, "versus": 0.0, "comparison_section": 0.0, "caption": -0.15}


def question_facts(query: Column) -> dict[str, Column]:
    """What the heuristic scores read of a question alone."""
    return {"kind": query_type(query), "focus": query_focus(query), "asked_cues": report_cues(query), "asked_words": title_terms(query), "asked_keys": keyword_terms(query), "asks_reference": F.contains(F.lower(query), F.lit("reference"))}


def chunk_facts(plain: Column | None = None) -> dict[str, Column]:
    """What they read of a chunk alone, from its columns; `plain` is its normalised text if there is one already."""
    c = {name: F.col(name) for name in ("doc_id", "title", "source_path", "section", "subsection", "text", "tags", "chunk_kind", "page_start", "token_count")}
    section, subsection, text = text_or_empty(c["section"]), text_or_empty(c["subsection"]), text_or_empty(c["text"])
    source = F.concat_ws(" ", c["doc_id"], c["title"], c["source_path"])
    return {
        "intro": F.startswith(F.upper(section), F.lit("1. INTRODUCTION")),
        "micro": c["chunk_kind"] == "definition_microchunk",
        "cue": definition_cue(text, plain=plain),
        "tagged": has_tag(c["tags"], "definition"),
        "modality": modality_specific(c["tags"], section, subsection, text, plain=plain),
        "like": recommendation_chunk(c["tags"], section, subsection),
        "summary": summary_like(section, text, plain=plain),
        "tokens": F.coalesce(c["token_count"], F.lit(0)),
        "front": front_matter(section, subsection, text, c["page_start"], plain),
        "refs": references(section),
        "caption": F.startswith(F.trim(text), F.lit("FIG.")) | F.startswith(F.trim(text), F.lit("TABLE ")),
        "recommend_head": F.contains(F.lower(section), F.lit("recommend")) | F.contains(F.lower(subsection), F.lit("recommend")),
        "head_keys": keyword_terms(F.concat_ws(" ", section, subsection)),
        "known": section != UNKNOWN,
        "versus": F.contains(F.lower(subsection), F.lit("vs")) | F.contains(F.lower(subsection), F.lit("versus")) | F.contains(F.lower(text), F.lit("compare")),
        "compared": F.upper(section).rlike(r"^(4\. MEASUREMENT|5\. COMPUTATIONAL|6\. TECHNIQUES)"),
        "have_cues": report_cues(source),
        "have_words": title_terms(source),
    }


def focus_texts(plain: Column | None = None) -> dict[str, Column]:
    """The two texts of a chunk that a question's focus is looked for in."""
    text = text_or_empty("text")
    return {"hay": F.lower(F.concat_ws(" ", text_or_empty("section"), text_or_empty("subsection"), text)), "cued": cued_sentences(text, plain=plain)}


def focus_facts(hay: Column, cued: Column, focus: Column) -> dict[str, Column]:
    """What they read of both: whether the chunk, and one of its sentences with a cue, holds the focus."""
    return {"in_hay": F.coalesce(F.contains(hay, focus), F.lit(False)), "said": holds_focus(cued, focus)}


def heuristic(f: dict[str, Column], w: dict[str, float], caption_in_definitions: bool) -> Column:
    """The score from the facts of a question, a chunk and their focus."""
    definition = _sum([
        (f["intro"], w["intro"]), (f["micro"], w["micro"]), (f["cue"], w["cue"]), (f["tagged"], w["tag"]),
        (f["in_hay"], w["focus"]), (f["said"], w["focus_sentence"]),
        (f["modality"] & ~f["said"], w["modality"]), (f["like"] & ~f["said"] & ~f["intro"], w["recommendation"]),
        (f["summary"] & ~f["said"] & ~f["cue"], w["summary"]), (~f["intro"] & ~f["cue"], w["no_cue"]), (f["tokens"] > w["long_tokens"], w["long"]),
        (f["front"], w["front_definition"]), (f["caption"] if caption_in_definitions else F.lit(False), w["caption"]),
    ])
    recommendation = _sum([(f["recommend_head"], w["recommend_head"]), (f["like"], w["recommend_like"])])
    locator = _sum([(terms_ratio(f["asked_keys"], f["head_keys"]) > w["locator_ratio"], w["locator"]), (f["known"], w["locator_known"])])
    comparison = _sum([(f["versus"], w["versus"]), (f["compared"], w["comparison_section"])])
    always = _sum([(f["front"], w["front"]), (f["refs"] & ~f["asks_reference"], w["references"]), (F.lit(False) if caption_in_definitions else f["caption"], w["caption"])])
    kind = f["kind"]
    by_kind = F.when(kind == "definition", definition).when(kind == "recommendation", recommendation).when(kind == "section_locator", locator).when(kind == "comparison", comparison).otherwise(0.0)
    return _report_match(f["asked_cues"], f["have_cues"], f["asked_words"], f["have_words"]) + always + by_kind


def _heuristic(query: Column, w: dict[str, float], caption_in_definitions: bool) -> Column:
    asked, texts = question_facts(query), focus_texts()
    return heuristic(asked | chunk_facts() | focus_facts(texts["hay"], texts["cued"], asked["focus"]), w, caption_in_definitions)


def chunk_bonus(query: Column) -> Column:
    """Additive retrieval bonus of a chunk row for a question."""
    return _heuristic(query, RETRIEVAL_WEIGHTS, caption_in_definitions=False)


def rerank_adjustment(query: Column) -> Column:
    """The stricter adjustment after candidates are known."""
    return _heuristic(query, RERANK_WEIGHTS, caption_in_definitions=True)


def blend_weights(query: Column) -> Column:
    """Struct of model, prior and bonus weights by kind of question."""
    kind = query_type(query)
    pick = lambda i: F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in rules.BLEND_WEIGHTS.items()), F.lit(rules.BLEND_DEFAULT[i]))
    return F.struct(pick(0).alias("model"), pick(1).alias("prior"), pick(2).alias("bonus"))


def infer_tags(section: Column, subsection: Column, text: Column, micro: Column, families: dict[str, tuple[str, ...]] = rules.TAGS, cues: tuple[str, ...] = rules.DEFINITION_CUES) -> Column:
    hay = normalize_ws(F.concat_ws(" ", section, subsection, text))
    recommended = any_match(normalize_ws(F.concat_ws(" ", section, subsection)), [rules.RECOMMENDATION]) | any_match(normalize_ws(text), [rules.RECOMMENDATION])
    flags = [F.when(any_match(hay, patterns), F.lit(tag)) for tag, patterns in families.items()]
    flags += [F.when(recommended, F.lit("recommendation")), F.when(micro | holds_any(F.lower(normalize_ws(text)), cues), F.lit("definition"))]
    return F.array_sort(F.array_compact(F.array(*flags)))


def overclaims(text: Column, patterns: tuple[str, ...] = rules.OVERCLAIMS) -> Column:
    return any_match(text, patterns)


def sufficiency(query: Column, text: Column) -> Column:
    """Share of the question's content terms in a text; null if it has none."""
    wanted = F.array_distinct(query_terms(query))
    return F.when(F.size(wanted) > 0, share_of(wanted, F.array_distinct(tokens(text))))
