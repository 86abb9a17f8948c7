"""Topic navigator: chunks assigned to topics by keywords, and indexes over topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.rules import FALLBACK_TOPIC, TAXONOMY, TOPIC_TERM_STOPWORDS
from lodestar.functions.text import citation, join_known, page_range, token_set, tokens
from lodestar.operators.retrieve import top_k

FIELDS = ("doc_id", "title", "section", "subsection", "chunk_kind")


def topic_score(hay: Column, keywords: tuple[str, ...]) -> Column:
    """3 for each phrase and 1 for each word found as a substring."""
    return sum((F.when(F.contains(hay, F.lit(k)), 3 if " " in k else 1).otherwise(0) for k in keywords), F.lit(0))


def assign_topics(chunks: DataFrame, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY, fallback: str = FALLBACK_TOPIC) -> DataFrame:
    """Adds topic: the largest score, ties to the larger name, the fallback where nothing is found."""
    hay = F.concat_ws(" ", *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in FIELDS), F.lower(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    rows = chunks.withColumn("hay", hay)
    scores = F.array(*(F.struct(topic_score(F.col("hay"), words).alias("score"), F.lit(name).alias("topic")) for name, words in taxonomy.items()))
    best = F.array_max(scores)
    return rows.withColumn("best", best).withColumn("topic", F.when(F.col("best.score") > 0, F.col("best.topic")).otherwise(F.lit(fallback))).drop("hay", "best")


def rows(chunks: DataFrame) -> DataFrame:
    """Pointer rows: topic, ids, pages, citation."""
    pages = page_range("page_start", "page_end")
    return chunks.select("topic", "chunk_id", "corpus_pos", "doc_id", F.col("title").alias("document"), "section", "subsection", "tags", pages.alias("page_range"), citation(F.lit("NAV"), F.col("title"), F.col("section"), pages, F.col("chunk_id")).alias("citation"))


def enriched(navigator: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows with organization and source_url of their document; of manifest rows (doc_id, pos, ...) that share an id the last counts."""
    last = manifest.groupBy("doc_id").agg(F.max_by(F.struct("organization", "source_url"), "pos").alias("m"))
    return navigator.join(last, "doc_id", "left").select(*navigator.columns, "m.organization", "m.source_url")


def topic_counts(navigator: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Chunks and distinct documents of every topic, also of those that have none."""
    per = navigator.groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))
    return taxonomy.select("topic").join(per, "topic", "left").na.fill(0)


def topic_documents(navigator: DataFrame, n: int = 5) -> DataFrame:
    """Per topic and document: count, first title, first n distinct sections and ids in corpus order.

    First places are found by ranking, so no list grows with a document.
    """
    key = ["topic", "doc_id"]
    per = navigator.groupBy(*key).agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("document", "corpus_pos").alias("title"))
    seen = navigator.groupBy(*key, "section").agg(F.min("corpus_pos").alias("pos"))
    sections = top_k(seen, n, key, [F.col("pos")]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "section"))).alias("s"))
    ids = top_k(navigator, n, key, [F.col("corpus_pos")]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("i"))
    out = per.join(sections, key).join(ids, key)
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("n_chunks").desc(), "doc_id"))
    return out.select(*key, "n_chunks", "title", F.transform("s", lambda x: x["section"]).alias("sections"), F.transform("i", lambda x: x["chunk_id"]).alias("chunk_ids"), place.alias("place"))


def top_terms(texts: DataFrame, k: int = 30, by: str = "topic", pattern: str = "[a-z][a-z0-9-]{2,}", stopwords: tuple[str, ...] = TOPIC_TERM_STOPWORDS) -> DataFrame:
    """The k most frequent terms of a group, ties to the first seen. texts: by, pos, text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    each = texts.select(by, "pos", F.posexplode(words).alias("at", "term")).where(~F.col("term").isin(*stopwords))
    counts = each.groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "at")).alias("seen"))
    return top_k(counts, k, [by], [F.col("n").desc(), F.col("seen")]).select(by, "term", "n", "rank")


def entities(navigator: DataFrame) -> DataFrame:
    """doc_id, topics: the sorted topics of a document."""
    return navigator.select("doc_id", "topic").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("topic")).alias("topics"))


def row_text() -> Column:
    return join_known([F.col("topic"), F.col("document"), F.col("section"), F.col("subsection"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")], " ")


def rank_topics(questions: DataFrame, navigator: DataFrame, words: int = 80) -> DataFrame:
    """qid, topic, score, rank: share of the question's tokens among a topic's name and frequent words."""
    each = navigator.select("topic", "corpus_pos", F.posexplode(tokens(row_text())).alias("at", "token"))
    counts = each.groupBy("topic", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("corpus_pos", "at")).alias("seen"))
    frequent = top_k(counts, words, ["topic"], [F.col("n").desc(), F.col("seen")]).select("topic", "token")
    named = navigator.select("topic").distinct().select("topic", F.explode(tokens(F.replace("topic", F.lit("-"), F.lit(" ")))).alias("token"))
    vocabulary = frequent.unionAll(named).distinct()
    asked = questions.select("qid", token_set("question").alias("set"))
    hits = asked.select("qid", F.size("set").alias("size"), F.explode("set").alias("token")).join(vocabulary, "token")
    scored = hits.groupBy("qid", "topic", "size").agg(F.count(F.lit(1)).alias("n")).select("qid", "topic", F.round(F.col("n") / F.col("size"), 6).alias("score"))
    return top_k(scored, 1 << 30, ["qid"], [F.col("score").desc(), F.col("topic")])


def rank_documents(questions: DataFrame, navigator: DataFrame, chosen: DataFrame, k: int = 5) -> DataFrame:
    """qid, doc_id, score, rank: summed overlap of navigator rows in the chosen topics (qid, topic).

    A row's overlap is the share of the question's tokens that it has, so the sum over rows
    is a sum over tokens of how many rows have them: questions meet counts a (topic,
    document, token), not rows. Documents without a shared token score 0; of those, the
    first 2k of a topic are all that can be ranked.
    """
    asked = questions.select("qid", token_set("question").alias("set")).join(chosen.select("qid", "topic"), "qid")
    words = asked.select("qid", "topic", F.size("set").alias("size"), F.explode("set").alias("token"))
    counts = navigator.select("topic", "doc_id", F.explode(token_set(row_text())).alias("token")).groupBy("topic", "doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    found = words.join(counts, ["topic", "token"]).groupBy("qid", "doc_id").agg((F.sum("n") / F.first("size")).alias("score"))
    firsts = top_k(navigator.select("topic", "doc_id").distinct(), 2 * k, ["topic"], [F.col("doc_id")]).select("topic", "doc_id")
    none = asked.select("qid", "topic").join(firsts, "topic").select("qid", "doc_id", F.lit(0.0).alias("score"))
    scored = found.unionByName(none).groupBy("qid", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(scored, k, ["qid"], [F.col("score").desc(), F.col("doc_id")])
