"""Evidence rows around hits: nearby assets, injected pages, sufficiency, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.predicates import asset_query, out_of_scope
from lodestar.functions.text import citation, page_range, query_terms, report_cues, requested_page, share_of, title_terms, token_set, tokens
from lodestar.operators.retrieve import small, top_k
from lodestar.sources.shared import fresh_folder, saved

THRESHOLD = 0.30


def nearby_assets(chunks: DataFrame, assets: DataFrame, window: int = 1, limit: int = 5) -> DataFrame:
    """Assets of a chunk's document within `window` pages, nearest to its first page first.

    The page is part of the join's key: a chunk meets the assets of its own pages, of which
    only the first `limit` a page can be among its nearest.
    """
    a = assets.where("asset_id IS NOT NULL").select("doc_id", "asset_id", "asset_type", F.col("page").alias("asset_page"), "caption", "text_preview")
    a = top_k(a, limit, ["doc_id", "asset_page"], [F.col("asset_id")], "of_page").drop("of_page")
    pairs = with_pages(chunks.select("chunk_id", "doc_id", "page_start", "page_end"), window, "asset_page").join(a, ["doc_id", "asset_page"])
    return top_k(pairs, limit, ["chunk_id"], [F.abs(F.col("asset_page") - F.col("page_start")), F.col("asset_id")])


def with_pages(chunks: DataFrame, window: int, name: str) -> DataFrame:
    """A row for each page of a chunk, widened by `window` pages on both sides; none for a chunk without pages."""
    known = chunks.where(F.col("page_start") - window <= F.col("page_end") + window)
    return known.withColumn(name, F.explode(F.sequence(F.col("page_start") - window, F.col("page_end") + window)))


def page_neighbourhood(targets: DataFrame, chunks: DataFrame, window: int = 1, limit: int = 3) -> DataFrame:
    """Chunks of a target's document whose pages overlap page - window to page + window.

    targets: qid, doc_id, page. The nearest chunks are found once a (document, page), not
    once a question.
    """
    wanted = targets.select("doc_id", "page").distinct()
    near = with_pages(chunks.select("doc_id", "chunk_id", "page_start", "page_end"), window, "page").join(wanted, ["doc_id", "page"], "left_semi")
    gap = F.least(F.abs(F.col("page_start") - F.col("page")), F.abs(F.col("page_end") - F.col("page")))
    near = top_k(near, limit, ["doc_id", "page"], [gap, F.col("page_start"), F.col("chunk_id")])
    return targets.join(near, ["doc_id", "page"])


def most_shared(asked: DataFrame, have: DataFrame, inside: list[str]) -> DataFrame:
    """qid, id, n: the ids that share most tokens with a question, all of them on a tie, and how many.

    asked: qid, inside, token; have: inside, id, token; both distinct. Only ids with the same
    `inside` columns meet. The ids with a question's rarest token show how many tokens, m, can be shared;
    an id that shares as many of the question's t known tokens has one of its t - m + 1 rarest, so
    only those are joined, and a word that is everywhere pairs nothing unless a question has no other.
    """
    folder = fresh_folder(asked.sparkSession, "shared")
    have = saved(have, folder, "have")
    rarity = have.join(asked.select(*inside, "token").distinct(), [*inside, "token"], "left_semi").groupBy(*inside, "token").agg(F.count(F.lit(1)).alias("df"))
    by = Window.partitionBy("qid", *inside)
    terms = asked.join(rarity, [*inside, "token"]).withColumn("at", F.row_number().over(by.orderBy("df", "token"))).withColumn("t", F.count(F.lit(1)).over(by))
    terms = saved(terms, folder, "terms")

    def counted(some: DataFrame) -> DataFrame:
        """Pairs that meet on some tokens, with the number of all tokens they share."""
        pairs = some.select("qid", *inside, "token").join(have, [*inside, "token"]).select("qid", *inside, "id").distinct()
        # a question's pairs aren't dealt to one task
        return pairs.join(small(terms.select("qid", *inside, "token")), ["qid", *inside]).join(have, [*inside, "id", "token"]).groupBy("qid", *inside, "id").agg(F.count(F.lit(1)).alias("n"))

    reach = counted(terms.where("at = 1")).groupBy("qid", *inside).agg(F.max("n").alias("m"))
    needed = terms.join(reach, ["qid", *inside]).where("at <= t - m + 1")
    found = saved(counted(needed), folder, "found")
    most = found.groupBy("qid").agg(F.max("n").alias("n"))
    return found.join(small(most), ["qid", "n"]).select("qid", "id", "n")


def infer_document(questions: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, doc_id: by identifiers, else by two or more title words, else the first evidence.

    documents: doc_id, title, pos; evidence: qid, doc_id, rank. Questions meet documents on
    the rarest of the identifiers and words they share (see most_shared).
    """
    name = F.concat_ws(" ", "doc_id", "title")
    all_of = F.lit(1).alias("all")
    exploded = lambda rows, key, c: rows.select(F.col(key).alias("qid" if key == "qid" else "id"), all_of, F.explode(c).alias("token")).distinct()
    by_cue = most_shared(exploded(questions, "qid", report_cues("question")), exploded(documents, "doc_id", report_cues(name)), ["all"])
    by_cue = by_cue.groupBy("qid").agg(F.min("id").alias("cue_doc"))
    by_term = most_shared(exploded(questions, "qid", title_terms("question")), exploded(documents, "doc_id", title_terms(name)), ["all"])
    by_term = by_term.where("n >= 2").join(documents.select(F.col("doc_id").alias("id"), "pos"), "id")
    by_term = by_term.groupBy("qid").agg(F.min_by("id", "pos").alias("term_doc"))
    first = evidence.groupBy("qid").agg(F.min_by("doc_id", "rank").alias("first_doc"))
    found = questions.select("qid").join(by_cue, "qid", "left").join(by_term, "qid", "left").join(first, "qid", "left")
    return found.select("qid", F.coalesce("cue_doc", "term_doc", "first_doc").alias("doc_id"))


def page_targets(questions: DataFrame, inferred: DataFrame) -> DataFrame:
    """qid, doc_id, page of questions that name an asset and a page."""
    rows = questions.where(asset_query(F.col("question"))).withColumn("page", requested_page("question")).where("page IS NOT NULL")
    return rows.join(inferred, "qid").where("doc_id IS NOT NULL").select("qid", "doc_id", "page")


def named_asset_targets(questions: DataFrame, inferred: DataFrame, assets: DataFrame) -> DataFrame:
    """The asset that shares most tokens with a question naming no page: earliest page, then largest id."""
    rows = questions.where(asset_query(F.col("question")) & requested_page("question").isNull()).join(inferred, "qid")
    low = F.lower("question")
    kind = F.when(F.contains(low, F.lit("table")), "table").when(F.contains(low, F.lit("figure")) | F.contains(low, F.lit("image")), "image")
    from lodestar.functions.rules import QUERY_STOPWORDS

    terms = F.array_distinct(F.filter(tokens("question"), lambda t: ~t.isin(*QUERY_STOPWORDS)))
    asked = rows.select("qid", "doc_id", F.coalesce(kind, F.lit("")).alias("kind"), F.explode(terms).alias("token"))
    hay = token_set(F.concat_ws(" ", "asset_id", "caption", "text_preview"))
    # a question that names no kind meets every asset under the kind ''
    kinds = F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("asset_type", F.lit("")))))
    have = assets.select("doc_id", F.struct("asset_id", "page").alias("id"), kinds.alias("kind"), hay.alias("hay")).select("doc_id", "id", "kind", F.explode("hay").alias("token")).distinct()
    found = most_shared(asked, have, ["doc_id", "kind"]).join(rows.select("qid", "doc_id"), "qid")
    best = found.groupBy("qid").agg(F.max_by(F.struct("doc_id", "id.page", "id.asset_id"), F.struct(-F.col("id.page"), F.col("id.asset_id"))).alias("t"))
    return best.select("qid", "t.*").where("page >= 1")


def inject(evidence: DataFrame, found: DataFrame, limit: int | None = None, flag: str = "asset_page_injected") -> DataFrame:
    """Puts found chunks before the evidence, without those it has, and ranks anew.

    Without a limit each question keeps as many rows as it had.
    """
    new = found.select("qid", "chunk_id", F.col("rank").alias("place")).join(evidence.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    had = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("had"))
    both = evidence.select("qid", "chunk_id", F.lit(1).alias("side"), F.col("rank").alias("place")).unionByName(new.withColumn("side", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("side", "place"))
    rows = both.join(had, "qid", "left").withColumn("rank", rank).where(F.col("rank") <= (F.lit(limit) if limit else F.coalesce("had", F.lit(0))))
    return rows.select("qid", "chunk_id", "rank", (F.col("side") == 0).alias(flag))


def sufficiency(questions: DataFrame, evidence: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """qid, sufficient, max_overlap, best_chunk_id.

    No content terms: sufficient. Outside the domain or without evidence: not.
    evidence: qid, chunk_id, rank, title, section, subsection, text.
    """
    q = questions.select("qid", F.array_distinct(query_terms("question")).alias("terms"), out_of_scope(F.col("question")).alias("foreign"))
    hay = token_set(F.concat_ws(" ", "title", "section", "subsection", "text"))
    pairs = q.join(evidence.select("qid", "chunk_id", "rank", hay.alias("hay")), "qid", "left")
    overlap = F.when(F.col("hay").isNull(), 0.0).otherwise(share_of(F.col("terms"), F.col("hay")))
    per = pairs.withColumn("o", overlap).groupBy("qid", "terms", "foreign").agg(F.count("chunk_id").alias("n"), F.max("o").alias("o"), F.max_by("chunk_id", F.struct("o", -F.col("rank"))).alias("best"))
    bare = F.size("terms") == 0
    ok = ~F.col("foreign") & (F.col("n") > 0) & (bare | (F.col("o") >= threshold))
    top = F.when(F.col("foreign") | (F.col("n") == 0), 0.0).when(bare, 1.0).otherwise(F.round("o", 4))
    return per.select("qid", ok.alias("sufficient"), top.alias("max_overlap"), F.when(~F.col("foreign") & ~bare & (F.col("o") > 0), F.col("best")).alias("best_chunk_id"))


def flatten(evidence: DataFrame) -> DataFrame:
    """Public evidence rows: E-ids, page ranges, citations and a struct of scores where present."""
    eid = F.concat(F.lit("E"), F.col("rank").cast("string"))
    pages = page_range("page_start", "page_end")
    scores = [c for c in ("dense_score", "bm25_score", "fusion_score", "heuristic_bonus", "final_retrieval_score", "rerank_score") if c in evidence.columns]
    rows = evidence.select("*", eid.alias("evidence_id"), pages.alias("page_range"))
    rows = rows.withColumn("citation", citation(F.col("evidence_id"), F.col("title"), F.col("section"), F.col("page_range"), F.col("chunk_id")))
    return rows.withColumn("scores", F.struct(*scores)).drop(*scores) if scores else rows
