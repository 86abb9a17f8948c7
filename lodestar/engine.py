"""The engine as an object: build an index once, ask tables of questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.predicates import asset_query, chunk_bonus, rerank_adjustment
from lodestar.functions.text import index_text
from lodestar.operators import answers, evidence, navigator, rerank, retrieve, routing
from lodestar.sources import files

MODES, SELECTORS, ANSWERERS = ("evidence", "bundle", "answer"), ("auto", "lexical", "semantic_coverage"), ("auto", "extractive", "model")
WARNINGS = "array<struct<code:string,message:string>>"


@dataclass
class Engine:
    """Chunks (the chunk table with corpus_pos) and, optionally, vectors, assets, a memory and a generator.

    vectors: chunk_id, corpus_pos, embedding. `embed` turns a question column into a vector
    column; `meta` says what made the vectors. Hybrid retrieval needs both. memory: records
    of what worked (see routing.memory_matches). `generate` maps prompts to texts.
    """

    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame | None = None
    assets: DataFrame | None = None
    embed: object = None
    heuristics: bool = False
    taxonomy: dict[str, tuple[str, ...]] = field(default_factory=dict)
    meta: DataFrame | None = None
    memory: DataFrame | None = None
    generate: object = None

    def __post_init__(self) -> None:
        indexed = self.chunks.withColumn("index_text", index_text())
        self.postings = retrieve.postings(indexed, "index_text")
        self.lengths = retrieve.lengths(indexed, "index_text", "doc_id", "corpus_pos")
        if self.vectors is not None and self.meta is None:
            self.meta = retrieve.dense_meta(self.vectors, "unnamed", "given")

    # --- index ----------------------------------------------------------------

    def save(self, path: str) -> None:
        """Writes the index as tables; postings are sorted by token within files."""
        self.postings.repartition("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
            self.meta.write.mode("overwrite").parquet(f"{path}/dense_meta")

    @staticmethod
    def missing(spark: SparkSession, path: str, backend: str = "auto") -> list[str]:
        """Tables that `backend` needs and the folder lacks."""
        return [t for t in retrieve.required_tables(backend) if not files.exists(spark, f"{path}/{t}/_SUCCESS")]

    def load(self, path: str, **expected) -> Engine:
        """Uses saved tables from now on, so questions don't tokenise the corpus again.

        `expected` values of the dense metadata (embedding_model_name, dimension, ...) have
        to match; a missing table raises FileNotFoundError.
        """
        gone = self.missing(self.spark, path)
        if gone:
            raise FileNotFoundError(f"the index at {path} lacks {', '.join(gone)}")
        read = self.spark.read.parquet
        self.postings, self.lengths, self.chunks = read(f"{path}/postings"), read(f"{path}/lengths"), read(f"{path}/chunks")
        if not self.missing(self.spark, path, "hybrid"):
            self.vectors, self.meta = read(f"{path}/vectors"), read(f"{path}/dense_meta")
        if expected:
            retrieve.check_index_meta(self.meta if self.meta is not None else self.spark.createDataFrame([], "dimension int"), **expected)
        return self

    @property
    def dense(self) -> str:
        """missing, unreadable, hash or semantic; without an embedder for questions: missing."""
        return routing.dense_status(self.meta) if self.vectors is not None and self.embed is not None else "missing"

    # --- retrieval --------------------------------------------------------------

    def _asked(self, questions: DataFrame | str, report_id: str | None) -> DataFrame:
        """qid, question, report_id."""
        if isinstance(questions, str):
            questions = self.spark.createDataFrame([(1, questions)], "qid long, question string")
        own = F.col("report_id") if "report_id" in questions.columns else F.lit(None).cast("string")
        return questions.select("qid", "question", F.nullif(F.coalesce(own, F.lit(report_id)), F.lit("")).alias("report_id"))

    def candidates(self, questions: DataFrame, backend: str = "sparse", k: int = retrieve.FUSED_K) -> DataFrame:
        """Chunk rows a question may use. A question's report_id keeps that document's rows, after ranking."""
        sparse = retrieve.best(retrieve.TOP_K, "score")(retrieve.bm25(questions, self.postings, self.lengths))
        if backend == "hybrid":
            if self.dense == "missing":
                raise ValueError("hybrid retrieval needs vectors and an embedder")
            asked = questions.select("qid", self.embed(F.col("question")).alias("query"))
            hits = retrieve.rrf(retrieve.dense_search(asked, self.vectors, tie="corpus_pos"), sparse, k)
        else:
            hits = retrieve.sparse_only(sparse, k)
        n = questions.count()
        hits = retrieve.sized(hits.drop("corpus_pos"), n * k)
        rows = self.chunks.join(hits, "chunk_id").join(retrieve.sized(questions.select("qid", "question", *({"report_id"} & set(questions.columns))), n), "qid")
        return rows.where(retrieve.INSIDE).drop("report_id") if "report_id" in questions.columns else rows

    def routes(self, questions: DataFrame, backend: str = "auto") -> DataFrame:
        """qid, backend, strategy, evidence_top_k, warnings: what is used for each question and why."""
        if backend == "routed":
            scenes = routing.with_scene(questions)
            matches = None if self.memory is None else routing.memory_matches(scenes, self.memory)
            chosen = routing.select_strategy(scenes, self.dense == "semantic", matches)
            told = F.concat(F.lit("strategy "), F.col("strategy"), F.lit(", "), F.col("memory_match_count").cast("string"), F.lit(" remembered"))
            return chosen.select("qid", "backend", "strategy", "evidence_top_k", F.array(F.struct(F.lit("routing_decision").alias("code"), told.alias("message"))).alias("warnings"))
        used, warnings = routing.backends(backend, self.dense)
        said = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(m).alias("message")) for c, m in warnings)) if warnings else F.array()
        return questions.select("qid", F.lit(used).alias("backend"), F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("int").alias("evidence_top_k"), said.cast(WARNINGS).alias("warnings"))

    def evidence(self, questions: DataFrame, backend: str = "auto", limit: int | None = None, routes: DataFrame | None = None) -> DataFrame:
        """Ranked, refined evidence rows, with pages that a question about tables and figures names."""
        routes = self.routes(questions, backend) if routes is None else routes
        kinds = ("sparse", "hybrid") if backend == "routed" and self.dense == "semantic" else ("sparse",) if backend == "routed" else (routing.backends(backend, self.dense)[0],)
        parts = [self.candidates(questions.join(routes.where(F.col("backend") == kind), "qid", "left_semi"), kind) for kind in kinds]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        how = {"bonus": chunk_bonus(F.col("question")), "adjustment": rerank_adjustment(F.col("question"))} if self.heuristics else {}
        if backend == "routed" and limit is None:
            rows = rerank.refine(rerank.rerank(rows, k=retrieve.FUSED_K, **how)).join(routes.select("qid", "evidence_top_k"), "qid")
            rows = rows.where(F.col("rank") <= F.col("evidence_top_k")).drop("evidence_top_k")
        else:
            rows = rerank.refine(rerank.rerank(rows, **(how | ({"k": limit} if limit else {}))), limit)
        return rows if self.assets is None else self._with_pages(questions, rows, limit)

    def _with_pages(self, questions: DataFrame, rows: DataFrame, limit: int | None) -> DataFrame:
        """Evidence with the chunks of pages that questions name, or that hold the table or figure they name, put first."""
        documents = self.chunks.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("corpus_pos").alias("pos"))
        inferred = evidence.infer_document(questions, documents, rows)
        if "report_id" in questions.columns:
            inferred = inferred.join(questions.select("qid", "report_id"), "qid").select("qid", F.coalesce("report_id", "doc_id").alias("doc_id"))
        targets = evidence.page_targets(questions, inferred).unionByName(evidence.named_asset_targets(questions, inferred, self.assets).select("qid", "doc_id", "page"))
        placed = evidence.inject(rows, evidence.page_neighbourhood(targets, self.chunks), limit)
        own = [c for c in rows.columns if c not in self.chunks.columns and c not in ("question", "rank", "qid")]
        scores = rows.select("qid", "chunk_id", *own)
        return placed.join(self.chunks, "chunk_id").join(scores, ["qid", "chunk_id"], "left").join(questions.select("qid", "question"), "qid")

    # --- questions --------------------------------------------------------------

    def status(self, questions: DataFrame, mode: str, backend: str, selector: str, answerer: str) -> DataFrame:
        """qid, question, report_id, error: what is wrong with a request before anything is retrieved."""
        known = self.chunks.select(F.col("doc_id").alias("report_id")).distinct().withColumn("known", F.lit(True))
        empty = self.chunks.isEmpty()
        rows = questions.join(known, "report_id", "left")
        unsupported = lambda what, value, some: (F.lit(value not in some), "out_of_scope", f"Unsupported {what}: {value}. Supported: {', '.join(some)}.")
        tests = [
            unsupported("mode", mode, MODES),
            unsupported("answer engine", answerer, ANSWERERS),
            unsupported("selector", selector, SELECTORS),
            unsupported("retrieval backend", backend, routing.BACKENDS),
            (F.lit(empty), "empty_corpus", "The corpus has no chunks."),
            (F.lit(backend == "hybrid" and self.dense == "missing"), "missing_index", "Hybrid retrieval needs vectors and an embedder."),
            (F.col("report_id").isNotNull() & F.col("known").isNull(), "out_of_scope", F.concat(F.lit("Report "), F.col("report_id"), F.lit(" is not indexed."))),
            answers.blank_question(F.col("question")),
            (F.lit(mode == "answer" and answerer == "model" and self.generate is None), "missing_model_path", "No generator is configured."),
        ]
        return rows.select("qid", "question", "report_id", answers.failure(tests).alias("error"))

    def query(self, questions: DataFrame | str, mode: str = "answer", backend: str = "auto", limit: int | None = None, selector: str = "auto", report_id: str | None = None, answerer: str = "auto") -> DataFrame:
        """Every question's result: ok, code, message, backend, warnings, then by mode evidence rows, a prompt, or an answer.

        What goes wrong with a question is a row with ok = false, not an exception. evidence:
        one row a piece of evidence; bundle and answer: one row a question.
        """
        asked = self._asked(questions, report_id)
        checked = self.status(asked, mode, backend, selector, answerer)
        supported = mode in MODES and backend in routing.BACKENDS and selector in SELECTORS and answerer in ANSWERERS and not (backend == "hybrid" and self.dense == "missing")
        if not supported:
            return self._result(checked, None, None, None)
        fine = checked.where("error IS NULL").drop("error")
        routes = self.routes(fine, backend)
        rows = self.evidence(fine, backend, limit, routes)
        enough = evidence.sufficiency(fine, rows).select("qid", "sufficient")
        if mode == "evidence":
            return self._result(checked, routes, enough, evidence.flatten(rows).drop("question"))
        if mode == "bundle":
            return self._result(checked, routes, enough, answers.grounded_prompt(rows).drop("question"))
        return self._result(checked, routes, enough, self._answers(rows, selector, answerer))

    def _answers(self, rows: DataFrame, selector: str, answerer: str) -> DataFrame:
        if answerer == "model" or (answerer == "auto" and self.generate is not None):
            ids = rows.groupBy("qid").agg(F.collect_set(F.concat(F.lit("E"), F.col("rank").cast("string"))).alias("evidence_ids"))
            told = answers.model_answers(answers.generated(answers.grounded_prompt(rows), self.generate), ids)
            return told.select("qid", "answer", "used_evidence_ids")
        told = answers.extractive_answers(rows, selector)
        if self.assets is not None:
            near = evidence.nearby_assets(rows.select(*self.chunks.columns).dropDuplicates(["chunk_id"]), self.assets, limit=8)
            shown = answers.asset_answers(rows.where(asset_query(F.col("question"))), near)
            told = told.join(shown.select("qid"), "qid", "left_anti").unionByName(shown)
        return told

    @staticmethod
    def _result(checked: DataFrame, routes: DataFrame | None, enough: DataFrame | None, found: DataFrame | None) -> DataFrame:
        if found is None:
            return checked.select("qid", "question", "report_id", F.lit(False).alias("ok"), "error.code", "error.message", F.lit(None).cast("string").alias("backend"), F.lit(None).cast(WARNINGS).alias("warnings"), F.lit(True).alias("abstained"))
        rows = checked.join(routes.select("qid", "backend", "strategy", "warnings"), "qid", "left").join(enough, "qid", "left")
        weak = ~F.coalesce("sufficient", F.lit(False))
        late = answers.failure([(weak, "insufficient_evidence", "The indexed evidence is insufficient to answer this question.")])
        rows = rows.withColumn("error", F.coalesce("error", late))
        fine = F.col("error").isNull()
        head = rows.select("qid", "question", "report_id", fine.alias("ok"), F.col("error.code").alias("code"), F.col("error.message").alias("message"), "backend", "strategy", "warnings", (~fine).alias("abstained"))
        return head.join(found.join(rows.where(fine).select("qid"), "qid", "left_semi"), "qid", "left")

    def remember(self, result: DataFrame, path: str, mode: str = "evidence", batch: str | None = None) -> bool:
        """Appends what was used for each question of an evidence result to the experience log; once for each batch id."""
        per = result.groupBy("qid", "question", "report_id", "strategy", "backend", "ok").agg(F.count("chunk_id").alias("n"), F.sort_array(F.collect_list("chunk_id")).alias("retrieved_chunk_ids"))
        scene = routing.with_scene(per)
        return files.append_log(scene.select(F.col("question").alias("query"), F.lit(mode).alias("mode"), "report_id", F.col("scene.task_type").alias("task_type"), F.col("scene.domain_tags").alias("domain_tags"), F.col("strategy").alias("strategy_used"), F.col("backend").alias("retrieval_backend"), F.col("n").cast("int").alias("evidence_top_k"), F.when(F.col("ok"), "sufficient").otherwise("insufficient").alias("evidence_status"), "retrieved_chunk_ids"), path, batch)

    # --- the corpus ---------------------------------------------------------------

    def reports(self) -> DataFrame:
        return self.chunks.groupBy("doc_id").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n_chunks"))

    def chunk(self, chunk_id: str) -> DataFrame:
        """One row: the chunk of that id, else the first in the corpus whose id begins with it, with its citation; else an error."""
        from lodestar.functions.text import citation, page_range

        pages = page_range("page_start", "page_end")
        found = self.chunks.where(F.col("chunk_id").startswith(chunk_id)).orderBy(F.col("chunk_id") != chunk_id, "corpus_pos").limit(1)
        found = found.withColumn("page_range", pages).withColumn("citation", citation(F.lit("E1"), F.col("title"), F.col("section"), pages, F.col("chunk_id")))
        one = self.spark.range(1).select(F.lit(chunk_id).alias("asked"))
        rows = one.join(found, F.lit(True), "left")
        error = answers.failure([(F.col("chunk_id").isNull(), "out_of_scope", f"Chunk {chunk_id} is not indexed.")])
        return rows.withColumn("error", error).select(F.col("error").isNull().alias("ok"), F.col("error.code").alias("code"), F.col("error.message").alias("message"), *found.columns)

    def navigator(self, manifest: DataFrame | None = None) -> DataFrame:
        """Navigator rows with their topics and, given the manifest, organization and source."""
        rows = navigator.rows(navigator.assign_topics(self.chunks, **({"taxonomy": self.taxonomy} if self.taxonomy else {})))
        return rows if manifest is None else navigator.enriched(rows, manifest)

    def build_navigator(self, path: str, manifest: DataFrame | None = None) -> None:
        """Writes rows by topic, documents by topic, frequent terms and topics by document."""
        rows = self.navigator(manifest)
        files.write_by(rows, f"{path}/topics", "topic")
        files.write_by(navigator.topic_documents(rows), f"{path}/topic_indexes", "topic")
        navigator.entities(rows).write.mode("overwrite").parquet(f"{path}/entities")
        texts = rows.select("topic", "chunk_id").join(self.chunks.select("chunk_id", F.col("corpus_pos").alias("pos"), "text"), "chunk_id")
        navigator.top_terms(texts).write.mode("overwrite").parquet(f"{path}/terms")

    def topics(self) -> DataFrame:
        return self.navigator().groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
