"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, quality
from lodestar.llm.alignment import token_alignment
from lodestar.llm.common import Scratch
from lodestar.llm.decontaminate import contamination
from lodestar.llm.dedup_exact import exact_dedup
from lodestar.llm.divergence import source_divergence
from lodestar.llm.licenses import license_scan
from lodestar.llm.packing import pack
from lodestar.llm.pipeline import ORACLE_SQL, run
from lodestar.llm.sharding import shuffle_to_shards
from lodestar.llm.simhash import simhash_classes
from lodestar.llm.substrings import substring_dedup
from lodestar.llm.token_counts import TokenLedger, counted
from lodestar.llm.token_files import read_token_files, token_files
from lodestar.plans.registry import Registry, table

REGISTRY = Registry()

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS x, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes),
h AS (SELECT g.doc_id, g.s, g.n, v.item_id FROM g JOIN v ON g.n = v.n AND array_to_string(g.w[g.s:g.s + g.n - 1], ' ') = v.x),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY x)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.x) AS text_sha256 FROM n JOIN g USING (x)
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT e.lang, e.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS BIGINT) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + v) AS BIGINT) AS q FROM c JOIN v USING (lang) GROUP BY lang, term, v),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
t AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q) * (p.p - l.q) // l.q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source UNION ALL SELECT * FROM t)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
"""


def _fold(n: int, key: str = "doc_id") -> Column:
    """The fold of an id; a null id counts as the empty text, so it has fold 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


@REGISTRY.query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(4) != 2))
    return langid.identify(docs, model, keep=[F.col("doc_id"), (_fold(4) == 2).alias("held_out")])


@REGISTRY.query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """licenses: the distinct names found, in order; spans: license@first_word+n_words."""
    found = license_scan(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    return found.select(
        "doc_id",
        F.size("matches").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat(m["license"], F.lit("@"), m["first_word"].cast("string"), F.lit("+"), m["n_words"].cast("string"))), ",").alias("spans"),
    )


@REGISTRY.query("op3_token_rollups")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after five batches, one of them sent twice; in the end every document counts.

    Tokenizer word_bpe_49k: every document is inserted once. Tokenizer words: every
    document is inserted with an estimate (a quarter of its bytes) and then revised to its
    number of words; a sixteenth of the documents, by checksum of the id, is deleted and
    inserted again.
    """
    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark, f"{Scratch(spark).path}/tokens")
    keys = [F.col("source"), F.col("lang")]
    none = F.lit(None).cast("long")
    bpe = counted(docs, keep=keys).select(F.lit("insert").alias("op"), "source", "lang", F.lit("word_bpe_49k").alias("tokenizer"), "n_tokens", none.alias("old_tokens"))
    estimate = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    plain = docs.select("doc_id", *keys, F.lit("words").alias("tokenizer"), estimate.alias("estimate"), words.alias("words"))
    change = lambda op, rows, n, old: rows.select(F.lit(op).alias("op"), *keys, "tokenizer", n.alias("n_tokens"), old.alias("old_tokens"))
    ledger.commit("0-bpe", bpe)
    ledger.commit("1-estimates", change("insert", plain, F.col("estimate"), none))
    for _ in range(2):  # the second time changes nothing
        ledger.commit("2-words", change("revise", plain, F.col("words"), F.col("estimate")))
    some = plain.where(_fold(16) == 0)
    ledger.commit("3-withdrawn", change("delete", some, none, F.col("words")))
    ledger.commit("4-back", change("insert", some, F.col("words"), none))
    return ledger.totals()


@REGISTRY.query("op4_quality_fm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), _fold(5, "id") != 0, metadata=["n_chars"])
    return quality.classify(docs, model, keep=[F.col("doc_id"), (_fold(5) == 0).alias("held_out")])


@REGISTRY.query("op5_hypergeometric_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle_to_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@REGISTRY.query("op6_benchmark_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@REGISTRY.query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = token_files(spark, table(spark, sf_dir, "documents"), Scratch(spark).path)
    return read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@REGISTRY.query("op8_harmonic_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to")


@REGISTRY.query("op9_simhash_bktree")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


@REGISTRY.query("op10_content_sort_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@REGISTRY.query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


@REGISTRY.query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


@REGISTRY.query("op13_substring_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


@REGISTRY.query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
