"""Retrieval, answer and contract metrics over detail tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.predicates import overclaims
from lodestar.functions.text import claim_text, extract_numbers, share_of, token_set, tokens

# Words of an answer's frame that need no grounding.
FRAME_WORDS = ("based", "only", "retrieved", "evidence")


def rate(flag: str | Column) -> Column:
    """Share of rows with a flag; 0 for no rows."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.round(F.count_if(c) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6)


def hit_at_k(hits: DataFrame, gold: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5), key: str = "chunk_id") -> DataFrame:
    """qid, hit_at_<k>..., rr: 1 over the rank of the first gold hit, 0 without one. gold: qid, key."""
    first = hits.join(gold.select("qid", key).distinct(), ["qid", key], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    rows = questions.select("qid").join(first, "qid", "left")
    return rows.select("qid", *(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int").alias(f"hit_at_{k}") for k in ks), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("rr"))


def summarize(details: DataFrame, *metrics: str, by: list[str] | None = None) -> DataFrame:
    """Means of metrics, 0 where there are no rows."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.round(F.avg(m), 6), F.lit(0.0)).alias(m) for m in metrics)]
    return details.groupBy(*(by or [])).agg(*aggs)


def section_hits(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """qid, hit: a top-k row whose section holds the wanted one. wanted: qid, gold_section."""
    rows = wanted.join(hits.where(F.col("rank") <= k).select("qid", "section"), "qid", "left")
    return rows.groupBy("qid").agg(F.coalesce(F.bool_or(F.contains(F.lower("section"), F.lower("gold_section"))), F.lit(False)).alias("hit"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn")]


def profile_rollup(details: DataFrame, profile: str, *flags: str) -> DataFrame:
    """Rates in total (profile null) and per profile, in one pass."""
    return details.rollup(profile).agg(F.count(F.lit(1)).alias("n"), *(rate(F.col(f)).alias(f) for f in flags))


def outcome_change(left: DataFrame, right: DataFrame, key: str = "qid", value: str = "correct") -> DataFrame:
    """improved, regressed, both or neither for questions in both runs."""
    rows = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key)
    return rows.select(key, F.when(F.col("a") & F.col("b"), "both").when(F.col("b"), "improved").when(F.col("a"), "regressed").otherwise("neither").alias("outcome"))


def key_difference(left: DataFrame, right: DataFrame, key: str = "qid") -> DataFrame:
    """Keys that only one side has: missing (left only) and unexpected (right only)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def duplicates(rows: DataFrame, key: str = "qid") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def quantiles(rows: DataFrame, value: str, wanted: dict[str, tuple[float, bool]], by: list[str], buckets: int = 1024) -> DataFrame:
    """by, a column for each wanted quantile: name -> (p, nearest rank instead of linear interpolation).

    Exact for any distribution, without a group's values in one task: values are counted in
    `buckets` equal ranges between the group's least and greatest one, which tells the
    buckets that hold the wanted ranks, and only those are put in order. Nulls don't count.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = rows.groupBy(*by).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("c").alias("n"))
    key = F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by))
    rows, ends = rows.withColumn("g", F.xxhash64(key, *(F.col(k).isNull() for k in by))), ends.withColumn("g", F.xxhash64(key, *(F.col(k).isNull() for k in by)))
    width = F.greatest(F.col("most") - F.col("least"), F.lit(1e-300))
    placed = rows.join(ends.select("g", "least", "most"), "g").withColumn("b", F.least(F.floor((F.col("v") - F.col("least")) / width * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = placed.groupBy("g", "b").agg(F.sum("c").alias("size"))
    before = F.sum("size").over(Window.partitionBy("g").orderBy("b")) - F.col("size")  # at most `buckets` rows a group
    ranks = []
    for name, (p, nearest) in wanted.items():
        if nearest:
            ranks.append(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).cast("long").alias("at"), F.lit(1.0).alias("share")))
        else:
            x = F.lit(p) * (F.col("n") - 1)
            ranks.append(F.struct(F.lit(name).alias("name"), (F.floor(x) + 1).cast("long").alias("at"), (1 - (x - F.floor(x))).alias("share")))
            ranks.append(F.struct(F.lit(name).alias("name"), F.least(F.floor(x) + 2, F.col("n")).cast("long").alias("at"), (x - F.floor(x)).alias("share")))
    asked = ends.select("g", "n", F.explode(F.array(*ranks)).alias("r")).select("g", "r.*")
    hit = sizes.withColumn("base", before).join(asked, "g").where((F.col("at") > F.col("base")) & (F.col("at") <= F.col("base") + F.col("size")))
    needed = hit.select("g", "b", "base").distinct()
    within = F.sum("c").over(Window.partitionBy("g", "b").orderBy("v"))
    ordered = placed.join(needed, ["g", "b"]).withColumn("to", F.col("base") + within).select("g", "v", (F.col("to") - F.col("c")).alias("from"), "to")
    found = ordered.join(asked, "g").where((F.col("at") > F.col("from")) & (F.col("at") <= F.col("to")))
    per = found.groupBy("g").agg(*(F.sum(F.when(F.col("name") == name, F.col("v") * F.col("share"))).alias(name) for name in wanted))
    return ends.join(per, "g").select(*by, *wanted)


def latency(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, median, min, max and nearest-rank p95."""
    v = F.col(value)
    by = by or []
    plain = rows.groupBy(*by).agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    places = quantiles(rows, value, {"median": (0.5, False), "p95": (0.95, True)}, by)
    joined = plain.crossJoin(F.broadcast(places)) if not by else plain.alias("a").join(places.alias("b"), reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by))).select("a.*", "b.median", "b.p95")
    return joined.select(*by, "mean", F.round("median", 6).alias("median"), "min", "max", "p95")


def passage_gold(items: DataFrame, texts: DataFrame, id_col: str, run: int = 8, rows: int = 1_000_000) -> DataFrame:
    """qid, id: texts that hold any `run` consecutive words of a question, or all words of a shorter one.

    items: qid, question; texts: id, text. Words are hashed once; runs meet by the hash of
    their words' hashes and are then compared word by word. The questions' runs are broadcast
    if there are at most `rows`.
    """
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    q = items.select("qid", tokens("question").alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(run)))
    q = q.select("qid", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("at"))
    q = q.select("qid", F.slice("w", F.col("at"), F.col("k")).alias("r")).distinct().withColumn("k", F.size("r"))
    sizes = sorted(k for (k,) in q.select("k").distinct().collect()) or [run]
    q = q.withColumn("h", F.xxhash64("k", hashed(F.col("r"))))
    d = texts.select(id_col, tokens("text").alias("w")).withColumn("hw", hashed(F.col("w"))).select(id_col, "w", "hw", F.posexplode("hw").alias("p", "x"))
    key = lambda k: F.when(F.col("p") + k <= F.size("w"), F.xxhash64(F.lit(k), F.slice("hw", F.col("p") + 1, F.lit(k))))
    d = d.withColumn("h", F.explode(F.array(*map(key, sizes)))) if len(sizes) > 1 else d.withColumn("h", key(sizes[0]))
    if q.count() <= rows:
        met = d.join(F.broadcast(q), "h")
    else:
        met = d.select(id_col, "h", F.slice("w", F.col("p") + 1, F.lit(run)).alias("w"), F.lit(0).alias("p")).join(q, "h")
    return met.where(F.slice("w", F.col("p") + 1, F.col("k")) == F.col("r")).select("qid", id_col).distinct()


def answer_quality(answers: DataFrame, evidence_text: DataFrame) -> DataFrame:
    """Grounded share of the answer's terms, unsupported numbers, overclaims. Tables: qid, answer; qid, hay."""
    rows = answers.join(evidence_text, "qid", "left").withColumn("hay", F.coalesce("hay", F.lit("")))
    bare = F.regexp_replace("answer", r"\[E\d+\]", " ")
    terms = F.array_distinct(F.filter(tokens(bare), lambda t: (F.char_length(t) >= 3) & ~t.isin(*FRAME_WORDS)))
    claim = claim_text("answer")
    return rows.select(
        "qid",
        F.round(share_of(terms, token_set("hay")), 6).alias("grounded"),
        F.array_sort(F.array_except(extract_numbers(claim), extract_numbers("hay"))).alias("unsupported_numbers"),
        overclaims(claim).alias("overclaim"),
    )


def marked_ids(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E\d+)\]"), F.lit(1)))


def ids_valid(used: Column, known: Column) -> Column:
    """Some id is used, and all used ones are known."""
    return (F.size(used) > 0) & (F.size(F.array_except(used, known)) == 0)


def page_hits(hits: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """qid, doc_hit, page_hit in the top k. wanted: qid, doc_id, page, window."""
    w = wanted.select("qid", F.col("doc_id").alias("want"), "page", "window")
    rows = w.join(hits.where(F.col("rank") <= k).select("qid", "doc_id", "page_start", "page_end"), "qid", "left")
    near = (F.col("page_start") <= F.col("page") + F.col("window")) & (F.col("page_end") >= F.col("page") - F.col("window"))
    same = F.col("doc_id") == F.col("want")
    return rows.groupBy("qid").agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("doc_hit"), F.coalesce(F.bool_or(same & near), F.lit(False)).alias("page_hit"))


def failure_categories(details: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds category: the first rule that holds, else passed."""
    return details.withColumn("category", F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules), F.lit("passed")))


def experiment_matrix(summaries: dict[str, DataFrame]) -> DataFrame:
    """Long table (experiment, metric, value) from one-row summaries of different shapes."""
    out = None
    for name, df in summaries.items():
        numeric = [c for c, kind in df.dtypes if kind in ("double", "bigint", "int")]
        part = df.select(F.lit(name).alias("experiment"), F.explode(F.create_map(*(x for c in numeric for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value"))
        out = part if out is None else out.unionByName(part)
    return out


def recomputed(details: DataFrame, summary: DataFrame, flags: tuple[str, ...], by: str, eps: float = 1e-12) -> DataFrame:
    """Check rows: by, metric, stated, recomputed, ok; summaries are compared with their details."""
    again = details.groupBy(by).agg(*((F.sum(F.col(f).cast("int")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f) for f in flags))
    long = lambda df, v: df.select(by, F.expr(f"stack({len(flags)}, " + ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in flags) + f") AS (metric, {v})"))
    rows = long(summary, "stated").join(long(again, "recomputed"), [by, "metric"], "full")
    return rows.withColumn("ok", F.coalesce(F.abs(F.col("stated") - F.col("recomputed")) <= eps, F.lit(False)))


def last_message(events: DataFrame, by: str, order: str, text: str, when: Column) -> DataFrame:
    return events.where(when).groupBy(by).agg(F.max_by(text, order).alias("last"))


def round_robin(rows: DataFrame, by: str, order: list[str], n: int | None = None) -> DataFrame:
    """The k-th row of every group before any (k+1)-th; `n` cuts the list, as a sample."""
    placed = rows.withColumn("round", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return placed.orderBy("round", by).limit(n) if n else placed
