"""How the sources of a language differ in their words: a sort-based streaming audit.

Entries (lang, term, source, document) are dealt by lang and term and sorted within their
partition by all four; one scan of the sorted entries reads run lengths, which are document
frequencies and counts, with a state of one run. Entries are summed before they are sent: a
task sends one for all its documents of a source, so a term that stands in a third of all
rows is as many entries as there are tasks and sources. Only a text too long to be counted
at once keeps its document number, and the scan counts it once.

A second scan, of the runs of kept terms, emits partial sums for pairs of sources, and terms
that may be among a source's first. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, importable
from lodestar.llm.memory import serve

SCALE = 1_000_000_000
LEAST_DOCS, TERMS = 3, 200
#: distinct entries a task holds before it sends them; bytes of a text that are counted at once
ENTRIES, BLOCK = 300_000, 1 << 22
#: sources whose pairs one scan sums: a task holds the square of it
SOURCES = 1_024
#: bytes of terms: ASCII letters, lowered, and all of other scripts; the others part terms
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_ENTRY = "lang string, term binary, source string, doc long, n_docs long, n long"
_RUN = "lang string, term binary, n_docs long, n long, sources array<string>, counts array<long>"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list a block."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and _TABLE[raw[end]] != 32:  # no term is cut
            end += 1
        yield raw[at:end].translate(_TABLE).split()
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    serve("divergence")
    number = TaskContext.get().partitionId() << 33
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for batch in batches:
        for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            number += 1
            occurrences, documents = seen[lang, source]
            before = len(occurrences)
            if len(raw) <= BLOCK:
                for words in terms_of(raw):
                    occurrences.update(words)
                    documents.update(set(words))
                held += len(occurrences) - before
            else:
                for words in terms_of(raw):
                    one = Counter(words)
                    yield _entries([(lang, source, number, one, None)])
            if held >= ENTRIES:
                yield _entries([(*k, -1, n, d) for k, (n, d) in seen.items()])
                seen.clear()
                held = 0
    if held:
        yield _entries([(*k, -1, n, d) for k, (n, d) in seen.items()])


def _entries(groups: list[tuple[str, str, int, Counter, Counter | None]]) -> pa.RecordBatch:
    size = [len(n) for *_, n, _ in groups]
    spread = lambda i, kind: pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(groups), dtype=np.int32), size)), pa.array([g[i] for g in groups], kind)).dictionary_decode()
    terms = [t for *_, n, _ in groups for t in n]
    docs = [1 if d is None else d[t] for *_, n, d in groups for t in n]
    return pa.record_batch({"lang": spread(0, pa.string()), "term": pa.array(terms, pa.binary()), "source": spread(1, pa.string()), "doc": spread(2, pa.int64()), "n_docs": pa.array(docs, pa.int64()), "n": pa.array([c for *_, n, _ in groups for c in n.values()], pa.int64())})


def _new(*columns: pa.Array) -> np.ndarray:
    """Whether a row begins a run of equal values in all columns."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _scan(least: int):
    """Sorted entries to one row a (lang, term) in `least` documents or more; the last run of a batch waits for the next."""

    def read(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        lang, term, source, doc, n_docs, n = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        run, group = _new(lang, term), _new(lang, term, source)
        docs = doc.to_numpy()
        again = np.zeros(len(docs), bool)
        again[1:] = ~group[1:] & (docs[1:] >= 0) & (docs[1:] == docs[:-1])
        first = np.flatnonzero(group)
        counts = np.add.reduceat(n.to_numpy(), first)
        in_docs = np.add.reduceat(np.where(again, 0, n_docs.to_numpy()), first)
        begins = np.flatnonzero(run[first])  # among groups
        whole = len(begins) if last else len(begins) - 1
        tail = first[begins[whole] :] if whole < len(begins) else first[:0]
        ends = np.append(tail[1:], len(docs))[: len(tail)] - 1  # the entry of a group that has its last document
        carry = pa.table({"lang": lang.take(pa.array(tail)), "term": term.take(pa.array(tail)), "source": source.take(pa.array(tail)), "doc": doc.take(pa.array(ends)), "n_docs": pa.array(in_docs[len(in_docs) - len(tail) :]), "n": pa.array(counts[len(counts) - len(tail) :])})
        if not whole:
            return None, carry
        edge = np.append(begins, len(first))
        total = np.add.reduceat(in_docs, begins)[:whole]
        keep = np.flatnonzero(total >= least)
        width = np.diff(edge)[keep]
        inner = np.repeat(edge[keep] - np.concatenate([[0], np.cumsum(width)[:-1]]) if len(keep) else keep, width) + np.arange(width.sum())
        at = pa.array(first[begins[keep]])
        offsets = pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, source.take(pa.array(first[inner]))), pa.ListArray.from_arrays(offsets, pa.array(counts[inner]))]
        return pa.record_batch({"lang": lang.take(at), "term": term.take(at), "n_docs": pa.array(total[keep]), "n": pa.array(np.add.reduceat(counts, begins)[keep]), "sources": lists[0], "counts": lists[1]}), carry

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                made, carry = read(table if carry is None else pa.concat_tables([carry.cast(table.schema), table]), False)
                if made is not None:
                    yield made
        if carry is not None and carry.num_rows:
            yield read(carry, True)[0]

    return run


def shares(counts: np.ndarray, total: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (counts + 1) / total) in 64 bits, for totals below 10^14; counts are below total."""
    part = 31_250
    whole, rest = np.divmod((counts + 1) * part, total)
    return 1 + whole * (scale // part) + rest * (scale // part) // total


def _compare(groups: dict[str, tuple[list[str], np.ndarray, int, int]], terms: int, lo: int, lo2: int, width: int):
    """Partial sums over pairs of sources lo.. and lo2.. of each language, and terms that may be among a source's first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("divergence")
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], np.ndarray] = {}
        place = {lang: {s: i for i, s in enumerate(names)} for lang, (names, *_) in groups.items()}
        for batch in batches:
            lang = batch.column("lang")
            edges = [*np.flatnonzero(_new(lang)).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                name = lang[a].as_py()
                names, totals, v, whole = groups[name]
                step = max(1, (1 << 20) // (len(names) + min(len(names), width) ** 2))
                for at in range(a, b, step):
                    rows = batch.slice(at, min(step, b - at))
                    flat = rows.column("sources").flatten().dictionary_encode()
                    column = np.array([place[name][s] for s in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
                    counts = np.zeros((rows.num_rows, len(names)), np.int64)
                    counts[np.repeat(np.arange(rows.num_rows), rows.column("counts").value_lengths().to_numpy()), column] = rows.column("counts").flatten().to_numpy()
                    p = shares(counts, totals + v)
                    one, other = p[:, lo : lo + width], p[:, lo2 : lo2 + width]
                    if one.size and other.size:
                        d = one[:, :, None] - other[:, None, :]
                        made = (d * d // other[:, None, :]).sum(axis=0)
                        sums[name] = sums[name] + made if name in sums else made
                    if lo == lo2 and one.size:
                        yield from _first_terms(name, rows, counts, p, whole + v, lo, width, best, terms, names)
        for name, made in sums.items():
            names = groups[name][0]
            i, j = np.indices(made.shape)
            keep = (i + lo != j + lo2).ravel()
            i, j = i.ravel()[keep] + lo, j.ravel()[keep] + lo2
            n = len(i)
            yield pa.record_batch({"lang": pa.array([name] * n, pa.string()), "source": pa.array([names[x] for x in i], pa.string()), "part": pa.array(["pair"] * n, pa.string()), "item": pa.array([names[x].encode() for x in j], pa.binary()), "value": pa.array(made.ravel()[keep])})

    return run


def _first_terms(name: str, rows: pa.RecordBatch, counts: np.ndarray, p: np.ndarray, whole: int, lo: int, width: int, best: dict, terms: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    q = shares(rows.column("n").to_numpy(), np.array(whole))
    for g in range(lo, min(lo + width, len(names))):
        d = p[:, g] - q
        may = (counts[:, g] > 0) & (d > 0)
        f = np.where(may, d * d // q, -1)
        held = best.get((name, g))
        if held is not None and len(held) == terms:
            may &= f >= held[0]
        at = np.flatnonzero(may)
        if not len(at):
            continue
        found = f[at]
        best[name, g] = np.sort(found if held is None else np.concatenate([held, found]))[-terms:]
        n = len(at)
        yield pa.record_batch({"lang": pa.array([name] * n, pa.string()), "source": pa.array([names[g]] * n, pa.string()), "part": pa.array(["term"] * n, pa.string()), "item": rows.column("term").take(pa.array(at)), "value": pa.array(found)})


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, terms: int = TERMS, sources: int = SOURCES, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source is from each other one of its language, and by which terms.

    Terms are runs of ASCII letters (lowered) and characters beyond ASCII; a language keeps
    those in `least_docs` of its rows or more. A term's share p in a group is 1 +
    floor(10^9 (count + 1) / (N + V)), V kept terms, N their count there. Part `pair` has a
    row for each other source, by the sum of floor((p - q)^2 / q) over all kept terms, zero
    without any; part `term` the first `terms` terms with a count and p above the
    language's, by the same value. Rank runs from 1 by falling value, then by the item's bytes.

    Null texts, langs and sources count as ''; each row is a document, also one that repeats
    another. Other columns are ignored whatever their names; an empty table gives an empty
    result. The result has a row for each pair of sources, so the table of groups (its
    square root) goes to all tasks; pairs are summed for `sources` times `sources` at a time.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text.alias("text"))
    entries = importable(docs).mapInArrow(_count, _ENTRY).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "doc")
    runs = scratch.save(entries.mapInArrow(_scan(least_docs), _RUN), "runs")
    counted = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = scratch.save(docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    kept = {r.lang: (r.v, r.n) for r in runs.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()}
    by_lang: dict[str, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
    for lang, source, n in groups.orderBy("lang", "source").collect():
        by_lang[lang][0].append(source)
        by_lang[lang][1].append(n)
    known = {lang: (names, np.array(n, np.int64), *kept.get(lang, (0, 0))) for lang, (names, n) in by_lang.items()}
    most = max((len(names) for names, *_ in known.values()), default=0)
    parts = None
    for lo in range(0, max(1, most), sources):
        for lo2 in range(0, max(1, most), sources):
            one = runs.mapInArrow(_compare(known, terms, lo, lo2, sources), "lang string, source string, part string, item binary, value long")
            parts = one if parts is None else parts.unionByName(one)
    parts = scratch.save(parts, "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").cast("binary").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("cast(source AS binary) <> item").join(pairs, ["lang", "source", "item"], "left")
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).unionByName(parts.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= terms))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
