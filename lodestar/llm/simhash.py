"""SimHash fingerprints and near-duplicate classes found with BK-trees.

Fingerprints: 64 bits of the whole text's word shingles. Links: at most RADIUS differing
bits. Equal fingerprints are one node throughout.

A BK-tree keeps the children of a node under their integer distance to it, and a search
within radius r follows, from a node at distance d, only the edges d - r to d + r. One tree
over all fingerprints would grow with the corpus, and so would each search in it, so there
is a tree a shard: with the 64 bits in m blocks, two fingerprints that differ in at most r
bits agree in at least m - r whole blocks, hence share one of C(m, r) block combinations.
Each value of a combination is a shard, and no link crosses all of them. m grows with the
number of fingerprints, so that shards stay small.

1. A shard of at most PIECE nodes meets in one task, which builds its tree, searches it for
   each node and keeps the links that join components. Nearly all links are found here.
2. A larger shard is mostly one group of near copies. Its smallest fingerprint is the root
   of its tree; the first step of every search, the distance to the root, is computed for
   all nodes at once, and nodes within the radius are linked to it. A shard whose nodes are
   all connected by now needs no further step, however many nodes it holds.
3. In other large shards, pairs inside the most frequent component need no search: trees are
   built of the remaining nodes, at most about PIECE each, and broadcast in groups of at most
   GROUP nodes, counted before; all nodes of these shards search them where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, importable
from lodestar.llm.components import components, join_to_unique
from lodestar.llm.memory import serve

RADIUS = 4
SHINGLE = 4
SEED = 42
#: nodes of a tree, and nodes of the trees that are broadcast at a time
PIECE, GROUP = 2048, 1 << 18
#: shingles whose bits are counted at a time
BLOCK = 1 << 14

_BLANKS = bytes(range(9, 14))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BLANKS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_BLANKS))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    totals = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], dtype="<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, keep_text: bool = False, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id as it is, the `keep` columns, text by `keep_text`, and fp: the 64 bits as a signed long."""
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    rows = df.select(F.col(id_col).alias("id"), *kept, F.col(text_col).alias("text"))
    passed = len(rows.columns) - (not keep_text)
    schema = rows.select(*rows.columns[:passed]).schema.add("fp", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("SimHash")
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(batch.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns[:passed], pa.array(fps)], names=schema.fieldNames())

    return importable(rows).mapInArrow(run, schema).toDF("id", *df.select(*(keep or [])).columns, *(["text"] if keep_text else []), "fp")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        node = 0
        while d := (self.values[node] ^ value).bit_count():
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            node = below

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values within the radius, in the order in which they were added."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            edges = self.children[node]
            if len(edges) > 2 * radius + 1:
                todo.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)
            else:
                todo.extend(child for k, child in edges.items() if d - radius <= k <= d + radius)


class Unions:
    """Components of what has been linked so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were connected before."""
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Places of linked values of one shard, found in its tree; they join what all pairs within the radius join."""
    tree, unions, links = BKTree(), Unions(), []
    for i, value in enumerate(values):
        links += [(i, j) for j in tree.search(value, radius) if unions.join(i, j)]
        tree.add(value)
    return links


def block_plan(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], int]:
    """(shift, bits) of the blocks and how many of them have to agree, for n fingerprints.

    The fewest blocks whose agreeing combinations have about log2(n) bits.
    """
    for m in range(radius + 1, 13):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        agree = m - radius
        if m >= radius + 2 and sum(sorted(b for _, b in blocks)[:agree]) >= min(60, max(1, n).bit_length() - 2) or m == 12:
            return blocks, agree
    raise AssertionError


_MASK = (1 << 64) - 1


def _pairs(nodes: pa.Array, found: list[tuple[int, int]], others: pa.Array | None = None) -> pa.RecordBatch:
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.record_batch([nodes.take(pa.array(at[:, 0])), (nodes if others is None else others).take(pa.array(at[:, 1]))], names=["a", "b"])


def _whole_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut so that rows of a key, which follow one another, stay together."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            key = held["key"].to_numpy()
            other = np.flatnonzero(key != key[-1])
            if len(other):
                yield held.slice(0, int(other[-1]) + 1)
                held = held.slice(int(other[-1]) + 1)
    if held is not None:
        yield held


def _small_shards(rows: DataFrame, radius: int, schema: str) -> DataFrame:
    """Links in shards that meet in one task each; rows have key and node."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("SimHash")
        for table in _whole_shards(batches):
            table = table.combine_chunks()
            key, nodes = table["key"].to_numpy(), table["node"].chunk(0)
            values = [v & _MASK for v in nodes.field("fp").to_pylist()]
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            found = [(lo + i, lo + j) for lo, hi in zip(edges, edges[1:], strict=False) for i, j in shard_links(values[lo:hi], radius)]
            if found:
                yield _pairs(nodes, found)

    return importable(rows).repartition("key").sortWithinPartitions("key").mapInArrow(search, schema)


def _tree_groups(members: DataFrame, group: int) -> int:
    """In how many groups the trees are broadcast, so that none has more than `group` nodes."""
    total = members.count()
    groups = -(-total // group)
    while groups and members.groupBy(F.pmod(F.xxhash64("key", "tree"), F.lit(groups))).count().agg(F.max("count")).first()[0] > group:
        groups *= 2
    return groups


def _broadcast_trees(members: DataFrame, queries: DataFrame, radius: int, schema: str) -> DataFrame:
    """Links from queries (key, node, label) to the trees of one group of members (key, tree, node, label).

    The group reaches the driver, which builds its trees and broadcasts them.
    """
    got = members.select("key", "tree", "node", "label").toArrow().combine_chunks()
    nodes = got["node"].chunk(0) if got.num_rows else None
    trees: dict[int, dict[int, tuple[BKTree, list[int]]]] = {}
    for at, (key, tree, node) in enumerate(zip(*(got[c].to_pylist() for c in ("key", "tree", "node")), strict=True)):
        bk, places = trees.setdefault(key, {}).setdefault(tree, (BKTree(), []))
        bk.add(node["fp"] & _MASK)
        places.append(at)
    shipped = members.sparkSession.sparkContext.broadcast((trees, nodes, got["label"].to_pylist()))
    keys = members.sparkSession.createDataFrame([(k,) for k in trees], "key long")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("SimHash")
        trees, nodes, labels = shipped.value
        unions = Unions()
        for batch in batches:
            found, own = [], batch.column("node")
            for i, (key, fp, label) in enumerate(zip(batch.column("key").to_pylist(), own.field("fp").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                for bk, places in trees[key].values():
                    found += [(i, places[j]) for j in bk.search(fp & _MASK, radius) if unions.join(label, labels[places[j]])]
            if found:
                yield _pairs(own, found, nodes)

    return importable(queries.join(F.broadcast(keys), "key").select("key", "node", "label")).mapInArrow(search, schema)


def near_links(nodes: DataFrame, n: int, scratch: Scratch, radius: int = RADIUS, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """(a, b, found): links whose components are those of all pairs of nodes within the radius.

    nodes has `node`, a struct that ends with fp and is ordered as component ids shall be.
    found: by "tree" (step 1), at the "root" (step 2) or in a "broadcast tree" (step 3).
    """
    blocks, agree = block_plan(n, radius)
    keys = []
    for number, chosen in enumerate(combinations(blocks, agree)):
        key = F.lit(number).cast("long")
        for shift, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("node.fp", shift).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(key)
    schema = f"a {nodes.schema['node'].dataType.simpleString()}, b {nodes.schema['node'].dataType.simpleString()}"
    keyed = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shards = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    large = shards.where(F.col("n") > piece)
    n_large = large.count()
    near_by = lambda df: F.broadcast(df) if n_large <= group else df
    small = keyed.join(near_by(large.select("key")), "key", "left_anti") if n_large else keyed
    small = small.join(shards.where(F.col("n") <= piece).select("key"), "key")
    links = scratch.save(_small_shards(small, radius, schema).withColumn("found", F.lit("tree")), "tree-links")
    if not n_large:
        return links

    rows = scratch.save(keyed.join(near_by(large.select("key")), "key"), "large-shards")
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"))
    near = F.bit_count(F.col("node.fp").bitwiseXOR(F.col("pivot.fp"))) <= radius
    at_root = rows.join(near_by(pivots), "key").where((F.col("node.fp") != F.col("pivot.fp")) & near)
    at_root = at_root.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = links.unionAll(scratch.save(at_root.withColumn("found", F.lit("root")), "root-links"))
    linked = components(links, scratch).select("node", F.col("root.fp").alias("top"))
    rows = rows.join(linked, "node", "left").select("key", "node", F.coalesce("top", "node.fp").alias("label"))
    rows = scratch.save(rows, "labelled")
    per = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1")
    main = main.select("key", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / piece).cast("int").alias("trees"))
    queries = scratch.save(rows.join(near_by(main), "key"), "open-shards")
    members = queries.where("label <> main").withColumn("tree", F.pmod(F.xxhash64("node.fp"), F.col("trees")).cast("int"))
    groups = _tree_groups(members, group)
    for g in range(groups):
        some = members.where(F.pmod(F.xxhash64("key", "tree"), F.lit(groups)) == g)
        found = _broadcast_trees(some, queries, radius, schema).withColumn("found", F.lit("broadcast tree"))
        links = links.unionAll(scratch.save(found, "broadcast-links"))
    return links


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, keep_text: bool = False, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, limit: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable), first, then the `keep` columns and, by `keep_text`, text.

    Null, empty and blank texts have fingerprint zero and link like any others. Ids may have
    any type that has an order. A null id is not a candidate for component_id, which is null
    only where a whole component has no id. Rows that repeat an id or a text are one node
    with their fingerprint. first is true for exactly one row of a component, of those with
    the smallest id. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession)
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    docs = fingerprints(df, id_col, text_col, kept, keep_text, shingle, seed).withColumn("place", F.monotonically_increasing_id())
    docs = scratch.save(docs, "fingerprints")  # places are fixed by being stored
    least = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    nodes = docs.groupBy("fp").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.save(nodes.select(F.struct("least", "fp").alias("node"), "n"), "nodes")
    n_nodes, n_docs = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    linked = components(near_links(nodes.select("node"), n_nodes, scratch, radius), scratch)
    linked = linked.select(F.col("node.fp").alias("fp"), F.col("root"))
    # a fingerprint of one row and no link is its own class; only the others are looked up
    shared = nodes.select("node.fp", "node", "n").join(linked, "fp", "left").where("n > 1 or root is not null")
    shared = scratch.save(shared.select("fp", "n", F.coalesce("root", "node")["least"].alias("least")), "classes")
    placed = docs.join(F.broadcast(shared), "fp", "left") if shared.count() <= limit else join_to_unique(docs, shared, "fp", n_docs, "left")
    component = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return placed.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("least.place") == F.col("place"), F.lit(True)).alias("first"),
        *(F.col(f"k{i}").alias(n) for i, n in enumerate(names)),
        *(["text"] if keep_text else []),
    )
