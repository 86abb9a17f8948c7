"""The ten operators against brute force, round trips and held-out accuracy on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import langid, licenses, packing, quality, sharding, simhash, wordhash
from lodestar.llm.common import Scratch
from lodestar.llm.components import components
from lodestar.llm.decontaminate import contamination
from lodestar.llm.dedup_exact import exact_dedup
from lodestar.llm.token_counts import TokenLedger, counted, signed
from lodestar.llm.token_files import TokenFile, read_token_files, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"Word{i % 977} tail{i % 13}," for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from it",
    "The quick\tbrown fox  jumps over the lazy dog and runs away\r\nfrom it",
    "",
    None,
    "   ",
    " ",
    "one",
    "é à ü ñ ß Straße CAFÉ déjà vu",
    "## 2 #2# <|endoftext|> mixed-case IT'S o'clock 3.14",
    "x y z \x1c\x1d İstanbul KK é",
    LONG,
    LONG,
    "!!! ??? ...",
    "The quick brown fox jumps over the lazy dog and runs away from it",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], f"s{i % 2}", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns that clash with results."""
    rows = [(1, "a b c", "x", 5), (1, "a b c", "x", 5), (None, "a b c", None, None), (None, None, "y", 0), (3, "a b c d", "z", 1), (0, "q", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, shard int").withColumn("id", F.lit("id")).withColumn("norm", F.lit("n")).withColumn("w", F.lit(1)).withColumn("fp", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_is_brute_force(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in enumerate(TEXTS)}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for run_rows, prefix in ((256, 64), (1, 4), (2, 0)):
        got = {r.doc_id: r for r in exact_dedup(docs, run_rows=run_rows, prefix=prefix).collect()}
        assert len(got) == len(TEXTS)
        for i, t in norm.items():
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(groups[t]), len(groups[t]), i == min(groups[t]))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("run_rows", [256, 1])
def test_exact_dedup_odd_rows(odd, empty, run_rows):
    rows = exact_dedup(odd, keep=[F.col("kept").alias("own"), F.col("shard")], run_rows=run_rows).toArrow().to_pylist()
    assert sorted(repr((r["own"], r["shard"])) for r in rows) == sorted(repr((r.kept, r.shard)) for r in odd.collect())
    same = [r for r in rows if r["group_size"] == 3]
    assert len(rows) == 6 and len(same) == 3 and {r["keep_id"] for r in same} == {1}
    assert [r["keep_id"] for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()] == [None]
    rows = exact_dedup(odd, run_rows=run_rows).collect()
    assert [r.doc_id for r in rows if r.group_size == 3 and r.kept] == [1] and sum(r.kept for r in rows) == 4
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_splits_hot_texts_and_shared_beginnings(spark):
    """Copies of one text, also with null ids, and texts that begin alike are dealt over the sort's places."""
    rows = [(i if i % 2 else None, "the same text") for i in range(900)] + [(i, "shared beginning " * 20 + str(i % 450)) for i in range(900, 1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    scratch = Scratch(spark)
    got = exact_dedup(df, run_rows=50, scratch=scratch).groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r.keep_id, r.group_size, r.kept) for r in got} == {(1, 900, 1)} | {(i, 2, 1) for i in range(900, 1350)}
    runs = spark.read.parquet(f"{scratch.path}/002-runs")
    assert runs.where("salted and at = 1").count() > 10 and runs.agg(F.max("run_n")).first()[0] < 300


def test_exact_dedup_has_one_text_exchange(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the sorted runs are read from the shared folder


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(texts, items):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        names = sorted(found)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [200_000, 2])
def test_contamination_is_brute_force(spark, limit):
    rng = random.Random(limit)
    vocabulary = ["aa", "bb", "cc", "éé", "d1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 10, 12, 15])))) for i in range(8)] + [(8, None), (9, "..."), (10, "Never Here")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(25)] + ["x " + items[0][1] + " y", items[5][1].upper(), None, "", LONG, *[" ".join([t or "", "zz", t or ""]) for _, t in items]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in contamination(df, spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0)), limit=limit).collect()}
    for i, want in enumerate(leaks(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, texts[i]


def test_contamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    for limit in (200_000, 0):
        rows = contamination(odd, items, limit=limit).collect()
        assert len(rows) == 6 and sum(r.contaminated for r in rows) == 4
    assert contamination(empty, items).count() == 0
    clean = contamination(odd, items.limit(0)).collect()
    assert len(clean) == 6 and not any(r.contaminated for r in clean)


def library_ids(text):
    import public_tokenizers

    return [*library(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library():
    import public_tokenizers

    from lodestar.llm.tokens import Encoder

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    alphabet = "abcXYZ012 '.,;:!?#<|>-_/ \n\té\u0301ßİKſ…–\u00ad\u200d\x1c\x85\u3000ʼ’²½१あΣς"
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœāčēğłńőšžǆªºıſ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000))]
    texts += TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)] + ["it's we've don't 's. x's.'re"]
    for encode, block in ((Encoder(path), 1 << 22), (Encoder(path, memory=40, stems=20), 37), (Encoder(path, by_word=False), 37)):
        for text in texts if block > 100 else texts[:11] + texts[15:]:
            assert np.frombuffer(encode.one(text, block), "<u4").tolist() == library(path).encode(text or "", add_special_tokens=False).ids


@lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_files_round_trip(spark, docs, odd, empty):
    files, folder = token_files(spark, docs, Scratch(spark).path, sequence=64, file_tokens=50)
    assert files.count() > 3
    got = read_token_files(files, folder).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(got, TEXTS, strict=True):
        ids = library_ids(text)
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (start, len(ids), crc(ids))
        start += len(ids)
    for name, n in ((f.name, f.n_tokens) for f in files.collect()):
        f = TokenFile(folder, name)
        whole, masks = [], []
        for k in range(-(-n // 64)):
            assert len(f.sequence(k)) == 64
            whole.append(f.sequence(k))
            masks.append(f.mask(k))
        mask = np.concatenate(masks)
        assert mask.sum() == n and mask[:n].all()
        assert np.array_equal(np.concatenate(whole)[mask], f.tokens(0, n))
        assert not f.sequence(0).flags.writeable  # a view of the mapped file
    files, folder = token_files(spark, odd, Scratch(spark).path)
    first = read_token_files(files, folder).collect()
    assert len(first) == 6 and sorted(map(repr, (r[1:] for r in first))) == sorted(map(repr, (r[1:] for r in read_token_files(*token_files(spark, odd.repartition(2), Scratch(spark).path)).collect())))
    files, folder = token_files(spark, empty, Scratch(spark).path)
    assert read_token_files(files, folder).count() == 0


def test_what_failed_tasks_left_is_deleted(spark, docs):
    import pathlib

    path = Scratch(spark).path
    folder = pathlib.Path(path.removeprefix("file://"), "tokens")
    folder.mkdir(parents=True)
    (folder / ".part-000000-0000.arrow.1f").write_bytes(b"x")
    files, _ = token_files(spark, docs, path)
    assert {p.name for p in folder.iterdir() if p.name.startswith(".part")} == set() and files.count() > 0


def test_packing_places_every_id_once(spark, docs, odd, empty):
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert crc(np.frombuffer(b"".join(p.ids for p in pieces), "<u4")) == crc(library_ids(text))
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert {p.doc_tokens for p in pieces} == {len(library_ids(text))}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        used = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert used <= 4096 and {p.sequence_tokens for p in pieces} == {used}
        assert {p.padded_to for p in pieces} == {used if used & (used - 1) == 0 else 4096}
    assert packing.pack(odd).where("start = 0").count() == 6
    assert packing.pack(empty).count() == 0


def test_open_pieces_don_t_keep_their_documents():
    packer, out, rng = packing.Packer(0), [], np.random.default_rng(1)
    for i in range(300):
        packer.add(i, np.zeros(int(rng.integers(90_000, 110_000)), "<u4"), out)
        out.clear()
    held = [piece[2] for pieces in packer.open.values() for piece in pieces]
    assert len(held) > 50
    kept = {id(base): base.nbytes for p in held for base in [p if p.base is None else p.base]}
    assert sum(kept.values()) <= 4 * packing.CAPACITY * packing.CLASSES


def test_packer_wastes_little():
    rng, out = np.random.default_rng(1), []
    packer = packing.Packer(0)
    lengths = rng.lognormal(6, 1.5, 3000).astype(int) + 1
    for i, n in enumerate(lengths):
        packer.add(i, np.zeros(n, "<u4"), out)
    packer.flush(out)
    padded = {r[5]: r[8] for r in out}
    assert sum(r[2] for r in out) == lengths.sum()
    assert sum(padded.values()) <= 1.01 * lengths.sum()
    for n in (1, 5, 63, 64, 65, 1365, 4095, 4096, 10_000):
        assert sum(x for _, x in packing.cut(n)) == n


def by_hand(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for text in TEXTS[:10] + [LONG[:5000], "a b c d e"]:
        assert simhash.fingerprint(text) == by_hand(text)


def classes_by_hand(fps, radius=4):
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    known = sorted(set(fps))
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {f: find(f) for f in known}


def as_long(f):
    return f - (1 << 64) if f >> 63 else f


def clusters(rng, n, members, bits):
    """n random fingerprints, the first of which have clusters, chains and near misses around them."""
    fps = [rng.getrandbits(64) for _ in range(n)]
    for centre in fps[: len(members)]:
        for _ in range(members[fps.index(centre)]):
            f = centre
            for b in rng.sample(range(64), rng.randint(1, bits)):
                f ^= 1 << b
            fps.append(f)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize(("piece", "group", "members"), [(2048, 1 << 18, [25] * 6), (3, 1 << 18, [25] * 6), (4, 16, [25] * 6), (200, 1 << 18, [1500, 40])])
def test_trees_join_what_all_pairs_join(spark, piece, group, members):
    """Also in shards of over a thousand nodes, by the trees of small shards, at the roots of large ones and in broadcast trees."""
    fps = clusters(random.Random(piece), 60, members, 7)
    scratch = Scratch(spark)
    nodes = spark.createDataFrame([(as_long(f), i) for i, f in enumerate(fps)], "fp long, least long").select(F.struct(F.lit(False).alias("none"), "least", "fp").alias("node"))
    links = simhash.near_links(nodes, len(fps), scratch, piece=piece, group=group)
    for r in links.collect():
        assert ((r.a.fp ^ r.b.fp) & ((1 << 64) - 1)).bit_count() <= 4
    found = {r.found for r in links.select("found").distinct().collect()}
    assert found == ({"tree"} if piece == 2048 else {"tree", "root", "broadcast tree"})
    got = {r.node.fp: r.root for r in components(links, scratch).collect()}
    want, have, least = defaultdict(set), defaultdict(set), {as_long(f): i for i, f in enumerate(fps)}
    for f, t in classes_by_hand(fps).items():
        want[t].add(as_long(f))
    for f in least:
        have[got[f].fp if f in got else f].add(f)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))
    assert all(root.least == min(least[f] for f in have[root.fp]) for root in got.values())  # a root is its component's first node


def test_shard_links_are_all_pairs_of_a_big_shard():
    fps = clusters(random.Random(8), 400, [900, 300, 200], 5)
    links, top = simhash.shard_links(fps, 4), classes_by_hand(fps)
    assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in links)
    unions = simhash.Unions()
    for i, j in links:
        assert unions.join(i, j)
    assert len({unions.top(i) for i in range(len(fps))}) == len(set(top.values()))


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(4)
    values = list({rng.getrandbits(14) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.search(q, 4)} == {v for v in values if (v ^ q).bit_count() <= 4}


def test_block_plan_loses_no_pair():
    for n in (1, 10**5, 10**8, 10**11):
        blocks, agree = simhash.block_plan(n)
        assert sum(b for _, b in blocks) == 64 and len(blocks) - agree >= simhash.RADIUS


def test_simhash_classes(docs, odd, empty):
    got = {r.doc_id: r for r in simhash.simhash_classes(docs).collect()}
    fps = {i: by_hand(t) for i, t in enumerate(TEXTS)}
    top = classes_by_hand(list(fps.values()))
    for i in fps:
        assert got[i].fingerprint == f"{fps[i]:016x}"
        assert got[i].component_id == min(j for j in fps if top[fps[j]] == top[fps[i]])
    assert simhash.simhash_classes(odd).count() == 6
    assert simhash.simhash_classes(empty).count() == 0
    named = {r.doc_id: r.component_id for r in simhash.simhash_classes(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()}
    assert all(named[f"d{i}"] == min(f"d{j}" for j in fps if top[fps[j]] == top[fps[i]]) for i in fps)


def test_hot_fingerprints_and_hubs(spark, monkeypatch):
    """Rows of a hot key meet their one partner by broadcast; results are the same."""
    from lodestar.llm import components as stars

    monkeypatch.setattr(stars, "HOT_ROWS", 3)
    texts = [None] * 40 + ["a b c d e f"] * 30 + [f"own text number {i} of many {i * 7}" for i in range(20)]
    rows = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.simhash_classes(rows).groupBy("fingerprint", "component_id").count().collect()
    assert sorted(r["count"] for r in got)[-2:] == [30, 40] and sum(r["count"] for r in got) == len(texts)
    assert {r.component_id for r in got if r["count"] in (30, 40)} == {1, 40}
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 300), 100)}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}


def test_communication_matrix_margins(monkeypatch):
    for sizes, room in (([5, 0, 17, 300], [50, 50, 200, 22]), ([1], [0, 1]), ([10**10, 3 * 10**9], [12 * 10**9, 10**9]), ([], [0, 0])):
        m = sharding.communication_matrix(sizes, room)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == room and m.min(initial=0) >= 0
    for exact in (sharding.EXACT, 0):  # numpy's draws and those by inversion have one mean and variance
        monkeypatch.setattr(sharding, "EXACT", exact)
        draws = np.array([sharding.communication_matrix([20, 80], [30, 30, 40], [exact, i])[0] for i in range(1500)])
        assert np.allclose(draws.mean(axis=0), [6, 6, 8], atol=0.25) and np.allclose(draws.var(axis=0), [20 * 0.3 * 0.7 * 80 / 99] * 2 + [20 * 0.4 * 0.6 * 80 / 99], atol=0.5)


def test_groups_of_partitions_divide_their_counts(spark):
    sizes = spark.createDataFrame([(p, 10 + p % 7) for p in range(50)], "part int, n long")
    ends = {r.part: np.diff([0, *r.ends]) for r in sharding._ends(sizes, 6, 5, 8).collect()}
    assert sorted(ends) == list(range(50)) and all(ends[p].min() >= 0 and ends[p].sum() == 10 + p % 7 for p in ends)
    totals = sum(ends.values())
    assert totals.max() - totals.min() <= 1


def test_hypergeometric_draws_have_their_mean_and_variance():
    rng = random.Random(9)
    draws = np.array([sharding.hypergeometric(30, 70, 20, rng) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_shards_are_exact_and_slots_gapless(docs, odd, empty):
    for n, bucket, group in ((4, 20_000, 1024), (3, 1, 2)):
        rows = sharding.shuffle_to_shards(docs, n, bucket_rows=bucket, group=group).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.size == len((TEXTS[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode())
        assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[s]) for s in range(n)]
        assert max(counts) - min(counts) <= 1
    assert sharding.shuffle_to_shards(odd, 2).count() == 6
    assert sharding.shuffle_to_shards(empty, 2).count() == 0


def test_write_shards_round_trip(spark, docs):
    path = Scratch(spark).folder("shards")
    sharding.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == len(TEXTS) and {r.text for r in back.collect()} == set(TEXTS)


def test_write_shards_keeps_rows_with_null_and_repeated_ids(spark, odd):
    path, rows = Scratch(spark).folder("shards"), odd.drop("shard")
    sharding.write_shards(rows, path, 4)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(rows.columns).collect())) == sorted(map(repr, rows.collect()))
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_write_shards_keeps_columns_of_any_name(spark):
    path = Scratch(spark).folder("shards")
    rows = spark.createDataFrame([(i, f"t{i}", "a", i * 2, "b", "c") for i in range(9)], "doc_id long, text string, __row string, Shard int, slot string, `a.b` string")
    sharding.write_shards(rows, path, 2)
    back = spark.read.parquet(path)
    assert set(back.columns) == {"doc_id", "text", "__row", "input_Shard", "input_slot", "a.b", "slot", "shard"}
    assert sorted((r.doc_id, r.text, r["__row"], r.input_Shard, r.input_slot, r["a.b"]) for r in back.collect()) == [(i, f"t{i}", "a", i * 2, "b", "c") for i in range(9)]
    assert sorted((r.shard, r.slot) for r in back.collect()) == [*((0, i) for i in range(5)), *((1, i) for i in range(4))]


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    inside = np.ones(256, bool)
    inside[32] = False
    raw = np.frombuffer(b"abc  de abc f de abcd", np.uint8)
    h = wordhash.span_hashes(raw, *wordhash.spans(raw, inside)).tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 4
    monkeypatch.setattr(wordhash, "KEPT", 4)
    assert wordhash.span_hashes(raw, *wordhash.spans(raw, inside)).tolist() == h


def test_language_of_clear_texts(spark, empty):
    rows = [("en", "the house and the garden with the tree " * 3), ("fr", "la maison et le jardin avec les arbres " * 3), ("de", "das haus und der garten mit dem baum " * 3)]
    model = langid.train(spark.createDataFrame(rows * 3 + [(None, "x"), ("en", None)], "lang string, text string"))
    assert model[0] == ["de", "en", "fr"]
    texts = ["the tree with the garden", "le jardin avec la maison", "der baum mit dem garten", None, "", "12 ...", "the tree and the house " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df, model, keep=[F.col("doc_id")]).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "fr", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, langid.train(empty), keep=[F.col("doc_id")]).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.train(empty)).collect()} == {"und"}


def test_trigrams_don_t_depend_on_the_slices(monkeypatch):
    text = "Été, 12 garden... ß tree\n\nover  the hill " * 20
    whole = langid.trigrams(text).tolist()
    for n in (1, 2, 7, 50):
        monkeypatch.setattr(langid, "SLICE", n)
        assert langid.trigrams(text).tolist() == whole


def bound(bind, tri):
    a, b, c = bind.letters([0 if x == " " else ord(x) for x in tri])
    return np.roll(a, 2).astype(int) * np.roll(b, 1) * c


def trigrams_by_hand(text):
    """Trigrams as strings; a blank is the boundary."""
    flat = " ".join(["", *"".join(c if c.isalpha() else " " for c in (text or "").lower()).split(), ""])
    return [flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " "]


def test_bundle_is_the_bound_sum(monkeypatch):
    text = "The quick Größe мир 日本 fox " * 3
    codes, counts = np.unique(langid.trigrams(text), return_counts=True)
    want = sum(bound(langid.Binder(64, 3), t) for t in trigrams_by_hand(text))
    for memory, bind_at in ((langid.MEMORY, langid.BIND), (7, 3)):
        monkeypatch.setattr(langid, "MEMORY", memory)
        monkeypatch.setattr(langid, "BIND", bind_at)
        bind = langid.Binder(64, 3)
        for _ in range(2):
            assert np.allclose(bind.bundle(codes, counts[None, :].astype(np.float32))[0], want)


def test_every_letter_has_its_own_vector():
    bind = langid.Binder(1024, 11)
    points = [0, *map(ord, "abzéßжя日本한"), ord("a") + 101, ord("é") + 101]
    vectors = bind.letters(points).astype(int)
    nearness = abs(vectors @ vectors.T) / 1024
    assert np.allclose(np.diag(nearness), 1) and (nearness - np.eye(len(points))).max() < 0.2


def test_ties_and_repeats_of_languages(spark):
    rows = [("xx", "some words of one text"), ("aa", "some words of one text")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    twice = langid.train(spark.createDataFrame(rows * 2, "lang string, text string"))
    assert np.allclose(2 * model[1], twice[1])
    got = langid.identify(spark.createDataFrame([("some words",), ("some words",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["aa", "aa"] and got[0] == got[1]  # of equal cosines the first language


def test_factorisation_machine_sums_pairs():
    rng = np.random.default_rng(2)
    model = quality.Model(np.zeros((1, 1)), 0.1, rng.normal(size=12), rng.normal(size=(12, 3)), 10)
    index, value = np.array([1, 4, 7, 2, 3]), rng.normal(size=5)
    for lo, hi in ((0, 3), (3, 5)):
        i, x = index[lo:hi], value[lo:hi]
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        y = 0.1 + model.linear[i] @ x + pairs
        assert np.isclose(model.score(index, value, np.array([0, 3]))[lo // 3], 1 / (1 + np.exp(-y)))


def test_quality_learns_and_scores_odd_texts(spark, empty, docs):
    good = [f"This is line {i} of a calm text, with words {i * 7} and marks." for i in range(60)]
    bad = [f"BUY!! NOW!! {i} ###$$$ &&& %%% {i * 3}!!" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, F.col("id") % 5 != 0)
    got = {r.doc_id: r for r in quality.classify(df, model, keep=[F.col("doc_id")]).collect()}
    held = [i for i in range(120) if i % 5 == 0]
    assert all(got[i].predicted == int(i < 60) for i in held)
    assert quality.classify(docs, model).count() == len(TEXTS)
    assert quality.classify(empty, quality.train(empty, labels, F.lit(True))).count() == 0


def test_training_settles_clashes_and_repeats(spark):
    """Labels and rows in another order, clashing labels, repeated and null ids: one model."""
    texts = [(i, f"This is line {i} of a calm text" if i % 2 else f"BUY!! {i} ###$$$ &&&", i) for i in range(60)] + [(5, "another text of five", 7), (None, "no id", None), (5, "This is line 5", None)]
    marks = [(i, i % 2) for i in range(60)] + [(7, 0), (7, 1), (8, 1), (None, 1), (9, None), (11, 1), (11, 1)]
    models = []
    for order in (1, -1):
        df = spark.createDataFrame(texts[::order], "doc_id long, text string, n_chars long").repartition(2)
        models.append(quality.train(df, spark.createDataFrame(marks[::order], "doc_id long, quality int"), F.lit(True), metadata=["n_chars"]))
    assert models[0].bias == models[1].bias and np.array_equal(models[0].factors, models[1].factors) and len(models[0].edges) == len(quality.STATISTICS) + 1
    df = spark.createDataFrame(texts, "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash")).withColumn("m0", F.lit(1)).withColumn("predicted", F.lit(1))
    rows = quality.classify(df, models[0], keep=[F.col("doc_id"), F.col("n_chars")]).collect()
    assert len(rows) == len(texts) and rows[0].score < 0.5 < rows[1].score
    one_sided = quality.train(df, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int"), F.lit(True), limit=1)
    assert not one_sided.factors.any()


def test_descriptions_don_t_depend_on_the_blocks(monkeypatch):
    text = "Some Words, here.\nAND more!! " * 50
    a = quality.describe(text)
    monkeypatch.setattr(quality, "KEPT", 64)
    b = quality.describe(text)
    assert np.allclose(a[0][:10], b[0][:10]) and np.array_equal(a[1], b[1]) and np.allclose(a[2], b[2])


def notices_by_hand(text, templates, containment=0.8):
    """Every window of every template, by sets of word tuples."""
    cut = lambda s: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, out = cut(text), []
    for name, notice in templates.items():
        v = cut(notice)
        k = min(5, len(v))
        if not k or len(w) < k:
            continue
        need, have = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}, [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        length, stride = licenses.window_of(len(v) - k + 1)
        hits = []
        for at in range(0, len(have), stride):
            inside = [i for i in range(at, min(at + length, len(have))) if have[i] in need]
            share = len({have[i] for i in inside}) / len(need)
            if share >= containment:
                hits.append((inside[0], inside[-1] + k, share))
        while hits:
            x, y, share = hits.pop(0)
            while hits and hits[0][0] < y:
                y, share = max(y, hits[0][1]), max(share, hits[0][2])
                hits.pop(0)
            out.append((name, x, y - x, share))
    return sorted(out, key=lambda m: (m[1], m[0]))


def noisy(rng, words, share):
    """Words of which about `share` are replaced, dropped or have another put before them."""
    out = []
    for w in words:
        out += rng.choice([["zzz"], [], ["yyy", w]]) if rng.random() < share else [w]
    return out


def test_bands_retrieve_what_all_windows_contain(spark):
    """Recall of retrieval by bands against exact containment in all windows of noisy notices."""
    rng, scanner = random.Random(3), licenses.Scanner(licenses.TEMPLATES)
    filler = [f"w{i}" for i in range(500)] + "the of this license software is in any".split()
    there, got = 0, 0
    for _ in range(12):
        for notice in licenses.TEMPLATES.values():
            text = " ".join([*rng.choices(filler, k=rng.randint(0, 90)), *noisy(rng, notice.split(), rng.choice([0, 0.01, 0.03])), *rng.choices(filler, k=rng.randint(0, 60))])
            words = licenses.words_of(text.encode())
            for k, by_length in scanner.windows.items():
                shingles = licenses.shingles_of(words, k) if len(words) >= k else words[:0]
                found = scanner.retrieved([shingles], k)
                for w in by_length.values():
                    for at in range(0, len(shingles), w.stride):
                        for t in w.templates:
                            if np.isin(scanner.sets[t], shingles[at : at + w.length]).mean() >= licenses.CONTAINMENT:
                                there, got = there + 1, got + ((0, w.length, at, t) in found)
    assert there > 1000 and got >= 0.99 * there


def test_bands_collide_as_promised():
    for t in (1, 2, 5, 8, 9, 30, 170):
        length, stride = licenses.window_of(t)
        assert length >= t + stride - 1 and length % stride == 0 and length // stride <= licenses.BLOCKS
        c = -(-8 * t // 10)
        assert 1 - (1 - (c / (length + t - c)) ** licenses.ROWS) ** licenses.bands_for(t, length) >= licenses.COLLISION


def test_license_scan_is_all_windows(spark, empty, odd, monkeypatch):
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(500)]
    fill = lambda n: " ".join(rng.choices(filler, k=n))
    texts = [f"{fill(rng.randint(0, 90))}\n{notice}\n{fill(40)}" for notice in licenses.TEMPLATES.values()]
    texts += [" ".join(noisy(rng, notice.split(), 0.02)) for notice in licenses.TEMPLATES.values()]
    texts += [texts[3], None, "", "... !", fill(3000), " ".join([*texts[:9], fill(5000), *texts[9:20]]), "one two three four five six. ALL RIGHTS  RESERVED.\nAll rights reserved. Nine ten all rights were reserved.", "All rights reserved.", "all rights"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("matches", F.lit("clash")).withColumn("k0", F.lit(1))
    want = [notices_by_hand(t, licenses.TEMPLATES) for t in texts]
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in licenses.license_scan(df, keep=[F.col("doc_id")]).collect()}
    assert len(got) == len(texts)
    for i, (name, notice) in enumerate(licenses.TEMPLATES.items()):
        assert name in {m[0] for m in got[i]}, name
    for i, rows in enumerate(want):
        assert [m[:3] for m in got[i]] == [m[:3] for m in rows] and np.allclose([m[3] for m in got[i]], [m[3] for m in rows]), texts[i]
    # the same whatever is read together: blocks of bytes, segments of shingles, batches of documents
    scanner, whole = licenses.Scanner(licenses.TEMPLATES), [got[i] for i in range(len(texts))]
    for name, n in (("KEPT", 64), ("SEGMENT", 64), ("BATCH", 10)):
        monkeypatch.setattr(licenses, name, n)
        assert scanner.scan(texts) == whole
    assert licenses.license_scan(empty).count() == 0 and licenses.license_scan(odd).count() == 6
    assert all(r.matches == [] for r in licenses.license_scan(df, templates={"none": "..."}).collect() + licenses.license_scan(df, templates={}).collect())


def test_license_templates_of_any_length_and_ties():
    own = licenses.Scanner({"one": "Copyleft", "two": "No warranty", "four": "Use it as is", "five": "Use it as you like", "five again": "Use it, as you like!"})
    got = own.scan(["You may use it as is; no warranty, copyleft. Use it as you like"])[0]
    assert [(name, at, n) for name, at, n, _ in got] == [("four", 2, 4), ("two", 6, 2), ("one", 8, 1), ("five", 9, 5), ("five again", 9, 5)]


def test_token_ledger_is_idempotent_and_signed(spark):
    ledger = TokenLedger(spark, Scratch(spark).folder("ledger"))
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, old_source string"
    one = spark.createDataFrame([("insert", "a", "en", "t", 10, None, None), ("insert", "a", "en", "t", 5, None, None), ("insert", "b", None, "t", None, None, None), ("insert", "c", "fr", "t", 9, None, None)], schema)
    two = spark.createDataFrame([("revise", "a", "en", "t", 7, 5, None), ("delete", "c", "fr", "t", None, 9, None), ("revise", "b", "en", "t", 12, 10, "a")], schema)
    assert ledger.totals().count() == 0
    assert ledger.commit("1", one) and not ledger.commit("1", one)
    assert ledger.commit("2", two) and not ledger.commit("2", two)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert got == {("a", "en", "t"): (1, 7), ("b", None, "t"): (1, 0), ("b", "en", "t"): (1, 12)}
    assert ledger.commit("3", one.limit(0)) and ledger.batches() == ["1", "2", "3"]
    with pytest.raises(Exception, match="unknown op"):
        ledger.commit("4", one.withColumn("op", F.lit("drop")))
    assert not ledger.committed("4")
    with pytest.raises(ValueError, match="batch id"):
        ledger.commit("../x", one)
    with pytest.raises(ValueError, match="other content"):
        ledger.commit("2", one)


def test_token_totals_are_folded_into_snapshots(spark):
    ledger = TokenLedger(spark, Scratch(spark).folder("ledger"))
    change = lambda n, op="insert": spark.createDataFrame([(op, "a", "en", "t", n if op == "insert" else None, None if op == "insert" else n)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    for i in range(4):
        ledger.commit(str(i), change(10 + i))
    assert ledger._parts() == (4, {"0", "1", "2", "3"}, []) and ledger._names("snapshot") == ["3", "4"]
    # a driver lost between a batch and its fold, or in the middle of one
    ledger._rollup(signed(change(11, "delete"))).write.parquet(ledger._folder("4"))
    spark.createDataFrame([("x",)], "batch string").write.parquet(f"{ledger.path}/snapshot=5/batches")
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "t", 3, 35)]
    assert not ledger.commit("4", change(11, "delete")) and ledger._parts()[:1] == (5,)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "t", 3, 35)] and ledger.batches() == ["0", "1", "2", "3", "4"]


def test_counted_is_the_library(spark, docs, odd, empty):
    rows = counted(docs.withColumn("n_tokens", F.lit("clash")), keep=[F.col("doc_id")]).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library_ids(t)) - 1 for i, t in enumerate(TEXTS)}
    assert sorted(r.n_tokens for r in counted(odd).collect())[0] == 0 and counted(odd).count() == 6 and counted(empty).count() == 0
