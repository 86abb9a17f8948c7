"""Split-safe readers, nested walks and commit logs against plain loops."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators.nested import element_texts, key_paths
from lodestar.sources import files, shared, splits


@pytest.fixture
def tiny_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "611b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


CELLS = ["a", "", 'x "y" z', "l1\nl2", "\n", '"', "a,b", 'mid"quote', "é\r\nq", "end ", "\n" * 30]


def test_csv_over_many_splits_is_what_a_reader_of_whole_files_gives(spark, tmp_path, tiny_splits):
    rng = random.Random(3)
    rows = [["h1", "h 2", "h3"], *([rng.choice(CELLS) for _ in range(3)] for _ in range(250))]
    (tmp_path / "c").mkdir()
    for name in "ab":
        made = io.StringIO()
        csv.writer(made, lineterminator="\n").writerows(rows)
        (tmp_path / "c" / f"{name}.csv").write_text("﻿" + made.getvalue(), newline="")
    path = f"{tmp_path}/c"
    assert splits.split_lines(spark, path).select("file", "block").distinct().count() > 10
    got = [(r.file[-5:], *tuple(r)[3:]) for r in splits.read_csv_split(spark, path, ["h 2"], place=True).orderBy("file", "block", "at").collect()]
    assert got == [(f"{name}.csv", *(x or None for x in r)) for name in "ab" for r in rows[1:]]
    whole = spark.read.csv(path, header=True, multiLine=True, escape='"').collect()
    assert sorted(map(str, (g[1:] for g in got))) == sorted(str(tuple(r)) for r in whole)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text('",x\n', max_size=12), min_size=1, max_size=6))
def test_quotes_are_followed_as_the_csv_module_does(parts):
    text = "".join(parts) or "x"
    records, held, inside = [], [], False
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        held.append(line)
        inside = splits.ends_inside(line, inside)
        if not inside:
            records.append("\n".join(held))
            held = []
    if held:
        records.append("\n".join(held))
    assert [row for r in records for row in csv.reader([r])] == list(csv.reader(io.StringIO(text, newline=""))) or inside


def test_line_numbers_over_many_splits(spark, tmp_path, tiny_splits):
    lines = ['{"a":1}', "", "[1]", '{"b":', '  {"c":"x"} ', "é" * 700] * 30
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.jsonl").write_text("\n".join(lines))
    (tmp_path / "j" / "2.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "j" / "3.jsonl").write_text("")
    (tmp_path / "j" / "4.jsonl").write_text("\n \n")
    errors = splits.json_line_errors(spark, f"{tmp_path}/j").collect()
    want = [(i, "not an object" if x == "[1]" else "invalid JSON") for i, x in enumerate(lines, 1) if x in ("[1]", '{"b":', "é" * 700)]
    assert all(sorted((r.line_no, r.error) for r in errors if r.file.endswith(f"{n}.jsonl")) == want for n in (1, 2))
    assert sorted((r.file[-7:], r.error) for r in errors if r.line_no == 0) == [("3.jsonl", "empty file"), ("4.jsonl", "empty file")]
    across = {r.line_no: r.value for r in splits.numbered_lines(spark, f"{tmp_path}/j", across=True).collect()}
    assert [across[i] for i in sorted(across)] == lines * 2 + ["", " "]
    with pytest.raises(ValueError, match=r"not an object at .*1\.jsonl:3$"):
        files.read_jsonl_strict(spark, f"{tmp_path}/j", "a long")
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}')
    assert files.read_jsonl_strict(spark, f"{tmp_path}/good.jsonl", "a long").where("a IS NOT NULL").count() == 2


# --- nested values ------------------------------------------------------------


def text_by_hand(element):
    content = element.get("content")
    if isinstance(content, str) and content.strip():
        return " ".join(content.split())
    kids = element.get("kids")
    return " ".join(t for k in (kids if isinstance(kids, list) else []) if isinstance(k, dict) and (t := text_by_hand(k)))


def paths_by_hand(value, path="$"):
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += [f"{path}.{k}"] * ("gold" in k.casefold()) + paths_by_hand(v, f"{path}.{k}")
    elif isinstance(value, list):
        out = [p for i, v in enumerate(value) for p in paths_by_hand(v, f"{path}[{i}]")]
    return out


def made(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, "gold", None, "x", True, 2.5, {}, []])
    if rng.random() < 0.4:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["content", "kids", "gold", "aGoLd x", "k", "Marigold"]): made(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_nested_walks_of_any_depth(spark):
    rng = random.Random(5)
    deep = {"content": "end", "gold_last": 1}
    for i in range(50):
        deep = {"kids": [{"content": f" a{i} "}, deep, 3, "x", None, [1]]}
    values = [deep, {"content": " own  x ", "kids": [{"content": "no"}]}, {"content": 5, "kids": [{"kids": [{"content": ""}, {"content": "t"}]}]}, [], {}, {"kids": None}, *(made(rng, 6) for _ in range(60))]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k int, j string").withColumn("v", F.parse_json("j"))
    texts = {r.k: r.text for r in element_texts(rows, "k", "v").collect()}
    assert texts == {i: text_by_hand(v) if isinstance(v, dict) else "" for i, v in enumerate(values)}
    found = sorted((r.k, r.path) for r in key_paths(rows, "k", "v").collect())
    assert found == sorted((i, p) for i, v in enumerate(values) for p in paths_by_hand(v))


# --- commits ------------------------------------------------------------------


def test_a_batch_sent_twice_is_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    path = f"{tmp_path}/log"
    assert shared.read_appended(spark, path, "id long, t string").count() == 0
    assert shared.append_once(df, path, "one") and not shared.append_once(df, path, "one")
    df.write.json(f"{path}/data/of-a-failed-attempt")
    assert shared.append_once(df, path, "two", form="parquet")
    assert shared.read_appended(spark, path, "id long, t string").count() == 2
    log = shared.CommitLog(spark, path)
    with pytest.raises(RuntimeError, match="another driver"):
        log.commit("three", 1, folder="x", form="json")
    assert [e["batches"] for e in log.entries()] == [["one"], ["two"]]
    assert files.append_log(df, f"{tmp_path}/x", "b") and not files.append_log(df, f"{tmp_path}/x", "b")
