"""Array and CSV files read in blocks of a few bytes, against Spark's readers of whole files."""

import json
import random

import pytest

from histloom.sources import blocks, readers

SCHEMA = "id long, name string, inner struct<a:string,list:array<long>>, price double"
WORDS = ['plain', 'a "quoted" one', "back\\slash", 'ends in \\', "br}ack{et]s[", ",", "line\nend", "é漢", '\\"', "", "tab\t", '"]}']


@pytest.fixture()
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(old, (str(size), "1"))]
    for k, v in old.items():
        spark.conf.set(k, v)


def record(rnd, i):
    inner = {"a": rnd.choice(WORDS), "list": [rnd.randrange(9) for _ in range(rnd.randrange(3))]}
    return {"id": i, "name": " ".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 3, 30]))), "inner": rnd.choice([inner, None]), "price": i / 4}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [700, 10**6])
def test_arrays(spark, tmp_path, small_blocks, size):
    rnd = random.Random(size)
    for n, (count, how) in enumerate([(30, {}), (15, {"indent": 2}), (1, {}), (20, {"ensure_ascii": False, "separators": (",", ":")})]):
        text = json.dumps([record(rnd, 100 * n + i) for i in range(count)], **how)
        (tmp_path / f"{n}.json").write_text(text + rnd.choice(["", "\n", " \n"]), encoding="utf-8")
    path = str(tmp_path)
    plain = rows(spark.read.schema(SCHEMA).option("multiLine", True).json(path))
    small_blocks(size)
    got = readers.read_json_array(spark, path, SCHEMA)
    assert rows(got) == plain and len(plain) == 66


def test_array_edges(spark, tmp_path, small_blocks):
    texts = ["[]", " [ ]\n", "", "\n", '{"id": 1, "inner": {"a": "x}"}}\n', '{"id": 2, "inner": {"a": "y"}}', '[{"id": 3}, {"id": "bad", "name": "n"}]',
             '﻿[{"id": 4}]', '[ {"id": 5} , {} , {"id": 6} ]', '[{"id": 7}{"id" 8}, {"id": 9}]']
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.json").write_text(text, encoding="utf-8")
    for size in (9, 10**6):
        small_blocks(size)
        got = [(r.id, r.name) for r in readers.read_json_array(spark, str(tmp_path), SCHEMA).collect()]
        assert {i for i, _ in got if i} == {1, 2, 3, 4, 5, 6, 7, 9}
        assert (None, "n") in got and len(got) == 11


@pytest.mark.parametrize("size", [600, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv(spark, tmp_path, small_blocks, size, end):
    rnd = random.Random(size)

    def field(text):
        return '"' + text.replace('"', '""') + '"' if set(text) & set('",\n\r') or rnd.random() < 0.2 else text

    words = [w for w in WORDS if "\\" not in w and w] + ["two\n\nends", "a\r\nb"]
    for n in range(3):
        lines = ["id,name,price"]
        lines += [f"{i},{field(' '.join(rnd.choices(words, k=rnd.choice([1, 2, 30]))))},{i / 2}" for i in range(n * 100, n * 100 + 30)]
        with open(tmp_path / f"{n}.csv", "w", encoding="utf-8", newline="") as f:
            f.write(end.join(lines) + rnd.choice(["", end, end + end]))
    schema = "id long, name string, price double"
    plain = spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(str(tmp_path))
    want = [r.replace("\\r", "") for r in rows(plain)]  # a file of \\r\\n has its quoted line ends changed there
    small_blocks(size)
    got = readers.read_csv(spark, str(tmp_path), schema, multiline=True)
    assert sorted(r.replace("\\r", "") for r in rows(got)) == sorted(want) and len(want) == 90


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    text = json.dumps([{"id": i, "name": "x" * 50} for i in range(2_000)])
    (tmp_path / "one.json").write_text(text)
    small_blocks(10_000)
    found = blocks.fragments(spark, str(tmp_path), "}")
    assert found.rdd.getNumPartitions() >= 10
    assert readers.read_json_array(spark, str(tmp_path), SCHEMA).count() == 2_000


def test_text_is_not_shuffled(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"id": 1}, {"id": 2}]')
    found = blocks.fragments(spark, str(tmp_path), "}")
    states = blocks.block_states(blocks.block_effects(found, "}", True))
    plan = blocks.with_states(found, states, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_many_blocks_are_joined(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(blocks, "SENT_BLOCKS", 1)
    text = json.dumps([{"id": i, "name": "{" * (i % 7)} for i in range(300)], indent=1)
    (tmp_path / "one.json").write_text(text)
    small_blocks(500)
    got = readers.read_json_array(spark, str(tmp_path), SCHEMA).select("id", "name").collect()
    assert sorted(map(tuple, got)) == [(i, "{" * (i % 7)) for i in range(300)]


def test_line_numbers(spark, tmp_path, small_blocks):
    rnd = random.Random(1)
    want = set()
    for n in range(3):
        lines = [f"{n}-{i}" * rnd.randrange(1, 9) if rnd.random() < 0.9 else "" for i in range(150)]
        (tmp_path / f"{n}.txt").write_text("\n".join(lines) + ["", "\n", "\n\n"][n])
        want |= {(f"{n}.txt", i + 1, v) for i, v in enumerate(lines + [""] * (n == 2)) if i < 149 or v or n}
    small_blocks(300)
    numbered = readers.numbered_lines(spark, str(tmp_path))
    got = [(r.file.rsplit("/")[-1], r.line_number, r.value) for r in numbered.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
