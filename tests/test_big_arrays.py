"""One big JSON array read in blocks gives the entries that a parser of the whole file gives."""

import json
import random

from daytrail.sources import big_arrays


def entries(n):
    rng = random.Random(3)
    odd = ["]", "[", "{", "}", '"', "\\", ",", "}}", "],[", "\\\"", "é中", "\n", "\t ", "plain text"]
    value = lambda d=0: rng.choice([
        rng.randrange(99), None, True, "".join(rng.choices(odd, k=rng.randint(0, 6))),
        *([[value(d + 1) for _ in range(rng.randint(0, 3))], {rng.choice(odd): value(d + 1)}] if d < 3 else []),
    ])
    return [{"ts": f"t{i}", "x": value(), rng.choice(odd): value()} for i in range(n)]


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        found = big_arrays.pieces(spark, path)
        blocks = found.select("block").distinct().count()
        rows = big_arrays.array_entries(spark, path).collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    return blocks, {p: sorted(json.dumps(json.loads(r["entry"]), sort_keys=True) for r in rows if r["path"].endswith(p)) for p in {r["path"].rpartition("/")[2] for r in rows}}


def test_blocks_of_any_size_give_the_entries(spark, tmp_path):
    data = entries(700)
    data[300]["long"] = ["a}b]" * 4000]  # longer than some blocks
    (tmp_path / "plain.json").write_text(json.dumps(data))
    (tmp_path / "wide.json").write_text("﻿ \n" + json.dumps(data[:50], indent=3, ensure_ascii=False) + "\n\n")
    (tmp_path / "values.json").write_text('[1, "a,b", [2, [3]], null, {"k": "]"} , true]')
    (tmp_path / "none.json").write_text("[ ]")
    (tmp_path / "object.json").write_text('{"a": [1, 2]}')
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"b": [2}')
    want = {
        "plain.json": sorted(json.dumps(e, sort_keys=True) for e in data),
        "wide.json": sorted(json.dumps(e, sort_keys=True) for e in data[:50]),
        "values.json": sorted(json.dumps(e) for e in [1, "a,b", [2, [3]], None, {"k": "]"}, True]),
    }
    for size in ("700b", "5k", "64m"):
        blocks, got = read(spark, str(tmp_path), size)
        assert got == want
        assert blocks > 20 if size == "700b" else blocks >= 1


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert read(spark, str(tmp_path), "1k")[1] == {}
