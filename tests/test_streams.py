from loomspan.streaming import history


def written(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))


def test_gaps_block_until_filled(spark, tmp_path):
    stream = written(spark, tmp_path, [[("s", 0), ("s", 2), ("t", 1)], [("s", 1), ("s", 0), ("t", 3)], [("s", 4), ("s", None)]], "story string, i int")
    got = history.run_to_table(history.gap_blocked(stream, "story", "i"), "append", "t")
    assert sorted(tuple(r) for r in got.collect()) == [("s", 0), ("s", 1), ("s", 2)]


def test_verdicts(spark, tmp_path):
    stream = written(spark, tmp_path, [[("s", 0, "a")], [("s", 1, "a"), ("s", 0, "a"), ("s", 1, "b")]], "story string, i int, id string")
    got = history.run_to_table(history.append_validated(stream, "story", "i", "id"), "append", "t")
    assert sorted((r["i"], r["id"], r["verdict"]) for r in got.collect()) == [(0, "a", "appended"), (0, "a", "repeated"), (1, "a", "conflict"), (1, "b", "appended")]


def test_delayed_values(spark, tmp_path):
    stream = written(spark, tmp_path, [[("s", 0, 1.0), ("s", 2, 3.0), ("t", 1, 9.0)], [("s", 1, 2.0), ("s", 0, 7.0)], [("s", 3, 4.0), ("s", None, 5.0)]], "story string, i int, x double")
    got = history.run_to_table(history.delayed(stream, "story", "i", "x", [0, 2]), "append", "t")
    assert sorted((r["i"], r["delay"], r["x"]) for r in got.collect()) == [(0, 0, 1.0), (0, 2, 0.0), (1, 0, 2.0), (1, 2, 0.0), (2, 0, 3.0), (2, 2, 1.0), (3, 0, 4.0), (3, 2, 2.0)]
