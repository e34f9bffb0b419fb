import gzip
import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import jsons
from loomspan.sources import files, sinks


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1,\n "y": "é"}')
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "a.json"), "x int, y string").collect()] == [(1, "é")]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n  \n{"x": 2}\n')
    assert sorted(r["x"] for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(b'{"x": 3}\n'))
    assert [r["x"] for r in files.read_jsonl(spark, str(tmp_path / "c.jsonl.gz"), "x int").collect()] == [3]
    (tmp_path / "d.jsonl").write_text('{"x": "no number"}\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, str(tmp_path / "d.jsonl"), "x int").collect()


def test_tensor_slices_and_resume(spark, tmp_path):
    path = str(tmp_path / "tensor")
    rows = [(s, "st", 0, t, b, [float(t + b)]) for s in ("p1", "p2") for t in range(6) for b in range(3)]
    schema = "subject string, story string, repeat int, t int, block int, values array<double>"
    files.write_tensor(spark.createDataFrame(rows, schema), path)
    files.write_tensor(spark.createDataFrame([("p1", "st", 0, 0, 1, [99.0])], schema), path)
    got = files.response(spark, path, "p1", "st", [0], (1, 2))
    assert sorted(r["t"] for r in got.collect()) == [1, 2, 3]
    assert [r["values"] for r in files.response(spark, path, "p1", "st", [1]).collect()] == [[99.0]]
    assert files.response(spark, path, "p2", "st").count() == 18
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()


def test_sparse_rows(spark):
    df = spark.createDataFrame([(1, [5.0, 6.0, 7.0], [0, 2, 1], [0, 2, 2, 3])], "k int, data array<double>, indices array<int>, indptr array<int>")
    assert {tuple(r) for r in files.csr_to_coo(df, "k", "data", "indices", "indptr").collect()} == {(1, 0, 0, 5.0), (1, 0, 2, 6.0), (1, 2, 1, 7.0)}


LONG = 'File type = "ooTextFile"\nObject class = "TextGrid"\nxmin = 0\nxmax = 2\ntiers? <exists>\nsize = 1\nitem []:\n item [1]:\n class = "IntervalTier"\n name = "word"\n xmin = 0\n xmax = 2\n intervals: size = 2\n intervals [1]:\n xmin = 0\n xmax = 1.5\n text = "say ""hi"""\n intervals [2]:\n xmin = 1\n xmax = 2\n text = "sp"\n'


def test_timing_tiers(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text(LONG)
    (tmp_path / "b.TextGrid").write_bytes('"ooTextFile"\n"TextGrid"\n0\n1\n<exists>\n1\n"TextTier"\n"p"\n0\n1\n1\n0.5\n"x"\n'.encode("utf-16"))
    got = {(r["tier"], r["idx"], r["start"], r["end"], r["label"], r["overlap"]) for r in files.read_textgrids(spark, str(tmp_path)).collect()}
    assert got == {("word", 0, 0.0, 1.5, 'say "hi"', 0.0), ("word", 1, 1.0, 2.0, "sp", 0.5), ("p", 0, 0.5, 0.5, "x", 0.0)}
    with pytest.raises(ValueError, match="not a"):
        files.parse_textgrid('"other" "thing"')


def test_arrays_archives_annotations(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(2, 3), y=np.array([1, 2]))
    got = {(r["name"], tuple(r["shape"]), r["row"], tuple(r["values"])) for r in files.read_arrays(spark, str(tmp_path / "a.npz")).collect()}
    assert got == {("x", (2, 3), 0, (0.0, 1.0, 2.0)), ("x", (2, 3), 1, (3.0, 4.0, 5.0)), ("y", (2,), 0, (1.0,)), ("y", (2,), 1, (2.0,))}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/one.txt", "1")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    members = files.read_zip_members(spark, str(tmp_path / "a.zip"))
    assert [(r["member"], bytes(r["content"])) for r in members.collect()] == [("d/one.txt", b"1")]
    assert {tuple(r) for r in files.missing_members(members, spark.createDataFrame([("two",)], "member string")).collect()} == {("d/one.txt", "unexpected"), ("two", "missing")}
    name = b"area\x00"
    raw = struct.pack(">i4i", 2, 0, 1 + (2 << 8) + (3 << 16), 1, 7) + struct.pack(">iii", 1, 1, 2) + b"t\x00" + struct.pack(">i", len(name)) + name + struct.pack(">4i", 1, 2, 3, 0)
    (tmp_path / "l.annot").write_bytes(raw)
    assert {(r["vertex"], r["name"]) for r in files.read_annot(spark, str(tmp_path / "l.annot")).collect()} == {(0, "area"), (1, None)}


def test_listings():
    page = lambda key, token: f'<L xmlns="u"><Contents><Key>{key}</Key><Size>3</Size></Contents>{f"<NextContinuationToken>{token}</NextContinuationToken>" if token else ""}</L>'
    assert files.listing({None: page("a", "t"), "t": page("b", None)}) == [("a", 3), ("b", 3)]
    with pytest.raises(ValueError, match="again"):
        files.listing({None: page("a", "t"), "t": page("b", "t")})
    assert files.parse_listing('<html><a href="x.h5">x</a><a href="../">up</a><a href="?C=N">s</a></html>') == ([("x.h5", -1)], None)


def test_content_kinds(spark):
    rows = [(b"\x89HDF\r\n\x1a\n..", "hdf5"), (b"\x1f\x8b1", "gzip"), (b"PK\x03\x04", "zip"), (b" <!DOCTYPE html>", "html"), (b"<?xml", "xml"), (b"\n{}", "json"), (b"", "other")]
    df = spark.createDataFrame(rows, "c binary, want string")
    assert all(r["want"] == r["kind"] for r in df.withColumn("kind", files.content_kind(F.col("c"))).collect())


def test_publish_once(spark, tmp_path):
    root = str(tmp_path / "builds")
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "x int, y string, z double")
    first = sinks.publish(spark, root, {"t": df}, {"code": 1})
    assert sinks.publish(spark, root, {"t": df.orderBy(F.desc("x")).repartition(3)}, {"code": 1}) == first
    assert sinks.publish(spark, root, {"t": df.limit(1)}, {"code": 1}) != first
    assert sinks.latest(spark, root) != f"{root}/{first}"
    assert sinks.verify(spark, f"{root}/{first}") == []
    assert sinks.checked(df, sinks.frame_hash(df)) is df
    with pytest.raises(ValueError, match="digest"):
        sinks.checked(df, "0")
    assert sinks.frame_hash(df.union(df)) != sinks.frame_hash(df)


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "one.json")
    assert sinks.write_once(spark, path, b"a")
    assert not sinks.write_once(spark, path, b"a")
    with pytest.raises(FileExistsError):
        sinks.write_once(spark, path, b"b")
    sinks.write_json(spark, str(tmp_path / "r.json"), {"b": float("nan"), "a": [float("inf"), 1.5, "é"]})
    assert sinks.read_bytes(spark, str(tmp_path / "r.json")).decode() == '{"a":[null,1.5,"é"],"b":null}'
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).collect()[0][0] == '{"a":null,"b":1}'
    for _ in range(2):
        sinks.append_log(spark.range(2).toDF("id"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    page = sinks.html_report("t<", spark.createDataFrame([("<b>", None)], "x string, y int"))
    assert "&lt;b&gt;" in page and "<h1>t&lt;</h1>" in page
    with pytest.raises(ValueError, match="more than"):
        sinks.html_report("t", spark.range(3).toDF("id"), 2)


def test_json_values(spark):
    value = {"a": {"b": [1, {"id": "x"}]}, "id": "y"}
    assert jsons.at_path(value, "a.b.1.id") == "x" and jsons.at_path(value, "a.c.d") is None
    assert jsons.edited(value, [{"op": "add", "path": "/a/b/-", "value": 2}, {"op": "replace", "path": "/id", "value": "z"}, {"op": "remove", "path": "/a/b/0"}]) == {"a": {"b": [{"id": "x"}, 2]}, "id": "z"}
    with pytest.raises(KeyError):
        jsons.edited(value, [{"op": "remove", "path": "/none"}])
    for path in ("/a/b/-1", "/a/b/9", "/a/b/x", "/a/b/-"):
        with pytest.raises(KeyError):
            jsons.edited(value, [{"op": "remove", "path": path}])
    with pytest.raises(KeyError):
        jsons.edited(value, [{"op": "add", "path": "/a/b/9", "value": 1}])
    assert jsons.ids_in(value) == ["x", "y"]
    assert jsons.sketch(value) == {"a": {"b": ["int"]}, "id": "str"}
    assert jsons.atoms({"a": [2, 1, 1], "b": {"c": None}}) == ["a=1", "a=2", "b.c=null"]
    record = jsons.patched(None, {"op": "add", "value": {"x": {"y": 1}}})
    record = jsons.patched(record, {"op": "set", "field": "x.y", "before": 1, "value": 2})
    assert record == {"x": {"y": 2}}
    with pytest.raises(ValueError, match="before"):
        jsons.patched(record, {"op": "set", "field": "x.y", "before": 1, "value": 3})
    for field in ("x.z", "w", "x.y.q"):
        with pytest.raises(ValueError, match="no field"):
            jsons.patched(record, {"op": "set", "field": field, "before": None, "value": 3})
    assert jsons.patched(record, {"op": "remove", "before": {"x": {"y": 2}}}) is None
    df = spark.createDataFrame([('{"b":1,"a":"x"}',), ('{ "a": "x", "b": 1 }',), ("{",), (None,)], "j string")
    hashes = [r[0] for r in df.select(jsons.canonical_hash("j")).collect()]
    assert hashes[0] == hashes[1] == __import__("hashlib").sha256(json.dumps({"a": "x", "b": 1}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() and hashes[2:] == [None, None]


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u00e9\\n", {}, [], true, false, null], "b": {"c": [[]]}}', "[]", ' "x" ', "0", "-0.5"])
def test_reader_of_deep_json_agrees(text):
    assert jsons._parsed_deep(text) == json.loads(text) and json.loads(jsons.written(json.loads(text))) == json.loads(text)
    assert jsons.written(json.loads(text), ", ", ": ") == json.dumps(json.loads(text), ensure_ascii=False)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1] x", "NaN", "[Infinity]", "01", '{1: 2}', '"open', "[1 2]", "tru", '{"a":}', "[}"])
def test_reader_of_deep_json_refuses(text):
    with pytest.raises(ValueError):
        jsons._parsed_deep(text)
    with pytest.raises(ValueError):
        jsons.parsed(text)


def test_depth_is_not_bounded():
    deep = jsons.parsed('{"a":[' * 50_000 + "1" + "]}" * 50_000)
    assert jsons.written(deep) == '{"a":[' * 50_000 + "1" + "]}" * 50_000
    assert sinks.canonical({"b": float("nan"), "a": [float("inf"), 1.5]}) == b'{"a":[null,1.5],"b":null}'


def test_published_file_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "pointer")
    for content in (b"one", b"two"):
        sinks.write_bytes(spark, path, content)
        assert sinks.read_bytes(spark, path) == content
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["pointer"]
