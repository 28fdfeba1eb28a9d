"""Discovery of files, and lines of unlike rows, on worked cases."""

import hashlib

from docloom.sources import catalogue, unlike


def test_discover(spark, tmp_path):
    for path in ("a.csv", "b.PDF", "c.unknown", ".hidden.json", "sub/d.md", "sub/deep/e.xml", "sub/.f.txt", ".dir/g.htm", "none"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * len(path))
    root = str(tmp_path)
    found = {r.name: r for r in catalogue.discover(spark, [root]).collect()}
    assert set(found) == {"a.csv", "b.PDF", "d.md", "e.xml", "g.htm"}
    r = found["e.xml"]
    assert (r.format, r.source_type, r.size_bytes, r.path) == ("xml", "semi_structured", 14, f"{root}/sub/deep/e.xml")
    assert r.source_id == hashlib.md5(r.path.encode()).hexdigest()[:12] and r.description == "Document: e.xml" and r.modified is not None
    assert {r.name for r in catalogue.discover(spark, [root], recursive=False).collect()} == {"a.csv", "b.PDF"}
    assert {r.name for r in catalogue.discover(spark, [root], hidden=True).collect()} == {*found, ".hidden.json", ".f.txt"}
    # A file by itself, a folder met twice, and a path that is not there.
    some = catalogue.discover(spark, [f"{root}/a.csv", f"{root}/sub", root, f"{root}/sub", f"{root}/not there"])
    assert some.count() == 5 and catalogue.discover(spark, [f"{root}/not there"]).count() == 0
    assert catalogue.discover(spark, [root]).rdd.getNumPartitions() >= 1
    assert {r.name for r in catalogue.search(some, source_type="semi_structured").collect()} == {"e.xml", "g.htm"}
    assert {r.name for r in catalogue.search(some, query="B.p", form="pdf", least=5, most=5).collect()} == {"b.PDF"}
    assert {r.name for r in catalogue.search(some, query="document: D").collect()} == {"d.md"}


def test_write_each(spark, tmp_path):
    rows = spark.createDataFrame([("x/1.txt", "é"), ("x/2.txt", ""), ("y/3.txt", None)], "path string, content string")
    assert catalogue.write_each(rows, f"{tmp_path}/out") == 2
    assert (tmp_path / "out/x/1.txt").read_text() == "é" and not (tmp_path / "out/y").exists()
    assert catalogue.write_each(rows.limit(0), f"{tmp_path}/out") == 0


def test_csv_rows(spark):
    lines = ["1,Ann,30", '2,"Bob, Jr",', "3", "4,Dan,40,more,yet", '5,"a ""b"" c",7', '6,"open,8', "", "   ", "null,,null", None]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = unlike.csv_rows(table, "id,name,age")
    got = [(r["_problem"], r.id, r.name, r.age) for r in rows.collect()]
    assert got[:5] == [(None, "1", "Ann", "30"), (None, "2", "Bob, Jr", None), ("short", "3", None, None), ("long", "4", "Dan", "40"), (None, "5", 'a "b" c', "7")]
    assert got[5][:2] == ("broken", "6") and len(got) == 7
    assert {(r.problem, r.n) for r in unlike.problems(rows).collect()} == {("good", 4), ("short", 1), ("long", 1), ("broken", 1)}
    profile = {r.column_name: r for r in unlike.profile_csv(rows).collect()}
    r = profile["id"]
    assert (r.total, r.nulls, r.different, r.least, r.most, r.completeness, r.uniqueness) == (7, 1, 6, "1", "6", round(6 / 7, 6), 1.0)
    assert (profile["age"].nulls, profile["age"].different) == (4, 3)
    assert unlike.csv_rows(table, "a,a,b").columns == ["_problem", "a", "a_1", "b"]
    assert unlike.profile_csv(unlike.csv_rows(table.limit(0), "a,b")).count() == 0


def test_json_of_unlike_rows(spark):
    lines = ['{"a": 1, "b": "x"}', '{"a": "y", "c": null}', '[{"a": 1}, {"d": [1, 2]}, 5]', "no json", "7", None, '{"a": ""}', "{}"]
    found = {r.column_name: r for r in unlike.profile_json(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert set(found) == {"a", "b", "c", "d"}
    r = found["a"]
    assert (r.total, r.nulls, r.different, r.least, r.most, r.types) == (6, 3, 2, "1", "y", "BIGINT|STRING")
    assert (found["c"].nulls, found["c"].different, found["c"].completeness, found["c"].uniqueness) == (6, 0, 0.0, 0.0)
    assert (found["d"].nulls, found["d"].least) == (5, "[1,2]")
    assert unlike.profile_json(spark.createDataFrame([], "line string")).count() == 0
