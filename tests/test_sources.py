"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tablewright import storage
from tablewright.sinks import files as sinks
from tablewright.sources import files, generated, jdbc


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_typed_header(spark, tmp_path):
    path = write(tmp_path, "t.csv", "pKey:string, lKey:string, val1:double, val2:integer, ok:boolean\n a , b,1.5,, true\nc,,2,3,false\n")
    df = files.read_csv_typed_header(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "double", "int", "boolean"]
    assert [tuple(r) for r in df.collect()] == [("a", "b", 1.5, None, True), ("c", None, 2.0, 3, False)]


def test_typed_header_refuses_other_widths(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a:integer,b:integer\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        files.read_csv_typed_header(spark, path).select("a").collect()


def test_typed_header_refuses_unknown_types():
    with pytest.raises(ValueError):
        files.typed_header_schema("a:date")


def test_text_split_keeps_trailing_empties(spark, tmp_path):
    path = write(tmp_path, "t.txt", "a , b,,\n1,2,3,4\n")
    out = files.read_text_split(spark, path, ["w", "x", "y", "z"]).collect()
    assert [tuple(r) for r in out] == [("a", "b", "", ""), ("1", "2", "3", "4")]


def test_text_split_takes_the_separator_literally(spark, tmp_path):
    path = write(tmp_path, "t.txt", "a|b\n")
    assert tuple(files.read_text_split(spark, path, ["x", "y"], sep="|").first()) == ("a", "b")


def test_skip_header(spark, tmp_path):
    path = write(tmp_path, "t.txt", "category,title\nlabor,Driver\n")
    out = files.read_text_skip_header(spark, path, "category", ["c", "t"]).collect()
    assert [tuple(r) for r in out] == [("labor", "Driver")]


def test_labelled_tsv_drops_empty_labels(spark, tmp_path):
    path = write(tmp_path, "t.tsv", "ham\thello\n\tlost\nspam\twin\n")
    out = files.read_labelled_tsv(spark, path).collect()
    assert [tuple(r) for r in out] == [("ham", "hello"), ("spam", "win")]


def test_bad_rows_are_dropped(spark, tmp_path):
    path = write(tmp_path, "t.csv", "1,2.5\nx,1\n3\n4,5,6\n7,8\n")
    schema = T.StructType().add("a", T.IntegerType()).add("b", T.DoubleType())
    out = files.read_csv_drop_bad(spark, path, schema).collect()
    assert [tuple(r) for r in out] == [(1, 2.5), (7, 8.0)]


def test_ratings_need_four_fields(spark, tmp_path):
    path = write(tmp_path, "r.txt", "0::2::3::1424380312\n1::2\n")
    assert [tuple(r) for r in files.read_ratings(spark, path).collect()] == [(0, 2, 3.0, 1424380312)]


def test_vector_text_forms(spark, tmp_path):
    path = write(tmp_path, "v.txt", "0.0 0.1\n[1.0,2.0]\n(3.0, [4.0,5.0])\n")
    out = [tuple(r) for r in files.read_vector_text(spark, path).collect()]
    assert out == [(None, [0.0, 0.1]), (None, [1.0, 2.0]), (3.0, [4.0, 5.0])]


def test_labeled_points(spark, tmp_path):
    path = write(tmp_path, "p.txt", "-0.5,1.0 -2.0\n")
    row = files.read_labeled_points(spark, path).first()
    assert (row["label"], list(row["features"])) == (-0.5, [1.0, -2.0])


def test_generated_normals(spark):
    out = generated.random_normals(spark, 20_000, 4, seed=1).selectExpr("avg(value) m", "stddev(value) s").first()
    assert out["m"] == pytest.approx(1.0, abs=0.06)
    assert out["s"] == pytest.approx(2.0, abs=0.06)
    assert generated.number_range(spark, 1, 500).count() == 500


def test_folded_types(spark):
    schema = T.StructType(
        [
            T.StructField("A", T.DecimalType(10, 2)),
            T.StructField("B", T.ShortType()),
            T.StructField("C", T.DateType()),
            T.StructField("D", T.TimestampType()),
            T.StructField("E", T.LongType()),
            T.StructField("F", T.BinaryType()),
        ]
    )
    out = jdbc.fold_types(spark.createDataFrame([], schema))
    assert out.columns == list("abcdef")
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "int", "string", "string", "bigint", "binary"]


class FakeReader:
    """Records how a database read is asked for."""

    def __init__(self, result=None):
        self.calls, self.result = [], result

    def format(self, name):
        self.calls.append(("format", name))
        return self

    def options(self, **given):
        self.calls.append(("options", given))
        return self

    def load(self):
        return self.result

    def jdbc(self, url, table, **given):
        self.calls.append((url, table, given))
        return self.result


class FakeSession:
    def __init__(self, result=None):
        self.read = FakeReader(result)


def test_query_is_pushed_to_the_database():
    session = FakeSession("rows")
    assert jdbc.read_query(session, "jdbc:x", "select 1;", user="u") == "rows"
    assert session.read.calls == [
        ("format", "jdbc"),
        ("options", {"url": "jdbc:x", "dbtable": "(select 1) pushed", "user": "u"}),
    ]


def test_partitioned_read_passes_its_ranges(spark):
    table = spark.createDataFrame([(1,)], "ID int")
    session = FakeSession(table)
    out = jdbc.read_partitioned(session, "jdbc:x", "select * from t", "ID", 0, 90, 3, user="u")
    assert out.columns == ["id"]
    url, asked, given = session.read.calls[0]
    assert (url, asked) == ("jdbc:x", "(select * from t) pushed")
    assert (given["column"], given["lowerBound"], given["upperBound"], given["numPartitions"]) == ("ID", 0, 90, 3)


def test_csv_parts_replace_the_old_target(spark, tmp_path):
    target = tmp_path / "out.csv"
    target.write_text("old")
    sinks.write_csv(spark.range(0, 200, 1, 4), str(target))
    assert sorted(int(r["id"]) for r in spark.read.csv(str(target), header=True).collect()) == list(range(200))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.csv"]


def test_one_csv_file_in_order_and_in_place(spark, tmp_path):
    target = tmp_path / "out.csv"
    df = spark.range(0, 300, 1, 6).selectExpr("id", "if(id % 7 = 0, null, concat('a,\"', id)) AS `x,y`").orderBy("id")
    sinks.write_single_csv(df, str(target))
    lines = target.read_text().splitlines()
    assert len(lines) == 301 and lines[0] == 'id,"x,y"' and lines[1:3] == ["0,", '1,"a,\\"1"']
    assert [line.split(",")[0] for line in lines[1:]] == [str(i) for i in range(300)]
    # A failing job leaves the old file as it was, and nothing beside it.
    with pytest.raises(Exception):
        sinks.write_single_csv(df.selectExpr("raise_error('no') AS id"), str(target))
    assert target.read_text().splitlines() == lines
    sinks.write_single_csv(df.limit(0), str(target))
    assert target.read_text() == 'id,"x,y"\n'
    sinks.write_csv(df, str(target))
    sinks.write_single_csv(df, str(target))  # over a folder
    assert target.read_text().splitlines() == lines
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.csv"]


def test_write_many_uses_the_default_table(spark, tmp_path):
    one, other = spark.range(3), spark.range(5)
    targets = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    sinks.write_many({"a": one}, targets, default=other)
    assert [spark.read.csv(targets[n], header=True).count() for n in "ab"] == [3, 5]


def test_write_lines_and_predictions(spark, tmp_path):
    sinks.write_lines(spark, ["x", "y"], str(tmp_path / "lines"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()} == {"x", "y"}
    df = spark.createDataFrame([("1 2", 0.5)], "line string, prediction double")
    sinks.write_predictions(df, str(tmp_path / "p"), "prediction", df["line"])
    assert spark.read.text(str(tmp_path / "p")).first()["value"] == "1 2 0.5"


def test_csv_line_writes_null(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert sinks.csv_line(df).first()["line"] == "1,null,x"


class FakeConf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class FakeCluster:
    def __init__(self, master, **conf):
        # A real session always has a warehouse.
        self.conf = FakeConf(**{"spark.sql.warehouse.dir": "/warehouse"} | conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_shared_folder_follows_the_session():
    named = FakeCluster("yarn", **{"spark.checkpoint.dir": "hdfs://a/b/"})
    assert storage.shared_folder(named) == "hdfs://a/b"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        storage.shared_folder(FakeCluster("yarn"))
    assert storage.shared_folder(FakeCluster("local[2]")) == storage.shared_folder(FakeCluster("local[4]"))


def test_cut_lineage_reads_back_what_was_written(spark):
    cut = storage.cut_lineage(spark.range(5))
    assert sorted(r["id"] for r in cut.collect()) == [0, 1, 2, 3, 4]
    assert "Range" not in cut._jdf.queryExecution().toString()


def test_spread_leaves_many_tasks_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 10, 1, 1), spark.range(0, 10, 1, cores * 2)
    assert storage.spread(few).rdd.getNumPartitions() == cores
    assert storage.spread(many) is many
