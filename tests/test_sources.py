import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quietband.sources.dataset import numeric_matrix, read_dataset, write_dataset
from quietband.sources.delimited import (
    HEAD_BYTES,
    SPARK_ENCODING,
    Layout,
    UnreadableFile,
    detect_encoding,
    has_quoted_breaks,
    inspect_head,
    read_delimited,
    read_tsv,
)
from quietband.sources.names import cleaned_names
from quietband.sources.records import quoted_records, text_lines
from quietband.sources.query import QueryRejected, check_read_only, read_query

HEADER = ["temperature", "Flow Rate", "sensor id"]
ROWS = [[20.5 + i, 1.25 * i, f"s{i}"] for i in range(20)]


def _write(path, sep=",", header=True, extra=(), encoding="utf-8"):
    lines = [sep.join(HEADER)] if header else []
    lines += [sep.join(map(str, row)) for row in ROWS] + list(extra)
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


@pytest.mark.parametrize("suffix,sep", [("a.csv", ","), ("b.csv", ";"), ("c.csv", "|"), ("d.tsv", "\t"), ("e.tab", "\t")])
def test_separator_and_header_are_detected(spark, tmp_path, suffix, sep):
    table = read_delimited(spark, _write(tmp_path / suffix, sep))
    assert table.columns == ["temperature", "flow_rate", "sensor_id"]
    assert dict(table.dtypes)["temperature"] == "double"
    assert table.count() == 20


def test_headerless_files_get_numbered_columns(spark, tmp_path):
    table = read_delimited(spark, _write(tmp_path / "n.csv", header=False))
    assert table.columns == ["col_0", "col_1", "col_2"] and table.count() == 20


def test_surplus_fields_are_skipped_and_short_lines_padded(spark, tmp_path):
    path = _write(tmp_path / "m.csv", extra=["1.0,2.0,x,too many", "7.5"])
    table = read_delimited(spark, path)
    assert table.count() == 21
    assert table.where("temperature = 7.5").first()["sensor_id"] is None
    assert read_delimited(spark, path, max_rows=5).count() == 5


def test_quotes_line_breaks_and_late_surplus_fields(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('name,score,note\n"say ""hi"" 3",1.5,"two\nlines"\ny,100,ok,,tail\nz,2\n')
    rows = sorted(map(tuple, read_delimited(spark, str(path)).collect()))
    assert rows == [('say "hi" 3', 1.5, "two\nlines"), ("z", 2.0, None)]


@pytest.mark.parametrize("sep", [",", "|"])
def test_quoted_line_breaks_beyond_the_head(spark, tmp_path, sep):
    path = tmp_path / "late.csv"
    lines = [sep.join(["name", "score", "note"])]
    lines += [sep.join([f"n{i}", str(i), '"say ""hi"" now"']) for i in range(2000)]
    plain = "\n".join(lines) + "\n"
    path.write_text(plain)
    assert not has_quoted_breaks(spark, str(path), inspect_head(plain.encode()[:HEAD_BYTES]))
    # The first line of the last record has an even number of quote signs.
    path.write_text(plain + sep.join(['5" pipe', "7", '"two\nlines"']) + "\n")
    rows = read_delimited(spark, str(path)).collect()
    assert len(rows) == 2001
    assert [tuple(r) for r in rows if r["score"] == 7 and r["name"] != "n7"] == [('5" pipe', 7, "two\nlines")]


@pytest.mark.parametrize(
    "line, spans",
    [('a,"b', True), ('"a"",', True), ('"a""",b', False), ('"",""', False), ('5",b', False), ('"""a', True), ('a,""""', False), ('"a,b","c', True)],
)
def test_lines_that_end_within_quotes(spark, tmp_path, line, spans):
    (tmp_path / "x.csv").write_text(line + "\n")
    layout = Layout("utf-8", ",", False, False)
    assert has_quoted_breaks(spark, str(tmp_path / "x.csv"), layout) == spans


def test_encodings(spark, tmp_path):
    path = _write(tmp_path / "l.csv", extra=["1.0,2.0,café"], encoding="latin-1")
    assert read_delimited(spark, path).where("sensor_id = 'café'").count() == 1
    assert detect_encoding("café".encode()) == "utf-8"
    with pytest.raises(UnreadableFile):
        detect_encoding(b"a\x00b")
    with pytest.raises(UnreadableFile):
        read_delimited(spark, str(tmp_path / "x.xlsx"))
    assert read_tsv(spark, _write(tmp_path / "t.tsv", "\t")).count() == 20


def test_cleaned_names():
    assert cleaned_names([" A B ", "Unnamed: 1", "a b", "", "A b"]) == ["a_b", "col_1", "a_b_1", "col_3", "a_b_2"]


@pytest.mark.parametrize("text", ["DROP TABLE x", "with a as (select 1) delete from b", "select 1; Update t set a=1", "EXPLAIN select 1"])
def test_only_reading_queries_pass(text):
    with pytest.raises(QueryRejected):
        check_read_only(text)


def test_views_can_be_queried(spark):
    spark.range(10).withColumn("updated", F.lit(1)).createOrReplaceTempView("ten")
    assert read_query(spark, " select id, updated from ten;", max_rows=4).count() == 4


def test_dataset_round_trip_and_numeric_matrix(spark, tmp_path):
    table = spark.createDataFrame(
        [(1.0, "a", None), (None, "b", None), (float("nan"), "c", 2)], "x double, s string, n int"
    )
    info = write_dataset(table, str(tmp_path / "d"))
    assert (info["n_rows"], info["n_columns"]) == (3, 3)
    assert read_dataset(spark, info["path"]).count() == 3
    kept = numeric_matrix(table)
    assert kept.dtypes == [("x", "double"), ("n", "double")] and kept.count() == 2


def _random_file(rng, rows, sep, ending):
    """Fields with separators, quotes, line breaks, blanks and stray quote signs."""
    signs = ["a", "b c", sep, '"', "\n", "é", "", "12"]
    table, lines = [], []
    for i in range(rows):
        fields = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 6))) for _ in range(3)]
        fields.append(f'{i}" pipe')  # a quote sign that opens nothing
        table.append(fields)
        quoted = ['"' + f.replace('"', '""') + '"' for f in fields[:3]]
        lines.append(sep.join([*quoted, fields[3]]))
    return table, ending.join(lines) + ending


@pytest.mark.parametrize("sep, ending, encoding", [(",", "\n", "utf-8"), ("|", "\r\n", "latin-1")])
def test_records_are_cut_alike_by_many_tasks(spark, tmp_path, sep, ending, encoding):
    rng = random.Random(7)
    table, text = _random_file(rng, 300, sep, ending)
    (tmp_path / "many").mkdir()
    for part in range(2):
        (tmp_path / "many" / f"{part}.csv").write_bytes(text.encode(encoding))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = text_lines(spark, str(tmp_path / "many"), SPARK_ENCODING[encoding])
        assert lines.rdd.getNumPartitions() > 20
        found = [r["record"] for r in quoted_records(lines, sep, header=False).collect()]
        shorter = quoted_records(lines, sep, header=True).count()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert shorter == 2 * len(table) - 2
    parsed = sorted(next(csv.reader(io.StringIO(r, newline=""), delimiter=sep)) for r in found)
    assert parsed == sorted(table * 2)


def test_a_field_longer_than_many_byte_ranges(spark, tmp_path):
    path = tmp_path / "long.csv"
    long = "line of text\n" * 400
    path.write_text(f'name,note\nx,"{long}"\ny,"z\nz"\n')
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = dict(map(tuple, read_delimited(spark, str(path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == {"x": long, "y": "z\nz"}


def test_folders_are_read_whole(spark, tmp_path):
    folder = tmp_path / "many.csv"
    spark.range(100).selectExpr("id", "concat('a\n', id) as note").repartition(5).write.options(
        header=True, escape='"'
    ).csv(str(folder))
    table = read_delimited(spark, str(folder))
    assert table.columns == ["id", "note"] and table.count() == 100
    assert table.where("note = concat('a\n', id)").count() == 100
    with pytest.raises(UnreadableFile):
        (tmp_path / "none.csv").mkdir()
        read_delimited(spark, str(tmp_path / "none.csv"))


def test_types_and_names_of_records_with_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,a,Big Name\n1\n2,"x\ny",3.5\n7,z,1\n')
    table = read_delimited(spark, str(path))
    assert [k for _, k in table.dtypes] == ["int", "string", "double"]
    assert sorted(r[0] for r in table.collect()) == [1, 2, 7]
    alone = tmp_path / "plain.csv"
    alone.write_text("a,a,Big Name\n1\n2,xy,3.5\n7,z,1\n")
    assert table.dtypes == read_delimited(spark, str(alone)).dtypes
