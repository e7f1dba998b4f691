"""Delimited text files with detected separator, header and encoding."""

from __future__ import annotations

import codecs
import csv
import io
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietband.sources.names import clean_column_names
from quietband.sources.records import ends_inside, quoted_records, text_lines

HEAD_BYTES = 10_240
SEPARATORS = ",;\t|"
EXTENSIONS = (".csv", ".tsv", ".tab")
# Spark's names for the encodings that are detected.
SPARK_ENCODING = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
# Fields beyond the last column that are looked at to find lines with too many.
SURPLUS_FIELDS = 16
_EXTRA = "_surplus_field_"


class UnreadableFile(ValueError):
    """The file is not delimited text this reader understands."""


def first_file(spark: SparkSession, path: str) -> str:
    """The path itself, or the first file of a folder by name that holds anything."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.getFileStatus(location).isDirectory():
        return path
    held = [s.getPath() for s in system.listStatus(location) if s.isFile() and s.getLen() > 0]
    names = sorted(p.toString() for p in held if p.getName()[0] not in "._")
    if not names:
        raise UnreadableFile(f"the folder {path} holds no data")
    return names[0]


def read_head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """First bytes of a file on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.open(location)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def has_quoted_breaks(spark: SparkSession, path: str, layout: Layout) -> bool:
    """Whether any quoted field goes on in the next line, found in one scan of the lines.

    The first record that spans lines starts a line, so its first line, taken apart on its
    own, ends within quotes; where no line does, no record spans lines.
    """
    if not _ascii_quotes(layout):
        return True  # quote signs do not show in the bytes: let the parser find them
    return not spark.read.text(path).where(ends_inside(F.col("value"), layout.sep)).isEmpty()


def _ascii_quotes(layout: Layout) -> bool:
    return '"\n'.encode(layout.encoding) == b'"\n'


@dataclass(frozen=True)
class Layout:
    """How a file is written, as far as its head tells."""

    encoding: str
    sep: str
    header: bool
    multiline: bool


def detect_encoding(head: bytes) -> str:
    """UTF-8 where the head is valid so far, else Latin-1, which takes any byte."""
    if b"\x00" in head:
        raise UnreadableFile("the file holds NUL bytes and looks binary")
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def inspect_head(head: bytes, sep: str | None = None, encoding: str | None = None) -> Layout:
    """Parse the head once per separator; the one that cuts most lines alike wins."""
    encoding = encoding or detect_encoding(head)
    text = head.decode(encoding, errors="replace")
    if len(head) == HEAD_BYTES and "\n" in text:
        text = text[: text.rindex("\n") + 1]  # the last line may be cut off
    best: tuple = (-1.0, 0, ",", [])
    for candidate in [sep] if sep else SEPARATORS:
        rows = [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=candidate) if row]
        width, alike = Counter(map(len, rows)).most_common(1)[0] if rows else (1, 0)
        share = alike / len(rows) if rows and width > 1 else 0.0
        if (share, width) > best[:2]:
            best = (share, width, candidate, rows)
    rows = best[3]
    return Layout(
        encoding,
        best[2] if best[0] > 0 or sep else ",",
        not rows or not any(map(_is_value, rows[0])),
        any("\n" in cell or "\r" in cell for row in rows for cell in row),
    )


def _is_value(cell: str) -> bool:
    """Whether a cell of the first line speaks against a header: empty or a number."""
    try:
        float(cell or "0")
    except ValueError:
        return not cell.strip()
    return True


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    header: bool | None = None,
    encoding: str | None = None,
    max_rows: int | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Read a CSV or TSV file, or a folder of them, with doubled quotes inside quoted fields.

    The layout comes from the head of the (first) file. Short lines are padded with NULL;
    lines with anything in the 16 fields beyond the last column are skipped. Quoted line
    breaks are looked for in all lines unless ``multiline`` is given; such files are cut
    into records by as many tasks as they have byte ranges.
    """
    name = path.rstrip("/")
    suffix = name[name.rfind("."):].lower() if "." in name else ""
    if suffix not in EXTENSIONS:
        raise UnreadableFile(f"unsupported extension {suffix!r}, expected one of {EXTENSIONS}")
    if sep is None and suffix in (".tsv", ".tab"):
        sep = "\t"
    head = read_head(spark, first_file(spark, path))
    found = inspect_head(head, sep, encoding)
    header = found.header if header is None else header
    if multiline is None:
        multiline = found.multiline or has_quoted_breaks(spark, path, found)
    written_in = SPARK_ENCODING.get(found.encoding, found.encoding)
    options = dict(sep=found.sep, escape='"', multiLine=multiline)
    # Field count and names come from the first record of the head, types from the file.
    infer = spark.read.options(**options, inferSchema=True, mode="DROPMALFORMED", header=header)
    if multiline and _ascii_quotes(found):
        records = quoted_records(text_lines(spark, path, written_in), found.sep, header)
        inferred = _parsed(infer, _first_record(spark, head.decode(found.encoding, errors="replace"), found.sep).union(records)).schema
        parsed = lambda reader: _parsed(reader, records)
    else:
        inferred = infer.option("encoding", written_in).csv(path).schema
        parsed = lambda reader: reader.options(header=header, encoding=written_in).csv(path)
    surplus = [T.StructField(f"{_EXTRA}{i}", T.StringType()) for i in range(SURPLUS_FIELDS)]
    reader = spark.read.options(**options, mode="PERMISSIVE", enforceSchema=True)
    rows = parsed(reader.schema(T.StructType([*inferred.fields, *surplus])))
    names = [field.name for field in surplus]
    rows = rows.where(F.coalesce(*names).isNull()).drop(*names)
    if not header:
        rows = rows.toDF(*[f"col_{i}" for i in range(len(inferred))])
    rows = clean_column_names(rows)
    return rows if max_rows is None else rows.limit(max_rows)


def _parsed(reader, records: DataFrame) -> DataFrame:
    """Spark's own parser over strings that each hold one record."""
    strings = records.sparkSession.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
    return reader._df(reader._jreader.csv(getattr(records._jdf, "as")(strings)))


def _first_record(spark: SparkSession, head: str, sep: str) -> DataFrame:
    rows = csv.reader(io.StringIO(head.lstrip("\ufeff"), newline=""), delimiter=sep)
    line = io.StringIO()
    csv.writer(line, delimiter=sep, quoting=csv.QUOTE_ALL, lineterminator="").writerow(next(filter(None, rows), []))
    return spark.createDataFrame([(line.getvalue(),)], "record string")


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, sep="\t", **options)
