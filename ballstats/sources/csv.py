"""Delivery CSV files: one file, one folder, or many files with different columns.

Columns are matched by header name and typed explicitly; nothing is inferred from values.
Each row gets ``seq``, its place in file order, as (file, block, row): a scan has no order of
its own, but within a block of a file the row numbers rise.  It sorts and compares like a
number; :func:`ballstats.sources.tables.ingest` turns it into one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballstats.operators.prepare import INDEX_COLUMNS, dedupe_first, prepare_deliveries, prepare_typed
from ballstats.schema import DELIVERIES, TYPED_DELIVERIES

# Texts that a CSV reader takes for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# League names and their files.
LEAGUES = {
    "T20I": "T20I.csv",
    "IPL": "all_matches.csv",
    "PSL": "PSL.csv",
    "SA20": "SA20.csv",
    "T20 WCs": "t20wcs.csv",
    "WPL": "WPL.csv",
    "CPL": "CPL.csv",
    "LPL": "LPL.csv",
    "MLC": "MLC.csv",
    "SMAT": "SMA.csv",
    "The 100": "The 100.csv",
}
# The files of the typed layout.
TYPED_FILES = ["T20Data.csv", "T20Leagues.csv"]

# Header lines read at a time; each waits for its file system, not for a core.
HEADER_READERS = 32

# Fixed value: files describing a match rather than its deliveries.
INFO_MARK = "_info"


def _reader(spark: SparkSession):
    return spark.read.option("header", True).option("escape", '"')


def _typed(text: Column, kind: T.DataType) -> Column:
    text = F.when(~text.isin(MISSING), text)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DoubleType):
        return text.try_cast("double")
    # whole numbers may be written as 1.0 where the column once had gaps
    return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The data files that some paths (files, folders, globs) name, in order; nothing is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        todo = sorted(fs.globStatus(place) or [], key=lambda s: s.getPath().toString())
        if not todo:
            raise FileNotFoundError(f"nothing at {path}")
        while todo:
            status = todo.pop(0)
            if status.isFile():
                found.append(status.getPath().toString())
            else:
                inner = sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().toString())
                todo[:0] = [s for s in inner if not s.getPath().getName().startswith(("_", "."))]
    return found


def _first_line(spark: SparkSession, path: str) -> str:
    """The header line of a file, compressed or not; no more than the stream's first buffer is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    try:
        source = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").lstrip("\ufeff")


def _first_lines(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The header lines of some files, in their order, read many at a time."""
    with ThreadPoolExecutor(HEADER_READERS) as readers:
        return list(readers.map(lambda path: _first_line(spark, path), paths))


def read_layout(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    multiline: bool = False,
    bad_rows: str = "error",
) -> DataFrame:
    """Read files that share one header line; a file with another header is an error.

    Columns of ``schema`` that the files lack are NULL; other columns are carried as text,
    except the index a written-out table starts with.  A row with more or fewer fields than the
    header is an error, or with ``bad_rows="null"`` is filled up with NULL or cut.  Selecting columns
    later parses only those.  Line breaks within quotes need ``multiline``, which reads each
    file in one task and parses all columns.
    """
    if bad_rows not in ("error", "null"):
        raise ValueError(f"bad_rows must be 'error' or 'null', not {bad_rows!r}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines: dict[str, str] = {}
    files = _files(spark, paths)
    for path, line in zip(files, _first_lines(spark, files), strict=True):
        if line:  # a file without a line holds no rows
            lines.setdefault(line, path)
    if len(lines) > 1:
        (_, first), (_, other), *_ = lines.items()
        raise ValueError(f"{other} has another header than {first}")
    return _read(spark, paths, next(iter(lines), ""), schema, multiline, bad_rows)


def _whole_rows(spark: SparkSession, paths: list[str], header: list[str], bad_rows: str) -> tuple[DataFrame, list[Column]]:
    """Rows whose quotes may hold line breaks, and their fields, by Spark's reader: every field of a row is parsed."""
    texts = T.StructType([T.StructField(h, T.StringType()) for h in header])
    # a row's fields can only be counted there if all of them are parsed
    strict = {"mode": "FAILFAST", "columnPruning": False} if bad_rows == "error" else {"mode": "PERMISSIVE"}
    rows = _reader(spark).option("multiLine", True).options(**strict).schema(texts).csv(paths)
    return rows, [F.col(f"`{h}`") for h in header]


def _line_rows(spark: SparkSession, paths: list[str], line: str, header: list[str], bad_rows: str) -> tuple[DataFrame, list[Column]]:
    """Rows that are one line each, and their fields.

    A line without quotes is counted by its commas, and a field is cut out only where it is selected.
    Lines with quotes go through Spark's parser.  Blank lines and repetitions of the header are no rows.
    """
    value = F.col("value")
    lines = spark.read.text(paths).filter((F.trim(value) != "") & ~value.isin(line, "\ufeff" + line))
    quoted, n = value.contains('"'), len(header)
    names = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(n)])
    mode = "FAILFAST" if bad_rows == "error" else "PERMISSIVE"
    parsed = F.from_csv(value, names.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"', "mode": mode})
    if bad_rows == "error":
        commas = F.length(value) - F.length(F.replace(value, F.lit(","), F.lit("")))
        wrong = F.concat(F.lit(f"malformed row, not of {n} fields: "), value)
        whole = F.when(quoted, parsed.isNotNull()).otherwise((commas == n - 1) | F.raise_error(wrong).cast("boolean"))
        lines = lines.filter(whole)
    rows = lines.withColumns({"_plain": F.when(~quoted, F.split(value, ",", -1)), "_parsed": F.when(quoted, parsed)})
    return rows, [F.coalesce(F.get("_plain", F.lit(i)), F.col(f"_parsed.f{i}")) for i in range(n)]


def _read(spark: SparkSession, paths: list[str], line: str, schema: T.StructType, multiline: bool, bad_rows: str) -> DataFrame:
    header = _reader(spark).option("multiLine", multiline).csv(paths).columns
    if multiline:
        rows, fields = _whole_rows(spark, paths, header, bad_rows)
    else:
        rows, fields = _line_rows(spark, paths, line, header, bad_rows)
    text = dict(zip(header, fields, strict=True))
    known = [
        (_typed(text[f.name], f.dataType) if f.name in text else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    extra = [F.nullif(text[h], F.lit("")).alias(h) for h in header if h not in schema.fieldNames() and h not in INDEX_COLUMNS]
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select(*known, *extra, place.alias("seq"))


def merge_csv(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = DELIVERIES,
    pattern: str = "*.csv",
    skip: str = INFO_MARK,
    multiline: bool = False,
    bad_rows: str = "error",
) -> DataFrame:
    """All CSV files of a folder as one table, columns matched by name.

    Info files are left out by name.  The others are grouped by header line, of which one is read
    of each file; each group is one scan, and the groups are united with NULL for columns a group
    lacks.  Only file names and header lines reach the driver.
    """
    layouts: dict[str, list[str]] = {}
    files = [(path, path.rsplit("/", 1)[-1]) for path in _files(spark, [folder])]
    files = [path for path, name in files if fnmatch(name, pattern) and skip not in name]
    for path, line in zip(files, _first_lines(spark, files), strict=True):
        if line:
            layouts.setdefault(line, []).append(path)
    if not layouts:
        raise FileNotFoundError(f"no {pattern} without {skip!r} in {folder}")
    parts = [_read(spark, paths, line, schema, multiline, bad_rows) for line, paths in layouts.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables whose columns may differ; a column one lacks is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def load_deliveries(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Prepared deliveries from CSV: typed, repeated rows dropped, derived columns added."""
    return prepare_deliveries(dedupe_first(read_layout(spark, paths, DELIVERIES)))


def load_league(spark: SparkSession, base: str, league: str, files: Mapping[str, str] = LEAGUES) -> DataFrame:
    """Prepared deliveries of one league of the registry below ``base``."""
    if league not in files:
        raise KeyError(f"unknown league {league!r}; known: {', '.join(files)}")
    return load_deliveries(spark, f"{base}/{files[league]}")


def load_typed(spark: SparkSession, base: str, files: Sequence[str] = TYPED_FILES) -> DataFrame:
    """Prepared typed deliveries: every file loaded by itself, then united."""
    tables = [
        prepare_typed(dedupe_first(read_layout(spark, f"{base}/{name}", TYPED_DELIVERIES))) for name in files
    ]
    return union_sources(*tables)
