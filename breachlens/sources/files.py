"""CSV and text scans.

Every cell is read as text: inference would cost a second pass and would strip leading zeros from passwords.
Columns are bound by the name in the header, whatever their order. Lines with too many fields are set aside with a
reason; lines with too few are padded with NULL. Both come out of one pass: a scan has a ``bad_line`` column, which is
NULL on usable rows.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Files
from ..functions.text import blank_to_null, strip
from ..functions.values import GENERIC_NA, SPYCLOUD_NA
from ..schemas import DIRECTORY, LEAK_CSV_COLUMNS, LINEAGE, SPYCLOUD_COLUMNS, all_text

BAD_LINE = "bad_line"
TOO_LONG = "too many fields"
CORRUPT = "_corrupt_record"

# Every line is split whole, or a query for few columns would not see that a line has too many.
PARSING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False}


def header_of(spark: SparkSession, paths, sep: str = ",") -> list[str]:
    """Column names on the first line of the first file; nothing else is read."""
    return spark.read.options(header=True, sep=sep, escape='"').csv(paths).columns


def by_header(spark: SparkSession, paths, sep: str = ",", *, listed: bool = False) -> list[tuple[list[str], list[str]]]:
    """[(column names, files)]: the files of ``paths`` by the header they have. Of each file one line is read.

    Only names and first lines pass through the driver, several at a time. ``listed`` says that ``paths`` are the files themselves.
    """
    files = sorted(paths if listed else (unquote(name) for name in spark.read.text(paths).inputFiles()))
    if len(files) <= 1 and not listed:
        return [(header_of(spark, paths, sep), files)] if files else []
    reader = Files(spark, files[0])
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(reader.first_line, files))
    groups = {}
    for name, line in zip(files, lines, strict=True):
        groups.setdefault(line, []).append(name)
    return [(header_of(spark, some[0], sep), some) for line, some in groups.items() if line]


def with_lineage(scan: DataFrame) -> DataFrame:
    """Add the position of each row: file, block in the file, place in the block."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_ord"),
    )


def lineage_id() -> Column:
    """One text per input row."""
    return F.concat_ws(":", *LINEAGE)


def field_count(line: Column, sep: str = ",") -> Column:
    """Fields in a raw line; separators inside quotes do not count. Only ever applied to the few bad lines."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def scan_csv(
    spark: SparkSession, paths, columns, *, na=GENERIC_NA, sep=",", multi_line=False, header=None, has_header=True
):
    """Rows of CSV files, each bound by the names in its own header.

    The result has exactly ``columns`` (missing ones NULL, unknown ones ignored) with ``na`` cells NULL, then ``bad_line``
    and the lineage. Files with the same header are one scan; files that have another order or a part of the columns are scans of their own,
    put together by name. With ``header`` all files must have that one: one that differs fails the read rather than being
    misread; ``has_header=False`` takes the names from ``header``. ``multi_line`` allows line breaks in quotes;
    such files are not split among tasks.
    """
    if header is None:
        groups = by_header(spark, paths, sep)
        if len(groups) > 1:
            options = {"na": na, "sep": sep, "multi_line": multi_line}
            scans = [scan_csv(spark, files, columns, header=names, **options) for names, files in groups]
            return reduce(DataFrame.unionByName, scans)
        if not groups:
            return empty_scan(spark, columns)
        header = groups[0][0]
    reader = spark.read.options(header=has_header, sep=sep, escape='"', enforceSchema=False, multiLine=multi_line)
    scan = reader.options(**PARSING).schema(raw_schema(header)).csv(paths)
    return cells(with_lineage(scan), header, columns, na=na, sep=sep)


def empty_scan(spark: SparkSession, columns) -> DataFrame:
    """A scan without rows."""
    lineage = [T.StructField("src_file", T.StringType()), *[T.StructField(c, T.LongType()) for c in LINEAGE[1:]]]
    return spark.createDataFrame([], T.StructType([*all_text([*columns, BAD_LINE]).fields, *lineage]))


def raw_schema(header):
    return T.StructType(all_text(header).fields + [T.StructField(CORRUPT, T.StringType())])


def cells(scan: DataFrame, header, columns, *, na=GENERIC_NA, sep=",") -> DataFrame:
    """A raw batch or stream in ``header`` order -> the scan's result. Spark marks long and short lines alike."""
    # Spark refuses to read the corrupt-record column alone, so the test names a cell too.
    present = F.length(F.coalesce(F.col(f"`{header[0]}`"), F.lit(""))) >= 0
    too_long = F.col(CORRUPT).isNotNull() & (field_count(F.col(CORRUPT), sep) > len(header)) & present
    have = set(header)
    values = [
        (blank_to_null(F.col(f"`{c}`"), na) if c in have else F.lit(None).cast("string")).alias(c) for c in columns
    ]
    return scan.select(*values, F.when(too_long, F.col(CORRUPT)).alias(BAD_LINE), *LINEAGE)


def split_bad_lines(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected lines with their reason)."""
    rejected = scan.filter(F.col(BAD_LINE).isNotNull())
    return scan.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE), rejected.select(
        F.col(BAD_LINE).alias("original_line"), F.lit(TOO_LONG).alias("error_msg"), *LINEAGE
    )


def scan_spycloud(spark, paths, **options):
    """The 25 columns of the vendor's layout."""
    return scan_csv(spark, paths, SPYCLOUD_COLUMNS, na=SPYCLOUD_NA, **options)


def scan_leak_csv(spark, paths, leak_id: int, columns=LEAK_CSV_COLUMNS, **options):
    """The generic layout, each row tagged with its leak."""
    return scan_csv(spark, paths, columns, **options).select(F.lit(leak_id).cast("long").alias("leak_id"), "*")


def collect_csv(spark, paths, columns, **options) -> tuple[str, DataFrame]:
    """("OK", rows), or (what went wrong, no rows) when the files cannot be opened."""
    try:
        return "OK", scan_csv(spark, paths, columns, **options)
    except AnalysisException as problem:
        return str(problem), empty_scan(spark, columns)


def scan_vips(spark, path) -> DataFrame:
    """Distinct ``email_key``, one address per line. No file means no VIPs."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
            raise
        lines = spark.createDataFrame([], "value string")
    return vips_from(lines, "value")


def scan_directory(spark, path) -> DataFrame:
    """A snapshot of the corporate directory, one JSON entry per line, attributes as arrays."""
    return spark.read.schema(DIRECTORY).json(path)


def vips_from(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.upper(strip(F.col(column))).alias("email_key")).distinct()


def scan_combo(spark, path, pattern=None) -> DataFrame:
    """``email:password`` lines of all files below a folder; everything after the first colon is password."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return with_lineage(split_combo(reader.text(path)))


def split_combo(lines: DataFrame) -> DataFrame:
    """A line without a colon has no password; blank lines are skipped."""
    parts = F.split("value", ":", 2)
    kept = lines.filter(F.length(F.trim("value")) > 0)
    return kept.select(F.get(parts, F.lit(0)).alias("email"), F.get(parts, F.lit(1)).alias("password"))
