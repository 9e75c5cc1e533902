"""Address lines from text: line ends, byte-order marks, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Marks at the start of a file, the longest first, and what they say of it.
MARKS = {
    b"\x00\x00\xfe\xff": "UTF-32BE",
    b"\xff\xfe\x00\x00": "UTF-32LE",
    b"\xef\xbb\xbf": "UTF-8",
    b"\xfe\xff": "UTF-16BE",
    b"\xff\xfe": "UTF-16LE",
}


def sniffed(spark: SparkSession, path: str) -> dict[str, str]:
    """The encoding that the first bytes of each file at path name; UTF-8 where they name none.

    Four bytes of each file are read, by whatever file system Spark finds there.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    found = {}
    for status in system.globStatus(at) or []:
        inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        for file in inside:
            if file.isDirectory() or file.getPath().getName()[:1] in "._":
                continue
            stream = system.open(file.getPath())
            head = bytes(b & 255 for b in (stream.read() for _ in range(min(4, file.getLen()))) if b >= 0)
            stream.close()
            found[file.getPath().toString()] = next((e for m, e in MARKS.items() if head.startswith(m)), "UTF-8")
    return found


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, line_id, value) of non-blank lines; ids ascend within a file.

    Lines end with LF, CR LF or a bare CR. Without an encoding that of each file
    is told by its mark. UTF-32 is refused.
    """
    if encoding is None:
        by: dict[str, list[str]] = {}
        for file, kind in sniffed(spark, path).items():
            by.setdefault(kind, []).append(file)
        if set(by) - {"UTF-8"}:
            rows = [_raw(spark, files, kind) for kind, files in sorted(by.items())]
            out = rows[0]
            for more in rows[1:]:
                out = out.unionByName(more)
            return _lines(out)
    return _lines(_raw(spark, [path], encoding or "UTF-8"))


def _raw(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    if encoding.upper().startswith("UTF-32"):
        raise ValueError(f"{encoding} is not supported")
    if encoding.upper() == "UTF-8":
        return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = spark.read.option("encoding", encoding).option("lineSep", "\n").option("sep", "\u0001").option("quote", "").csv(paths, schema="value string")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", "\r")).alias("value"))


def _lines(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("line_id", F.monotonically_increasing_id())
        .withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
        .filter(F.trim("value") != "")
    )


def given_lines(spark: SparkSession, stream, folder: str, at_once: int = 100_000) -> DataFrame:
    """(file, line_id, value) of the non-blank lines of an open stream, as of the standard input.

    The stream is read once, `at_once` lines at a time, into files in a shared folder.
    """
    schema = "file string, line_id long, value string"
    held: list[tuple[str, int, str]] = []
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
    for number, line in enumerate(stream):
        if value := line.rstrip("\r\n").lstrip("\ufeff" if not number else ""):
            held.append(("-", number, value))
        if len(held) >= at_once:
            spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
            held = []
    if held:
        spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).filter(F.trim("value") != "")


def line_count(lines: DataFrame) -> int:
    return lines.count()


def comment_filtered(value: Column) -> Column:
    """A line without its comments; null where nothing is left. Block comments within the line only."""
    c = F.trim(value)
    c = F.regexp_replace(c, r"/\*.*?\*/", "")
    c = F.trim(F.regexp_replace(c, r"(^|[^:])//.*$", "$1"))
    c = F.regexp_replace(c, r"^([\"'])(.*)\1$", "$2")
    return F.when((c != "") & ~c.startswith("#"), c)


def without_block_comments(lines: DataFrame, file: str = "file") -> DataFrame:
    """Removes /* … */ that span lines: a line inside an open block is dropped, a line's outer parts stay.

    A running balance of marks within each file says what is open; files are
    the unit of order, so they can be worked on side by side.
    """
    marks = F.regexp_extract_all("value", F.lit(r"/\*|\*/"), F.lit(0))
    last = F.element_at(marks, -1)
    w = Window.partitionBy(file).orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.last(F.when(F.size(marks) > 0, last), ignorenulls=True).over(w) == "/*", F.lit(False))
    text = F.when(F.col("_open"), F.concat(F.lit("/*"), F.col("value"))).otherwise(F.col("value"))
    return (
        lines.withColumn("_open", opened)
        .withColumn("value", F.regexp_replace(F.regexp_replace(text, r"/\*.*?\*/", ""), r"/\*.*$", ""))
        .drop("_open")
        .filter(F.trim("value") != "")
    )
