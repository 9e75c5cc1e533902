"""Output formats, as one string column for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.constants import CSV_COLUMNS, LEVELS

#: Columns that a CSV line always quotes; `others` too, where there are any.
QUOTED = ("input", "output", "lg_code", "machiaza_id")
SIMPLE_COLUMNS = ["input", "output", "score", "match_level"]
#: Keys of the matched rows, which the formats add for whoever looks for a fault.
DEBUG_COLUMNS = ["pref_key", "city_key", "town_key", "parcel_key", "rsdtblk_key", "rsdtdsp_key"]
#: Their value is left out, not null, where there is none.
_ABSENT = "rsdt_addr_flg"


def level_name(level: Column) -> Column:
    """The published name of a level."""
    names = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    return F.element_at(names, level.cast("int"))


def number(c: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _value(df: DataFrame, c: str) -> Column:
    """A result's value as it is published."""
    if c not in df.columns:
        return F.array().cast("array<string>") if c == "others" else F.lit(None).cast("string")
    kind = df.schema[c].dataType.typeName()
    if c in ("match_level", "coordinate_level"):
        return level_name(F.col(c))
    return F.nullif(F.col(c), F.lit("")) if kind == "string" and c not in ("input", "output") else F.col(c)


def _text(df: DataFrame, c: str) -> Column:
    v = _value(df, c)
    if c == "others":
        return F.when(F.size(v) > 0, F.concat(F.lit('"'), F.array_join(v, ","), F.lit('"'))).otherwise(F.lit(""))
    if c in ("score", "lat", "lon"):
        v = number(v)
    elif c == "input":  # a quote, or two that are doubled already
        v = F.regexp_replace(v, '"{1,2}', '""')
    v = F.coalesce(v.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), v, F.lit('"')) if c in QUOTED else v


def csv_columns(debug: bool = False) -> list[str]:
    return CSV_COLUMNS + DEBUG_COLUMNS * debug


def csv_lines(df: DataFrame, debug: bool = False) -> Column:
    return F.concat_ws(",", *(_text(df, c) for c in csv_columns(debug)))


def simplified_lines(df: DataFrame, debug: bool = False) -> Column:
    return F.concat_ws(",", *(_text(df, c) for c in SIMPLE_COLUMNS))


def _json(row: Column) -> Column:
    # In a string of JSON quotes are escaped, so that this is a key and nothing else.
    return F.regexp_replace(F.to_json(row, {"ignoreNullFields": "false"}), f',"{_ABSENT}":null', "")


def _place(df: DataFrame) -> Column:
    """Latitude and longitude, both or neither."""
    both = _value(df, "lat").isNotNull() & _value(df, "lon").isNotNull()
    return F.struct(*(F.when(both, _value(df, c).cast("double")).alias(c) for c in ("lat", "lon")))


def _results(df: DataFrame, skip: tuple[str, ...]) -> list[Column]:
    at = _place(df)
    order = ["input", "output", "others", *(c for c in CSV_COLUMNS if c not in ("input", "output", "others"))]
    return [(at[c] if c in ("lat", "lon") else _value(df, c)).alias(c) for c in order if c not in skip]


def _keys(df: DataFrame, prefix: str) -> list[Column]:
    return [_value(df, c).cast("long").alias(prefix + c) for c in DEBUG_COLUMNS]


def json_lines(df: DataFrame, debug: bool = False) -> Column:
    parts = [F.struct(F.col("input")).alias("query"), F.struct(*_results(df, ("input",))).alias("result")]
    return _json(F.struct(*parts, *([F.struct(*_keys(df, "")).alias("debug")] if debug else [])))


def geojson_lines(df: DataFrame, debug: bool = False) -> Column:
    at = _place(df)
    point = F.struct(F.lit("Point").alias("type"), F.array(at["lon"], at["lat"]).alias("coordinates"))
    props = F.struct(*_results(df, ()), *(_keys(df, "debug_") if debug else []))
    return _json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties")))


FORMATS = {
    "csv": csv_lines,
    "simplified": simplified_lines,
    "json": json_lines,
    "ndjson": json_lines,
    "geojson": geojson_lines,
    "ndgeojson": geojson_lines,
}


#: What goes before, between and after the rows of a format; MIME types of the whole.
FRAMES = {"json": ("[", ",", "]"), "geojson": ('{"type":"FeatureCollection", "features":[', ",", "]}")}
MIME = {k: "text/x-csv" if k in ("csv", "simplified") else "application/json" for k in FORMATS}


def formatted(df: DataFrame, kind: str, debug: bool = False) -> DataFrame:
    """(line_id, value) in a format."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    return df.select("line_id", FORMATS[kind](df, debug).alias("value"))


def framed(df: DataFrame, kind: str, debug: bool = False) -> DataFrame:
    """(line_id, value) of all lines of a format's text, in the order of line_id: heads and brackets too."""
    rows = formatted(df, kind, debug)
    spark = df.sparkSession
    if kind in ("csv", "simplified"):
        head = ",".join(csv_columns(debug) if kind == "csv" else SIMPLE_COLUMNS)
        return spark.createDataFrame([(None, head)], rows.schema).unionByName(rows)
    if kind in FRAMES:
        start, between, end = FRAMES[kind]
        last = rows.agg(F.max("line_id")).first()[0]
        rows = rows.withColumn("value", F.when(F.col("line_id") < F.lit(last), F.concat("value", F.lit(between))).otherwise(F.col("value")))
        after = (last if last is not None else 0) + 1
        return spark.createDataFrame([(None, start), (after, end)], rows.schema).unionByName(rows)
    return rows


def write(df: DataFrame, kind: str, path: str, debug: bool = False) -> None:
    """Lines in the order of line_id, as text files that follow one another.

    The two formats that are one JSON value get their brackets as lines of the
    first and last file; commas end all rows but the last.
    """
    framed(df, kind, debug).sort(F.col("line_id").asc_nulls_first()).select("value").write.mode("overwrite").text(path)


def printed(df: DataFrame, kind: str, debug: bool = False, out=None) -> None:
    """The same lines to a stream, the standard output by default; rows come one partition at a time."""
    import sys

    stream = out or sys.stdout
    for r in framed(df, kind, debug).sort(F.col("line_id").asc_nulls_first()).select("value").toLocalIterator():
        stream.write(r["value"] + "\n")
