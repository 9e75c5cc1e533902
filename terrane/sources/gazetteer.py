"""A gazetteer folder: registry files joined into the tables that the geocoder reads.

Names and positions of one kind come in two files with the same keys. They are
merged, get the keys that stages join by, and are written over what the folder
holds: pref, city and town as single tables, blocks, residences and lots in a
folder for each municipality. Loading the same files again changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import hash_key
from terrane.operators.storage import settled
from terrane.operators.upsert import last_of, lg_filter, lg_targets, positions_updated, upserted, write_routed
from terrane.plans.geocode import Gazetteer
from terrane.sources import registry

#: Table: kinds with names and positions, natural keys, whether it is split by municipality.
TABLES = {
    "pref": ("pref", "pref_pos", ["lg_code"], False),
    "city": ("city", "city_pos", ["lg_code"], False),
    "town": ("town", "town_pos", ["lg_code", "machiaza_id"], False),
    "rsdt_blk": ("rsdtdsp_blk", "rsdtdsp_blk_pos", ["lg_code", "machiaza_id", "blk_id"], True),
    "rsdt_dsp": ("rsdtdsp_rsdt", "rsdtdsp_rsdt_pos", ["lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id"], True),
    "parcel": ("parcel", "parcel_pos", ["lg_code", "machiaza_id", "prc_id"], True),
}
#: What the geocoder can't do without, by table.
NEEDED = {
    "pref": ["pref_key", "pref"], "city": ["city_key", "pref_key", "city"], "town": ["town_key", "city_key", "machiaza_id"],
    "rsdt_blk": ["town_key", "blk_id", "blk_num"], "rsdt_dsp": ["town_key", "blk_id", "rsdt_id", "rsdt_num"], "parcel": ["town_key", "prc_id", "prc_num1"],
}


def row_key(*columns: str) -> Column:
    """Key of a row below the municipality, from its natural keys; blank ones don't count."""
    return F.xxhash64(F.concat_ws("/", *(F.nullif(F.col(c), F.lit("")) for c in columns)))


def with_keys(rows: DataFrame, table: str) -> DataFrame:
    """rows with the keys that stages join by."""
    keys = {"pref_key": hash_key(F.substring("lg_code", 1, 2))}
    if table != "pref":
        keys["city_key"] = hash_key(F.col("lg_code"))
    if "machiaza_id" in rows.columns:
        keys["town_key"] = row_key("lg_code", "machiaza_id")
    own = {"rsdt_blk": ("rsdtblk_key", "blk_id"), "rsdt_dsp": ("rsdtdsp_key", "rsdt2_id"), "parcel": ("parcel_key", "prc_id")}
    if table in own:
        name, last = own[table]
        columns = TABLES[table][2]
        keys[name] = row_key(*columns[: columns.index(last) + 1])
    return rows.withColumns(keys)


def merged(names: DataFrame, places: DataFrame | None, table: str) -> DataFrame:
    """Names with their positions; a position without a name makes a row, one of an unknown reference system none."""
    keys = TABLES[table][2]
    blank = {k: F.coalesce(k, F.lit("")) for k in keys}
    order = F.monotonically_increasing_id()
    names = last_of(names.withColumns(blank).withColumn("_n", order), keys, F.col("_n")).drop("_n")
    names = names.withColumns({"rep_lat": F.lit(None).cast("double"), "rep_lon": F.lit(None).cast("double")})
    if places is None:
        return names
    places = places.filter("not rejected").withColumns(blank).withColumn("_n", order)
    return positions_updated(names, last_of(places, keys, F.col("_n")).drop("_n"), keys)


def wanted(rows: DataFrame, table: str, codes: list[str] | None) -> DataFrame:
    """The rows of some municipalities or, by `NN....`, prefectures; a prefecture's own row if any of its codes is asked for."""
    if not codes:
        return rows
    asked = rows.sparkSession.createDataFrame([(c,) for c in codes], "lg_code string")
    if table == "pref":
        heads = asked.select(F.substring("lg_code", 1, 2).alias("_head")).distinct()
        return rows.join(F.broadcast(heads), F.substring(rows["lg_code"], 1, 2) == F.col("_head"), "left_semi")
    return lg_filter(rows, lg_targets(asked, rows.select("lg_code").distinct()))


def load(spark: SparkSession, csv: str, folder: str, codes: list[str] | None = None) -> dict[str, dict[str, int]]:
    """Loads the CSV files below `csv` into a gazetteer folder; how many rows are new, updated and the same, by table."""
    done = {}
    for table, (names_kind, places_kind, keys, routed) in TABLES.items():
        found = {}
        for kind in (names_kind, places_kind):
            for scope in ("all", "pref", "city"):
                try:
                    rows = registry.read_registry(spark, f"{csv}/mt_{kind}_{scope}*.csv", kind)
                except AnalysisException:
                    continue
                found[kind] = rows if kind not in found else found[kind].unionByName(rows)
        if names_kind not in found:
            continue
        rows = with_keys(wanted(merged(found[names_kind], found.get(places_kind), table), table, codes), table)
        path = f"{folder}/{table}"
        values = [c for c in rows.columns if c not in keys]
        try:
            old = spark.read.parquet(path).drop("municipality")
        except AnalysisException:
            old = spark.createDataFrame([], rows.schema)
        # What is read is written over, so it has to lie elsewhere first.
        new = settled(upserted(old, rows, keys, values), f"load-{table}")
        done[table] = {r["changed"]: r["n"] for r in new.groupBy("changed").agg(F.count("*").alias("n")).collect()}
        if set(done[table]) - {"same"}:
            out = new.drop("changed")
            if routed:
                write_routed(out, path)
            else:
                out.write.mode("overwrite").parquet(path)
    return done


def read(spark: SparkSession, folder: str) -> Gazetteer:
    """The gazetteer of a folder. Only pref and city have to be there; a table without its keys is refused."""
    found = {}
    for table, columns in NEEDED.items():
        try:
            rows = spark.read.parquet(f"{folder}/{table}")
        except AnalysisException:
            if table in ("pref", "city"):
                raise
            continue
        if missing := [c for c in columns if c not in rows.columns]:
            raise ValueError(f"{folder}/{table} has no {', '.join(missing)}")
        found[table] = rows.drop("municipality")
    return Gazetteer(**found)
