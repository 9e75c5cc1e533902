"""Match dictionaries derived from registry tables by ordinary joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.prefix_match import sized


def blank(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def has(c: str) -> Column:
    return blank(c) != ""


def city_with_pref(city: DataFrame, pref: DataFrame) -> DataFrame:
    return city.join(sized(pref.select("pref_key", "pref")), "pref_key")


def town_full(town: DataFrame, city: DataFrame, pref: DataFrame) -> DataFrame:
    """Towns with city and prefecture, match level, and coordinates inherited from the city."""
    c = city_with_pref(city, pref).withColumnsRenamed({"rep_lat": "city_lat", "rep_lon": "city_lon"})
    own = F.col("rep_lat").isNotNull()
    return (
        town.join(sized(c), "city_key")
        .withColumn("match_level", F.when(F.substring("machiaza_id", 5, 3) == "000", 3).otherwise(4))
        .withColumn("coordinate_level", F.when(own, F.col("match_level")).otherwise(2))
        .withColumn("rep_lon", F.when(own, F.col("rep_lon")).otherwise(F.col("city_lon")))
        .withColumn("rep_lat", F.coalesce("rep_lat", "city_lat"))
    )


def town_kind() -> Column:
    """Which of the five dictionary queries a town row belongs to; null: none."""
    o, c, k = has("oaza_cho"), has("chome"), has("koaza")
    return (
        F.when(o & c & k, "oaza_chome_koaza")
        .when(o & c, "oaza_chome")
        .when(o & ~c & ~k, "oaza")
        .when(~o & c & ~k, "chome")
        .when(~o & ~c & k, "koaza")
    )


def distinct_chome(full: DataFrame) -> DataFrame:
    return full.filter(has("chome")).select("city_key", "oaza_cho", "chome", "rsdt_addr_flg").distinct()


def oaza_parents(full: DataFrame) -> DataFrame:
    """One parent for each oaza, with the city's coordinate where none of its rows has one."""
    return full.filter(has("oaza_cho")).groupBy(
        "city_key", F.concat(F.substring("machiaza_id", 1, 4), F.lit("000")).alias("machiaza_id"), "oaza_cho"
    ).agg(F.min("rep_lat").alias("rep_lat"), F.count("*").alias("n"))


def with_parents(full: DataFrame) -> DataFrame:
    """full and, for each oaza that only has parts of its own, a row for the oaza as a whole.

    Such a row has no key of its own and no flag; its place is its city's.
    """
    named = full.filter(has("oaza_cho") & (F.coalesce("koaza_aka_code", F.lit(0)) != 2)).withColumn("_stem", F.substring("machiaza_id", 1, 4))
    own = named.filter(F.col("machiaza_id").endswith("000")).select("city_key", "_stem").distinct()
    keys = ["city_key", "_stem", "oaza_cho"]
    of_city = {"rep_lat": "city_lat", "rep_lon": "city_lon"}
    shared = [c for c in full.columns if c in ("pref_key", "lg_code", "county", "city", "ward", "pref")]
    rows = (
        named.join(own, ["city_key", "_stem"], "left_anti")
        .groupBy(*keys)
        .agg(*(F.min(c).alias(c) for c in shared), *(F.min(v if v in full.columns else k).alias(k) for k, v in of_city.items()))
        .withColumn("machiaza_id", F.concat("_stem", F.lit("000")))
        .withColumns({"match_level": F.lit(3), "coordinate_level": F.lit(2), "koaza_aka_code": F.lit(0), "rsdt_addr_flg": F.lit(-1)})
    )
    missing = {f.name: F.lit(None).cast(f.dataType) for f in full.schema.fields if f.name not in rows.columns}
    return full.unionByName(rows.withColumns(missing).select(*full.columns))


def by_precedence(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union in which a later part's row overwrites an earlier one's with the same keys."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("prec", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prec"), *order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def star_expanded(parents: DataFrame, concrete: DataFrame, keys: list[str]) -> DataFrame:
    """Parents of unknown flag take the flags of their concrete rows; the better coordinate stays."""
    c = concrete.groupBy(*keys, "rsdt_addr_flg").agg(F.max("rep_lat").alias("own_lat"))
    return parents.join(c, keys, "left").select(
        *keys, F.coalesce("rsdt_addr_flg", F.lit(-1)).alias("rsdt_addr_flg"), F.coalesce("own_lat", "rep_lat").alias("rep_lat")
    )


def inherited(full: DataFrame) -> DataFrame:
    """Rows that only have the city's coordinate take the best of their oaza's."""
    best = (
        full.filter("coordinate_level > 2")
        .groupBy("city_key", F.substring("machiaza_id", 1, 4).alias("stem"))
        .agg(F.max_by(F.struct("rep_lat", "rep_lon", "coordinate_level"), F.struct("coordinate_level", F.expr("-town_key"))).alias("b"))
    )
    city_only = F.col("coordinate_level") == 2
    return full.withColumn("stem", F.substring("machiaza_id", 1, 4)).join(best, ["city_key", "stem"], "left").select(
        *(c for c in full.columns if c not in ("rep_lat", "rep_lon", "coordinate_level")),
        *(F.when(city_only, F.coalesce(F.col(f"b.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in ("rep_lat", "rep_lon", "coordinate_level")),
    )


def kyoto_streets(full: DataFrame, lg_prefix: str = "261") -> DataFrame:
    """Street names: detail rows and their parents, the last of equal keys."""
    rows = full.filter(F.col("lg_code").startswith(lg_prefix) & has("oaza_cho") & F.col("rep_lat").isNotNull())
    detail = by_precedence([rows.filter("match_level = 4")], ["city_key", "machiaza_id"], [F.desc("town_key")])
    parent = by_precedence([rows.filter("match_level = 3")], ["city_key", "machiaza_id"], [F.desc("town_key")])
    return detail.unionByName(parent)


def street_keys(rows: DataFrame) -> DataFrame:
    """Streets and towns of Kyoto under the forms that lines give them: a street before its town, a part after it."""
    street = F.coalesce("koaza_aka_code", F.lit(0)) == 2
    name = lambda *c: F.concat(*map(blank, c))
    forms = [
        F.when(F.col("match_level") == 3, name("oaza_cho")),
        F.when((F.col("match_level") == 4) & street, name("koaza", "oaza_cho")),
        F.when((F.col("match_level") == 4) & ~street & ~has("oaza_cho") & ~has("chome"), name("koaza")),
        F.when((F.col("match_level") == 4) & ~street & has("oaza_cho") & ~has("chome") & has("koaza"), name("oaza_cho", "koaza")),
        F.when((F.col("match_level") == 4) & ~street & has("oaza_cho") & has("chome"), name("oaza_cho", "chome")),
        F.when((F.col("match_level") == 4) & ~street & has("oaza_cho") & has("chome") & has("koaza"), name("oaza_cho", "chome", "koaza")),
    ]
    keys = F.array_distinct(F.filter(F.array(*forms), lambda k: k.isNotNull() & (k != "")))
    return rows.withColumn("key", F.explode(keys))


def tokyo_wards(city: DataFrame, pref: str = "東京都") -> DataFrame:
    """Cities of Tokyo that are wards."""
    return city.filter((F.col("pref") == pref) & F.col("city").endswith("区"))


def key_variants(key: Column, *suffixes: str) -> Column:
    """A key and, for longer ones, the key without each suffix."""
    return F.array_distinct(
        F.array(key, *(F.when(F.length(key) > 2, F.regexp_replace(key, f"{s}$", "")).otherwise(key) for s in suffixes))
    )


def county_city_keys(city: DataFrame) -> DataFrame:
    return city.filter(has("county")).withColumn("key", F.concat(F.col("county"), F.col("city")))


def city_ward_keys(city: DataFrame) -> DataFrame:
    """Cities that are no wards themselves, under two keys: city and ward, and the ward alone."""
    keys = F.array_distinct(F.array(F.concat("city", blank("ward")), blank("ward")))
    return city.filter(~F.col("city").endswith("区")).withColumn("key", F.explode(keys)).filter("key <> ''")


def ward_towns(full: DataFrame, suffix: str, pref: str | None = None) -> DataFrame:
    """Towns of the wards of one prefecture, with the key ward and town."""
    rows = full.filter(F.col("city").endswith(suffix) & (F.coalesce("koaza_aka_code", F.lit(0)) != 2))
    if pref:
        rows = rows.filter(F.col("pref") == pref)
    return rows.withColumn("key", F.concat_ws("", "city", "oaza_cho", "chome", "koaza"))


def wards(city: DataFrame, pref: DataFrame) -> DataFrame:
    return city_with_pref(city, pref).filter(has("ward")).withColumn("key", F.col("ward"))


def replaced_into(rows: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """rows, overwritten by newer rows of the same keys."""
    return by_precedence([rows, newer], keys, [F.lit(0)])


def without_town(c: str) -> Column:
    """A name without its town word, where it has more than two characters."""
    v = blank(c)
    short = F.regexp_replace(v, "番町$", "")
    return F.when(F.length(v) > 2, F.when(short != v, short).otherwise(F.regexp_replace(v, "町$", ""))).otherwise(v)


def town_keys(full: DataFrame) -> DataFrame:
    """Each town under its full key and those in which its oaza or its chome lacks the town word."""
    forms = [("oaza_cho", "chome"), (None, "chome"), ("oaza_cho", None)]
    keys = [F.concat(blank(o) if o else without_town("oaza_cho"), blank(c) if c else without_town("chome"), blank("koaza")) for o, c in forms]
    return full.withColumn("key", F.explode(F.array_distinct(F.array(*keys)))).filter("key <> ''")
