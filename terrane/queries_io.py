"""Queries over sources and stored tables: what is written and read back must be what the tables say."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import dictionary as D
from terrane.operators import upsert as U
from terrane.operators.progress import counted
from terrane.operators.storage import shared_folder
from terrane.queries import _FULL, _full, _results, _table, derived, query
from terrane.sources import download, gazetteer, registry, sinks
from terrane.sources import lines as S


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/terrane/query-{name}-{uuid.uuid4().hex}"


@query("select s_suppkey, s_name || ' 1-' || s_suppkey as address from supplier")
def lines_from_text(spark, d):
    """Lines written as text, with a comment and a mark at the start of a file, and read again."""
    path = _folder(spark, "lines")
    s = _table(spark, d, "supplier").select(F.concat(F.lit("﻿"), "s_name", F.lit(" 1-"), "s_suppkey", F.lit(" // note\n\n# no line")).alias("value"))
    s.write.text(path)
    rows = S.read_lines(spark, path).select(S.comment_filtered(F.col("value")).alias("address")).filter("address is not null")
    return rows.select(F.regexp_extract("address", "([0-9]+)$", 1).cast("long").alias("s_suppkey"), "address")


@query("select count(*) as n from supplier")
def line_counter(spark, d):
    path = _folder(spark, "count")
    _table(spark, d, "supplier").select("s_name").write.text(path)
    return spark.createDataFrame([(S.line_count(S.read_lines(spark, path)),)], "n long")


@query("select p_partkey, p_name as chome, case when p_partkey % 2 = 0 then null else 30.5 end as rep_lat, p_partkey % 3 = 0 as rejected from part")
def registry_csv(spark, d):
    """Positions in a registry file: blanks are nulls, an unknown reference system rejects a row."""
    path = _folder(spark, "csv")
    p = _table(spark, d, "part").select(
        F.col("p_partkey").alias("lg_code"), F.col("p_name").alias("machiaza_id"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("30.5").alias("rep_lat"),
        F.lit("130").alias("rep_lon"), F.when(F.col("p_partkey") % 3 == 0, "EPSG:2451").otherwise("EPSG:6668").alias("rep_srid"), F.lit("1").alias("rsdt_addr_flg"),
    )
    p.write.option("header", True).csv(path)
    rows = registry.read_registry(spark, path, "town_pos")
    return rows.select(F.col("lg_code").cast("long").alias("p_partkey"), F.col("machiaza_id").alias("chome"), "rep_lat", "rejected")


@query("select n_nationkey, n_name || '.csv' as name, 'a,b' || chr(10) || n_name as content, strlen('a,b' || chr(10) || n_name) as size from nation")
def zip_entries(spark, d):
    """Archives made of two entries, the second in a folder of its own, and opened."""

    def packed(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            rows = []
            for key, name in zip(b["n_nationkey"], b["n_name"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("empty/", "")
                    z.writestr(f"{name}.csv", f"a,b\n{name}")
                rows.append((str(key), out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = _table(spark, d, "nation").select("n_nationkey", "n_name").mapInPandas(packed, "path string, content binary")
    rows = registry.unzipped(files).filter(F.crc32("content") == F.col("crc32"))
    return rows.select(F.col("archive").cast("int").alias("n_nationkey"), "name", F.col("content").cast("string").alias("content"), "size")


@query("select 'https://h.example/' || n_name || '.csv.zip' as url, '2024-01-' || lpad(cast(n_nationkey as varchar), 2, '0') as last_modified from nation")
def catalog_entries(spark, d):
    path = _folder(spark, "catalog")
    n = _table(spark, d, "nation")
    entry = F.struct(
        F.concat(F.lit("最終更新日: 2024-01-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("description"),
        F.array(*(F.struct(F.concat(F.lit("https://h.example/"), "n_name", F.lit(e)).alias("accessURL")) for e in (".csv.zip", ".pdf"))).alias("distribution"),
    )
    n.agg(F.collect_list(entry).alias("dataset")).select(F.to_json(F.struct("dataset")).alias("value")).coalesce(1).write.text(path)
    return registry.catalog(spark, path)


@query("select p_partkey, 'town' as dataset, case when p_partkey % 2 = 0 then '13....' else '131016' end as lg_code from part")
def package_urls(spark, d):
    even = F.col("p_partkey") % 2 == 0
    url = F.when(even, "https://h.example/mt_town/pref/mt_town_pref13.csv.zip").otherwise("https://h.example/mt_town/city/mt_town_city131016.csv.zip")
    return _table(spark, d, "part").select("p_partkey", *registry.package_of_url(url))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'town' else 'parcel' end as dataset, lpad(cast(n_nationkey as varchar), 6, '0') as lg_code from nation")
def package_ids(spark, d):
    code = F.lpad(F.col("n_nationkey").cast("string"), 6, "0")
    number = F.when(F.col("n_nationkey") % 2 == 0, "000003").otherwise("000010")
    ids = F.concat(F.lit("ba-o1-"), code, F.lit("_g2-"), number)
    return _table(spark, d, "nation").select("n_nationkey", *registry.package_of_id(ids, {"000003": "town", "000010": "parcel"}))


def _registry(spark, d, path: str) -> None:
    """The derived gazetteer as registry files."""
    full = derived(spark, d, "city").join(derived(spark, d, "pref").select("pref_key", "pref"), "pref_key")
    files = {
        "pref_all": derived(spark, d, "pref").select("lg_code", "pref"),
        "pref_pos_all": derived(spark, d, "pref").select("lg_code", F.lit("35").alias("rep_lat"), F.lit("139").alias("rep_lon"), F.lit("EPSG:6668").alias("rep_srid")),
        "city_all": full.select("lg_code", "pref", "county", "city", "ward"),
        "city_pos_all": full.filter("rep_lat is not null").select("lg_code", "rep_lat", "rep_lon", F.lit("EPSG:4612").alias("rep_srid")),
    }
    town = derived(spark, d, "town").join(full.select("city_key", "lg_code", "pref", "county", "city", "ward"), "city_key")
    # A municipality's part ids are unique here, as in a registry.
    town = town.withColumn("machiaza_id", F.lpad(F.col("town_key").cast("string"), 7, "0"))
    files["town_all"] = town.select("lg_code", "machiaza_id", "pref", "county", "city", "ward", "oaza_cho", "chome", "koaza", "rsdt_addr_flg", "koaza_aka_code")
    files["town_pos_all"] = town.filter("rep_lat is not null").select("lg_code", "machiaza_id", "rep_lat", "rep_lon", F.lit("EPSG:6668").alias("rep_srid"), "rsdt_addr_flg")
    block = town.withColumn("blk_id", F.lpad((F.col("town_key") % 9 + 1).cast("string"), 3, "0")).withColumn("blk_num", (F.col("town_key") % 9 + 1).cast("string"))
    files["rsdtdsp_blk_pref01"] = block.select("lg_code", "machiaza_id", "blk_id", "blk_num")
    lot = town.withColumn("prc_id", T.parcel_id(F.col("town_key"), F.lit("2"), F.lit(None))).withColumn("prc_num1", F.col("town_key").cast("string"))
    files["parcel_city010000"] = lot.select("lg_code", "machiaza_id", "prc_id", "prc_num1", F.lit("2").alias("prc_num2"), F.lit(None).cast("string").alias("prc_num3"), F.lit("0").alias("rsdt_addr_flg"))
    for name, rows in files.items():
        rows.write.option("header", True).csv(f"{path}/mt_{name}.csv")


def _loaded(spark, d, codes=None):
    path = _folder(spark, "registry")
    _registry(spark, d, f"{path}/csv")
    return path, gazetteer.load(spark, f"{path}/csv", f"{path}/gazetteer", codes)


_TOWNS = "(select lpad(cast(t.town_key as varchar), 7, '0') as machiaza_id, c.lg_code, nullif(t.oaza_cho, '') as oaza_cho, t.rep_lat, t.town_key from town t join city c on c.city_key = t.city_key)"


@query(f"select lg_code, machiaza_id, oaza_cho, rep_lat from {_TOWNS} x")
def load_towns(spark, d):
    path, _ = _loaded(spark, d)
    return gazetteer.read(spark, f"{path}/gazetteer").town.select("lg_code", "machiaza_id", "oaza_cho", "rep_lat")


@query(f"select lg_code, machiaza_id, cast(town_key % 9 + 1 as varchar) as blk_num, town_key % 9 + 1 as blk from {_TOWNS} x where substr(lg_code, 1, 2) = '01' or lg_code = '020010'")
def load_blocks_of_some(spark, d):
    """A prefecture's blocks go to a folder for each municipality; only those asked for are loaded."""
    path, _ = _loaded(spark, d, ["01....", "020010"])
    blk = gazetteer.read(spark, f"{path}/gazetteer").rsdt_blk
    town = gazetteer.read(spark, f"{path}/gazetteer").town.select("town_key", "lg_code", "machiaza_id")
    return blk.drop("lg_code", "machiaza_id").join(town, "town_key").select("lg_code", "machiaza_id", "blk_num", F.col("blk_id").cast("long").alias("blk"))


@query(f"select lg_code, count(*) as n, min(machiaza_id) as least from {_TOWNS} x group by lg_code")
def load_lots_by_municipality(spark, d):
    """Lots in their folders, counted by folder."""
    path, _ = _loaded(spark, d)
    rows = spark.read.parquet(f"{path}/gazetteer/parcel").withColumn("at", F.regexp_extract(F.input_file_name(), "municipality=([0-9]+)", 1))
    return rows.groupBy(F.col("at").alias("lg_code")).agg(F.count("*").alias("n"), F.min("machiaza_id").alias("least"))


@query("select 'pref' as name, 'same' as changed, count(*) as n from pref union all select 'city', 'same', count(*) from city union all select 'town', 'same', count(*) from town union all select 'rsdt_blk', 'same', count(*) from town union all select 'parcel', 'same', count(*) from town")
def load_again(spark, d):
    """The same files a second time: nothing is new or updated."""
    path, _ = _loaded(spark, d)
    again = gazetteer.load(spark, f"{path}/csv", f"{path}/gazetteer")
    return spark.createDataFrame([(t, c, n) for t, by in again.items() for c, n in by.items()], "name string, changed string, n long")


@query("select 'pref' as name, true as there union all select 'nothing', false")
def table_exists(spark, d):
    path = _folder(spark, "exists")
    derived(spark, d, "pref").write.parquet(f"{path}/pref")
    return spark.createDataFrame([(t, U.has_rows(spark, f"{path}/{t}")) for t in ("pref", "nothing")], "name string, there boolean")


@query("select c.lg_code, count(*) as n from town t join city c on c.city_key = t.city_key group by c.lg_code")
def partition_route(spark, d):
    """Rows written to a folder for each municipality, and counted by folder."""
    path = _folder(spark, "routed")
    U.write_routed(_full(spark, d).select("lg_code", "town_key"), path)
    at = F.regexp_extract(F.input_file_name(), "municipality=([0-9]+)", 1)
    return spark.read.parquet(path).select(at.alias("lg_code"), "town_key").groupBy("lg_code").agg(F.count("*").alias("n"))


@query("select o_orderkey as k, case when o_orderkey % 3 = 0 then 'new' else 'old' end as etag from orders where o_orderkey % 5 <> 0")
def dataset_cache(spark, d):
    """Entries written over those of the same URL, some then taken out; stored and read again."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("https://h.example/x?k="), F.col("o_orderkey")).alias("url"))

    def entries(rows, tag):
        none = {"last_modified": "string", "content_length": "long", "crc32": "long", "status": "int"}
        return rows.select(T.url_key(F.col("url")).alias("url_key"), "url", F.lit(tag).alias("etag"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))

    path = _folder(spark, "cache")
    known = download.stored(entries(o, "old"), path)
    known = download.stored(download.cache_put(known, entries(o.filter("k % 3 = 0"), "new")), path)
    known = download.stored(download.cache_without(known, o.filter("k % 5 = 0")), path)
    return known.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("k"), "etag")


@query(f"select city || oaza_cho || chome || koaza as key, town_key from {_FULL} f where city like '%1' and pref = 'AMERICA' and koaza_aka_code <> 2")
def dict_ward_towns(spark, d):
    return D.ward_towns(_full(spark, d), "1", "AMERICA").select("key", "town_key")


@query("select c.city_key, p.pref from city c join pref p on p.pref_key = c.pref_key where p.pref = '東京都' and c.city like '%区' union all select 0, '東京都'")
def dict_tokyo_wards(spark, d):
    named = D.city_with_pref(derived(spark, d, "city"), derived(spark, d, "pref")).select("city_key", "city", "pref")
    more = spark.createDataFrame([(0, "千代田区", "東京都"), (1, "八王子市", "東京都"), (2, "北区", "京都府")], "city_key long, city string, pref string")
    return D.tokyo_wards(named.unionByName(more)).select("city_key", "pref")


@query(f"""select distinct town_key, key from (select town_key, case when koaza_aka_code = 2 and match_level = 4 then [koaza || oaza_cho] when match_level = 3 then [oaza_cho]
 when oaza_cho = '' and chome = '' then [koaza] when oaza_cho <> '' and chome = '' and koaza <> '' then [oaza_cho || koaza] when oaza_cho <> '' and chome <> '' and koaza = '' then [oaza_cho || chome]
 when oaza_cho <> '' and chome <> '' then [oaza_cho || chome, oaza_cho || chome || koaza] end as keys from {_FULL} f) x, unnest(keys) as u(key) where key <> ''""")
def dict_street_keys(spark, d):
    return D.street_keys(_full(spark, d)).select("town_key", "key").distinct()


@query("select row_number() over (order by town_key) as at, town_key as line_id from town")
def ordered_output(spark, d):
    """Where each line stands in the written JSON array, brackets not counted."""
    from pyspark.sql import Window

    rows = _results(spark, d).withColumn("output", F.col("line_id").cast("string"))
    path = _folder(spark, "ordered")
    sinks.write(rows.repartition(7), "json", path)
    # Files follow one another by name, and lines within a file.
    got = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    got = got.withColumn("at", (F.row_number().over(Window.orderBy("f", "i")) - 1).cast("long")).filter(~F.col("value").isin("[", "]"))
    return got.select("at", F.get_json_object(F.regexp_replace("value", ",$", ""), "$.result.output").cast("long").alias("line_id"))


@query("select count(*) as n, sum(s_suppkey) as total from supplier")
def progress_count(spark, d):
    """Rows counted as they pass to a file."""
    rows, seen = counted(_table(spark, d, "supplier").select("s_suppkey"))
    path = _folder(spark, "progress")
    rows.write.parquet(path)
    return spark.read.parquet(path).agg(F.lit(seen()).cast("long").alias("n"), F.sum("s_suppkey").alias("total"))


@query(f"""select city_key, machiaza_id, oaza_cho from (select city_key, substr(machiaza_id, 1, 4) || '000' as machiaza_id, oaza_cho, count(*) as n from {_FULL} f
 where oaza_cho <> '' and koaza_aka_code <> 2 group by all) x where not exists (select 1 from town t where t.city_key = x.city_key and t.machiaza_id = x.machiaza_id and t.oaza_cho <> '' and t.koaza_aka_code <> 2)""")
def dict_missing_parents(spark, d):
    full = _full(spark, d)
    return D.with_parents(full).filter("town_key is null").select("city_key", "machiaza_id", "oaza_cho")
