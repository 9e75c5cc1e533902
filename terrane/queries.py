"""Queries over the driver's tables, each with the SQL that must give the same rows.

The tables hold no addresses; a gazetteer is derived from them: regions are
prefectures, nations cities, parts towns, and order lines the address lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import dictionary as D
from terrane.operators import lookup as L
from terrane.operators import prefix_match as M
from terrane.operators import rank as R
from terrane.operators import upsert as U
from terrane.sources import lines as S
from terrane.sources import registry, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The derived gazetteer, in SQL that both engines read alike.
VIEWS = {
    "pref": "select cast(r_regionkey as bigint) as pref_key, r_name as pref, "
    "lpad(cast(r_regionkey + 1 as varchar(9)), 2, '0') || '0000' as lg_code from region",
    "city": "select cast(n_nationkey as bigint) as city_key, cast(n_regionkey as bigint) as pref_key, n_name as city, "
    "lpad(cast(n_regionkey + 1 as varchar(9)), 2, '0') || lpad(cast(n_nationkey as varchar(9)), 3, '0') || '0' as lg_code, "
    "case when n_nationkey % 5 = 0 then null else 30 + cast(n_nationkey as double) / 4 end as rep_lat, "
    "case when n_nationkey % 5 = 0 then null else 130 + cast(n_nationkey as double) / 8 end as rep_lon, "
    "case when n_nationkey % 3 = 0 then 'COUNTY_' || cast(n_regionkey as varchar(9)) end as county, "
    "case when n_nationkey % 4 = 0 then 'WARD' else '' end as ward from nation",
    "town": "select p_partkey as town_key, p_partkey % 25 as city_key, "
    "lpad(cast(p_partkey % 300 as varchar(9)), 4, '0') || lpad(cast(p_size % 4 as varchar(9)), 3, '0') as machiaza_id, "
    "case when p_partkey % 7 = 0 then '' else p_brand end as oaza_cho, "
    "case when p_partkey % 3 = 0 then '' else p_type end as chome, "
    "case when p_partkey % 2 = 0 then '' else p_name end as koaza, "
    "cast(p_size % 3 as int) as rsdt_addr_flg, case when p_partkey % 11 = 0 then 2 else 0 end as koaza_aka_code, "
    "case when p_partkey % 3 = 1 then null else 30 + cast(p_partkey as double) / 64 end as rep_lat, "
    "case when p_partkey % 3 = 1 then null else 130 + cast(p_partkey as double) / 64 end as rep_lon from part",
    "lines": "select l_orderkey * 10 + l_linenumber as line_id, l_orderkey, l_linenumber, r_name || n_name || p_brand || ' ' || "
    "cast(l_orderkey as varchar(19)) || '-' || cast(l_linenumber as varchar(9)) as address, p_partkey, p_brand from "
    "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by l_orderkey, l_linenumber) l "
    "join part on p_partkey = l_partkey join nation on n_nationkey = p_partkey % 25 join region on r_regionkey = n_regionkey",
    "suppliers": "select s_suppkey as line_id, n_name || cast(s_suppkey as varchar(19)) as address from supplier "
    "join nation on n_nationkey = s_nationkey",
}
_CTE = "with " + ", ".join(f"{k} as ({v})" for k, v in VIEWS.items())


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One derived table; the tables it is made of are read as views."""
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "part", "lineitem", "supplier") if t in sql}
    for t in frames:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **frames)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if sql.lstrip().startswith("with") else f"{_CTE} {sql}"
        return f

    return put


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _full(spark, d):
    return D.town_full(derived(spark, d, "town"), derived(spark, d, "city"), derived(spark, d, "pref"))


_FULL = """(select t.town_key, t.city_key, t.machiaza_id, t.oaza_cho, t.chome, t.koaza, t.rsdt_addr_flg, t.koaza_aka_code, c.lg_code, c.city, p.pref,
 case when substr(machiaza_id, 5, 3) = '000' then 3 else 4 end as match_level,
 case when t.rep_lat is null then 2 when substr(machiaza_id, 5, 3) = '000' then 3 else 4 end as coordinate_level,
 coalesce(t.rep_lat, c.rep_lat) as rep_lat, case when t.rep_lat is not null then t.rep_lon else c.rep_lon end as rep_lon
 from town t join city c on c.city_key = t.city_key join pref p on p.pref_key = c.pref_key)"""


@query("select city_key, city, lg_code from city where rep_lat is not null")
def scan_project_filter(spark, d):
    return derived(spark, d, "city").filter("rep_lat is not null").select("city_key", "city", "lg_code")


@query("select c.city_key, c.city, p.pref, c.lg_code from city c join pref p on p.pref_key = c.pref_key")
def dict_city_with_pref(spark, d):
    return D.city_with_pref(derived(spark, d, "city"), derived(spark, d, "pref")).select("city_key", "city", "pref", "lg_code")


@query(f"select town_key, lg_code, match_level, coordinate_level, rep_lat, rep_lon from {_FULL} f")
def dict_town_levels(spark, d):
    return _full(spark, d).select("town_key", "lg_code", "match_level", "coordinate_level", "rep_lat", "rep_lon")


_KIND = """case when oaza_cho <> '' and chome <> '' and koaza <> '' then 'oaza_chome_koaza' when oaza_cho <> '' and chome <> '' then 'oaza_chome'
 when oaza_cho <> '' and chome = '' and koaza = '' then 'oaza' when oaza_cho = '' and chome <> '' and koaza = '' then 'chome'
 when oaza_cho = '' and chome = '' and koaza <> '' then 'koaza' end"""


@query(f"select town_key, {_KIND} as kind from town")
def dict_town_kind(spark, d):
    return derived(spark, d, "town").select("town_key", D.town_kind().alias("kind"))


@query("select city_key, oaza_cho, chome, rsdt_addr_flg from town where chome <> '' group by all")
def dict_chome_distinct(spark, d):
    return D.distinct_chome(derived(spark, d, "town"))


@query(f"select city_key, substr(machiaza_id, 1, 4) || '000' as machiaza_id, oaza_cho, min(rep_lat) as rep_lat, count(*) as n from {_FULL} f where oaza_cho <> '' group by all")
def dict_oaza_parent(spark, d):
    return D.oaza_parents(_full(spark, d))


@query("""select city_key, machiaza_id, town_key, prec from (select *, row_number() over (partition by city_key, machiaza_id order by prec desc, town_key) as r from (
 select city_key, machiaza_id, town_key, 0 as prec from town where oaza_cho <> '' union all select city_key, machiaza_id, town_key, 1 from town where chome <> ''
 union all select city_key, machiaza_id, town_key, 2 from town where koaza <> '') u) x where r = 1""")
def dict_union_precedence(spark, d):
    t = derived(spark, d, "town").select("city_key", "machiaza_id", "town_key", "oaza_cho", "chome", "koaza")
    parts = [t.filter(D.has(c)).select("city_key", "machiaza_id", "town_key") for c in ("oaza_cho", "chome", "koaza")]
    return D.by_precedence(parts, ["city_key", "machiaza_id"], [F.col("town_key")])


@query(f"""select p.city_key, p.machiaza_id, coalesce(c.rsdt_addr_flg, -1) as rsdt_addr_flg, coalesce(c.own, p.rep_lat) as rep_lat from
 (select city_key, substr(machiaza_id, 1, 4) || '000' as machiaza_id, min(rep_lat) as rep_lat from {_FULL} f where oaza_cho <> '' group by all) p
 left join (select city_key, machiaza_id, rsdt_addr_flg, max(rep_lat) as own from town group by all) c on c.city_key = p.city_key and c.machiaza_id = p.machiaza_id""")
def dict_star_expand(spark, d):
    parents = D.oaza_parents(_full(spark, d)).groupBy("city_key", "machiaza_id").agg(F.min("rep_lat").alias("rep_lat"))
    return D.star_expanded(parents, derived(spark, d, "town"), ["city_key", "machiaza_id"])


@query(f"""select f.town_key, case when f.coordinate_level = 2 then coalesce(b.b.rep_lat, f.rep_lat) else f.rep_lat end as rep_lat,
 case when f.coordinate_level = 2 then coalesce(b.b.coordinate_level, 2) else f.coordinate_level end as coordinate_level from {_FULL} f left join (
 select city_key, substr(machiaza_id, 1, 4) as stem, arg_max(struct_pack(rep_lat := rep_lat, coordinate_level := coordinate_level), coordinate_level * 10000000000 - town_key) as b
 from {_FULL} g where coordinate_level > 2 group by all) b on b.city_key = f.city_key and b.stem = substr(f.machiaza_id, 1, 4)""")
def dict_coord_inherit(spark, d):
    return D.inherited(_full(spark, d)).select("town_key", "rep_lat", "coordinate_level")


@query("select distinct city_key, key from (select city_key, city || ward as key from city where city not like '%区' union all select city_key, ward from city where city not like '%区') x where key <> ''")
def dict_key_variants(spark, d):
    return D.city_ward_keys(derived(spark, d, "city")).select("city_key", "key")


@query("select city_key, county || city as key from city where county is not null and county <> ''")
def dict_county_city(spark, d):
    return D.county_city_keys(derived(spark, d, "city")).select("city_key", "key")


@query(f"select town_key, city || oaza_cho || chome || koaza as key from {_FULL} f where city like '%_1' escape '#' and koaza_aka_code <> 2 and city like '%1'")
def dict_ward_suffix(spark, d):
    return D.ward_towns(_full(spark, d), "1").select("town_key", "key")


@query("select c.city_key, p.pref, c.ward as key from city c join pref p on p.pref_key = c.pref_key where c.ward <> ''")
def dict_wards(spark, d):
    return D.wards(derived(spark, d, "city"), derived(spark, d, "pref")).select("city_key", "pref", "key")


@query(f"""select machiaza_id, city_key, town_key from (select *, row_number() over (partition by city_key, machiaza_id, match_level order by town_key desc) as r
 from {_FULL} f where lg_code like '01%' and oaza_cho <> '' and rep_lat is not null) x where r = 1""")
def dict_street_rows(spark, d):
    return D.kyoto_streets(_full(spark, d), "01").select("machiaza_id", "city_key", "town_key")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) x where r = 1""")
def replace_into_temp(spark, d):
    o = _table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return U.last_of(o, ["o_custkey"], F.col("o_orderkey"))


def _cities(spark, d):
    return derived(spark, d, "city").select(F.col("city").alias("key"), "city_key", "pref_key")


def _suppliers(spark, d):
    return derived(spark, d, "suppliers")


_HITS = "(select line_id, address, city_key, city, length(city) as depth, substr(address, length(city) + 1) as unmatched from suppliers join city on starts_with(address, city))"


@query(f"select line_id, city_key, depth, unmatched from {_HITS} h")
def prefix_match_all(spark, d):
    return M.prefix_match(_suppliers(spark, d), _cities(spark, d), "address").select("line_id", "city_key", "depth", "unmatched")


@query(f"select line_id, arg_max(city_key, depth) as city_key, max(depth) as depth from {_HITS} h group by line_id")
def prefix_match_longest(spark, d):
    return M.prefix_match(_suppliers(spark, d), _cities(spark, d), "address", mode="longest").select("line_id", "city_key", "depth")


@query(f"select line_id, city_key from {_HITS} h where depth = length(address) or not exists (select 1 from city c where c.city <> h.city and starts_with(c.city, h.city))")
def prefix_match_leaf(spark, d):
    return M.prefix_match(_suppliers(spark, d), _cities(spark, d), "address", mode="leaf").select("line_id", "city_key")


@query("""select line_id, city_key from (select line_id, replace(address, 'TION', 'T?ON') as a from suppliers) s join city
 on length(city) <= length(a) and city like replace(replace(substr(a, 1, length(city)), '_', '#_'), '?', '_') escape '#'""")
def prefix_match_fuzzy(spark, d):
    c = _suppliers(spark, d).withColumn("address", F.replace("address", F.lit("TION"), F.lit("T?ON")))
    return M.fuzzy_match(c, _cities(spark, d), "address").select("line_id", "city_key")


@query("""select line_id, city_key, amb from (select line_id, replace(address, '_', '') as a from suppliers) s join (select city as key, city_key, 0 as amb from city union all
 select replace(city, '_', ''), city_key, 1 from city) c on starts_with(a, key)""")
def prefix_match_challenge(spark, d):
    c = _suppliers(spark, d).withColumn("address", F.replace("address", F.lit("_"), F.lit("")))
    return M.prefix_match(c, M.missing_words(_cities(spark, d), ["_"]), "address").select("line_id", "city_key", "amb")


@query(f"select line_id, pref_key, max(depth) as depth from (select h.*, c.pref_key from {_HITS} h join city c on c.city_key = h.city_key) x group by all")
def match_best_per_info(spark, d):
    hits = M.prefix_match(_suppliers(spark, d), _cities(spark, d), "address")
    return M.best_per_info(hits, "line_id", "pref_key", F.col("depth")).select("line_id", "pref_key", "depth")


@query(f"select line_id, city_key from {_HITS} h where not (regexp_matches(city, '[0-9]$') and regexp_matches(unmatched, '^[0-9]'))")
def digit_boundary_filter(spark, d):
    return M.digit_boundary(M.prefix_match(_suppliers(spark, d), _cities(spark, d), "address")).select("line_id", "city_key")


def _hierarchy(spark, d):
    """Address lines through prefecture, city and town names, longest first."""
    lines = derived(spark, d, "lines").select("line_id", "address")
    pref = derived(spark, d, "pref").select(F.col("pref").alias("key"), "pref_key")
    c = M.prefix_match(lines, pref, "address", mode="longest").select("line_id", "address", "pref_key", F.col("unmatched").alias("rest"))
    city = derived(spark, d, "city").select(F.col("city").alias("key"), "city_key", F.col("pref_key").alias("_p"))
    c = M.digit_boundary(M.prefix_match(c, city, "rest")).filter("pref_key = _p")
    return c.select("line_id", "address", "pref_key", "city_key", F.col("unmatched").alias("rest"))


_HIER = """(select line_id, address, p.pref_key, c.city_key, substr(address, length(pref) + length(city) + 1) as rest from lines join pref p on starts_with(address, p.pref)
 join city c on c.pref_key = p.pref_key and starts_with(substr(address, length(pref) + 1), city)
 where not regexp_matches(substr(address, length(pref) + length(city) + 1), '^[0-9]'))"""


@query(f"select line_id, pref_key, city_key, rest from {_HIER} h")
def hier_pref_city(spark, d):
    return _hierarchy(spark, d).select("line_id", "pref_key", "city_key", "rest")


_KEEP = "select line_id, city_key from {h} h where city_key % 2 = 0 union all select line_id, null from suppliers s where not exists (select 1 from {h} h where h.line_id = s.line_id and h.city_key % 2 = 0)"


@query(_KEEP.format(h=_HITS))
def keep_original_on_miss(spark, d):
    c = _suppliers(spark, d)
    hits = M.prefix_match(c, _cities(spark, d).filter("city_key % 2 = 0"), "address")
    return M.keep_original(c, hits, "line_id").select("line_id", "city_key")


@query(f"select pref_key, rest, line_id, city_key from (select *, row_number() over (partition by pref_key, rest order by line_id, city_key) as r from {_HIER} h) x where r = 1")
def candidate_dedupe(spark, d):
    return M.first_wins(_hierarchy(spark, d), ["pref_key", "rest"], [F.col("line_id"), F.col("city_key")]).select("pref_key", "rest", "line_id", "city_key")


@query("select line_id, s_suppkey as blk_id, s_nationkey as blk_nation from (select line_id, regexp_extract(address, ' ([0-9]+)', 1) as n from lines) l join supplier on cast(s_suppkey as varchar) = n")
def block_lookup(spark, d):
    blk = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("blk_num"), F.col("s_suppkey").alias("blk_id"), F.col("s_nationkey").alias("blk_nation"), F.lit(1).alias("town"))
    c = derived(spark, d, "lines").select("line_id", F.lit(1).alias("town"), L.leading_number(F.regexp_replace("address", "^.* ", "")).alias("n"))
    return L.by_number(c, blk, ["town"], "blk_num", "n").select("line_id", "blk_id", "blk_nation")


@query("select line_id, c_custkey as rsdt_id, try_cast(c_custkey as int) as rsdt_num from (select line_id, regexp_extract(address, ' ([0-9]+)', 1) as n from lines) l join customer on cast(c_custkey as varchar) = n")
def residence_lookup(spark, d):
    dsp = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("num"), F.col("c_custkey").alias("rsdt_id"), F.lit(1).alias("blk"))
    c = derived(spark, d, "lines").select("line_id", F.lit(1).alias("blk"), L.leading_number(F.regexp_replace("address", "^.* ", "")).alias("n"))
    return L.by_number(c, dsp, ["blk"], "num", "n").select("line_id", "rsdt_id", F.col("rsdt_id").try_cast("int").alias("rsdt_num"))


_LOT = "lpad(cast({o} as varchar(19)), 7, '0') || lpad(cast({n} as varchar(19)), 7, '0') || '0000000'"
_PARCELS = f"(select l_partkey % 25 as city, {_LOT.format(o='l_orderkey', n='l_linenumber')} as prc_id, case when l_linenumber % 2 = 0 then null else l_quantity end as rep_lat, l_extendedprice as rep_lon from (select distinct on (l_orderkey, l_linenumber, l_partkey % 25) * from lineitem order by l_orderkey, l_linenumber, l_partkey % 25, l_partkey, l_quantity, l_extendedprice) z)"


def _parcels(spark, d):
    li = M.first_wins(
        _table(spark, d, "lineitem").withColumn("city", F.col("l_partkey") % 25),
        ["l_orderkey", "l_linenumber", "city"], [F.col(c) for c in ("l_partkey", "l_quantity", "l_extendedprice")],
    )
    lat = F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity"))
    return li.select("city", T.parcel_id(F.col("l_orderkey"), F.col("l_linenumber"), F.lit(0), 7).alias("prc_id"), lat.alias("rep_lat"), F.col("l_extendedprice").alias("rep_lon"))


@query(f"select line_id, prc_id from (select line_id, o_custkey % 25 as city, {_LOT.replace('0000000', '_______').format(o='o_orderkey', n='1').replace(chr(39) + '_______' + chr(39), chr(39) + '_______' + chr(39))} as p from (select o_orderkey as line_id, o_orderkey, o_custkey from orders) o) q join {_PARCELS} z on z.city = q.city and z.prc_id like p")
def parcel_lookup_like(spark, d):
    o = _table(spark, d, "orders")
    c = o.select(F.col("o_orderkey").alias("line_id"), (F.col("o_custkey") % 25).alias("city"), F.concat(T.left_padded(F.col("o_orderkey"), 7), T.left_padded(F.lit(1), 7), F.lit("???????")).alias("n"))
    return L.by_number(c, _parcels(spark, d), ["city"], "prc_id", "n").select("line_id", F.col("n").alias("prc_id"))


@query(f"""select line_id, prc_id, rep_lat from (select line_id, first(prc_id order by n desc, prc_id) as prc_id, first(rep_lat order by n desc, prc_id) filter (rep_lat is not null) as rep_lat from (
 select line_id, n, z.prc_id, z.rep_lat from (select line_id, p_partkey % 25 as city, 2 as n, {_LOT.format(o='l_orderkey', n='l_linenumber')} as id from lines union all
 select line_id, p_partkey % 25, 1, {_LOT.format(o='l_orderkey', n='0')} from lines) q join {_PARCELS} z on z.city = q.city and z.prc_id = q.id) h group by line_id) x""")
def parcel_longest_first_coord(spark, d):
    c = derived(spark, d, "lines").select("line_id", (F.col("p_partkey") % 25).alias("city"), F.regexp_replace("address", "^.* ", "").alias("rest"))
    return L.parcels(c, _parcels(spark, d), ["city"], "rest", width=7).select("line_id", "prc_id", "rep_lat").distinct()


@query("select city_key, lg_code from city where substr(lg_code, 1, 2) = '02' or lg_code in ('010000', '030020')")
def lg_filter_semi(spark, d):
    wanted = spark.createDataFrame([("02....",), ("010000",), ("030020",)], "lg_code string")
    city = derived(spark, d, "city").select("city_key", "lg_code")
    return U.lg_filter(city, U.lg_targets(wanted, city.select("lg_code")))


@query("select coalesce(a.k, b.k) as k, a.status, b.rep_lat from (select o_orderkey as k, o_orderstatus as status from orders where o_orderkey % 3 <> 0) a full join (select o_orderkey as k, o_totalprice as rep_lat from orders where o_orderkey % 4 <> 0) b on a.k = b.k")
def upsert_attrs_pos(spark, d):
    o = _table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    return U.attrs_with_pos(o.filter("k % 3 <> 0").select("k", F.col("o_orderstatus").alias("status")), o.filter("k % 4 <> 0").select("k", F.col("o_totalprice").alias("rep_lat")), ["k"])


_OLD = "(select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 5 <> 0)"
_NEW = "(select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 3 <> 0)"


def _snapshots(spark, d):
    o = _table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    new = F.when(F.col("k") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return o.filter("k % 5 <> 0").select("k", F.col("o_totalprice").alias("v")), o.filter("k % 3 <> 0").select("k", new.alias("v"))


@query(f"select coalesce(o.k, n.k) as k, case when n.k is not null and n.v is distinct from o.v then n.v else o.v end as v, case when o.k is null then 'new' when n.k is not null and n.v is distinct from o.v then 'updated' else 'same' end as changed from {_OLD} o full join {_NEW} n on n.k = o.k")
def upsert_changed_only(spark, d):
    return U.upserted(*_snapshots(spark, d), ["k"], ["v"])


@query(f"select n.k, n.v from {_NEW} n where not exists (select 1 from {_OLD} o where o.k = n.k and o.v = n.v)")
def changed_packages(spark, d):
    old, new = _snapshots(spark, d)
    return U.changed_packages(new, old, "k", "v")


# Several candidates a line: all towns of a city, ranked by the points of 2.8, for each of the three targets.
_POINTS = """case target when 'all' then list_extract([-2.0, 1, 2, 3, 4, 5, 6, 4.5]::double[], {l} + 1) when 'residential' then list_extract([-2.0, 1, 2, 3, 4, 5, 6, -1]::double[], {l} + 1)
 else list_extract([-2.0, 1, 2, 3, 4, -1, -1, 6]::double[], {l} + 1) end"""
_CANDS = f"""(select *, lp + cp - 2 * abs(lp - cp) + matched_cnt - unmatched_n - ambiguous_cnt + similarity + case when original_flg = 1 and rsdt_addr_flg = 1 or original_flg in (0, 2) and rsdt_addr_flg = 0 then 1 else 0 end as points,
 similarity >= 0.5 or matched_cnt / 40.0 >= 0.3 or match_level >= 2 as confident from (select *, {_POINTS.format(l='match_level')} as lp, {_POINTS.format(l='coordinate_level')} as cp from
 (select o_custkey as line_id, o_orderkey as seq, list_extract(['all', 'residential', 'parcel'], cast(o_custkey % 3 as int) + 1) as target, cast(o_orderkey % 8 as int) as match_level, cast(o_orderkey // 8 % 8 as int) as coordinate_level,
 cast(o_orderkey % 23 as int) as matched_cnt, cast(o_orderkey % 5 as int) as unmatched_n, cast(o_orderkey % 2 as int) as ambiguous_cnt, cast(o_orderkey % 101 as double) / 100 as similarity,
 case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 4 as int) - 1 end as original_flg, case o_orderkey % 3 when 0 then 0 when 1 then 1 end as rsdt_addr_flg from orders) c) d)"""


def _candidates(spark, d):
    k, target = F.col("o_orderkey"), F.array(*map(F.lit, ("all", "residential", "parcel")))
    c = _table(spark, d, "orders").select(
        F.col("o_custkey").alias("line_id"), k.alias("seq"), F.element_at(target, (F.col("o_custkey") % 3 + 1).cast("int")).alias("target"),
        (k % 8).cast("int").alias("match_level"), F.expr("cast(o_orderkey div 8 % 8 as int)").alias("coordinate_level"), (k % 23).cast("int").alias("matched_cnt"),
        F.repeat(F.lit("x"), (k % 5).cast("int")).alias("unmatched"), (k % 2).cast("int").alias("ambiguous_cnt"), ((k % 101).cast("double") / 100).alias("similarity"),
        F.when(k % 4 != 0, (k % 4).cast("int") - 1).alias("original_flg"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).alias("rsdt_addr_flg"), F.lit("y" * 40).alias("input"), F.lit(0).alias("koaza_aka_code"),
    )
    return c.withColumn("score", R.score()).withColumn("confident", R.confident())


@query(f"select seq, points, confident from {_CANDS} x")
def candidate_score(spark, d):
    return _candidates(spark, d).select("seq", F.col("score").alias("points"), "confident")


@query(f"select line_id, seq, points from (select *, row_number() over (partition by line_id order by confident desc, points desc, matched_cnt desc, seq) as r from {_CANDS} x) y where r = 1")
def rank_top1(spark, d):
    return R.top(_candidates(spark, d)).select("line_id", "seq", F.col("score").alias("points"))


@query(f"""select line_id, seq, points from (select *, min(r) filter (rsdt_addr_flg = 1 and counts) over w as r1, min(r) filter (rsdt_addr_flg = 0 and counts) over w as r0, arg_min(points, r) filter (rsdt_addr_flg = 1 and counts) over w as p1,
 arg_min(points, r) filter (rsdt_addr_flg = 0 and counts) over w as p0, bool_or(rsdt_addr_flg = 1 and counts and original_flg = 1 and match_level >= 3 and r = first1) over w as marked from
 (select *, min(r) filter (rsdt_addr_flg = 1 and counts) over (partition by line_id) as first1 from (select *, confident or not bool_or(confident) over (partition by line_id) as counts,
 row_number() over (partition by line_id order by confident desc, points desc, matched_cnt desc, seq) as r from {_CANDS} x) y) z window w as (partition by line_id)) v
 where r = case when r1 is null then coalesce(r0, 1) when r0 is null then r1 when target = 'residential' then r1 when target = 'parcel' then r0 when p1 >= p0 or (p0 - p1 <= 2 and coalesce(marked, false)) then r1 else r0 end""")
def top_per_flag_arbitration(spark, d):
    return R.chosen(_candidates(spark, d)).select("line_id", "seq", F.col("score").alias("points"))


@query("""select p_partkey, case p_partkey % 3 when 0 then list_extract([-2.0, 1, 2, 3, 4, 5, 6, 4.5]::double[], p_size % 8 + 1) when 1 then list_extract([-2.0, 1, 2, 3, 4, 5, 6, -1]::double[], p_size % 8 + 1)
 else list_extract([-2.0, 1, 2, 3, 4, -1, -1, 6]::double[], p_size % 8 + 1) end as points from part""")
def level_score(spark, d):
    target = F.element_at(F.array(*map(F.lit, ("all", "residential", "parcel"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", R.level_points(target, F.col("p_size") % 8).alias("points"))


_WIDE = "translate(address, '0123456789', '０１２３４５６７８９')"


@query(f"select line_id, translate({_WIDE}, '０１２３４５６７８９', '0123456789') as address from lines")
def hankaku(spark, d):
    wide = F.translate("address", "0123456789", "０１２３４５６７８９")
    return derived(spark, d, "lines").select("line_id", T.hankaku(wide).alias("address"))


@query("select line_id, regexp_replace(regexp_replace(regexp_replace(a, '^[@␣]+|[@␣]+$', '', 'g'), '@+', '@', 'g'), '␣+', '␣', 'g') as address from (select line_id, '@␣' || replace(replace(address, '-', '@@'), ' ', '␣␣') || '@' as a from lines) x")
def trim_sentinels(spark, d):
    a = F.concat(F.lit("@␣"), F.replace(F.replace("address", F.lit("-"), F.lit("@@")), F.lit(" "), F.lit("␣␣")), F.lit("@"))
    return derived(spark, d, "lines").select("line_id", T.trim_sentinels(a).alias("address"))


@query("select line_id, regexp_replace(regexp_replace(replace(address, '-', '－'), '([0-9])－', '\\1@', 'g'), '－([0-9])', '@\\1', 'g') as address from lines")
def dash_unify(spark, d):
    return derived(spark, d, "lines").select("line_id", T.dash_unify(F.replace("address", F.lit("-"), F.lit("－"))).alias("address"))


@query("select p_partkey, cast(100 - floor(100.0::double * levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand))) as double) / 100.0 as ratio from part")
def levenshtein_ratio(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.levenshtein_ratio(F.col("p_name"), F.col("p_brand")).alias("ratio"))


@query(f"select town_key, pref || city || case when koaza_aka_code = 2 then koaza || oaza_cho else oaza_cho || chome || koaza end || cast(town_key as varchar) || '-7' as line from {_FULL} f")
def format_address(spark, d):
    n = F.lit(None).cast("string")
    f = T.format_address(F.col("pref"), n, F.col("city"), n, F.col("oaza_cho"), F.col("chome"), F.col("koaza"), F.col("koaza_aka_code"), n, n, n, F.col("town_key"), F.lit("7"), n, n)
    return _full(spark, d).select("town_key", F.replace(f, F.lit(" "), F.lit(" ")).alias("line"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'town' when 1 then 'rsdtdsp_blk' else 'parcel' end as kind, case p_partkey % 3 when 0 then '000000' when 1 then lpad(cast(p_size as varchar), 2, '0') || '....' else lpad(cast(p_size as varchar), 6, '1') end as lg_code from part")
def filename_meta(spark, d):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, "mt_town_all.csv").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("mt_rsdtdsp_blk_pref"), F.lpad(size, 2, "0"), F.lit(".csv"))).otherwise(F.concat(F.lit("mt_parcel_city"), F.lpad(size, 6, "1"), F.lit(".csv")))
    return _table(spark, d, "part").select("p_partkey", *registry.filename_meta(name))


@query("select o_custkey as lg_code, count(distinct o_orderstatus) as n, arg_max(o_orderkey, o_orderkey) filter (o_orderstatus = 'F') as f from orders group by o_custkey")
def package_tree(spark, d):
    p = _table(spark, d, "orders").select(F.col("o_custkey").alias("lg_code"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("url"))
    return registry.package_tree(p, "url").select("lg_code", F.size("urls").cast("long").alias("n"), F.try_element_at("urls", F.lit("F")).alias("f"))


@query("select doc_id, count(*) as n from (select doc_id, unnest(string_split(replace(text, '%', '/*x*/'), chr(10))) as l from documents) x where trim(regexp_replace(l, '/\\*.*?\\*/', '', 'g')) <> '' and not starts_with(trim(regexp_replace(l, '/\\*.*?\\*/', '', 'g')), '#') group by doc_id")
def comment_filter(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("%"), F.lit("/*x*/")), "\n")).alias("l"))
    return rows.filter(S.comment_filtered(F.col("l")).isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select n_nationkey, list_reduce(list_prepend(5381::bigint, list_transform(range(length(n_name)::bigint), lambda i: ord(reverse(n_name)[i + 1])::bigint)), lambda a, x: xor((a * 33) & 4294967295, x)) as key from nation")
def hash_key(spark, d):
    return _table(spark, d, "nation").select("n_nationkey", T.hash_key(F.col("n_name")).alias("key"))


@query()
def crc_fingerprint(spark, d):
    return U.with_crc(_table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_partkey", "p_name", "p_brand"])


def _results(spark, d):
    return _full(spark, d).select(
        F.col("town_key").alias("line_id"), F.concat("pref", "city", "oaza_cho").alias("input"), F.concat("pref", "city").alias("output"),
        F.lit(0.5).alias("score"), "match_level", "coordinate_level", F.col("rep_lat").alias("lat"), F.col("rep_lon").alias("lon"), "lg_code", "pref", "city",
    )


_LEVEL = "case {l} when 0 then 'unknown' when 1 then 'prefecture' when 2 then 'city' when 3 then 'machiaza' when 4 then 'machiaza_detail' end"
_NAMES = f"{_LEVEL.format(l='match_level')} as m, {_LEVEL.format(l='coordinate_level')} as c, regexp_replace(cast(rep_lat as varchar), '\\.0$', '') as la, regexp_replace(cast(rep_lon as varchar), '\\.0$', '') as lo"


@query(f"""select town_key as line_id, '"' || pref || city || oaza_cho || '","' || pref || city || '",0.5,' || m as value from (select *, {_NAMES} from {_FULL} f) x""")
def simplified_line(spark, d):
    return sinks.formatted(_results(spark, d), "simplified")


@query(f"""select town_key as line_id, '"' || pref || city || oaza_cho || '","' || pref || city || '",0.5,' || m || ',' || c || ',' || coalesce(la, '') || ',' || coalesce(lo, '') || ',,"' || lg_code || '","",,,,,,' || pref || ',,' || city || repeat(',', 10) as value
 from (select *, {_NAMES} from {_FULL} f) x""")
def csv_line(spark, d):
    return sinks.formatted(_results(spark, d), "csv")


def _json_sql(head: str, tail: str) -> str:
    none = "".join(f',"{c}":null' for c in ("county", "city", "ward", "oaza_cho", "chome", "koaza", "blk_num", "rsdt_num", "rsdt_num2", "prc_num1", "prc_num2", "prc_num3"))
    after = none.replace(',"city":null', ",\"city\":\"' || city || '\"")
    at = "case when rep_lat is null or rep_lon is null then 'null' else cast({v} as varchar) end"
    return f"""select town_key as line_id, '{head}"output":"' || pref || city || '","others":[],"score":0.5,"match_level":"' || m || '","coordinate_level":"' || c || '","lat":' || {at.format(v='rep_lat')} || ',"lon":' || {at.format(v='rep_lon')}
 || ',"lg_code":"' || lg_code || '","machiaza_id":null,"blk_id":null,"rsdt_id":null,"rsdt2_id":null,"prc_id":null,"pref":"' || pref || '"{after}{tail}' as value from (select *, {_NAMES} from {_FULL} f) x"""


@query(_json_sql("""{"query":{"input":"' || pref || city || oaza_cho || '"},"result":{""", "}}"))
def ndjson_line(spark, d):
    return sinks.formatted(_results(spark, d), "ndjson")


@query(_json_sql("""{"type":"Feature","geometry":{"type":"Point","coordinates":[' || case when rep_lat is null or rep_lon is null then 'null,null' else cast(rep_lon as varchar) || ',' || cast(rep_lat as varchar) end || ']},"properties":{"input":"' || pref || city || oaza_cho || '",""", "}}"))
def geojson_feature(spark, d):
    return sinks.formatted(_results(spark, d), "ndgeojson")


@query("select p_partkey, '東京都千代田区' || cast(p_partkey as varchar) || '@' || cast(20 + p_size as varchar) || '␣け' as text from part")
def japanese_normalise(spark, d):
    wide = F.concat(F.lit("東京都千代田区"), F.col("p_partkey").cast("string"), F.lit("丁目二十"), F.col("p_size").cast("string"), F.lit("番地 ガ"))
    return _table(spark, d, "part").select("p_partkey", T.python_text(T.normalise)(wide).alias("text"))


def _places(spark, d):
    pref = derived(spark, d, "pref").withColumn("rep_lat", F.lit(None).cast("double")).withColumn("rep_lon", F.lit(None).cast("double"))
    return pref, derived(spark, d, "city").withColumn("ward", F.lit(None).cast("string")).withColumn("county", F.lit(None).cast("string"))


@query()
def geocode_lines(spark, d):
    """The geocoder over order lines and the derived gazetteer, in which many towns have one name."""
    from terrane.plans.geocode import Gazetteer, geocode

    lines = derived(spark, d, "lines").select("line_id", "address")
    out = geocode(lines, Gazetteer(*_places(spark, d), derived(spark, d, "town")), japanese=False)
    return out.select("line_id", "output", "score", "match_level", "coordinate_level", "city_key", "town_key", "lat", "lon")


@query("select l.line_id, c.pref_key, c.city_key, c.lg_code from lines l join city c on c.city_key = l.p_partkey % 25")
def geocode_cities(spark, d):
    """Prefecture and city of each line: names that begin other names, numbers that go on."""
    from terrane.plans.geocode import Gazetteer, geocode

    return geocode(derived(spark, d, "lines").select("line_id", "address"), Gazetteer(*_places(spark, d)), japanese=False).select("line_id", "pref_key", "city_key", "lg_code")


_NUMBERED = "(select s_suppkey as line_id, s_suppkey % 12 + 1 as a, s_suppkey % 7 + 1 as b, s_suppkey % 3 as t, n_nationkey as city_key, n_regionkey as pref_key from supplier join nation on n_nationkey = s_nationkey)"


@query(f"""select line_id, case when t = 1 and a >= 10 then 3 when t = 2 and a <= 9 then 3 when a >= 10 then 7 when b <= 5 then 6 else 5 end as match_level,
 case when t = 2 or a >= 10 then null else cast(a as varchar) end as blk_num, case when t = 2 or a >= 10 or b > 5 then null else cast(b as varchar) end as rsdt_num,
 case when t = 1 or a <= 9 then null else cast(a as varchar) end as prc_num1, case when t = 1 and a >= 10 or t = 2 and a <= 9 then 25.0 when a >= 10 then 40 + a when b <= 5 and b % 2 = 1 then 31 + cast(b as double) / 8 else 30 + cast(a as double) / 4 end as lat
 from {_NUMBERED} x""")
def geocode_numbers(spark, d):
    """Blocks, residences and lots of a town in each city, under each target; a residence without a place has its block's."""
    from terrane.plans.geocode import Gazetteer, geocode

    pref, city = _places(spark, d)
    key = F.col("s_suppkey")
    s = _table(spark, d, "supplier").join(_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(_table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    lines = s.select(
        key.alias("line_id"), F.concat("r_name", "n_name", F.lit("TOWN "), key % 12 + 1, F.lit("-"), key % 7 + 1).alias("address"),
        F.element_at(F.array(*map(F.lit, ("all", "residential", "parcel"))), (key % 3 + 1).cast("int")).alias("target"),
    )
    town = city.select((F.col("city_key") + 1000).alias("town_key"), "city_key", F.lit("0001000").alias("machiaza_id"), F.lit("TOWN").alias("oaza_cho"), F.lit(1).alias("rsdt_addr_flg"), F.lit(25.0).alias("rep_lat"), F.lit(135.0).alias("rep_lon"))
    numbers = town.select("town_key", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("a"))
    text = lambda c: F.col(c).cast("string")
    at = {"rep_lon": F.lit(135.0)}
    blk = numbers.filter("a <= 9").select("town_key", F.lpad(text("a"), 3, "0").alias("blk_id"), text("a").alias("blk_num"), (30 + F.col("a") / 4).alias("rep_lat")).withColumns(at)
    both = numbers.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(7))))
    dsp = both.filter("a <= 9 and b <= 5").select("town_key", F.lpad(text("a"), 3, "0").alias("blk_id"), F.lpad(text("b"), 3, "0").alias("rsdt_id"), text("b").alias("rsdt_num"), F.when(F.col("b") % 2 == 1, 31 + F.col("b") / 8).alias("rep_lat")).withColumns(at)
    lots = both.filter("a > 9").select("town_key", T.parcel_id(F.col("a"), F.col("b"), F.lit(0)).alias("prc_id"), text("a").alias("prc_num1"), text("b").alias("prc_num2"), (40.0 + F.col("a")).alias("rep_lat")).withColumns(at)
    out = geocode(lines, Gazetteer(pref, city, town, blk, dsp, lots), japanese=False)
    return out.select("line_id", "match_level", "blk_num", "rsdt_num", "prc_num1", "lat")


from terrane import queries_io, queries_text  # noqa: E402, F401  they register more queries
