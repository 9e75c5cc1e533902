"""Geocoding as a chain of candidate expansions.

A line starts as one candidate. Each stage matches the rest of the text with a
dictionary, adds a candidate for each hit and keeps the original where nothing,
or nothing certain, was hit. At the end the candidates of a line are scored and
the best one is returned.

Gazetteer tables (all optional but pref and city): pref(pref_key, pref, lg_code,
rep_lat, rep_lon), city(city_key, pref_key, lg_code, county, city, ward, rep_lat,
rep_lon), town(town_key, city_key, machiaza_id, oaza_cho, chome, koaza,
rsdt_addr_flg, koaza_aka_code, rep_lat, rep_lon), rsdt_blk(town_key, blk_id,
blk_num, ...), rsdt_dsp(town_key, blk_id, rsdt_id, rsdt2_id, rsdt_num, rsdt_num2,
...), parcel(town_key, prc_id, prc_num1..3, ...).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import written as W
from terrane.functions.constants import DASH, FUZZY, MISSING_WORDS, OAZA_BANCHO, SPACE, VARIANTS
from terrane.functions.text import format_address, python_text
from terrane.operators import dictionary as D
from terrane.operators import lookup as L
from terrane.operators import rank as R
from terrane.operators.prefix_match import BROADCAST_KEYS, first_wins, fuzzy_match, key_lengths, missing_words, sized
from terrane.operators.storage import settled

TARGETS = ("all", "residential", "parcel")

#: Columns of a candidate that stages fill in, with their types.
FIELDS = {
    "pref_key": "long", "city_key": "long", "town_key": "long", "lg_code": "string", "pref": "string", "county": "string",
    "city": "string", "ward": "string", "machiaza_id": "string", "oaza_cho": "string", "chome": "string", "koaza": "string",
    "koaza_aka_code": "int", "rsdt_addr_flg": "int", "original_flg": "int", "blk_id": "string", "blk_num": "string",
    "rsdt_id": "string", "rsdt2_id": "string", "rsdt_num": "string", "rsdt_num2": "string", "prc_id": "string",
    "prc_num1": "string", "prc_num2": "string", "prc_num3": "string", "rep_lat": "double", "rep_lon": "double",
    "rsdtblk_key": "long", "rsdtdsp_key": "long", "parcel_key": "long", "unused": "string",
}
_PLACE = {"rep_lat": "double", "rep_lon": "double"}
# Fields of numbers, which rows don't carry before there are numbers to look up.
_NUMBERS = ("blk_id", "blk_num", "rsdt_id", "rsdt2_id", "rsdt_num", "rsdt_num2", "prc_id", "prc_num1", "prc_num2", "prc_num3", "rsdtblk_key", "rsdtdsp_key", "parcel_key")
#: Lines in a task: few enough that the sorts of their candidates stay in memory, as what they spill is many times the lines.
LINES_A_TASK = 20_000
#: Lines from which on beginnings are matched in their place, where there are so many times as many lines.
SHARED_LINES, SHARED_BY = 10_000, 4
# A line's last number behind a blank, in which lines of one beginning differ; the same where nothing has to stand before it.
NUMBER, NUMBER_LEFT = rf"([{SPACE} ])([0-9][-0-9{DASH}]*)\z", rf"(?:^|[{SPACE} ])[0-9][-0-9{DASH}]*\z"
# Wards of Tokyo whose names other prefectures have too.
SHARED_WARDS = ("北区", "中央区", "港区", "大田区", "板橋区")
# Words that say on which side of a street of Kyoto a place lies, and what may be missing in its name.
BEARING = "上る|下る|東入|西入|角[東西南北]|[東西南北]側"
STREET_WORDS = ["通", "角", "東入", "西入", "上る", "下る", "角西", "角東", "北側", "南側", "東側", "西側"]


@dataclass
class Gazetteer:
    pref: DataFrame
    city: DataFrame
    town: DataFrame | None = None
    rsdt_blk: DataFrame | None = None
    rsdt_dsp: DataFrame | None = None
    parcel: DataFrame | None = None


@dataclass(frozen=True)
class Book:
    """A dictionary, written down, and what a match has to know of it, learned once."""

    rows: DataFrame
    lengths: list[int]
    small: bool

    @staticmethod
    def of(rows: DataFrame, name: str) -> Book:
        rows = settled(rows, f"book-{name}")
        return Book(rows, key_lengths(rows), rows.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS)


def tasks(lines: int, usual: int) -> int:
    """How many tasks lines are dealt to: as many as usual, fewer of few lines, more where a task would have too many."""
    return max(-(-lines // LINES_A_TASK), min(usual, -(-lines // 1000)), 1)


def padded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns, cast; missing ones are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


class Geocoder:
    """Dictionaries of a gazetteer, spelled as lines are normalised, and the stages over them."""

    def __init__(self, gazetteer: Gazetteer, japanese: bool = True, fuzzy: str | None = None, variants: Mapping[str, str] | None = None) -> None:
        self.japanese, self.fuzzy = japanese, fuzzy[0] if fuzzy else None
        standard, wild = W.variants_of(VARIANTS if variants is None else variants), self.fuzzy
        if japanese:
            self.spell = python_text(lambda t: W.normalised(t, wild, standard).text)
            self.spell_place = python_text(lambda t: W.place_key(t, standard))
            self.spell_town = python_text(lambda t: W.town_text(t, standard))
            self.spell_street = python_text(lambda t: W.street_text(t, standard))
        else:
            self.spell = self.spell_place = self.spell_town = self.spell_street = lambda c: F.trim(c)

        def end(lines, ends):
            import pandas as pd

            return pd.Series([
                None if line is None else W.restored_text(W.end_as_written(line, e, wild, standard).strip(), wild) for line, e in zip(lines, ends, strict=True)
            ], dtype=object)

        self.end = F.pandas_udf(end, "string") if japanese else (lambda _, rest: F.trim(rest))
        pref = padded(gazetteer.pref, {"pref_key": "long", "pref": "string", "lg_code": "string"} | _PLACE)
        city = padded(
            gazetteer.city,
            {"city_key": "long", "pref_key": "long", "county": "string", "city": "string", "ward": "string", "lg_code": "string"} | _PLACE,
        )
        self.pref = Book.of(missing_words(pref.withColumn("key", self.spell_place(F.col("pref"))), MISSING_WORDS["pref"]), "pref")
        self.city = Book.of(self.city_keys(D.city_with_pref(city, pref)), "city")
        self.town = self.street = None
        if gazetteer.town is not None:
            town = padded(
                gazetteer.town,
                {k: FIELDS[k] for k in ("town_key", "city_key", "machiaza_id", "oaza_cho", "chome", "koaza", "koaza_aka_code", "rsdt_addr_flg")} | _PLACE,
            )
            full = settled(D.inherited(D.with_parents(D.town_full(town, city, pref))), "book-towns")
            rows = D.town_keys(full.filter(F.coalesce("koaza_aka_code", F.lit(0)) != 2))
            rows = rows.withColumn("key", self.spell_town(F.col("key"))).filter("key <> ''")
            rows = first_wins(rows, ["city_key", "key", "machiaza_id"], [F.col("town_key").asc_nulls_last()]).withColumn("amb", F.lit(0))
            # Looked up in a city, in a prefecture, or anywhere, as far as is known.
            scopes = F.array(F.concat(F.lit("c"), F.col("city_key")), F.concat(F.lit("p"), F.col("pref_key")), F.lit(""))
            rows = rows.withColumn("_scope", F.explode(scopes)).withColumn("key", F.concat_ws("|", "_scope", "key")).drop("_scope")
            self.town = Book.of(rows, "town")
            streets = D.kyoto_streets(full)
            if not streets.isEmpty():
                keyed = D.street_keys(streets).withColumn("key", self.spell_street(F.col("key"))).filter("key <> ''")
                self.street = Book.of(missing_words(keyed, STREET_WORDS), "street")
        # Where spelling leaves numbers alone and nothing is looked up behind what was found, a last number decides nothing.
        self.by_beginning = not japanese and self.street is None
        table = lambda df, key, *more: None if df is None else padded(df, {"town_key": "long", key: "long"} | dict.fromkeys(more, "string") | _PLACE)
        self.blk = table(gazetteer.rsdt_blk, "rsdtblk_key", "blk_id", "blk_num")
        self.dsp = table(gazetteer.rsdt_dsp, "rsdtdsp_key", "blk_id", "rsdt_id", "rsdt2_id", "rsdt_num", "rsdt_num2")
        self.parcel = table(gazetteer.parcel, "parcel_key", "prc_id", "prc_num1", "prc_num2", "prc_num3")

    def city_keys(self, named: DataFrame) -> DataFrame:
        """Keys of cities by step: county and city, city and ward, ward, ward of Tokyo.

        A later step is asked only where the earlier ones had nothing certain.
        """
        parts = [
            (1, D.county_city_keys(named), "city"),
            (2, D.city_ward_keys(named), "ward"),
            (3, named.filter(D.has("ward")).withColumn("key", F.explode(F.array("ward", F.concat("city", "ward")))), "ward"),
            (4, D.tokyo_wards(named).withColumn("key", F.col("city")), "ward"),
        ]
        rows = None
        for step, part, words in parts:
            keyed = part.withColumn("key", self.spell_place(F.col("key"))).filter("key <> ''")
            keyed = missing_words(keyed, MISSING_WORDS[words]).withColumn("step", F.lit(step))
            rows = keyed if rows is None else rows.unionByName(keyed)
        return rows

    def spelled(self, lines: DataFrame) -> DataFrame:
        """What is written down and dealt of each line: (line_id, address[, target]); rest is null where it is the input."""
        target = F.coalesce(F.col("target"), F.lit("all")) if "target" in lines.columns else F.lit("all")
        rows = lines.select("line_id", F.coalesce(F.col("address"), F.lit("")).alias("input"), target.alias("target"))
        return rows.withColumn("rest", self.spell(F.col("input"))).withColumn("rest", F.nullif("rest", "input"))

    def start(self, spelled: DataFrame) -> DataFrame:
        """One candidate for each line."""
        return spelled.select(
            "line_id",
            "input",
            "target",
            F.coalesce("rest", "input").alias("rest"),
            F.lit(0).alias("match_level"),
            F.lit(0).alias("coordinate_level"),
            F.lit(0).alias("matched_cnt"),
            F.lit(0).alias("ambiguous_cnt"),
            F.concat(F.col("line_id").cast("string"), F.lit(":")).alias("cand"),
            *(F.lit(None).cast(t).alias(c) for c, t in FIELDS.items() if c not in _NUMBERS),
        )

    def opened(self, c: DataFrame, book: Book, tries: Column, wild: bool) -> DataFrame:
        """Each candidate as it is (depth 0), and each hit of its tries with the book's columns, which begin with _d_.

        tries: array of the texts to look up. All of it is one pass over the candidates,
        and a line's rows stay where they are: as lines are dealt by line_id at the start,
        nothing that follows moves them again as long as dictionaries are broadcast.
        """
        d = book.rows.select(F.col("key").alias("_cut"), "amb", F.lit(True).alias("_d_found"), *(F.col(k).alias(f"_d_{k}") for k in book.rows.columns if k not in ("key", "amb")))
        plain = c.withColumn("_try", F.explode(F.concat(F.array(F.lit(None).cast("string")), tries)))
        cuts = F.filter(F.array(*map(F.lit, book.lengths or [1])), lambda n: n <= F.length("_try"))
        cut = plain.withColumn("depth", F.explode(F.when(F.col("_try").isNull(), F.array(F.lit(0))).otherwise(cuts)))
        # What no key can be equal to stands for the candidate itself, another one for each line.
        cut = cut.withColumn("_cut", F.when(F.col("depth") == 0, F.concat(F.lit("\0"), F.col("line_id").cast("string"))).otherwise(F.col("_try").substr(F.lit(1), F.col("depth"))))
        out = cut.join(F.broadcast(d) if book.small else d, "_cut", "left").filter("depth = 0 or _d_found")
        if wild:
            scope = lambda k: F.regexp_extract(k, r"^[cp]?[0-9]*\|", 0)
            names = d.withColumnRenamed("amb", "_left_out").withColumnRenamed("_cut", "key").withColumn("_scope", scope("key"))
            asked = plain.filter(F.col("_try").isNotNull()).withColumn("_scope", scope("_try"))
            more = fuzzy_match(asked, names, "_try", on=("_scope",)).withColumnRenamed("key", "_cut").drop("unmatched")
            more = more.filter("amb > 0").withColumn("amb", F.col("amb") + F.col("_left_out")).drop("_left_out", "_scope")
            out = out.unionByName(more)
        out = out.withColumn("unmatched", F.col("_try").substr(F.col("depth") + 1, F.length("_try"))).withColumnRenamed("_cut", "key")
        return out.filter((F.col("depth") == 0) | ~(F.col("key").rlike("[0-9]$") & F.col("unmatched").rlike("^[0-9]")))

    def taken(self, rows: DataFrame, book: Book, cands: DataFrame, level: Column, values: list[str]) -> DataFrame:
        """The candidates that hits make, beside those that stay as they are, in the columns of cands."""
        hit = F.col("depth") != 0
        names = [v for v in values if v in book.rows.columns]
        inherits = "coordinate_level" in book.rows.columns
        place = F.col("_d_rep_lat").isNotNull() & F.col("_d_rep_lon").isNotNull()
        new = {v: F.col(f"_d_{v}") for v in names if v not in _PLACE}
        new |= {v: F.when(place, F.col(f"_d_{v}")).otherwise(F.col(v)) for v in _PLACE}
        new |= {
            "match_level": level,
            "coordinate_level": F.when(place, F.col("_d_coordinate_level") if inherits else level).otherwise(F.col("coordinate_level")),
            "matched_cnt": F.col("matched_cnt") + F.col("depth"),
            "ambiguous_cnt": F.col("ambiguous_cnt") + F.col("amb"),
            "rest": F.regexp_replace("unmatched", f"^[{SPACE} ]+", ""),
        }
        if "original_flg" in values:
            new["original_flg"] = F.col("_d_rsdt_addr_flg")
        found = rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})
        # One name can stand for several rows: a candidate of its own for each.
        left = F.regexp_replace("rest", NUMBER_LEFT, "") if self.by_beginning else F.col("rest")
        own = F.concat_ws("/", "cand", F.hex(F.xxhash64(*(F.col(v) for v in names), "key", left)))
        found = found.withColumn("_of", F.when(~hit, F.col("cand"))).withColumn("cand", F.when(hit, own).otherwise(F.col("cand")))
        keys = ["line_id", "_of", "rest", "lg_code", "unused", *(v for v in names if v.endswith("_key") or v == "machiaza_id")]
        best = [F.col("ambiguous_cnt"), F.desc("matched_cnt"), F.col("cand")]
        return first_wins(found, list(dict.fromkeys(keys)), best).select(*cands.columns)

    def stages(self, lines: DataFrame) -> DataFrame:
        """All candidates of all lines.

        Prefectures, cities and towns are one pass over lines dealt by line_id; the
        numbers that follow meet larger tables, and each of their stages is written down.
        """
        spelled = settled(self.spelled(lines), "geocode-start")
        text = F.coalesce("rest", "input")
        beginning = F.regexp_replace(text, NUMBER, r"$1\0")
        n, wild, different = spelled.agg(
            F.count("*"), F.coalesce(F.max(text.contains(FUZZY)), F.lit(False)),
            F.approx_count_distinct(F.struct(beginning, "target")) if self.by_beginning else F.lit(None),
        ).first()
        usual = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = spelled.repartition(tasks(n, usual), "line_id")
        if self.by_beginning and n >= SHARED_LINES and different * SHARED_BY <= n and not self.numbers_in_keys():
            rows = spelled.select(beginning.alias("input"), "target").distinct()
            rows = rows.select(F.monotonically_increasing_id().alias("line_id"), "*", F.lit(None).cast("string").alias("rest"))
            rows = settled(rows, "geocode-beginnings")
            parts = tasks(rows.count(), usual)
            c = self.places(rows.repartition(parts, "line_id"), wild, parts)
            if self.blk is None and self.dsp is None and self.parcel is None:
                c = self.leaders(c)
            c = c.withColumn("cand", F.expr("substr(cand, instr(cand, ':'))"))
            c = self.with_numbers(dealt, settled(c, "geocode-shared"), beginning)
        else:
            c = self.places(dealt, wild, tasks(n, usual))
        whole = [x for x in c.columns if x not in FIELDS]
        c = c.select(*whole, *(F.lit(None).cast(t).alias(x) if x in _NUMBERS else F.col(x) for x, t in FIELDS.items()))
        for table, step in ((self.blk, self.block), (self.dsp, self.residence), (self.parcel, self.lot)):
            if table is not None:
                c = step(settled(c, f"geocode-before-{step.__name__}"), wild)
        return c

    def places(self, dealt: DataFrame, wild: bool, parts: int) -> DataFrame:
        """Candidates down to towns of spelled lines that are dealt by line_id."""
        c = self.in_city(self.in_pref(self.start(dealt), wild), wild)
        if self.street is not None:
            c = settled(self.in_street(settled(c, "geocode-city"), wild), "geocode-street").repartition(parts, "line_id")
        return c if self.town is None else self.in_town(c, wild)

    def numbers_in_keys(self) -> bool:
        """Whether some key may reach into a line's last number: one that starts with a number or has one behind a blank."""
        books = (b for b in (self.pref, self.city, self.town) if b is not None)
        name = F.regexp_replace("key", r"^[cp]?[0-9]*\|", "")
        return any(not b.rows.filter(F.col("key").rlike(f"(?:^|[{SPACE} ])[0-9]") | name.rlike("^[0-9]")).isEmpty() for b in books)

    def leaders(self, c: DataFrame) -> DataFrame:
        """Of a beginning's candidates those that can be the best of a line, where no numbers are looked up.

        Points of a beginning's lines are those of the candidate, plus what is the same for
        all of them, plus a similarity of 0 to 1. So one that is behind a certain one of
        its flag by more than 1 is never given, and of those with one output and one sort of
        points the first is first in every line. Beside a certain residence or lot nothing
        else is given.
        """
        c = c.withColumn("rsdt_addr_flg", F.when(F.col("city") == "京都市", 0).otherwise(F.col("rsdt_addr_flg")))
        scored = c.withColumns({"unmatched": F.concat(D.blank("unused"), F.trim("rest")), "similarity": F.lit(0.0)})
        scored = scored.withColumns({"_points": R.score(), "_sure": F.col("match_level") >= 2, "_agrees": R.flag_agrees()})
        most = F.max(F.when(F.col("_sure"), F.col("_points"))).over(Window.partitionBy("line_id", "rsdt_addr_flg"))
        numbered = F.coalesce(F.col("rsdt_addr_flg").isin(0, 1), F.lit(False))
        either = F.max(F.col("_sure") & numbered).over(Window.partitionBy("line_id"))
        scored = scored.withColumns({"_most": most, "_either": either}).filter("not _sure or _points + 1 >= _most").filter(numbered | ~F.col("_either"))
        shown = ["rest", "pref", "county", "city", "ward", "oaza_cho", "chome", "koaza", "koaza_aka_code", "unused"]
        one = ["line_id", *shown, "rsdt_addr_flg", "_agrees", "_sure", "matched_cnt"]
        return first_wins(scored, one, [F.desc("_points"), F.col("cand")]).select(*c.columns)

    def with_numbers(self, dealt: DataFrame, shared: DataFrame, beginning: Column) -> DataFrame:
        """The candidates of lines: those of their beginnings, with the lines' own numbers at the end of what is left."""
        number = F.regexp_extract(F.coalesce("rest", "input"), NUMBER, 2)
        rows = dealt.select("line_id", "input", "target", beginning.alias("_beginning"), number.alias("_number"))
        found = rows.join(sized(shared.drop("line_id").withColumnRenamed("input", "_beginning")), ["_beginning", "target"])
        rest = F.concat(F.expr("left(rest, length(rest) - 1)"), "_number")
        rest = F.when(F.col("_number") != "", rest).otherwise(F.col("rest"))
        return found.withColumns({"rest": rest, "cand": F.concat(F.col("line_id").cast("string"), "cand")}).select(*shared.columns)

    def in_pref(self, c: DataFrame, wild: bool) -> DataFrame:
        tries = F.when((F.col("match_level") == 0) & (F.col("rest") != ""), F.array("rest")).otherwise(F.array().cast("array<string>"))
        rows = self.opened(c, self.pref, tries, wild)
        sure = F.max((F.col("depth") > 0) & (F.col("amb") == 0)).over(Window.partitionBy("line_id", "cand"))
        rows = rows.withColumn("_sure", sure).filter("depth > 0 or not coalesce(_sure, false)")
        return self.taken(rows, self.pref, c, F.lit(1), ["pref_key", "pref", "lg_code", *_PLACE])

    def in_city(self, c: DataFrame, wild: bool) -> DataFrame:
        """The steps of cities in one match: a step counts until one before it had only certain hits."""
        tries = F.when((F.col("match_level") < 2) & (F.col("rest") != ""), F.array("rest")).otherwise(F.array().cast("array<string>"))
        rows = self.opened(c, self.city, tries, wild)
        step, hit = F.col("_d_step"), F.col("depth") > 0
        # Wards of Tokyo are asked in any prefecture; all else has to lie in the one that is known.
        tokyo = F.coalesce(F.substring("lg_code", 1, 2), F.lit("")) == "13"
        rows = rows.filter(~hit | F.col("pref_key").isNull() | (F.col("pref_key") == F.col("_d_pref_key")) | ((step == 4) & tokyo))
        unsure = (F.col("amb") > 0) | ((step == 3) & (F.col("match_level") == 0)) | ((step == 4) & F.col("_d_city").isin(*SHARED_WARDS) & ~tokyo)
        rows = rows.withColumn("_unsure", F.max(unsure).over(Window.partitionBy("line_id", "cand", "_d_step")))
        last = F.min(F.when(hit & ~F.col("_unsure"), step)).over(Window.partitionBy("line_id", "cand"))
        rows = rows.withColumn("_last", last).filter(F.col("_last").isNull() | (hit & (step <= F.col("_last"))))
        return self.taken(rows, self.city, c, F.lit(2), ["pref_key", "city_key", "lg_code", "pref", "county", "city", "ward", *_PLACE])

    def in_street(self, c: DataFrame, wild: bool) -> DataFrame:
        """Streets of Kyoto: the whole rest, the rest without a bearing, and what follows the bearing; the original always stays.

        What a try leaves out counts as uncertain and as unmatched.
        """
        asked = c.filter((F.col("match_level") <= 3) & (F.col("rest") != "") & (F.col("lg_code").isNull() | F.col("lg_code").startswith("26")))
        asked = asked.withColumn("_try", F.explode(street_tries(F.col("rest")))).withColumns(
            {"rest": self.spell_street(F.col("_try.rest")), "unused": F.col("_try.unused"), "ambiguous_cnt": F.col("ambiguous_cnt") + F.col("_try.amb")}
        )
        asked = asked.filter("rest <> ''").drop("_try")
        hits = self.opened(asked, self.street, F.array("rest"), wild).filter("depth > 0")
        agree = [F.col(k).isNull() | (F.col(k) == F.col(f"_d_{k}")) for k in ("pref_key", "city_key", "oaza_cho")]
        # A number that was taken for a chome has to be followed by a dash.
        chome = F.col("_d_oaza_cho").contains("丁目") & (F.col("unmatched") != "") & ~F.col("unmatched").startswith(DASH)
        hits = hits.filter((F.col("match_level") == 0) | (agree[0] & agree[1] & agree[2] & ~F.coalesce(chome, F.lit(False))))
        return c.unionByName(self.taken(hits, self.street, c, F.col("_d_match_level"), TOWN_VALUES))

    def in_town(self, c: DataFrame, wild: bool) -> DataFrame:
        """Towns of the candidate's city, or else of its prefecture, or of all: the scope is part of the key.

        A line may leave out that a place is a town, and a town may have been found
        already, of which there are longer names.
        """
        free = (F.col("rest") != "") & (F.coalesce("koaza_aka_code", F.lit(0)) != 2) & ~F.col("rest").rlike("(?:上る|下る|東入る?|西入る?)|(?:角[東西南北])|(?:[東西南北]側)")
        rows = c.withColumn("_rest", self.spell_town(F.when(free, F.col("rest")).otherwise(F.lit(""))))
        found = F.concat(D.blank("oaza_cho"), D.blank("chome"))
        scope = F.when(F.col("city_key").isNotNull(), F.concat(F.lit("c"), "city_key")).when(F.col("pref_key").isNotNull(), F.concat(F.lit("p"), "pref_key")).otherwise(F.lit(""))
        again = F.when(F.col("oaza_cho").isNotNull(), F.concat(self.spell_town(found), "_rest"))
        less = [F.when(F.col("_rest").rlike(p), F.regexp_replace("_rest", p, new)) for p, new in ((f"([0-9]){OAZA_BANCHO}", "$1"), ("^([^町]*)町", "$1"))]
        tries = F.array_distinct(F.filter(F.array("_rest", again, *less), lambda t: t.isNotNull()))
        rows = rows.withColumn("_where", F.concat(scope, F.lit("|"))).withColumn("_again", F.concat("_where", again))
        tries = F.when(F.col("_rest") != "", F.transform(tries, lambda t: F.concat(F.col("_where"), t))).otherwise(F.array().cast("array<string>"))
        rows = self.opened(rows, self.town, tries, wild)
        hit = F.col("depth") > 0
        whole = F.coalesce(F.col("_try") == F.col("_again"), F.lit(False))
        rows = rows.filter(~hit | whole | F.col("oaza_cho").isNull() | (F.col("oaza_cho") == F.col("_d_oaza_cho")))
        lead = F.length("_where") + F.when(whole, F.length(found)).otherwise(F.lit(0))
        named = F.concat(D.blank("_d_oaza_cho"), D.blank("_d_chome"))
        # A dash after a chome, or a second town word after a town, belongs to the match.
        swallowed = (named.contains("丁目") & F.col("unmatched").startswith(DASH)).cast("int")
        town = (F.col("_d_oaza_cho").endswith("町") | F.col("_d_chome").endswith("町")) & F.col("unmatched").startswith("町")
        town = F.coalesce(town, F.lit(False)).cast("int")
        behind = F.col("unmatched").substr(swallowed + town + 1, F.length("unmatched"))
        # A hit of the words that were found already gains nothing, but counts.
        depth = F.when(hit, F.col("depth") - lead + swallowed + town).otherwise(F.lit(0))
        own = Window.partitionBy("line_id", "cand")
        rows = rows.withColumn("_none", F.max(F.when(hit, F.col("amb"))).over(own)).filter(hit | F.col("_none").isNull() | (F.col("_none") > 0) | (F.col("match_level") >= 3))
        rows = rows.withColumns({"unmatched": F.when(hit, behind), "_gain": depth})
        rows = rows.withColumn("matched_cnt", F.col("matched_cnt") + F.col("_gain") - F.col("depth"))
        return self.taken(rows, self.town, c, F.col("_d_match_level"), TOWN_VALUES)

    def numbered(self, c: DataFrame, table: DataFrame, eligible: Column, level: int, flag: int, on: list[str], column: str, n: int, wild: bool) -> DataFrame:
        number = "_number"
        asked = c.filter(eligible).withColumn(number, L.leading_number(F.col("rest")))
        own = [x for x in table.columns if x not in on and x != column]
        d = table.select(*on, column, *(F.col(x).alias(f"_d_{x}") for x in own))
        place = F.col("_d_rep_lat").isNotNull() & F.col("_d_rep_lon").isNotNull()
        hits = L.by_number(asked, d, on, column, number, wild)
        rest = L.rest_after(F.col("rest"), n)
        hits = hits.withColumns(
            {x: F.col(f"_d_{x}") for x in own if x not in _PLACE}
            | {x: F.when(place, F.col(f"_d_{x}")).otherwise(F.col(x)) for x in _PLACE}
            | {
                column: F.col(number),
                "match_level": F.lit(level),
                "coordinate_level": F.when(place, level).otherwise(F.col("coordinate_level")),
                "matched_cnt": F.col("matched_cnt") + F.length("rest") - F.length(rest),
                "rest": rest,
                "rsdt_addr_flg": F.lit(flag),
                "cand": F.concat_ws("/", "cand", F.lit(f"L{level}"), F.hex(F.xxhash64(*(F.col(f"_d_{x}") for x in own)))),
            }
        )
        return hits.select(*c.columns).unionByName(c)

    def block(self, c: DataFrame, wild: bool) -> DataFrame:
        ok = (F.col("target") != "parcel") & F.col("match_level").between(3, 4) & F.col("town_key").isNotNull() & (F.coalesce("city", F.lit("")) != "京都市")
        return self.numbered(c, self.blk, ok, 5, 1, ["town_key"], "blk_num", 1, wild)

    def residence(self, c: DataFrame, wild: bool) -> DataFrame:
        """A residence's number, and where there is one the second number behind it; else the block stays."""
        ok = (F.col("target") != "parcel") & (F.col("match_level") == 5)
        second = F.nullif(F.col("rsdt_num2"), F.lit(""))
        both = self.dsp.filter(second.isNotNull()).withColumn("rsdt_num", F.concat("rsdt_num", F.lit(DASH), second)).withColumn("_second", second)
        one = self.dsp.filter(second.isNull()).withColumn("_second", F.lit(None).cast("string"))
        asked = c.filter(ok)
        numbers = [L.leading_number(F.col("rest"), i) for i in (0, 1)]
        found = None
        for table, number, n in ((both, F.concat(numbers[0], F.lit(DASH), numbers[1]), 2), (one, numbers[0], 1)):
            d = table.select("town_key", "blk_id", "rsdt_num", *(F.col(x).alias(f"_d_{x}") for x in ("rsdtdsp_key", "rsdt_id", "rsdt2_id", "_second", *_PLACE)))
            place = F.col("_d_rep_lat").isNotNull() & F.col("_d_rep_lon").isNotNull()
            hits = L.by_number(asked.withColumn("_number", number), d, ["town_key", "blk_id"], "rsdt_num", "_number", wild)
            rest = L.rest_after(F.col("rest"), n)
            hits = hits.withColumns(
                {x: F.col(f"_d_{x}") for x in ("rsdtdsp_key", "rsdt_id", "rsdt2_id")}
                | {x: F.when(place, F.col(f"_d_{x}")).otherwise(F.col(x)) for x in _PLACE}
                | {
                    "rsdt_num": F.substring_index("_number", DASH, 1), "rsdt_num2": F.col("_d__second"), "match_level": F.lit(6),
                    "coordinate_level": F.when(place, 6).otherwise(F.col("coordinate_level")),
                    "matched_cnt": F.col("matched_cnt") + F.length("rest") - F.length(rest), "rest": rest, "rsdt_addr_flg": F.lit(1),
                    "cand": F.concat_ws("/", "cand", F.lit("L6"), F.hex(F.xxhash64("_d_rsdt_id", "_d_rsdt2_id", "_number"))),
                }
            ).select(*c.columns)
            found = hits if found is None else found.unionByName(hits)
        return found.unionByName(c)

    def lot(self, c: DataFrame, wild: bool) -> DataFrame:
        ok = (F.col("target") != "residential") & F.col("match_level").between(3, 4) & F.col("town_key").isNotNull() & (F.col("rest") != "")
        d = self.parcel.select("town_key", "prc_id", "rep_lat", "rep_lon", F.col("parcel_key").alias("_key"), *(F.col(f"prc_num{i}").alias(f"_d{i}") for i in (1, 2, 3)))
        asked = c.filter(ok).drop("prc_id").withColumnsRenamed({"rep_lat": "_lat", "rep_lon": "_lon"})
        # Lots under a street of Kyoto are those of its town.
        hits = L.parcels(asked, d, ["town_key"], "rest", cand_id="cand", wild=wild)
        place = F.col("rep_lat").isNotNull()
        rest = F.when(F.col("n_numbers") == 3, L.rest_after(F.col("rest"), 3)).when(F.col("n_numbers") == 2, L.rest_after(F.col("rest"), 2)).otherwise(L.rest_after(F.col("rest"), 1))
        hits = hits.withColumn("_rest", rest).withColumns({
            "coordinate_level": F.when(place, 7).otherwise(F.col("coordinate_level")),
            "rep_lat": F.coalesce("rep_lat", "_lat"),
            "rep_lon": F.coalesce("rep_lon", "_lon"),
            "match_level": F.lit(7),
            "matched_cnt": F.col("matched_cnt") + F.length("rest") - F.length("_rest"),
            "rest": F.col("_rest"),
            "rsdt_addr_flg": F.lit(0),
            "parcel_key": F.col("_key"),
            "cand": F.concat_ws("/", "cand", F.lit("L7"), "prc_id"),
            **{f"prc_num{i}": F.col(f"_d{i}") for i in (1, 2, 3)},
        })
        return hits.select(*c.columns).unionByName(c)

    def geocode(self, lines: DataFrame) -> DataFrame:
        """One row for each line: the best candidate, in the columns of the formats."""
        c = self.stages(lines)
        if self.street is not None:
            # Of a town's lots, whose table has the town itself only, streets of Kyoto take theirs.
            c = c.withColumn("rsdt_addr_flg", F.when(F.col("city") == "京都市", 0).otherwise(F.col("rsdt_addr_flg")))
        end = self.end(F.col("input"), F.col("rest"))
        c = c.withColumn("end", F.when(F.col("rest") == "", "").otherwise(end))
        number = lambda k: F.nullif(F.col(k), F.lit("0"))
        output = format_address(
            F.col("pref"), F.col("county"), F.col("city"), F.col("ward"), F.col("oaza_cho"), F.col("chome"), F.col("koaza"),
            F.coalesce("koaza_aka_code", F.lit(0)), F.col("blk_num"), F.col("rsdt_num"), F.col("rsdt_num2"),
            F.col("prc_num1"), number("prc_num2"), number("prc_num3"), F.col("end"),
        )
        c = (
            c.withColumn("output", output)
            .withColumn("unmatched", F.concat(D.blank("unused"), "end"))
            .withColumn("similarity", R.similarity())
            # Kyoto's city has lots only.
            .withColumn("rsdt_addr_flg", F.when(F.col("city") == "京都市", 0).otherwise(F.col("rsdt_addr_flg")))
            .withColumn("points", R.score())
            .withColumn("confident", R.confident())
        )
        best = R.chosen(c, "line_id", ("cand",), by="points").withColumnRenamed("similarity", "score")
        return best.withColumn("others", F.filter(F.array("unused", "end"), lambda x: x != "")).withColumnsRenamed(
            {"rep_lat": "lat", "rep_lon": "lon"}
        ).drop("rest", "unmatched", "confident", "cand", "original_flg", "unused", "end")


TOWN_VALUES = [
    "pref_key", "city_key", "town_key", "lg_code", "pref", "county", "city", "ward", "machiaza_id", "oaza_cho", "chome", "koaza", "koaza_aka_code",
    "rsdt_addr_flg", "original_flg", *_PLACE,
]


def street_tries(rest: Column) -> Column:
    """What to look up of a rest, with what that leaves out: array of (rest, amb, unused)."""

    def run(rests):
        import re

        import pandas as pd

        out = []
        for text in rests:
            whole = re.sub("([東西]入)る", r"\1", text or "")
            tries = [(whole, 0, "")]
            for m in re.finditer(BEARING, whole):
                before, after = whole[: m.start()], whole[m.end() :]
                tries += [(before + after, len(m[0]), m[0]), (after, m.end(), before + m[0])]
            out.append([dict(zip(("rest", "amb", "unused"), t, strict=True)) for t in tries if t[0]])
        return pd.Series(out)

    return F.pandas_udf(run, "array<struct<rest: string, amb: int, unused: string>>")(rest)


def geocode(lines: DataFrame, gazetteer: Gazetteer, japanese: bool = True, fuzzy: str | None = None) -> DataFrame:
    """The best match of each (line_id, address[, target])."""
    return Geocoder(gazetteer, japanese, fuzzy).geocode(lines)
