import json

import pytest
from pyspark.sql import functions as F

from terrane.plans.geocode import Gazetteer, Geocoder
from terrane.sources import sinks
from terrane.streaming.geocode import geocode_stream


@pytest.fixture(scope="module")
def geocoder(spark):
    place = "rep_lat double, rep_lon double"
    return Geocoder(Gazetteer(
        spark.createDataFrame([(1, "東京都", "130001", 35.6, 139.7), (2, "京都府", "260002", 35.0, 135.7)], f"pref_key long, pref string, lg_code string, {place}"),
        spark.createDataFrame([(11, 1, "131016", None, "千代田区", None, 35.69, 139.75), (21, 2, "261017", None, "京都市", "北区", 35.04, 135.75)], f"city_key long, pref_key long, lg_code string, county string, city string, ward string, {place}"),
        spark.createDataFrame([(111, 11, "0056000", "紀尾井町", None, None, 1, 0, 35.68, 139.73), (112, 11, "0001001", "飯田橋", "一丁目", None, 1, 0, None, None)], f"town_key long, city_key long, machiaza_id string, oaza_cho string, chome string, koaza string, rsdt_addr_flg int, koaza_aka_code int, {place}"),
        spark.createDataFrame([(111, "001", "1", 35.681, 139.731)], f"town_key long, blk_id string, blk_num string, {place}"),
        spark.createDataFrame([(111, "001", "003", None, "3", None, 35.682, 139.732)], f"town_key long, blk_id string, rsdt_id string, rsdt2_id string, rsdt_num string, rsdt_num2 string, {place}"),
        spark.createDataFrame([(111, "000010000300000", "1", "3", None, 35.683, 139.733)], f"town_key long, prc_id string, prc_num1 string, prc_num2 string, prc_num3 string, {place}"),
    ))


LINES = [
    (1, "東京都千代田区紀尾井町１－３　東京ガーデンテラス"),
    (2, "千代田飯田橋1丁目2-3"),
    (3, "京都市北区どこか"),
    (4, "nowhere"),
    (5, None),
]


def test_levels(spark, geocoder):
    out = {r["line_id"]: r for r in geocoder.geocode(spark.createDataFrame(LINES, "line_id long, address string")).collect()}
    assert [out[i]["match_level"] for i in range(1, 6)] == [6, 4, 2, 0, 0]
    assert (out[1]["rsdt_id"], out[1]["lat"], out[1]["others"]) == ("003", 35.682, ["東京ガーデンテラス"])
    assert (out[2]["coordinate_level"], out[2]["lat"]) == (2, 35.69)
    assert out[4]["others"] == ["nowhere"]


def test_parcel_target(spark, geocoder):
    lines = spark.createDataFrame([(1, LINES[0][1], "parcel")], "line_id long, address string, target string")
    assert geocoder.geocode(lines).first()["prc_id"] == "000010000300000"


def test_wild_cards(spark, geocoder):
    lines = [(1, "東京都千代?区紀尾井町1-3"), (2, "東?都千代田区紀?井町1-3")]
    out = {r["line_id"]: r for r in geocoder.geocode(spark.createDataFrame(lines, "line_id long, address string")).collect()}
    assert [(out[i]["match_level"], out[i]["rsdt_id"], out[i]["ambiguous_cnt"]) for i in (1, 2)] == [(6, "003", 1), (6, "003", 2)]


def test_residence_or_lot(spark):
    from terrane.operators import rank as R

    rows = [
        # line, target, flag, original, level, score: within two points of a residence of a residential town; the same elsewhere; too far.
        (1, "all", 0, 1, 7, 12.0), (1, "all", 1, 1, 5, 10.0),
        (2, "all", 0, 0, 7, 12.0), (2, "all", 1, 0, 5, 10.0),
        (3, "all", 0, 1, 7, 12.1), (3, "all", 1, 1, 5, 10.0),
        (4, "parcel", 0, 1, 7, 9.0), (4, "parcel", 1, 1, 5, 10.0),
        (5, "residential", 0, 0, 7, 19.0), (5, "residential", 1, 0, 5, 10.0),
        (6, "all", None, None, 2, 20.0), (6, "all", 0, 0, 7, 12.0),
        (7, "all", None, None, 2, 20.0), (7, "all", None, None, 2, 12.0),
    ]
    c = spark.createDataFrame([(*r, 1, True, i) for i, r in enumerate(rows)], "line_id long, target string, rsdt_addr_flg int, original_flg int, match_level int, score double, matched_cnt int, confident boolean, seq int")
    got = {r["line_id"]: (r["match_level"], r["score"]) for r in R.chosen(c).collect()}
    assert got == {1: (5, 10.0), 2: (7, 12.0), 3: (7, 12.1), 4: (7, 9.0), 5: (5, 10.0), 6: (7, 12.0), 7: (2, 20.0)}

    place = "rep_lat double, rep_lon double"
    coder = Geocoder(Gazetteer(
        spark.createDataFrame([(1, "東京都", "130001", 35.6, 139.7)], f"pref_key long, pref string, lg_code string, {place}"),
        spark.createDataFrame([(11, 1, "131016", None, "千代田区", None, 35.69, 139.75)], f"city_key long, pref_key long, lg_code string, county string, city string, ward string, {place}"),
        spark.createDataFrame([(111, 11, "0056000", "紀尾井町", None, None, 1, 0, 35.68, 139.73), (112, 11, "0057000", "永田町", None, None, 0, 0, 35.67, 139.74)], f"town_key long, city_key long, machiaza_id string, oaza_cho string, chome string, koaza string, rsdt_addr_flg int, koaza_aka_code int, {place}"),
        spark.createDataFrame([(111, "002", "2", 35.681, 139.731), (112, "002", "2", 35.671, 139.741)], f"town_key long, blk_id string, blk_num string, {place}"),
        None,
        spark.createDataFrame([(t, "000020000500000", "2", "5", None, 35.683, 139.733) for t in (111, 112)], f"town_key long, prc_id string, prc_num1 string, prc_num2 string, prc_num3 string, {place}"),
    ))
    out = coder.geocode(spark.createDataFrame([(1, "東京都千代田区紀尾井町2-5"), (2, "東京都千代田区永田町2-5")], "line_id long, address string"))
    assert sorted((r["line_id"], r["match_level"], r["rsdt_addr_flg"]) for r in out.collect()) == [(1, 5, 1), (2, 7, 0)]


def test_lines_in_a_task(spark, monkeypatch):
    """Candidates aren't written down for their ends, and no task has more lines than it can sort in memory."""
    from terrane.plans import geocode as G

    assert [G.tasks(n, 200) for n in (0, 5, 90_000, 4_600_000)] == [1, 1, 90, 230]
    place = "rep_lat double, rep_lon double"
    coder = Geocoder(Gazetteer(
        spark.createDataFrame([(1, "A", "010000", None, None)], f"pref_key long, pref string, lg_code string, {place}"),
        spark.createDataFrame([(11, 1, "010011", "B", None, None)], f"city_key long, pref_key long, lg_code string, city string, {place}"),
    ), japanese=False)
    written = {}
    monkeypatch.setattr(G, "LINES_A_TASK", 10)
    monkeypatch.setattr(G, "settled", lambda df, name, f=G.settled: written.setdefault(name, f(df, name)))
    out = coder.geocode(spark.range(95).selectExpr("id as line_id", "if(id % 2 = 0, 'A?', ' A ') as address")).select("line_id", "input", "match_level")
    assert {k: v.columns for k, v in written.items()} == {"geocode-start": ["line_id", "input", "target", "rest"]}
    assert out.rdd.getNumPartitions() == 10
    assert {tuple(r)[1:] for r in out.collect()} == {("A?", 1), (" A ", 1)}


def test_lines_of_one_beginning(spark, monkeypatch):
    """Lines that differ in their last number meet dictionaries once, also large ones, and come out as each by itself."""
    from terrane.plans import geocode as G

    place = "rep_lat double, rep_lon double"
    towns = [(100 + i, 11, f"{i:04d}00{i % 2}", ("T", "T町", "TU", "V#1")[i % 4], ("", "W")[i % 3 == 0], "", i % 3, 0, None if i % 5 else 1.0 + i, 2.0) for i in range(48)]

    def coder(towns=towns, lots=None):
        return Geocoder(Gazetteer(
            spark.createDataFrame([(1, "A", "010000", None, None)], f"pref_key long, pref string, lg_code string, {place}"),
            spark.createDataFrame([(11, 1, "010011", "B", 3.0, 4.0), (12, 1, "010029", "BC", None, None)], f"city_key long, pref_key long, lg_code string, city string, {place}"),
            spark.createDataFrame(towns, f"town_key long, city_key long, machiaza_id string, oaza_cho string, chome string, koaza string, rsdt_addr_flg int, koaza_aka_code int, {place}"),
            parcel=lots,
        ), japanese=False)

    heads = ["ABT", "ABT町", " ABTU", "ABCT町W", "ABV#1", "A?TU", "BV#12", "nowhere", "AB T町 7", "", "A"]
    tails = [" 12", " 0", " 3-4-5", "␣8", " 12 ", "", "-6", " 7b", "\n", " 1\n"]
    rows = [(h + (t if i % 3 else f" {i}"), ("all", "residential", "parcel", None)[i % 4]) for i, (h, t) in enumerate([(h, t) for h in heads for t in tails] * 4)]
    lines = spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, (None, None)])], "line_id long, address string, target string")

    def found(coder, ways=(10**9, 1)):
        out = []
        for least in ways:
            monkeypatch.setattr(G, "SHARED_LINES", least)
            written.clear()
            out.append(sorted(coder.geocode(lines).collect(), key=lambda r: r["line_id"]))
        assert len(out[0]) == len(rows) + 1 and out[0] == out[-1]
        return out[-1]

    written = {}
    monkeypatch.setattr(G, "settled", lambda df, name, f=G.settled: written.setdefault(name, f(df, name)))
    monkeypatch.setattr(G, "SHARED_BY", 2)
    monkeypatch.setattr(G, "BROADCAST_KEYS", 1)
    assert {r["match_level"] for r in found(coder())} == {0, 1, 2, 3, 4}
    assert written["geocode-beginnings"].count() * G.SHARED_BY <= len(rows)
    lots = spark.createDataFrame([(t[0], "000120000000000", "12", None, None, 5.0, 6.0) for t in towns], f"town_key long, prc_id string, prc_num1 string, prc_num2 string, prc_num3 string, {place}")
    assert 7 in {r["match_level"] for r in found(coder(lots=lots))} and "geocode-shared" in written
    # A key that reaches into numbers tells such lines apart.
    found(coder([*towns, (200, 11, "0099000", "T 12", None, None, 0, 0, 7.0, 8.0)]), (1,))
    assert "geocode-start" in written and "geocode-beginnings" not in written


def test_formats(spark, geocoder):
    rows = geocoder.geocode(spark.createDataFrame(LINES[:1], "line_id long, address string")).cache()
    assert json.loads(sinks.formatted(rows, "ndjson").first()[1])["result"]["rsdt_id"] == "003"
    assert json.loads(sinks.formatted(rows, "ndgeojson").first()[1])["geometry"]["coordinates"] == [139.732, 35.682]
    assert sinks.formatted(rows, "csv").first()[1].startswith('"東京都千代田区')
    with pytest.raises(ValueError, match="unknown format"):
        sinks.formatted(rows, "xml")


def test_stream_equals_batch(spark, geocoder, tmp_path):
    lines = spark.createDataFrame(LINES, "line_id long, address string")
    lines.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    geocode_stream(stream, geocoder, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("line_id", "output")
    assert sorted(got.collect()) == sorted(geocoder.geocode(lines).select("line_id", "output").collect())


def test_comments(spark):
    from terrane.sources.lines import comment_filtered, without_block_comments

    rows = spark.createDataFrame(
        [(1, "a /* x", "f"), (2, "inside", "f"), (3, "y */ b // c", "f"), (4, "# no", "f"), (5, '"q" #in', "f"), (6, '"z"', "f")],
        "line_id long, value string, file string",
    )
    got = without_block_comments(rows).select("line_id", comment_filtered(F.col("value")).alias("v")).filter("v is not null")
    assert [tuple(r) for r in got.orderBy("line_id").collect()] == [(1, "a"), (3, "b"), (5, '"q" #in'), (6, "z")]
