"""The commands from end to end, and what they read and write."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from terrane import cli
from terrane.sources import download, gazetteer, sinks
from terrane.sources.lines import read_lines, sniffed

FILES = {
    "pref_all": "lg_code,pref\n130001,東京都\n260002,京都府\n",
    "pref_pos_all": "lg_code,rep_lat,rep_lon,rep_srid\n130001,35.6,139.7,EPSG:6668\n",
    "city_all": "lg_code,pref,county,city,ward\n131016,東京都,,千代田区,\n261041,京都府,,京都市,中京区\n",
    "city_pos_all": "lg_code,rep_lat,rep_lon,rep_srid\n131016,35.69,139.75,EPSG:6668\n261041,35.01,135.75,EPSG:6668\n",
    "town_all": "lg_code,machiaza_id,pref,county,city,ward,oaza_cho,chome,koaza,rsdt_addr_flg,koaza_aka_code\n"
    "131016,0056000,東京都,,千代田区,,紀尾井町,,,1,0\n131016,0001001,東京都,,千代田区,,飯田橋,一丁目,,1,0\n"
    "261041,0001000,京都府,,京都市,中京区,柏屋町,,,0,0\n261041,0001101,京都府,,京都市,中京区,柏屋町,,柳馬場通六角下る,0,2\n",
    "town_pos_all": "lg_code,machiaza_id,rep_lat,rep_lon,rep_srid,rsdt_addr_flg\n131016,0056000,35.68,139.73,EPSG:6668,1\n261041,0001101,35.007,135.764,EPSG:6668,0\n261041,0001000,35.006,135.765,EPSG:6668,0\n131016,0001001,1,1,EPSG:2451,1\n",
    "rsdtdsp_blk_pref13": "lg_code,machiaza_id,blk_id,blk_num\n131016,0056000,001,1\n",
    "rsdtdsp_blk_pos_pref13": "lg_code,machiaza_id,blk_id,rep_lat,rep_lon,rep_srid,blk_num\n131016,0056000,001,35.681,139.731,EPSG:6668,1\n",
    "rsdtdsp_rsdt_pref13": "lg_code,machiaza_id,blk_id,blk_num,rsdt_id,rsdt_num,rsdt2_id,rsdt_num2,rsdt_addr_flg\n131016,0056000,001,1,003,3,,,1\n131016,0056000,001,1,003,3,002,2,1\n",
    "rsdtdsp_rsdt_pos_pref13": "lg_code,machiaza_id,blk_id,rsdt_id,rsdt2_id,rep_lat,rep_lon,rep_srid,rsdt_addr_flg\n131016,0056000,001,003,,35.682,139.732,EPSG:6668,1\n",
    "parcel_city131016": "lg_code,machiaza_id,prc_id,prc_num1,prc_num2,prc_num3,rsdt_addr_flg\n131016,0056000,000050000700000,5,7,,0\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    at = tmp_path_factory.mktemp("registry")
    for name, text in FILES.items():
        (at / f"mt_{name}.csv").write_text(text, encoding="utf-8")
    cli.main(["load", str(at), str(at / "gazetteer")])
    return at


def geocoded(folder, capsys, text, *more):
    (folder / "lines.txt").write_text(text, encoding="utf-8")
    capsys.readouterr()
    cli.main(["geocode", str(folder / "lines.txt"), "--gazetteer", str(folder / "gazetteer"), *more])
    return capsys.readouterr().out


def test_load_then_geocode(folder, capsys, spark):
    lines = "東京都千代田区紀尾井町１－３　ガーデン・ﾃﾗｽ // note\n# none\n\n千代田区紀尾井町1-3-2\n東京都千代田区紀尾井町5-7\n東京都千代田区飯田橋１丁目９番１号\n京都府京都市中京区柳馬場通六角下る柏屋町３４ビル\n東京都千代田?紀尾井町1\n"
    out = json.loads(geocoded(folder, capsys, lines, "--debug"))
    got = [(r["result"]["match_level"], r["result"]["coordinate_level"], r["result"]["output"], r["result"]["others"]) for r in out]
    assert got == [
        ("residential_detail", "residential_detail", "東京都千代田区紀尾井町1-3 ガーデン・ﾃﾗｽ", ["ガーデン・ﾃﾗｽ"]),
        ("residential_detail", "residential_block", "東京都千代田区紀尾井町1-3-2", []),
        ("parcel", "machiaza", "東京都千代田区紀尾井町5-7", []),
        ("machiaza_detail", "city", "東京都千代田区飯田橋一丁目9-1", ["9-1"]),
        got[4],
        ("residential_block", "residential_block", "東京都千代田区紀尾井町1", []),
    ]
    assert got[4][:2] == ("machiaza_detail", "machiaza_detail") and out[4]["result"]["koaza"] == "柳馬場通六角下る"
    first = out[0]
    assert (first["result"]["lat"], first["result"]["rsdt_addr_flg"], first["result"]["ward"], first["result"]["rsdt_id"]) == (35.682, 1, None, "003")
    assert first["debug"]["pref_key"] and first["debug"]["rsdtdsp_key"] and not first["debug"]["parcel_key"]
    assert 0 < first["result"]["score"] <= 1


def test_targets(folder, capsys):
    line = "東京都千代田区紀尾井町5-7\n"
    kinds = {t: json.loads(geocoded(folder, capsys, line, "--target", t, "--format", "ndjson"))["result"] for t in ("all", "residential", "parcel")}
    assert [kinds[t]["match_level"] for t in ("all", "residential", "parcel")] == ["parcel", "machiaza", "parcel"]


def test_formats_of_one_line(folder, capsys):
    line = '東京都千代田区紀尾井町1-3 "A"\n'
    csv = geocoded(folder, capsys, line, "--format", "csv").splitlines()
    assert csv[0].split(",")[:4] == ["input", "output", "score", "match_level"]
    assert csv[1].startswith('"東京都千代田区紀尾井町1-3 ""A""","東京都千代田区紀尾井町1-3 ') and ",residential_detail,residential_detail,35.682,139.732," in csv[1]
    assert geocoded(folder, capsys, line, "--format", "simplified").splitlines()[1].endswith(",residential_detail")
    geo = json.loads(geocoded(folder, capsys, line, "--format", "geojson"))
    assert geo["type"] == "FeatureCollection" and geo["features"][0]["geometry"]["coordinates"] == [139.732, 35.682]
    assert geo["features"][0]["properties"]["blk_num"] == "1"
    none = json.loads(geocoded(folder, capsys, "nowhere\n", "--format", "ndgeojson"))
    assert none["geometry"]["coordinates"] == [None, None] and "rsdt_addr_flg" not in none["properties"]


def test_standard_input_and_own_wild_card(folder, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("東京都千代田区紀尾井■1-3\n"))
    capsys.readouterr()
    cli.main(["geocode", "-", "--gazetteer", str(folder / "gazetteer"), "--fuzzy", "■", "--format", "ndjson"])
    assert json.loads(capsys.readouterr().out)["result"]["match_level"] == "residential_detail"


def test_load_again_and_updates(folder, spark):
    assert {t: set(c) for t, c in gazetteer.load(spark, str(folder), str(folder / "gazetteer")).items()} == dict.fromkeys(gazetteer.TABLES, {"same"})
    (folder / "mt_parcel_city131016.csv").write_text(FILES["parcel_city131016"].replace("5,7", "5,8") + "131016,0056000,000090000000000,9,,,0\n", encoding="utf-8")
    assert gazetteer.load(spark, str(folder), str(folder / "gazetteer"))["parcel"] == {"updated": 1, "new": 1}
    assert gazetteer.read(spark, str(folder / "gazetteer")).parcel.count() == 2


def test_a_gazetteer_without_keys_is_refused(spark, tmp_path):
    for t in ("pref", "city"):
        spark.createDataFrame([("130001", "東京都")], "lg_code string, pref string").write.parquet(str(tmp_path / t))
    with pytest.raises(ValueError, match="pref_key"):
        gazetteer.read(spark, str(tmp_path))


def test_encodings(spark, tmp_path):
    for name, code, mark in (("a", "utf-8", b"\xef\xbb\xbf"), ("b", "utf-16-le", b"\xff\xfe"), ("c", "utf-16-be", b"\xfe\xff"), ("d", "utf-8", b"")):
        (tmp_path / f"{name}.txt").write_bytes(mark + "東京都\r\n京都府\r大阪府\n\n".encode(code))
    assert sorted(sniffed(spark, str(tmp_path)).values()) == ["UTF-16BE", "UTF-16LE", "UTF-8", "UTF-8"]
    got = [(r["file"][-5:], r["value"]) for r in read_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"{n}.txt", v) for n in "abcd" for v in ("東京都", "京都府", "大阪府"))
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe\x00\x00")
    with pytest.raises(ValueError, match="UTF-32"):
        read_lines(spark, str(tmp_path))


def test_download(spark, tmp_path):
    """New archives come, unchanged ones don't, a missing one leaves the cache as it was."""
    version = {"/a.zip": "1", "/b.zip": "1"}
    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self, body=True):
            asked.append((self.command, self.path))
            tag = version.get(self.path)
            if tag is None or self.headers.get("If-None-Match") == tag:
                self.send_response(304 if tag else 404)
                self.send_header("Content-Length", "0")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("ETag", tag)
            self.send_header("Content-Length", "3" if body else "0")
            self.end_headers()
            if body:
                self.wfile.write(b"zip")

        def do_HEAD(self):
            self.do_GET(body=False)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"
    urls = spark.createDataFrame([(f"{root}/{n}.zip",) for n in ("a", "b", "c")], "url string")

    def status(rows):
        return {r["url"][-5:]: r["status"] for r in rows.collect()}

    folder = str(tmp_path / "d")
    assert status(download.download(urls, folder)) == {"a.zip": 200, "b.zip": 200, "c.zip": 404}
    assert download.cache(spark, f"{folder}/cache").count() == 2
    assert status(download.download(urls, folder)) == {"a.zip": 304, "b.zip": 304, "c.zip": 404}
    version["/b.zip"] = "2"
    assert status(download.to_update(urls, download.cache(spark, f"{folder}/cache"))) == {"b.zip": 200, "c.zip": 404}
    assert status(download.download(urls, folder))["b.zip"] == 200
    assert {r["etag"] for r in download.cache(spark, f"{folder}/cache").collect()} == {"1", "2"}
    assert spark.read.parquet(f"{folder}/archives").count() == 2
    assert ("HEAD", "/b.zip") in asked
    server.shutdown()


def test_urls_with_one_key(spark, tmp_path):
    from terrane.functions.text import url_key

    one, other = ("https://h.example/x?k=5004826", "https://h.example/x?k=1958091")
    rows = spark.createDataFrame([(u, "old") for u in (one, other)], "url string, etag string").withColumn("url_key", url_key(F.col("url")))
    assert rows.select("url_key").distinct().count() == 1
    newer = rows.filter(F.col("url") == one).withColumn("etag", F.lit("new"))
    got = lambda df: {r["url"]: r["etag"] for r in df.collect()}
    assert got(download.cache_put(rows, newer)) == {one: "new", other: "old"}
    assert got(download.cache_without(rows, newer)) == {other: "old"}
    # What lies in the same folder of archives isn't written over.
    new = rows.select("url_key", "url", F.encode("etag", "utf-8").alias("content"))
    new.write.partitionBy("url_key").parquet(str(tmp_path / "archives"))
    both = download.archives(newer.select("url_key", "url", F.encode("etag", "utf-8").alias("content")), str(tmp_path)).collect()
    assert sorted((r["url"], bytes(r["content"])) for r in both) == [(other, b"old"), (one, b"new")]


def test_server(folder, spark):
    import urllib.error
    import urllib.parse
    import urllib.request

    from terrane import Geocoder
    from terrane.server import server

    at = server(spark, Geocoder(gazetteer.read(spark, str(folder / "gazetteer"))).geocode, 0)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{at.server_address[1]}"

    def got(path, **query):
        try:
            with urllib.request.urlopen(f"{root}{path}?{urllib.parse.urlencode(query)}") as r:
                return r.status, r.headers, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.headers, e.read().decode()

    status, headers, body = got("/geocode", address="東京都千代田区紀尾井町1-3", format="geojson")
    assert (status, headers["Access-Control-Allow-Origin"]) == (200, "*") and json.loads(body)["features"][0]["properties"]["rsdt_id"] == "003"
    assert headers["Content-Type"].startswith("application/json")
    status, headers, body = got("/geocode", address="東京都千代田区", format="csv")
    assert headers["Content-Type"].startswith("text/x-csv") and body.splitlines()[1].startswith('"東京都千代田区"')
    assert [got("/geocode", address="x", **q)[0] for q in ({"target": "y"}, {"format": "y"}, {"fuzzy": "yy"})] == [400] * 3
    assert got("/geocode", address=" ")[0] == 400 and got("/other")[0] == 404
    at.shutdown()


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown format"):
        sinks.formatted(spark.range(1).withColumnRenamed("id", "line_id"), "xml")
