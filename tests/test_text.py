import pytest

from terrane.functions import text as T
from terrane.functions.constants import VARIANTS


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("二十五丁目三十一番地", "25丁目31番地"),
        ("二十四軒三条一丁目", "24軒3条1丁目"),
        ("一神戸市一丁目", "一神戸市1丁目"),
        ("神戸市四百四十四丁目マンション三〇二号室", "神戸市四百44丁目マンション302号室"),
        ("飯川壱〇弐", "飯川102"),
    ],
)
def test_numerals(given, expected):
    assert T.kan2num(given) == expected


@pytest.mark.parametrize(("given", "expected"), [("ガギグゲゴ", "けぎぐけご"), ("ｶﾝｻﾞｷﾋﾞﾙ", "けんざきびる"), ("ゑヱ之", "ええの")])
def test_hiragana(given, expected):
    assert T.to_hiragana(given) == expected


@pytest.mark.parametrize(("given", "expected"), [("1@2@3号室", "1@2␣3号室"), ("482の2", "482@2"), ("3@8@15都営くすのき", "3@8@15␣都営くすのき")])
def test_space_before_room(given, expected):
    assert T.insert_space(given) == expected


def test_brackets():
    assert T.without_brackets("a(b(c)d)e「f") == "ae「f"


def test_columns(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("ＡＢ１２-３", "261114", "東京都千代田区糀町一丁目")], "a string, k string, j string").select(
        T.hankaku(F.col("a")), T.hash_key(F.col("k")), T.replaced_words(F.col("j"), VARIANTS), T.left_padded(F.lit("123456"), 5),
        T.levenshtein_ratio(F.lit("沖縄県那覇市"), F.lit("沖縄都那覇市")), T.levenshtein_ratio(F.lit(""), F.lit("")),
    ).first()
    assert row[:4] == ("AB12-3", 3587982500, "東京都千代田区麹町一丁目", "123456")
    assert row[4] == pytest.approx(0.83, abs=0.011)
    assert row[5] == 1.0
