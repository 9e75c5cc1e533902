"""Queries over text functions: lines are made of the tables' numbers and names, and
the SQL says what must come of them without repeating the rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.functions import written as W
from terrane.functions.constants import VARIANTS
from terrane.queries import _table, query


def _parts(spark, d):
    return _table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("m"), F.col("p_partkey").cast("string").alias("n"))


def _kanji(c: Column) -> Column:
    return F.translate(c, "0123456789", "〇一二三四五六七八九")


def _wide(c: Column) -> Column:
    return F.translate(c, "0123456789", "０１２３４５６７８９")


def _made(spark, d, f, *parts):
    made = F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return _parts(spark, d).select("p_partkey", T.python_text(f)(made).alias("text"))


def _normal(text: str) -> str:
    return W.normalised(text).text


_FROM = "(select p_partkey, p_name, cast(p_size as varchar) as m, cast(p_partkey as varchar) as n from part) p"


@query(f"select p_partkey, '神戸' || n || '丁目' as text from {_FROM}")
def numerals_in_place(spark, d):
    return _made(spark, d, T.kan2num, "神戸", _kanji(F.col("n")), "丁目")


@query("select p_partkey, '東' || cast(p_size + 10 as varchar) || '条' as text from part")
def numerals_with_ten(spark, d):
    size = F.col("p_size") + 10
    ten = F.when(size >= 20, _kanji(F.floor(size / 10).cast("string"))).otherwise(F.lit(""))
    one = F.when(size % 10 > 0, _kanji((size % 10).cast("string"))).otherwise(F.lit(""))
    text = F.concat(F.lit("東"), ten, F.lit("十"), one, F.lit("条"))
    return _table(spark, d, "part").select("p_partkey", T.python_text(T.kan2num)(text).alias("text"))


@query(f"select p_partkey, translate(n, '0123456789', '〇一二三四五六七八九') || '万' as text from {_FROM}")
def numerals_that_stay(spark, d):
    return _made(spark, d, T.kan2num, _kanji(F.col("n")), "万")


# Syllables by their place in the blocks of kana; those that names write alike, and small ones, are left out.
_SYLLABLES = "あいうえおきぎくぐこごさざしじすずせぜそぞただちぢつづてでとど"


@query(f"select p_partkey, substr('{_SYLLABLES}', cast(p_partkey % {len(_SYLLABLES)} as int) + 1, 1) || 'ん' as text from part")
def katakana_to_hiragana(spark, d):
    at = F.expr(f"substr('{_SYLLABLES}', cast(p_partkey % {len(_SYLLABLES)} as int) + 1, 1)")
    wide = T.python_text(lambda t: "".join(chr(ord(c) + 0x60) for c in t))(F.concat(at, F.lit("ん")))
    return _table(spark, d, "part").select("p_partkey", T.hiragana(wide).alias("text"))


@query("select p_partkey, chr(cast(12450 + p_partkey % 80 as int)) as text from part")
def hiragana_to_katakana(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.python_text(lambda t: T.to_katakana(chr(12354 + int(t))))((F.col("p_partkey") % 80).cast("string")).alias("text"))


@query(f"select p_partkey, n || '@' || m || '@7␣都営' as text from {_FROM}")
def space_before_building(spark, d):
    return _made(spark, d, T.insert_space, F.col("n"), "@", F.col("m"), "@7都営")


@query(f"select p_partkey, n || '@2␣' || m || '号室' as text from {_FROM}")
def space_before_room(spark, d):
    return _made(spark, d, T.insert_space, F.col("n"), "@2@", F.col("m"), "号室")


@query(f"select p_partkey, p_name || m as text from {_FROM}")
def brackets_ignored(spark, d):
    return _made(spark, d, T.without_brackets, F.col("p_name"), "(", F.col("n"), "「x」)", F.col("m"), "[y]")


@query(f"select p_partkey, p_name || '?' || n || '?' as text from {_FROM}")
def unreadable_to_wild_card(spark, d):
    return _parts(spark, d).select("p_partkey", T.readable(F.concat("p_name", F.lit("éü"), "n", F.lit("☃"))).alias("text"))


@query(f"select p_partkey, case when length(m) = 1 then true else false end as digit, length(m) = 1 and m <> '0' as kanji from {_FROM}")
def character_kinds(spark, d):
    return _parts(spark, d).select("p_partkey", T.is_digit(F.col("m")).alias("digit"), T.is_kanji_numeral(_kanji(F.col("m"))).alias("kanji"))


@query(f"select p_partkey, '東京都␣千代田区' || n || '@' || m as text from {_FROM}")
def normalise_width_and_dash(spark, d):
    return _made(spark, d, _normal, "東京都　千代田区", _wide(F.col("n")), "−", _wide(F.col("m")))


@query(f"select p_partkey, '神田' || n || '@' || m || '@3' as text from {_FROM}")
def normalise_counted(spark, d):
    return _made(spark, d, _normal, "神田 ", F.col("n"), "丁目", F.col("m"), "番地3号")


@query(f"select p_partkey, '神田' || n || '@' || m || '@␣びる' as text from {_FROM}")
def normalise_kanji_numbers(spark, d):
    return _made(spark, d, _normal, "神田", _kanji(F.col("n")), "番", _kanji(F.col("m")), "号　ビル")


@query(f"select p_partkey, '港' || n || '@5' as text from {_FROM}")
def normalise_one_as_dash(spark, d):
    return _made(spark, d, _normal, "港", F.col("n"), "一5")


@query(f"select p_partkey, '<OB>' || n || '@' || m as text from {_FROM}")
def normalise_tokens(spark, d):
    return _made(spark, d, _normal, "字番町", F.col("n"), "の", F.col("m"))


@query(f"select p_partkey, '桜通会' || n as text from {_FROM}")
def normalise_variants(spark, d):
    return _made(spark, d, _normal, "櫻通曾", F.col("n"), "番地")


@query(f"select p_partkey, '北' || n || '@西2@' || m as text from {_FROM}")
def normalise_bearings(spark, d):
    return _made(spark, d, _normal, "北", F.col("n"), "条西2-", F.col("m"))


@query(f"select p_partkey, '大沢' || n || '@' || m as text from {_FROM}")
def normalise_parts_of_land(spark, d):
    return _made(spark, d, _normal, "三宅島大沢第", F.col("n"), "地割", F.col("m"))


@query(f"select p_partkey, '緑が丘' || n || '@' || m as text from {_FROM}")
def town_spelling(spark, d):
    return _made(spark, d, W.town_text, "大字緑が丘", _kanji(F.col("n")), "丁目", F.col("m"), "番地")


@query(f"select p_partkey, n || '@4条通' as text from {_FROM}")
def street_spelling(spark, d):
    return _made(spark, d, W.street_text, F.col("n"), "丁目四条通")


@query("select p_partkey, case p_partkey % 4 when 0 then '楠' when 1 then '桜' when 2 then '広島' else '雲雀' end || p_name as text from part")
def variant_words(spark, d):
    given = F.element_at(F.array(*map(F.lit, ("楠木", "櫻", "廣島", "鸙"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", T.replaced_words(F.concat(given, "p_name"), VARIANTS).alias("text"))


@query(f"select p_partkey, 'ﾋﾞﾙ ' || m || 'Ｆ（南）' as text from {_FROM}")
def end_as_written(spark, d):
    """What follows the number, as it was written, found from how it was spelled."""

    def end(line: str) -> str:
        return W.end_as_written(line, W.normalised(line).text.split("␣", 1)[1])

    return _made(spark, d, end, "東京都千代田区", F.col("n"), "丁目2番地 ﾋﾞﾙ ", F.col("m"), "Ｆ（南）")


@query(f"select p_partkey, case when p_partkey % 3 = 0 then '-' || n when p_partkey % 3 = 1 then n || '-' || m else '無番地' || n end as text from {_FROM}")
def restored_ends(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("番地"), "n")).when(k == 1, F.concat("n", F.lit("の"), "m")).otherwise(F.concat(F.lit("<MB>"), "n"))
    return _parts(spark, d).select("p_partkey", T.python_text(W.restored_text)(text).alias("text"))


_HASH = "list_reduce(list_prepend(5381::bigint, list_transform(range(length({u})::bigint), lambda i: ord(reverse({u})[i + 1])::bigint)), lambda a, x: xor((a * 33) & 4294967295, x))"


@query(f"select n_nationkey, lower(to_hex({_HASH.format(u='u')})) as key from (select n_nationkey, 'https://h.example/' || n_name || '.zip?a=1&b=' || n_nationkey as u from nation) x")
def url_keys(spark, d):
    url = F.concat(F.lit("https://h.example/"), "n_name", F.lit(".zip?b="), F.col("n_nationkey"), F.lit("&a=1"))
    return _table(spark, d, "nation").select("n_nationkey", T.url_key(url).alias("key"))
