"""Text functions as column expressions, and the few that need a scan in Python.

Whatever a regular expression or a character map can say stays on the JVM. The
rest is plain Python on strings, applied to Arrow batches by `python_text`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.constants import BANGAICHI, DASH, DASHES, MUBANCHI, OAZA_BANCHO, OAZA_CENTER, SPACE
from terrane.functions.written import _ASCII, _WIDE, UNREADABLE, Written, bracketed, hiragana_text, kan2num, kana_map, normalised, numeral, spaced

__all__ = ["kan2num", "numeral"]


def hankaku(c: Column) -> Column:
    """Full-width letters and digits become ASCII."""
    return F.translate(c, _WIDE, _ASCII)


def to_hiragana(text: str) -> str:
    return hiragana_text(unicodedata.normalize("NFKC", text))


def hiragana(c: Column) -> Column:
    """The same map on the JVM, for text that is composed already."""
    m = kana_map()
    return F.translate(c, "".join(m), "".join(m.values()))


def to_katakana(text: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in unicodedata.normalize("NFKC", text))


def replaced_words(c: Column, table: Mapping[str, str]) -> Column:
    """Longest words first, then single characters in one pass: variant characters to standard ones.

    The table is a parameter, so that a registry can bring its own.
    """
    for k in sorted((k for k in table if len(k) > 1 or len(table[k]) != 1), key=lambda k: (-len(k), k)):
        c = F.replace(c, F.lit(k), F.lit(table[k]))
    one = {k: v for k, v in table.items() if len(k) == len(v) == 1}
    return F.translate(c, "".join(one), "".join(one.values())) if one else c


def insert_space(text: str) -> str:
    """A room or building apart from the number before it; `の` between numbers is a dash."""
    return spaced(Written(text)).text


def without_brackets(text: str) -> str:
    """Text in brackets goes, nested or not; a bracket that isn't closed stays."""
    return Written(text).without(bracketed(text)).text


def normalise(text: str, fuzzy: str | None = None) -> str:
    """An address line as the dictionaries spell it."""
    return normalised(text, fuzzy).text


def readable(c: Column, wild: str = "?") -> Column:
    """Runs of characters that no line has become a wild card."""
    return F.regexp_replace(c, UNREADABLE, wild)


def is_digit(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]$"), F.lit(False))


def is_kanji_numeral(c: Column) -> Column:
    return F.coalesce(c.rlike("^[壱一二ニ弐参三四五六七八ㇵハ九零十]$"), F.lit(False))


def trim_sentinels(c: Column) -> Column:
    """Leading and trailing sentinels go, repeated ones become one."""
    c = F.regexp_replace(c, f"^[{DASH}{SPACE}]+|[{DASH}{SPACE}]+$", "")
    return F.regexp_replace(F.regexp_replace(c, f"{DASH}+", DASH), f"{SPACE}+", SPACE)


def dash_unify(c: Column) -> Column:
    """A dash beside a digit becomes the sentinel."""
    marks = "[" + "".join(f"\\{x}" if x in "-" else x for x in DASHES) + "]"
    return F.regexp_replace(F.regexp_replace(c, f"([0-9]){marks}", f"$1{DASH}"), f"{marks}([0-9])", f"{DASH}$1")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Similarity with two decimals; two empty strings are equal."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(
        (100 - F.floor(F.lit(100.0) * F.levenshtein(a, b) / most)).cast("double") / F.lit(100.0)
    )


def left_padded(c: Column, width: int) -> Column:
    """Zeros on the left; what is longer stays whole."""
    c = c.cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def parcel_id(n1: Column, n2: Column, n3: Column, width: int = 5) -> Column:
    return F.concat(*(left_padded(F.coalesce(n.cast("string"), F.lit("0")), width) for n in (n1, n2, n3)))


def hash_key(c: Column) -> Column:
    """Unsigned 32-bit string hash: over the reversed characters, times 33, exclusive or."""
    codes = F.transform(F.filter(F.split(F.reverse(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(
        codes, F.lit(5381).cast("bigint"), lambda a, x: (a * 33).bitwiseAND(F.lit(4294967295).cast("bigint")).bitwiseXOR(x)
    )


def url_ordered(url: Column) -> Column:
    """A URL whose query parameters are put in order: what is equal in it is one URL."""
    query = F.array_join(F.array_sort(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")), "&")
    return F.concat(F.substring_index(url, "?", 1), F.lit("?"), query)


def url_key(url: Column) -> Column:
    """Hash of a URL whose query parameters are put in order. It has 32 bits only, so that different URLs can share it."""
    return F.lower(F.hex(hash_key(url_ordered(url))))


def record_crc(*columns: Column) -> Column:
    """CRC-32 in hexadecimal of a record's JSON, nulls included."""
    return F.lower(F.hex(F.crc32(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))))


def format_address(pref, county, city, ward, oaza, chome, koaza, aka, block, num, num2, n1, n2, n3, rest) -> Column:
    """One readable line from the parts of a match."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = F.concat(*map(blank, (pref, county, city, ward)))
    town = F.when(aka == 2, F.concat(blank(koaza), blank(oaza))).otherwise(F.concat(*map(blank, (oaza, chome, koaza))))
    some = lambda c: F.when(blank(c) != "", blank(c))
    lot = F.when(some(n1).isNull(), F.lit("")).otherwise(
        F.concat_ws("-", some(n1), some(n2), F.when(some(n2).isNotNull(), some(n3)))
    )
    number = F.when(lot != "", lot).otherwise(F.concat_ws("-", some(block), some(num), some(num2)))
    tail = F.when(blank(rest) != "", F.concat(F.when((number != "") & ~blank(rest).startswith("-"), F.lit(" ")).otherwise(F.lit("")), blank(rest))).otherwise(F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.concat(place, town, number, tail), " +", " "), "丁目-([0-9])", "丁目$1")


def restored(c: Column) -> Column:
    """Normalised text as people write it."""
    for token, word in ((OAZA_BANCHO, "番町"), (MUBANCHI, "無番地"), (BANGAICHI, "番外地"), (OAZA_CENTER, "センター")):
        c = F.replace(c, F.lit(token), F.lit(word))
    c = F.regexp_replace(c, "^(番地|号)", "")
    return F.trim(F.translate(c, DASH + SPACE, "- "))


def python_text(f):
    """A plain function on strings as an Arrow function on columns; null stays null."""

    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")
