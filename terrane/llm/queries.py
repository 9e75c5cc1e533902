"""The registered queries of this package, over the whole table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, fingerprint, mixing, near_dedup, pii, quality, rules, secrets, sharding, token_files
from terrane.llm.common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), near_dedup.Plan(shingle=3, percent=85))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), shards=40)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ruled(documents(spark, sf_dir))


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(documents(spark, sf_dir))


def op7_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_back(token_files.written(documents(spark, sf_dir)))


def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_spans(documents(spark, sf_dir)).drop("n_term")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_near_dedup,
        op3_virtual_slots,
        op4_quality_classifier,
        op5_adaptive_rules,
        op6_bottom_k,
        op7_streaming_bpe,
        op8_temperature_mixing,
        op9_token_files,
        op10_disclosure_pii,
    )
}

_CUT = "({v} >> greatest(length(ltrim(cast(cast({v} as bit) as varchar), '0')) - 6, 0)) << greatest(length(ltrim(cast(cast({v} as bit) as varchar), '0')) - 6, 0)"


def _fences(name: str, keys: str) -> str:
    """Fences by keys from the values themselves: tenths of cut values, counted row by row."""
    by = f"{keys}, " if keys else ""
    cases = lambda what: "case k " + " ".join(f"when '{k}' then {what(spread, low)}" for k, (_, spread, low) in rules.STATISTICS.items()) + " end"
    least, both = cases(lambda spread, _: spread), cases(lambda _, low: str(low).lower())
    wide = rules.WIDE
    return f"""{name} as (select {by}k, n, case when {both} then t1 - {wide} * greatest(t5 - t1, {least}) else -1 end as low, t9 + {wide} * greatest(t9 - t5, {least}) as high from (
 select {by}k, max(n) as n, min(v) filter (10 * r >= n) as t1, min(v) filter (10 * r >= 5 * n) as t5, min(v) filter (10 * r >= 9 * n) as t9 from (
 select {by}k, v, row_number() over (partition by {by}k order by v) as r, count(*) over (partition by {by}k) as n from cut) x group by {by}k) y)"""


#: The whole of op5 in plain SQL: counts of whole texts, tenths of each group, verdicts.
_RULES = f"""with texts as (select doc_id, lang, source, coalesce(text, '') as text from documents),
 worded as (select doc_id, lang, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts),
 windows as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from worded where len(w) >= 8) x),
 twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from windows) x where n > 1),
 repeats as (select doc_id, count(*) as n from (select distinct doc_id, i + k as at from twice, range(8) as r(k)) x group by doc_id),
 counts as (select d.doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
 len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(r.n, 0) as n_repeat_words from worded d left join repeats r on r.doc_id = d.doc_id),
 based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts),
 long as (select doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as k, unnest([1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
 1000 * n_repeat_words // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)]) as v from based),
 cut as (select lang, source, k, {_CUT.format(v="v")} as v from long where not base_failed),
 {_fences("own", "lang, source")}, {_fences("spoken", "lang")}, {_fences("whole", "")},
 judged as (select l.doc_id, bool_and(coalesce(v >= case when o.n >= {rules.MIN_ROWS} then o.low when s.n >= {rules.MIN_ROWS} then s.low else w.low end
 and v <= case when o.n >= {rules.MIN_ROWS} then o.high when s.n >= {rules.MIN_ROWS} then s.high else w.high end, true)) as fits from long l
 left join own o on o.lang is not distinct from l.lang and o.source is not distinct from l.source and o.k = l.k left join spoken s on s.lang is not distinct from l.lang and s.k = l.k left join whole w on w.k = l.k group by l.doc_id)
 select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and fits as kept from based b join judged j on j.doc_id = b.doc_id"""

ORACLE_SQL: dict[str, str] = {"op5_adaptive_rules": _RULES}
