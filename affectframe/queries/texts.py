"""Cleaning and text filters, over whole texts of all languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.constants import (
    CELEBRATION_PATTERNS,
    EVENT_KEYWORDS,
    MEMORIAL_PATTERNS,
    PICTOGRAPH_RANGES,
)
from affectframe.functions import text as cleaning
from affectframe.functions.once import with_column_once
from affectframe.functions.predicates import is_ceremonial, mentions_any
from affectframe.functions.text import preview, slug
from affectframe.functions.times import parse_post_date
from affectframe.operators.filters import drop_ceremonial, drop_events, drop_short
from affectframe.operators.ranking import first_per_label, sample_per_group as sample, sample_report
from affectframe.operators.split import rename
from affectframe.plans.collect import eligible
from affectframe.queries.registry import documents, query, table
from affectframe.sources.readers import full_text

# What invented prose lacks: marks of reposts, addresses, names, signs and short words.
_BEFORE = "RT @author_{id}: rt  ve MÜ ab "
_AFTER = " see https://t.co/a1{id} (www.example.org/p?q=%20{id}) ❤️ \U0001F600 #tag{id} 漢 mail a.b@c.org ki!\n"


def _decorated(spark: SparkSession, sf: str) -> DataFrame:
    def filled(template: str) -> list[Column]:
        first, *others = [F.lit(part) for part in template.split("{id}")]
        return [first] + [c for part in others for c in (F.col("doc_id").cast("string"), part)]

    text = F.concat(*filled(_BEFORE), F.col("text"), *filled(_AFTER))
    return documents(spark, sf, "doc_id", "text").select("doc_id", text.alias("text"))


def _sql_text(template: str) -> str:
    parts = ["'" + part.replace("\n", "' || chr(10) || '") + "'" for part in template.split("{id}")]
    return " || doc_id || ".join(parts)


DECORATED = f"""decorated AS (
  SELECT doc_id, {_sql_text(_BEFORE)} || text || {_sql_text(_AFTER)} AS text FROM documents)"""

# RE2 has no look-around: a word is matched with its neighbours, twice, because
# two words in a row share the sign between them.
_W = r"\p{L}\p{N}_"
_S = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
_URL = r"[a-z!$-_]+"
_PICTOGRAPHS = "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in PICTOGRAPH_RANGES)


def _sql_replace(value: str, *steps: tuple[str, str]) -> str:
    for pattern, replacement in steps:
        value = f"regexp_replace({value}, '{pattern}', '{replacement}', 'g')"
    return value


_REPOST_SQL = [(rf"(^|[^{_W}])[Rr][Tt][{_S}]*@[A-Za-z0-9_]+:?[{_S}]*", r"\1")] + 2 * [
    (rf"(^|[^{_W}])[Rr][Tt]($|[^{_W}])", r"\1\2")
]
_URL_SQL = [(f"https?://{_URL}", ""), (rf"www\.{_URL}", ""), (r"t\.co/[a-zA-Z0-9]+", "")]
_MENTION_SQL = [("@[A-Za-z0-9_]+:?", ""), ("@[A-Za-z0-9_]+", "")]
_EMOJI_SQL = [(f"[{_PICTOGRAPHS}]+", "")]
_SPACE_SQL = [(f"[{_S}]+", " ")]
_SPECIAL_SQL = [(rf"[^{_W}{_S}.,!?\-]", "")]


def _sql_words(value: str) -> str:
    return f"""array_to_string(list_filter(regexp_split_to_array({value}, '[{_S}]+'),
      lambda w: length(w) > 2 OR lower(w) IN ('ve', 'ya', 'da', 'ki', 'mi', 'mu', 'mü')), ' ')"""


_CLEAN_SQL = _sql_words(_sql_replace(
    "text", *_REPOST_SQL, *_URL_SQL, *_MENTION_SQL, ("#([A-Za-z0-9_]+)", r"\1"),
    *_EMOJI_SQL, *_SPACE_SQL, *_SPECIAL_SQL,
))


@query(f"WITH {DECORATED} SELECT doc_id, {_CLEAN_SQL} AS text FROM decorated")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _decorated(spark, sf).select("doc_id", cleaning.clean_text(F.col("text")).alias("text"))


def _applied(spark: SparkSession, sf: str, step) -> DataFrame:
    return _decorated(spark, sf).select("doc_id", step(F.col("text")).alias("text"))


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_replace('text', *_REPOST_SQL)} AS text FROM decorated")
def strip_repost_marks(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.strip_repost_marks)


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_replace('text', *_URL_SQL)} AS text FROM decorated")
def strip_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.strip_urls)


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_replace('text', *_MENTION_SQL)} AS text FROM decorated")
def strip_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.strip_mentions)


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_replace('text', ('#([A-Za-z0-9_]+)', chr(92) + '1'))} AS text FROM decorated")
def unwrap_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.unwrap_hashtags)


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_replace('text', *_EMOJI_SQL)} AS text FROM decorated")
def strip_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.strip_emoji)


@query(f"WITH {DECORATED} SELECT doc_id, trim({_sql_replace('text', *_SPACE_SQL)}) AS text FROM decorated")
def collapse_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.collapse_whitespace)


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_replace('text', *_SPECIAL_SQL)} AS text FROM decorated")
def strip_special(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.strip_special)


@query(f"WITH {DECORATED} SELECT doc_id, {_sql_words('text')} AS text FROM decorated")
def short_words(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, cleaning.drop_short_words)


# A phrase per language makes the default word lists bite on invented prose.
_PHRASES = {"de": "Büyük miting bugün", "es": "bir ziyaret. 19 Mayıs", "fr": "saygılar, kutlu olsunlar"}


def _phrased(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.lit("iyi kiler")
    for lang, words in _PHRASES.items():
        phrase = F.when(F.col("lang") == lang, words).otherwise(phrase)
    return with_column_once(
        documents(spark, sf, "doc_id", "text", "lang"), "text", F.concat("text", F.lit(" "), phrase)
    )


PHRASED = "phrased AS (SELECT doc_id, lang, text || ' ' || CASE lang " + " ".join(
    f"WHEN '{lang}' THEN '{words}'" for lang, words in _PHRASES.items()
) + " ELSE 'iyi kiler' END AS text FROM documents)"


@query(f"WITH {PHRASED} SELECT doc_id FROM phrased WHERE NOT ("
       + " OR ".join(f"contains(lower(text), '{k}')" for k in EVENT_KEYWORDS) + ")")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return drop_events(_phrased(spark, sf), "text").select("doc_id")


@query(f"""WITH {PHRASED} SELECT doc_id FROM phrased WHERE NOT regexp_matches(lower(text),
  '(^|[^{_W}])({'|'.join(MEMORIAL_PATTERNS + CELEBRATION_PATTERNS)})($|[^{_W}])')""")
def ceremonial_filter(spark: SparkSession, sf: str) -> DataFrame:
    return drop_ceremonial(_phrased(spark, sf), "text").select("doc_id")


@query(f"""SELECT doc_id,
  contains(lower(text), 'tion the') OR contains(lower(text), 'elle') AS announces,
  regexp_matches(lower(text), '(^|[^{_W}])(the|une elle|de[rn])($|[^{_W}])') AS ceremonial
FROM documents""")
def custom_word_lists(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        mentions_any(text, ["tion the", "elle"]).alias("announces"),
        is_ceremonial(text, ["the", "une elle", "de[rn]"]).alias("ceremonial"),
    )


@query(f"""SELECT doc_id FROM documents
WHERE len(list_filter(regexp_split_to_array(text, '[^{_W}]+'), lambda x: x <> '')) >= 40""")
def short_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    return drop_short(documents(spark, sf, "doc_id", "text"), "text", 40).select("doc_id")


@query(f"""WITH {DECORATED}, cleaned AS MATERIALIZED (SELECT doc_id, {_CLEAN_SQL} AS text FROM decorated)
SELECT doc_id, length(text) AS characters FROM cleaned
WHERE len(list_filter(regexp_split_to_array(text, '[^{_W}]+'), lambda x: x <> '')) >= 40
  AND NOT contains(lower(text), 'elle')""")
def clean_and_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The filters of the cleaning job see the cleaned text, computed once per row."""
    cleaned = with_column_once(_decorated(spark, sf), "text", cleaning.clean_text(F.col("text")))
    kept = drop_short(drop_events(cleaned, "text", ["elle"]), "text", 40)
    return kept.select("doc_id", F.length("text").cast("bigint").alias("characters"))


@query("""WITH posts AS (
  SELECT conv_id, turn, role, TIMESTAMP '2020-12-30 00:00:00' + to_hours(conv_id::INT) AS moment FROM conversations)
SELECT conv_id, turn FROM posts
WHERE moment >= TIMESTAMP '2020-12-31 21:00:00' AND role <> 'assistant' AND turn < 3""")
def repost_reply_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible posts: an assistant's turn is a repost, a late turn a reply."""
    at = F.timestamp_add("HOUR", F.col("conv_id").cast("int"), F.lit("2020-12-30").cast("timestamp"))
    talk = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.when(F.col("role") == "assistant", "RT @").otherwise("rt @"), F.col("text")).alias("Text"),
        F.date_format(at, "EEE MMM dd HH:mm:ss +0000 yyyy").alias("Date"),
        F.when(F.col("turn") >= 3, F.col("conv_id")).alias("in_reply_to_status_id"),
    )
    dated = talk.withColumn("ts", parse_post_date(F.col("Date")))
    return eligible(dated, F.col("ts"), zone="Europe/Istanbul").select("conv_id", "turn")


@query("""SELECT upper(lang) AS heading,
  row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id)::INT AS ordinal,
  left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview
FROM documents QUALIFY ordinal <= 5""")
def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return sample_report(sample(table(spark, sf, "documents"), "lang", 5, id="doc_id"), "lang", "text")


@query("""SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS ordinal,
  CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS label_position
FROM documents WHERE lang IN ('fr', 'de') QUALIFY ordinal <= 5""")
def first_rows_per_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = first_per_label(
        table(spark, sf, "documents"), ["fr", "de", "none"], 5, label="lang", id="doc_id"
    )
    return rows.select("lang", "doc_id", "ordinal", "label_position")


@query("""SELECT doc_id, lower(replace('Topic ' || source, ' ', '_')) AS slug,
  coalesce(CASE WHEN quality = 1 THEN text END, lang) AS body_start, lang AS labels
FROM (SELECT d.doc_id, d.source, d.lang, left(d.text, 150) || CASE WHEN length(d.text) > 150 THEN '...' ELSE '' END AS text, quality
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Slug, preview, preferred text and a renamed column."""
    documents = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    two_texts = documents.withColumns({
        "full_text": F.when(F.col("quality") == 1, preview(F.col("text"), 150)), "text": F.col("lang"),
    })
    chosen = rename(full_text(two_texts), "lang", "labels")
    return chosen.select(
        "doc_id",
        slug(F.concat(F.lit("Topic "), F.col("source"))).alias("slug"),
        F.col("Text").alias("body_start"),
        "labels",
    )
