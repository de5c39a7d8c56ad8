"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Defined results: a null text has no words and fails the base rules; a text without words too;
ratios over nothing are 0; very long texts are measured whole; repeated rows each get a row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the languages that the corpus is expected in.
STOP_WORDS = {
    "en": "the be to of and a in that have it is for on with as was at by this are or an from".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "le la les de des et en un une du que qui dans pour pas sur au par est avec il ce".split(),
    "es": "el la los las de que y en un una del se por con para su al lo como no es".split(),
}
#: (measure, least, most); a bound of None does not bind. A text is kept if it fails no row.
THRESHOLDS = (
    ("mean_word_length", 2.0, 20.0),
    ("symbol_ratio", None, 0.25),
    ("upper_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
)
#: The stop-word rule needs this many words to say anything.
STOP_WORDS_FROM = 50


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures() -> dict[str, Column]:
    """The measures that thresholds can name, over the columns that ``measured`` makes."""
    return {
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "upper_ratio": _ratio(F.col("n_upper"), F.col("n_letters")),
        "stop_word_ratio": F.when(F.col("n_words") >= STOP_WORDS_FROM, _ratio(F.col("n_stop"), F.col("n_words"))).otherwise(F.lit(1.0)),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": _ratio(F.col("n_bullets"), F.col("n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipses"), F.col("n_lines")),
    }


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression: no row fails."""
    named, ok = measures(), F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            ok = ok & (named[name] >= least)
        if most is not None:
            ok = ok & (named[name] <= most)
    return ok


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """The counts behind all measures, as columns beside the id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stops = sorted({f for ws in STOP_WORDS.values() for w in ws for f in (w, w[:1].upper() + w[1:])})
    gone = lambda c, chars: F.char_length(c) - F.char_length(F.translate(c, chars, ""))
    df = docs.withColumn("text_", text)
    df = df.withColumn("words_", F.filter(F.split("text_", C.BLANK_CLASS), lambda w: w != ""))
    df = df.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words_")
    df = df.select(
        *docs.columns,
        "words_",
        n.cast("long").alias("n_words"),
        F.char_length(F.translate("text_", C.BLANKS, "")).cast("long").alias("word_chars"),
        gone(F.col("text_"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words_", lambda w: w.isin(stops))).alias("n_stop"),
        F.char_length(F.regexp_replace("text_", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.char_length(F.regexp_replace("text_", r"[^\p{L}]+", "")).alias("n_letters"),
        F.size(F.filter("lines_", lambda x: x.rlike(r"^\s*[-*•·]"))).alias("n_bullets"),
        F.size(F.filter("lines_", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipses"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words_", i, WINDOW)))).otherwise(F.array().cast("array<long>")).alias("windows_"),
    ).drop("words_")
    # only texts with a repeated window are sorted; then runs of equal hashes give their places
    again = F.size(F.array_distinct("windows_")) < F.size("windows_")
    none = F.array().cast("array<struct<h:long,i:int>>")
    df = df.withColumn("sorted_", F.when(again, F.array_sort(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("windows_")
    twice = F.filter("sorted_", lambda x, i: F.coalesce(F.get("sorted_", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted_", i + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("sorted_")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per input row: id_col, the counts, base_failed and kept."""
    df = measured(docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").cast("string").alias("in_")), "in_").drop("in_")
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
    return df.select(F.col("id_").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop", "n_upper", "n_letters")


def oracle() -> str:
    """The same rules over ``documents`` as DuckDB SQL, made from the same tables."""
    stops = sorted({f for ws in STOP_WORDS.values() for w in ws for f in (w, w[:1].upper() + w[1:])})
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    named = {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "upper_ratio": ratio("n_upper", "n_letters"),
        "stop_word_ratio": f"CASE WHEN n_words >= {STOP_WORDS_FROM} THEN {ratio('n_stop', 'n_words')} ELSE 1.0 END",
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullets", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipses", "n_lines"),
    }
    rules = [f"({named[n]}) >= {least}" for n, least, _ in THRESHOLDS if least is not None] + [f"({named[n]}) <= {most}" for n, _, most in THRESHOLDS if most is not None]
    words = ", ".join(f"'{w}'" for w in stops)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({words}))) AS n_stop,
         length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•·]'))) AS n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipses
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(rules)} AS kept FROM f
"""
