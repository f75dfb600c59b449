"""Quality rules: counts that a document must meet, and divergence from its language.

Base rules: a document fails with under ``min_words`` words, or if over half of its
words stand in three-word windows that occur twice or more in it.

Divergence: a document's histogram of character classes and its histogram of common
words of its language (``COMMON``, and all other words as one) are compared, by the
Jensen-Shannon distance to base 2, with the same histograms summed over all documents of
its language that meet the base rules, of however many there are. Texts shorter than ``min_chars`` characters are not judged by
classes and those of under ``divergence_words`` words not by words, since their histograms say too little.

Words are runs of anything but space and the characters 9 to 13. A three-word
window is known by the XXH64 of its words, 64 bits, within one document.

Null or empty text has no words and fails. A null language counts as an empty one, for
which only character classes are compared, as for any language without a
list. Repeated rows are judged alike; no rows give none. Columns that are carried along may have any names: they
stand in one structure until the end; :func:`judged` leaves out those that have the name of a result, :func:`kept_rows`
none. The work is DataFrame expressions
alone: one pass over the texts, a table in the shared folder, and sums by language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import stored, work_dir

SPACES = " \t\n\x0b\x0c\r"
#: Common words of four languages.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "para", "no"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
#: Character classes beside white space; what is left are small letters.
CLASSES = {"capitals": "[A-Z]+", "digits": "[0-9]+", "marks": "[!-/:-@\\[-`{-~]+", "beyond_ascii": "[^\\x00-\\x7F]+"}
#: Languages (some 200 bytes each) up to which their references are sent to all executors; beyond, both sides are shuffled.
BROADCAST_LANGUAGES = 10_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(text: Column, pattern: str) -> Column:
    """The number of characters that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return F.size(lines) - F.size(F.array_distinct(lines))


def _among(listed: list[str]) -> Callable[[Column], Column]:
    return lambda word: word.isin(listed)


def features(docs: DataFrame, extra: list[str]) -> DataFrame:
    """The ``extra`` columns as the structure ``_row``, the base counts, the length and both histograms (arrays) of each document.

    Each step is a projection of its own, whose columns the next one uses more
    than once, so nothing is computed twice.
    """
    none, text = F.array().cast("array<string>"), F.coalesce(docs["text"], F.lit(""))
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    row = F.struct(*(docs[c] for c in extra)) if extra else F.struct(F.lit(0))
    held = docs.select(row.alias("_row"), F.coalesce(lang, F.lit("")).alias("_lang"), text.alias("_text"), F.btrim(text, F.lit(SPACES)).alias("_inner"))
    words = F.when(F.length("_inner") == 0, none).otherwise(F.split("_inner", "[\\x20\\x09-\\x0D]+"))
    # what is neither a small letter nor white space is looked at class by class
    rest = F.regexp_replace("_text", "[a-z\\x20\\x09-\\x0D]+", "")
    held = held.select("_row", "_lang", "_text", words.alias("_words"), rest.alias("_rest"))
    last = F.size("_words") - 3
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    windows = F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), window))
    common = none
    for lang, listed in COMMON.items():
        common = F.when(F.col("_lang") == lang, F.filter("_words", _among(listed))).otherwise(common)
    held = held.select(
        "_row",
        "_lang",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length("_text").cast("bigint").alias("_length"),
        _covered(F.col("_rest"), "[#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        _dup_lines(F.col("_text")).cast("bigint").alias("n_dup_lines"),
        *(_covered(F.col("_rest"), p).cast("bigint").alias(f"_{name}") for name, p in CLASSES.items()),
        F.length("_rest").cast("bigint").alias("_other"),
        windows.alias("_windows"),
        common.alias("_common"),
    )
    # (hash, place) in order of the hash, where any hash is there twice
    pairs = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    held = held.withColumn("_pairs", pairs).drop("_windows")
    again = F.filter("_pairs", lambda x, j: F.get("_pairs", j + 1)["h"].eqNullSafe(x["h"]) | F.get("_pairs", j - 1)["h"].eqNullSafe(x["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(places, zero, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(3), i - a["last"])).alias("total")), lambda a: a["total"])
    stop = none
    for lang, listed in COMMON.items():
        stop = F.when(F.col("_lang") == lang, F.array(*map(F.lit, listed))).otherwise(stop)
    counted = F.transform(stop, lambda w: (F.size("_common") - F.size(F.array_remove("_common", w))).cast("bigint"))
    spaces = F.col("_length") - F.col("word_chars")
    return held.select(
        "_row",
        "_lang",
        *BASE[:-1],
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "_length",
        F.array(F.col("word_chars") - F.col("_other"), spaces, *(F.col(f"_{name}") for name in CLASSES)).alias("_chars"),
        F.concat(counted, F.array(F.col("n_words") - F.size("_common"))).alias("_told"),
    )


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance to base 2 of two arrays of counts; null if either has none."""
    total_p, total_q = (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) for x in (p, q))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(F.transform(p, lambda x: x / total_p), F.transform(q, lambda x: x / total_q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, b: a + b))))


def _judged(docs: DataFrame, extra: list[str], min_words: int, min_chars: int, divergence_words: int, class_distance: float, word_distance: float) -> DataFrame:
    folder = work_dir(docs.sparkSession, "quality")
    held = stored(features(docs, extra), f"{folder}/features")
    size = len(CLASSES) + 2
    most = max(map(len, COMMON.values())) + 1
    at = [F.coalesce(F.sum(F.get("_chars", F.lit(i))), F.lit(0)).cast("double") for i in range(size)]
    words = [F.sum(F.get("_told", F.lit(i))).cast("double") for i in range(most)]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    references = held.where(~failed).groupBy("_lang").agg(F.array(*at).alias("_chars_ref"), F.filter(F.array(*words), lambda x: x.isNotNull()).alias("_told_ref"))
    references = stored(references, f"{folder}/references")
    compared = held.join(F.broadcast(references) if references.count() <= BROADCAST_LANGUAGES else references, "_lang", "left")
    by_class = F.when(F.col("_length") >= min_chars, distance(F.transform("_chars", lambda x: x.cast("double")), F.col("_chars_ref")))
    by_word = F.when((F.col("n_words") >= divergence_words) & (F.size("_told") > 1), distance(F.transform("_told", lambda x: x.cast("double")), F.col("_told_ref")))
    compared = compared.select("_row", *BASE, by_class.alias("class_distance"), by_word.alias("word_distance"), failed.alias("base_failed"))
    close = (F.coalesce("class_distance", F.lit(0.0)) <= class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= word_distance)
    return compared.withColumn("kept", ~F.col("base_failed") & close)


def judged(docs: DataFrame, extra: list[str], min_words: int = 50, min_chars: int = 200, divergence_words: int = 100, class_distance: float = 0.29, word_distance: float = 0.295) -> DataFrame:
    """``extra`` columns, the base counts, both distances, base_failed and kept."""
    results = [*BASE, "class_distance", "word_distance", "base_failed", "kept"]
    carried = [c for c in extra if c.lower() not in results]
    found = _judged(docs, carried, min_words, min_chars, divergence_words, class_distance, word_distance)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in carried), *results)


def kept_rows(docs: DataFrame, min_words: int = 50, min_chars: int = 200, divergence_words: int = 100, class_distance: float = 0.29, word_distance: float = 0.295) -> DataFrame:
    """The rows of ``docs`` that are kept, as they were."""
    found = _judged(docs, docs.columns, min_words, min_chars, divergence_words, class_distance, word_distance)
    return found.where("kept").select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
