"""Line-first cleaning, in DataFrame expressions alone.

Each line is judged by itself (punctuation, navigation, boilerplate, symbols, shouting, repetition); lines that fail are
removed, and a document is rejected if too much of its text went with them. Everything is computed within the row: no
shuffle, no Python, and memory in proportion to one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"

#: Phrases that mark a line as boilerplate in any of the languages handled (fixed values, all lower case).
BOILERPLATE = (
    "all rights reserved",
    "alle rechte vorbehalten",
    "tous droits réservés",
    "todos los derechos reservados",
    "click here",
    "cookie policy",
    "cookie settings",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "datenschutzerklärung",
    "politique de confidentialité",
    "política de privacidad",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
)

#: First words of short navigation lines (fixed values, all lower case).
NAVIGATION = ("home", "menu", "next", "previous", "back to top", "read more", "log in", "login", "sign in", "share", "skip to content", "search")

TERMINAL = "[.!?…:;\"”»’')\\]][ \\t\\r\\f\\x0B]*$"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def _removed_chars(line: Column, chars: str) -> Column:
    return F.char_length(line) - F.char_length(F.translate(line, chars, ""))


def line_passes(line: Column) -> Column:
    """True for a line of prose. A line is given as it stands between two \\n."""
    solid = F.char_length(F.translate(line, SPACES, ""))
    ends_well = line.rlike(TERMINAL)
    navigation = (_removed_chars(line, "|»›·•") >= 2) | F.lower(line).rlike("^[ \\t]*(" + "|".join(NAVIGATION) + ")([ \\t]+[^ \\t]+){0,3}[ \\t\\r]*$")
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    symbols = _removed_chars(line, SYMBOLS + "{}[]~^=_\\@") * 20 > solid
    shouting = (F.upper(line) == line) & (F.lower(line) != line) & (solid > 12)
    return ends_well & ~navigation & ~boilerplate & ~symbols & ~shouting


def clean_lines(documents: DataFrame, least_share: float = 0.5, run: int = 8, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, the cleaned text, the share of characters kept, and kept.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words describe the whole text (null: empty). base_failed holds
    for fewer than least_words words, or where more than repeat_percent % of the words lie in run-word windows found twice
    or more. cleaned_text has the lines that pass line_passes, each distinct line once; share is its part of the
    non-space characters. kept = not base_failed and share >= least_share.

    Null, empty and white-space texts have no words: base_failed. Lines without a word are dropped and count as nothing.
    Rows are judged one by one, so repeated rows give repeated results; an empty table gives an empty result. Other columns
    are ignored.
    """
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    d = d.select("doc_id", "_t", word_array(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"))
    at = F.when(F.size("_w") >= run, F.sequence(F.lit(1), F.size("_w") - (run - 1))).otherwise(F.array().cast("array<int>"))
    d = d.withColumns({"_h": F.transform(at, lambda i: F.xxhash64(F.slice("_w", i, run))), "_d": F.array_distinct("_l")})
    # positions of windows found twice or more: neighbours of equal hash in sorted order
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("_s")
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    zipped = F.arrays_zip(F.col("_s").alias("x"), F.concat(nothing, F.slice("_s", F.lit(1), n - 1)).alias("p"), F.concat(F.slice("_s", F.lit(2), n - 1), nothing).alias("q"))
    same = F.filter(zipped, lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(same, lambda z: z["x"]["i"]))))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(run), F.coalesce(b - a, F.lit(run))))
    repeat = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0))
    d = d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        _removed_chars(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size("_d")).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.array_join(F.filter("_d", line_passes), "\n").alias("cleaned_text"),
    )
    share = F.when(F.col("word_chars") > 0, F.char_length(F.translate("cleaned_text", SPACES, "")) / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    return d.withColumns({"base_failed": failed, "share": share}).withColumn("kept", ~F.col("base_failed") & (F.col("share") >= least_share))
