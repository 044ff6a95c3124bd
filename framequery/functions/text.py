"""Text functions of the recognition path, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinels of the public output and the languages with a model of their own.
NO_TEXT, OCR_ERROR, EMPTY_CROP = "no_text_detected", "ocr_error", "empty_crop"
SERVER_LANGUAGES = ("ch", "chinese_cht", "japan")
OWN_LANGUAGES = ("en", "korean", "th", "el", "te", "ta")
#: Unicode blanks and the four information separators.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def language_model(language: Column) -> Column:
    low = F.lower(F.coalesce(language, F.lit("en")))
    return F.when(low.isin(*SERVER_LANGUAGES), F.lit("server")).when(low.isin(*OWN_LANGUAGES), low).otherwise(F.lit("latin"))


def status(text: Column, confidence: Column, threshold: float, strict: bool = False) -> Column:
    """The text, or the sentinel of why there is none. ``strict``: confidence must exceed the threshold."""
    enough = confidence > threshold if strict else confidence >= threshold
    return F.when(text.isNull(), F.lit(OCR_ERROR)).when((text != "") & enough, text).otherwise(F.lit(NO_TEXT))


def succeeded(text: Column) -> Column:
    return ~text.isin(NO_TEXT, EMPTY_CROP, OCR_ERROR)


def joined_lines(texts: Column, scores: Column, threshold: float) -> Column:
    """The lines that pass the threshold, squeezed and joined; NULL if none."""
    pairs = F.filter(F.arrays_zip(texts.alias("t"), scores.alias("s")), lambda p: (p["s"] > threshold) & (squeeze(p["t"]) != ""))
    text = squeeze(F.array_join(F.transform(pairs, lambda p: p["t"]), " "))
    return F.when(text != "", text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frame_file(n: Column) -> Column:
    return F.format_string("frame_%06d.png", n)


def without_wrapper(name: Column) -> Column:
    """Parameter name without the prefix of a data-parallel wrapper."""
    return F.regexp_replace(name, r"^module\.", "")
