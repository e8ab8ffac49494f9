"""Text functions: ASCII-only case folding, names, paths, sizes."""

from __future__ import annotations

import math
import string
import unicodedata
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as SQLite's LIKE and NOCASE fold."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def contains_ascii_ci(c: Column, text: str) -> Column:
    return ascii_lower(c).contains(ascii_lower(F.lit(text)))


def escape_like(text: str) -> str:
    """A LIKE pattern that matches ``text`` itself (escape character ``\\``)."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def normalize_text(text: str) -> str:
    """Lower case without diacritics; the two French ligatures are spelled out."""
    if text.isascii():
        return text.lower()
    bare = (c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return "".join({"œ": "oe", "æ": "ae"}.get(c, c) for c in bare)


def normalize_column() -> Any:
    """``normalize_text`` as an Arrow UDF, null for null."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(normalize_text, na_action="ignore")

    return run


def format_person_name(c: Column) -> Column:
    """Words of the trimmed name with their first character in upper case, the rest as it is."""
    words = F.filter(F.split(F.trim(c), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def sanitize_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def folder_display_name(c: Column) -> Column:
    """Last segment of a path, or the whole path if that is empty."""
    last = F.substring_index(c, "/", -1)
    return F.when(last == "", c).otherwise(last)


def format_file_size(c: Column) -> Column:
    """B to TB on base 1024 with one decimal; nothing or less is ``0 B``."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    power = F.least(F.floor(F.log(c.cast("double")) / math.log(1024) + 1e-12), F.lit(4)).cast("int")
    return F.when(c > 0, F.concat(F.format_string("%.1f ", c / F.pow(F.lit(1024.0), power)), F.get(units, power))).otherwise("0 B")


def format_number(c: Column) -> Column:
    return F.format_number(c, 0)


#: Fixed display names of media types 0 to 8.
MEDIA_LABELS = ("Other", "Photo", "Selfie", "Panorama", "Burst", "Screenshot", "Document", "Social", "Square")


def media_type_label(c: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, MEDIA_LABELS)), c), F.lit("Undefined"))


def detect_media_type(name: Column, path: Column, width: Column, height: Column, make: Column, model: Column) -> Column:
    """Media type from names, then from dimensions and camera; rules in order of precedence."""
    n, p = F.lower(name), F.lower(F.coalesce(path, F.lit("")))
    ratio = width.cast("float") / F.nullif(height, F.lit(0)).cast("float")
    side = F.when(ratio < 1, F.lit(1.0).cast("float") / F.nullif(ratio, F.lit(0.0).cast("float"))).otherwise(ratio).cast("float")
    sized = width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0)
    front = F.coalesce(F.lower(model).contains("front"), F.lit(False))
    return (
        F.when(_any(n, ("screenshot",)) | _any(p, ("screenshots",)), 5)
        .when(_any(p, ("scan", "office lens")), 6)
        .when(_any(p, ("whatsapp", "signal", "telegram")) | _any(n, ("signal",)), 7)
        .when(_any(n, ("burst", "_seq_")), 4)
        .when(sized & (side > F.lit(2.2).cast("float")), 3)
        .when(sized & (side == 1), 8)
        .when(sized & front, 2)
        .when(sized, 1)
        .when(make.isNull() & model.isNull(), 0)
        .otherwise(1)
    )


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out
