"""Text normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Composed Latin letters and the single letters that remain of them without marks."""
    whole, plain = [], []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            whole.append(chr(code))
            plain.append(base)
    return "".join(whole), "".join(plain)


ACCENTED, PLAIN = _accents()


def unaccent(text: Column) -> Column:
    """Latin letters without their marks; marks that follow a letter are dropped too."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Without marks, single spaces, lower case; null gives an empty string."""
    return F.lower(spaced(unaccent(F.coalesce(text, F.lit("")))))


def normalize_identifier(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_text(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_person(text: Column) -> Column:
    """Upper case without marks; blank gives null."""
    return F.nullif(F.upper(spaced(unaccent(text))), F.lit(""))


def normalize_text_full(text: Column) -> Column:
    """normalize_text with the whole of NFKD, for scripts beyond Latin; slower, as it leaves the JVM."""

    def plain(batch: pd.Series) -> pd.Series:
        kept = batch.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
        return kept.str.split().str.join(" ").str.lower()

    return F.pandas_udf(plain, "string")(text)


BLANKS = ("", "null", "none", "-", "--")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*BLANKS), F.lit(True))


def filled(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))
