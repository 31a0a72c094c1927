"""Normalisation of transcripts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import spell

#: Characters that can't change under NFKC or NFD: most texts have no others and never leave the JVM.
_PLAIN = r"^[\x00-\x7F]*$"
_COMPOSED = r"^[\x00-\x7FÀ-ſ]*$"


# Not over iterators of batches: Spark gives each such function a worker of its own in every task, and plain ones of a projection share one.
@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _strip_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"), na_action="ignore")


@F.pandas_udf(T.StringType())
def _spell(numbers: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else spell(n, lang) for n, lang in zip(numbers, langs, strict=True)])


def compose(text: Column) -> Column:
    """NFKC. Texts of Latin letters that are composed already skip the Python worker."""
    needs = ~text.rlike(_COMPOSED)
    return F.when(needs, _compose(F.when(needs, text))).otherwise(text)


def strip_accents(text: Column, lang: Column) -> Column:
    """German umlauts become two letters, other marks go; ß is ss everywhere."""
    german = text
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        german = F.replace(german, F.lit(a), F.lit(b))
    folded = F.replace(F.when(lang.startswith("de"), german).otherwise(text), F.lit("ß"), F.lit("ss"))
    needs = ~folded.rlike(_PLAIN)
    return F.when(needs, _strip_marks(F.when(needs, folded))).otherwise(folded)


def parse_number(raw: Column) -> Column:
    """Value of a number as it stands in a text: a last separator with one or two digits after it is the decimal one."""
    sign = F.when(raw.startswith("-"), -1.0).otherwise(1.0)
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[-+]", ""), r"[.,]+$", "")
    decimals = F.regexp_extract(bare, r"[.,](\p{Nd}{1,2})$", 1)
    whole = F.regexp_replace(F.when(decimals != "", F.regexp_replace(bare, r"[.,]\p{Nd}{1,2}$", "")).otherwise(bare), r"[.,]", "")
    return sign * F.concat(whole, F.lit("."), F.when(decimals != "", decimals).otherwise("0")).try_cast("double")


def expand_numbers(text: Column, lang: Column) -> Column:
    """Write out numbers in words; texts without digits skip the Python worker."""
    needs = text.rlike(r"\p{Nd}")
    return F.when(needs, _spell(F.when(needs, text), lang)).otherwise(text)


def normalize_text(text: Column, lang: Column, accents: bool = False, numbers: bool = True) -> Column:
    """Lower-case words of letters, digits and apostrophes, one space apart; null gives ''.

    accents: strip them. numbers: write them out.
    """
    out = F.lower(compose(F.coalesce(text, F.lit(""))))
    if numbers:
        out = expand_numbers(out, lang)
    if accents:
        out = strip_accents(out, lang)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}']+", " "))


def words(text: Column) -> Column:
    """The words of a normalised text; none for ''."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
