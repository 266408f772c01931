"""Cleaning and splitting of text before tokens are merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that are decoded, in this order.
ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&"))
#: Fixed value: special marks, contractions, letters, digits, other signs; an underscore never matches.
TOKEN_PATTERN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]+|[^\s\w]+"


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def trim_blanks(text: Column) -> Column:
    """Blanks, tabs, carriage returns and line feeds off both ends."""
    return F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def basic_clean(text: Column) -> Column:
    """Entities decoded twice, then trimmed."""
    return trim_blanks(unescape(unescape(text)))


def whitespace_clean(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def keep_charset(text: Column, kept: str = "a-zA-Z0-9", case: str | None = None) -> Column:
    """Only characters of a class, optionally in one case."""
    text = F.regexp_replace(text, f"[^{kept}]", "")
    return F.lower(text) if case == "lower" else F.upper(text) if case == "upper" else text


def split_values(text: Column, mark: str = ",") -> Column:
    """The parts between marks, in order; an empty part after the last mark doesn't count, others do. None for null."""
    whole = F.coalesce(text, F.lit(""))
    # without the last mark, and without anything where that is all there is
    cut = F.split(F.regexp_replace(whole, rf"[{mark}]\z", ""), f"[{mark}]", -1)
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(cut)


def split_ints(text: Column, mark: str = ",") -> Column:
    """``split_values`` as whole numbers; null for a part that is none."""
    number = r"^\s*[+-]?[0-9]{1,10}\s*$"
    return F.transform(split_values(text, mark), lambda x: F.when(x.rlike(number), F.trim(x).try_cast("int")))
