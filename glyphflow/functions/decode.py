"""Decoding of per-step character predictions to text and confidence, as array expressions.

A dictionary is an array of symbols indexed by id. Confidences multiply the kept steps' probabilities in step order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ctc_dictionary(symbols: list[str]) -> list[str]:
    """Id 0 is the blank."""
    return ["", *symbols]


def attention_dictionary(symbols: list[str]) -> list[str]:
    """Ids 0 and 1 are the start and stop marks."""
    return ["[GO]", "[s]", *symbols]


def transformer_dictionary(symbols: list[str]) -> list[str]:
    """Id 0 is the end mark; two more marks close the list."""
    return ["[E]", *symbols, "[B]", "[P]"]


def product(probs: Column) -> Column:
    return F.aggregate(probs.cast("array<double>"), F.lit(1.0), lambda a, x: a * x)


def symbols_of(ids: Column, dictionary: list[str]) -> Column:
    """The ids' symbols in one string; ids outside the dictionary give nothing."""
    table = F.array(*map(F.lit, dictionary))
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")


def ctc(ids: Column, probs: Column, dictionary: list[str]) -> tuple[Column, Column]:
    """(text, confidence): the first step of every run of equal ids, without blanks and ids outside the dictionary."""
    def kept(i: Column) -> Column:
        at = F.get(ids, i)
        return ~at.eqNullSafe(F.get(ids, i - 1)) & (at > 0) & (at < len(dictionary))

    return symbols_of(F.filter(ids, lambda _, i: kept(i)), dictionary), product(F.filter(probs, lambda _, i: kept(i)))


def attention(ids: Column, probs: Column, dictionary: list[str], stop: int = 1) -> tuple[Column, Column]:
    """(text, confidence) of the steps before the stop mark; all steps without one."""
    at = F.array_position(ids, stop).cast("int")
    n = F.when(at > 0, at - 1).otherwise(F.size(ids))
    return symbols_of(F.slice(ids, F.lit(1), n), dictionary), product(F.slice(probs, F.lit(1), n))


def transformer(rows: Column, dictionary: list[str], only_alnum: bool = False, only_lowercase: bool = False) -> tuple[Column, Column]:
    """(text, confidence) of a matrix of step scores: each step's first maximum up to the end mark.

    The end mark's own score counts in the confidence, and so does that of a symbol that the filter drops.
    """
    best = F.transform(rows, F.array_max)
    ids = F.transform(rows, lambda r: F.array_position(r, F.array_max(r)).cast("int") - 1)
    end = F.array_position(ids, 0).cast("int")
    n = F.when(end > 0, end - 1).otherwise(F.size(ids))
    text = symbols_of(F.slice(ids, F.lit(1), n), dictionary)
    if only_alnum:
        text = F.regexp_replace(text, "[^a-zA-Z0-9]", "")
    if only_lowercase:
        text = ascii_lower(text)
    return text, product(F.slice(best, F.lit(1), F.when(end > 0, end).otherwise(F.size(ids))))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upright(original: Column, flipped: Column) -> Column:
    """Of two (text, conf) structs the flipped one only where it is strictly surer."""
    return F.when(flipped["conf"] > original["conf"], flipped).otherwise(original)


def cut_bytes(text: Column, most: int = 63) -> tuple[Column, Column]:
    """(text cut to whole characters within ``most`` bytes, its uncut length in bytes)."""
    whole = F.octet_length(text)
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.when(whole <= most, text).otherwise(F.substring(text, F.lit(1), F.array_max(fits))), whole


def fixed_tokens(ids: Column, end: int, length: int = 16) -> Column:
    """Token ids at a fixed length: zeros behind short lists, long ones cut with the end token last."""
    cut = F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(end)))
    return F.when(F.size(ids) > length, cut).otherwise(F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - F.size(ids)))))
