"""Token counts of text sections: a document is encoded once and its tokens are attributed to spans by offset."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "split")
_SECTION = "array<struct<section: int, char_start: long, char_end: long>>"
_loaded: dict[tuple, tuple] = {}


def _encoding(path: str, pattern: str):
    """The tokenizer of a rank file, and every token's length in bytes; kept by the Python worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        width[list(ranks.values())] = [len(t) for t in ranks]
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width
    return _loaded[path, pattern]


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines; a line feed belongs to the line it ends. An empty text is one empty line."""
    ends = np.array([i + 1 for i, c in enumerate(text) if c == "\n"], np.int64) if "\n" in text else np.empty(0, np.int64)
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends[:-1]]), ends


def byte_offsets(raw: bytes) -> np.ndarray:
    """The byte position of every character, and the total."""
    b = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each byte span [start, end); tokens lie end to end and close at ``token_ends``.

    A token that crosses a span's edge belongs, by the rule ``start``, to the spans that hold its first byte;
    by ``end`` to those that hold its last; by ``split`` to each span in proportion to the bytes it has there.
    """
    token_starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    if rule == "start":
        return np.searchsorted(token_starts, ends) - np.searchsorted(token_starts, starts)
    if rule == "end":
        return np.searchsorted(token_ends, ends, "right") - np.searchsorted(token_ends, starts, "right")
    if not len(token_ends):
        return np.zeros(len(starts))
    edges = np.concatenate([[0], token_ends])
    return np.interp(ends, edges, np.arange(len(edges))) - np.interp(starts, edges, np.arange(len(edges)))


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start", spans: Column | None = None) -> DataFrame:
    """A row per section of every row of ``docs`` (doc_id, text): its character span and its share of the tokens.

    ``spans`` is an array of (section, char_start, char_end) structs, which may overlap or leave gaps and is cut to
    the text; without it the sections are the lines. Every text is encoded once and whole: counts add up to the text's
    tokens under each rule where the spans tile it. A null text counts as empty; an empty text has one empty
    line and no tokens; a null span array gives no rows, a span with a null edge or with its end before its start
    counts as empty at its start. Repeated rows give repeated sections; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = spans is not None
    count = pa.float64() if rule == "split" else pa.int64()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, width = _encoding(ranks_path, pattern)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            asked = b.column("spans").to_pylist() if given else None
            for k, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)):
                text = text.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                ids = np.array(library.encode_ordinary(text), np.int64)
                closes = np.cumsum(width[ids]) if len(ids) else np.empty(0, np.int64)
                if given:
                    rows = asked[k] or []
                    names = [r["section"] for r in rows]
                    starts = np.array([min(max(r["char_start"] or 0, 0), len(text)) for r in rows], np.int64)
                    ends = np.maximum(np.array([min(max(r["char_end"] or 0, 0), len(text)) for r in rows], np.int64), starts)
                else:
                    starts, ends = line_spans(text)
                    names = range(len(starts))
                at = byte_offsets(raw)
                found = attribute(closes, at[starts], at[ends], rule)
                for column, values in zip(out, ([doc] * len(starts), names, starts.tolist(), ends.tolist(), found.tolist(), [len(ids)] * len(starts)), strict=True):
                    column.extend(values)
                held += len(starts)
                if held >= 100_000:
                    yield _batch(out, count)
                    out, held = [[], [], [], [], [], []], 0
            yield _batch(out, count)

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([spans.cast(_SECTION).alias("spans")] if given else []))
    return text.mapInArrow(scan, f"doc_id long, section int, char_start long, char_end long, n_tokens {'double' if rule == 'split' else 'long'}, doc_tokens long")


def _batch(columns: list[list], count: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), count, pa.int64())
    names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "doc_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def field_tokens(rows: DataFrame, key: str, fields: list[str], ranks_path: str, pattern: str, rule: str = "start", separator: str = "\n") -> DataFrame:
    """Tokens of each of ``fields`` when a row is encoded as their concatenation: key, field, n_tokens.

    A null field is empty. The separator after a field counts with the field.
    """
    whole = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    ends = [sum((F.length(w) for w in whole[:i]), F.lit(0)) for i in range(len(fields) + 1)]
    spans = F.array(*(F.struct(F.lit(i).alias("section"), ends[i].alias("char_start"), ends[i + 1].alias("char_end")) for i in range(len(fields))))
    staged = rows.select(F.col(key).alias("doc_id"), F.concat(*whole).alias("text"), spans.alias("spans"))
    counted = section_tokens(staged, ranks_path, pattern, rule, F.col("spans"))
    return counted.select(F.col("doc_id").alias(key), F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1).alias("field"), "n_tokens")
