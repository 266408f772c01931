"""SentencePiece encoding and decoding with n-best segmentation.

The lattice holds every vocabulary piece that matches the text and a byte fallback for characters without a piece. A
forward Viterbi pass gives the best score of every prefix; a backward A-star search from the end uses those scores as
its heuristic. The heuristic is exact, so paths leave the queue in order of their scores and the first n are the
n best. Scores are integers, so sums are exact and ties are real ties.

No piece of the vocabulary holds a blank after another character, so the lattice falls apart at blanks. What lies
between (a chunk) is solved once and remembered; the forward passes of all new chunks of a batch run together, one
character further at a time. The n best of a text take an alternative in the n - 1 chunks whose second best costs
least, which is exact: any other alternative is behind n better ones.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped_texts, worker_state

BLANK = "▁"
#: Log-probabilities are rounded to multiples of 1 / SCALE.
SCALE = 1 << 20
#: Piece number r of the vocabulary (in the order of its merges) has probability in proportion to 1 / (r + OFFSET).
OFFSET = 2.7
#: A byte of the fallback costs so much more than the rarest piece.
BYTE_COST = 2.0
#: Chunks and their characters that a worker remembers; it starts anew beyond either.
MEMO_CHUNKS, MEMO_CHARS = 400_000, 20_000_000
MEMO_RANKED = 50_000
#: Characters of the texts, or of new chunks, that are solved at once.
STRETCH, TOGETHER = 3_000_000, 500_000
_NONE = -(1 << 60)
_CHUNKS = re.compile(r" +[^ ]*")


@dataclass(frozen=True, eq=False)
class Vocabulary:
    scores: dict[str, tuple[int, int]]
    longest: int
    byte_id: int
    byte_score: int
    raw: tuple[bytes, ...]


@lru_cache(2)
def vocabulary(model_path: str) -> Vocabulary:
    """Pieces of a SentencePiece model with byte fallback; the model's own merge order ranks them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + OFFSET) for r in range(len(ids))))
    scores = {sp.id_to_piece(i): (-round((math.log(r + OFFSET) + total) * SCALE), i) for r, i in enumerate(ids)}
    scores = {p: x for p, x in scores.items() if BLANK not in p.lstrip(BLANK)}
    first = next(i for i in range(sp.vocab_size()) if sp.is_byte(i))
    raw = tuple(bytes([i - first]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(sp.vocab_size()))
    return Vocabulary(scores, max(map(len, scores)), first, min(s for s, _ in scores.values()) - round(BYTE_COST * SCALE), raw)


class Trie:
    """The pieces as a character trie that many texts walk at once: its steps lie in an open-addressed table."""

    def __init__(self, voc: Vocabulary):
        chars = sorted({c for p in voc.scores for c in p})
        self.kind = np.zeros(0x110000, np.int64)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        steps: dict[int, int] = {}
        ends: dict[int, tuple[int, int]] = {}
        kinds = {c: k + 1 for k, c in enumerate(chars)}
        for piece, scored in voc.scores.items():
            at = 0
            for c in piece:
                at = steps.setdefault(at * self.kinds + kinds[c], len(steps) + 1)
            ends[at] = scored
        self.score, self.id = np.full(len(steps) + 1, _NONE), np.full(len(steps) + 1, -1)
        for at, (s, i) in ends.items():
            self.score[at], self.id[at] = s, i
        self.single = np.zeros(self.kinds, bool)
        self.single[[kinds[p] for p in voc.scores if len(p) == 1]] = True
        self.bits = (4 * len(steps)).bit_length()
        self.keys, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        keys, to = np.array(list(steps)), np.array(list(steps.values()))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            placed, first = np.unique(slot[free], return_index=True)
            self.keys[placed], self.to[placed] = keys[free][first], to[free][first]
            left = self.keys[slot] != keys
            keys, to, slot = keys[left], to[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes that lie a character further; 0 where there is none."""
        key = node * self.kinds + kind
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], 0)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def _marked(chunk: str) -> tuple[str, str]:
    """A chunk behind its blank, as pieces spell it and as it stands in the text."""
    raw = " " + chunk
    if chunk[:1] != " " and BLANK not in chunk:
        return BLANK + chunk, raw
    blanks = len(raw) - len(raw.lstrip(" "))
    return BLANK * blanks + raw[blanks:].replace(BLANK, "\0"), raw


def lattice(voc: Vocabulary, marked: str, raw: str) -> tuple[list[list], list[int], list[int]]:
    """For each position the pieces that end there, shortest first (start, score, ids), and each prefix's best and second best score."""
    n = len(marked)
    ends: list[list] = [[] for _ in range(n + 1)]
    best, second = [0] + [_NONE] * n, [_NONE] * (n + 1)
    get, longest = voc.scores.get, voc.longest
    for j in range(1, n + 1):
        here, one, two = ends[j], _NONE, _NONE
        for i in range(j - 1, max(j - longest, 0) - 1, -1):
            hit = get(marked[i:j])
            if hit:
                here.append((i, hit[0], (hit[1],)))
            elif i == j - 1:
                data = raw[i].encode("utf-8", "surrogatepass")
                here.append((i, voc.byte_score * len(data), tuple(voc.byte_id + b for b in data)))
        for i, s, _ in here:
            x = best[i] + s
            if x > one:
                one, two = x, one
            elif x > two:
                two = x
            two = max(two, second[i] + s)
        best[j], second[j] = one, two
    return ends, best, second


def search(ends: list[list], best: list[int], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best (score, ids) by backward A-star, best first; among equals the path with the longest last piece."""
    queue: list[tuple] = [(-best[-1], 0, len(best) - 1, 0, None)]
    out: list[tuple[int, tuple[int, ...]]] = []
    count = 0
    while queue and len(out) < n:
        _, _, at, done, path = heapq.heappop(queue)
        if not at:
            ids: list[int] = []
            while path:
                ids.extend(path[0])
                path = path[1]
            out.append((done, tuple(ids)))
            continue
        for i, s, ids in ends[at]:
            count -= 1
            heapq.heappush(queue, (-(done + s + best[i]), count, i, done + s, (ids, path)))
    return out


def forward(trie: Trie, voc: Vocabulary, marked: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi over many chunks: (flat ids, ids of each, best scores, second best scores).

    All chunks advance together, a character at a time. Of equal scores the longest last piece stays, as in ``search``.
    """
    code = np.frombuffer("".join(m + "\0" for m in marked).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.append(trie.kind[code], np.zeros(1, np.int64))
    size = np.array([len(m) for m in marked])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    at = np.flatnonzero(kind[:-1])
    alone = ~trie.single[kind[:-1]]
    alone[begin + size] = False
    alone = np.flatnonzero(alone)
    width = 1 + (code[alone] > 0x7F) + (code[alone] > 0x7FF) + (code[alone] > 0xFFFF)
    # what has no piece stands for itself, as minus its code
    node, places, spans, gains, pieces, k = np.zeros(len(at), np.int64), [alone], [np.ones(len(alone), np.int64)], [width * voc.byte_score], [-code[alone].astype(np.int64)], 0
    while len(at):
        node = trie.step(node, kind[at + k])
        alive = node > 0
        at, node, k = at[alive], node[alive], k + 1
        whole = trie.id[node] >= 0
        places.append(at[whole])
        gains.append(trie.score[node[whole]])
        pieces.append(trie.id[node[whole]])
        spans.append(np.full(len(places[-1]), k))
    start, gain, piece = np.concatenate(places), np.concatenate(gains), np.concatenate(pieces)
    end = start + np.concatenate(spans)
    owner = np.repeat(np.arange(len(size)), size + 1)[start]
    order = np.argsort(owner.astype(np.uint16), kind="stable")
    order = order[np.argsort((end - begin[owner]).astype(np.uint16)[order], kind="stable")]
    start, end, gain, piece = start[order], end[order], gain[order], piece[order]
    upto = np.searchsorted(end - begin[owner[order]], np.arange(size.max() + 2))
    best, second, back = np.full(len(kind) + 1, _NONE), np.full(len(kind) + 1, _NONE), np.zeros(len(kind) + 1, np.int64)
    best[begin] = 0
    for t in range(1, int(size.max()) + 1):
        a, b = upto[t], upto[t + 1]
        s, e, g = start[a:b], end[a:b], gain[a:b]
        cut = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        count = np.diff(np.append(cut, b - a))
        x = best[s] + g
        top = np.maximum.reduceat(x, cut)
        # the last of equals is the longest piece, as edges of one end stand shortest first
        last = np.maximum.reduceat(np.where(x == np.repeat(top, count), np.arange(b - a), -1), cut)
        y = second[s] + g
        x[last], other = _NONE, x
        second[e[cut]] = np.maximum.reduceat(np.maximum(other, y), cut)
        best[e[cut]], back[e[cut]] = top, a + last
    close = begin + size
    here, which, picked, owners = close.copy(), np.arange(len(size)), [], []
    while len(which):
        edge = back[here[which]]
        picked.append(piece[edge])
        owners.append(which)
        here[which] = start[edge]
        which = which[here[which] > begin[which]]
    whose, found = np.concatenate(owners[::-1]), np.concatenate(picked[::-1])
    order = np.argsort(whose.astype(np.uint16), kind="stable")
    whose, found = whose[order], found[order]
    byte = np.flatnonzero(found < 0)
    if len(byte):
        data = [chr(-c).encode("utf-8", "surrogatepass") for c in found[byte].tolist()]
        many = np.ones(len(found), np.int64)
        many[byte] = [len(d) for d in data]
        whose, found, wide = np.repeat(whose, many), np.repeat(found, many), np.repeat(found < 0, many)
        found[wide] = voc.byte_id + np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    return found.astype(np.int32), np.bincount(whose, minlength=len(size)), best[close], second[close]


class Chunks(dict):
    """chunk after a blank -> its row in the tables of what has been solved."""

    def __init__(self, voc: Vocabulary):
        super().__init__()
        self.voc, self.trie, self.ranked = voc, Trie(voc), {}
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.chars = 0
        self.ids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.tables: tuple | None = None

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = row = len(self)
        return row

    def _solve(self) -> None:
        """Rows for the new chunks: best score, what the second best lacks, ids, and whether these decode to the chunk."""
        spelt = [(k, *_marked(chunk)) for k, chunk in enumerate(self.new)]
        # a mark of the text's own, or a chunk of great length, takes the plain way
        plain = [x for x in spelt if len(x[1]) < 1 << 16 and "\0" not in x[1]]
        odd = [x for x in spelt if len(x[1]) >= 1 << 16 or "\0" in x[1]]
        size, score, second = (np.zeros(len(self.new), np.int64) for _ in range(3))
        parts: list[np.ndarray] = [np.empty(0, np.int32)] * len(self.new)
        at = 0
        while at < len(plain):
            stop, held = at, 0
            while stop < len(plain) and stop - at < 50_000 and held < TOGETHER:
                held += len(plain[stop][1])
                stop += 1
            ids, n, one, two = forward(self.trie, self.voc, [m for _, m, _ in plain[at:stop]])
            own = np.array([k for k, _, _ in plain[at:stop]])
            size[own], score[own], second[own] = n, one, two
            ends = np.cumsum(n).tolist()
            for k, a, b in zip(own.tolist(), [0, *ends], ends, strict=False):
                parts[k] = ids[a:b]
            at = stop
        for k, marked, raw in odd:
            ends, best, seconds = lattice(self.voc, marked, raw)
            ids = search(ends, best, 1)[0][1]
            parts[k], size[k], score[k], second[k] = np.array(ids, np.int32), len(ids), best[-1], seconds[-1]
        flat = np.concatenate(parts)
        raw, ends = list(map(self.voc.raw.__getitem__, flat.tolist())), np.cumsum(size).tolist()
        exact = [b"".join(raw[a:b]) == x[2].encode("utf-8", "surrogatepass") for a, b, x in zip([0, *ends], ends, spelt, strict=False)]
        lack = np.where(second > _NONE // 2, score - second, np.iinfo(np.int64).max)
        self.ids.append(flat)
        self.rows.append(np.stack([size, score, lack, np.array(exact, np.int64)]))
        self.chars += sum(map(len, self.new))
        self.new, self.tables = [], None

    def found(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the texts' chunks, one text after the other, and the texts' numbers of chunks."""
        if len(self) > MEMO_CHUNKS or self.chars > MEMO_CHARS:
            self._reset()
        count = np.array([len(t) for t in texts])
        rows = np.fromiter(chain.from_iterable(map(self.__getitem__, t) for t in texts), np.int64, int(count.sum()))
        if self.new:
            self._solve()
        if self.tables is None:
            self.ids, self.rows = [np.concatenate(self.ids)], [np.concatenate(self.rows, 1)]
            self.tables = self.ids[0], np.concatenate([[0], np.cumsum(self.rows[0][0])]), *self.rows[0]
        return rows, count

    def best_of(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """A chunk's n best segmentations."""
        if (chunk, n) not in self.ranked:
            if len(self.ranked) >= MEMO_RANKED:
                self.ranked.clear()
            self.ranked[chunk, n] = search(*lattice(self.voc, *_marked(chunk))[:2], n)
        return self.ranked[chunk, n]

    def encode(self, texts: list[str], n: int) -> list[tuple]:
        """(best ids, score, n best as (score, changes), decodes) of every text; a change replaces ids of the best."""
        cut = [_chunks(t) for t in texts]
        rows, count = self.found(cut)
        ids, begin, size, score, lack, exact = self.tables
        length = size[rows]
        close = np.cumsum(length)
        flat = ids[np.repeat(begin[rows] - (close - length), length) + np.arange(close[-1] if len(close) else 0)]
        stop = np.cumsum(count)
        out = []
        for chunks, a, b in zip(cut, (stop - count).tolist(), stop.tolist(), strict=True):
            own, first = rows[a:b], int(close[a] - length[a])
            total = int(score[own].sum())
            costs = lack[own]
            near = np.argpartition(costs, n - 1)[: n - 1] if n <= len(costs) else np.arange(len(costs))
            near = np.sort(near[costs[near] < np.iinfo(np.int64).max])
            ranked = [(0, ())]
            for k in near.tolist():
                many = self.best_of(chunks[k], n)
                top, place = many[0][0], int(close[a + k] - length[a + k]) - first
                more = [(s - top, ((place, many[0][1], x),)) for s, x in many[1:]]
                ranked = heapq.nlargest(n, [*ranked, *((s + t, c + d) for s, c in ranked for t, d in more)], key=lambda r: r[0])
            out.append((flat[first : int(close[b - 1])], total, [(total + s, [_change(*c) for c in changes]) for s, changes in ranked], bool(exact[own].all())))
        return out


def _change(at: int, old: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, int, tuple[int, ...]]:
    """(position, ids that go, ids that come), without what both begin and end with."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return at + a, len(old) - a - b, new[a : len(new) - b]


def _chunks(text: str) -> list[str]:
    """What follows each blank (one is put before the text); a chunk holds the further blanks of a run."""
    return text.split(" ") if "  " not in text and text[:1] != " " else [c[1:] for c in _CHUNKS.findall(" " + text)]


def decode(voc: Vocabulary, ids: np.ndarray) -> str:
    """The text of an id sequence: the reverse of encoding, exactly."""
    raw = voc.raw
    return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


def _lists(values: list, kind: pa.DataType, make: Any = None) -> pa.ListArray:
    """A list column from Python lists; ``make`` turns the flat values into an array."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = [x for v in values for x in v]
    return pa.ListArray.from_arrays(pa.array(offsets), make(flat) if make else pa.array(flat, kind))


def _changes(flat: list[tuple]) -> pa.StructArray:
    columns = [pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()), _lists([c[2] for c in flat], pa.int32())]
    return pa.StructArray.from_arrays(columns, ["at", "n", "ids"])


def _ranked(flat: list[tuple]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([r[0] / SCALE for r in flat], pa.float64()), _lists([r[1] for r in flat], None, _changes)], ["score", "changes"])


SCHEMA = "ids array<int>, n_pieces long, score double, n_best array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>, decoded boolean"


def encode_texts(docs: DataFrame, model_path: str, n: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ids, n_pieces, score, n_best and decoded of every row.

    ``ids`` and ``score`` are the best segmentation's. ``n_best`` has the n best, best first, fewer where there are
    fewer: the score of each and its ids as changes of ``ids`` (``n`` ids from position ``at`` give way to ``ids``;
    see ``segmentation``). ``decoded`` tells whether decoding the ids gives the text again; it does for every text.
    A null text is an empty one, which is a single blank piece. Texts are read whole and repeated rows encoded each;
    other columns are ignored, and a kept one of a result's name gives way to it.
    """

    def make(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        chunks = worker_state("chunks", (model_path,), lambda: Chunks(vocabulary(model_path)))
        at = 0
        while at < len(texts):
            part: list[str] = []
            held = 0
            while at < len(texts) and held < STRETCH:
                part.append(texts[at].as_py() or "")
                held += len(part[-1])
                at += 1
            rows = chunks.encode(part, n)
            sizes = np.array([len(r[0]) for r in rows])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield len(rows), [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[0] for r in rows]))), pa.array(sizes, pa.int64()), pa.array([r[1] / SCALE for r in rows], pa.float64()),
                _lists([r[2] for r in rows], None, _ranked), pa.array([r[3] for r in rows], pa.bool_()),
            ]

    return mapped_texts(docs, keep, make, SCHEMA)


def segmentation(ids: Column, changes: Column) -> Column:
    """The ids of one of the n best, from the best ids and its changes (which stand in order of their positions)."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    step = lambda s, c: F.struct((c["at"] + c["n"]).alias("at"), F.concat(s["ids"], F.slice(ids, s["at"] + 1, c["at"] - s["at"]), c["ids"]).alias("ids"))
    return F.aggregate(changes, begin, step, lambda s: F.concat(s["ids"], F.slice(ids, s["at"] + 1, F.size(ids))))


def decode_ids(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the text of every row's ids; a null id array gives a null text, an empty one an empty text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        for b in batches:
            texts = [None if x.as_py() is None else decode(voc, np.array(x.as_py(), np.int64)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    given = encoded.select(*keep, F.col("ids").cast("array<int>"))
    schema = ", ".join(f"`{k}` {t}" for k, t in given.dtypes if k in keep)
    return given.mapInArrow(scan, f"{schema}, text string")
