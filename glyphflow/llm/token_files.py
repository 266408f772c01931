"""Token-ID output: binary shard files holding one id array and Elias-Fano coded document boundaries.

A shard file is, all little-endian::

    magic  8 bytes  b"TOKEF01\\n"
    header 8 x u64  id width in bytes, documents, documents without an id, ids, smallest doc_id,
                    bytes of ids, bytes of boundaries, bytes of doc_ids
    ids             n_ids x u16 or u32
    boundaries      Elias-Fano sequence of the position after each document's last id
    doc_ids         Elias-Fano sequence of (doc_id - smallest doc_id), ascending

An Elias-Fano sequence of n ascending values below u keeps floor(log2(u / n)) low bits of each value verbatim and
the rest in unary, about 2 + log2(u / n) bits a value; a sample of every 256th set bit makes ``select`` touch a
bounded stretch, so no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, worker_state

MAGIC = b"TOKEF01\n"
SAMPLE = 256
#: A shard is closed once it holds this many ids, so that no task holds more than one shard and one document.
SHARD_IDS = 4_000_000
#: Words remembered by a Python worker; the memo is emptied when full.
MEMO_WORDS = 500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class EliasFano:
    """An ascending sequence of non-negative integers with constant-stretch ``select``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("Elias-Fano needs ascending non-negative values")
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (v >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u8")
        return head.tobytes() + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, s = (int(x) for x in np.frombuffer(data, "<u8", 5))
        return cls(n, bits, data[40 : 40 + a], data[40 + a : 40 + a + b], np.frombuffer(data, "<u4", s, 40 + a + b))

    def select(self, i: int) -> int:
        """The i-th value, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            bits = np.unpackbits(np.frombuffer(self.high, np.uint8, min(64, len(self.high) - byte), byte), bitorder="little")
            ones = np.flatnonzero(bits[skip:])
            if left < len(ones):
                position = byte * 8 + skip + int(ones[left])
                break
            left, byte, skip = left - len(ones), byte + 64, 0
        first = i * self.low_bits
        span = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return ((position - i) << self.low_bits) | ((span >> (first % 8)) & ((1 << self.low_bits) - 1))

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file for documents in ascending doc_id order, those without an id first."""
    missing = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends, keys = EliasFano.of(np.cumsum(lengths)).to_bytes(), EliasFano.of(known - base).to_bytes()
    flat = ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
    head = np.array([flat.itemsize, len(lengths), missing, len(flat), 0, flat.nbytes, len(ends), len(keys)], "<u8")
    head.view("<i8")[4] = base
    return MAGIC + head.tobytes() + flat.tobytes() + ends + keys


class Shard:
    """Random access to a shard file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        width, self.n_docs, self.missing, n, _, a, b, c = (int(x) for x in np.frombuffer(data, "<u8", 8, 8))
        self.base = int(np.frombuffer(data, "<i8", 8, 8)[4])
        self.ids = np.frombuffer(data, f"<u{width}", n, 72)
        self.ends = EliasFano.from_bytes(data[72 + a : 72 + a + b])
        self.keys = EliasFano.from_bytes(data[72 + a + b : 72 + a + b + c])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.missing else self.base + self.keys.select(i - self.missing)


def _filesystem(path: str):
    """(file system, path in it) for a local path or the URI of a store that pyarrow reaches."""
    from pyarrow.fs import FileSystem

    if re.match(r"file:/(?!/)", path) or path.startswith("/"):
        path = "file://" + path.removeprefix("file:")
    return FileSystem.from_uri(path)


class _Words(dict):
    """Id bytes (u32) of blank-separated words; a word is encoded by the library's own steps when first met."""

    def __init__(self, library):
        super().__init__()
        self.normalize, self.cut, self.model = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str, library.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) > 1 and word[-1:] in b".," and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        else:  # to the rules before the merges, a word of ASCII letters is one piece as it stands
            pieces = [word.decode()] if word.isalpha() else [p for p, _ in self.cut(self.normalize(word.decode()))]
            ids = array("I", [t.id for p in pieces for t in self.model(p)]).tobytes()
        self[word] = ids
        return ids


#: What a tokenizer's steps must be for its words to be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def word_by_word(library) -> bool:
    """Whether a text's ids are those of its words in turn, by the steps that the tokenizer names.

    They must lower-case, cut at blanks and from a letter to a full stop or comma, and hold no added token without
    ``<|``; nothing may be cut, padded or put around the text.
    """
    steps = json.loads(library.to_str())
    plain = all(steps[k] is None for k in ("truncation", "padding", "post_processor")) and steps["model"]["type"] == "BPE" and not steps["model"].get("dropout")
    return plain and steps["normalizer"] == _NORMALIZER and steps["pre_tokenizer"] == _CUTS and all("<|" in t["content"] for t in steps["added_tokens"])


def _encoder(tokenizer_path: str):
    """text -> id bytes (u32), equal to the library's ``encode`` of the whole text.

    Where the tokenizer's steps allow it (``word_by_word``), each worker encodes a word once and remembers it; other
    tokenizers, and texts that may hold a special token's string, take the library's own way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def load() -> tuple:
        library = Tokenizer.from_file(tokenizer_path)
        return library, _Words(library) if word_by_word(library) else None

    library, words = worker_state("words", (tokenizer_path,), load)

    def encode(text: str) -> bytes:
        if words is None or "<|" in text:
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(words.__getitem__, text.encode().translate(_LOWER).split()))

    return encode


def _writer(folder: str, tokenizer_path: str, end_id: int, shard_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        encode, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        keys: list[int | None] = []
        coded: list[bytes] = []
        n = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, coded, n, seq
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            data = shard_bytes(keys, [len(x) // 4 for x in coded], np.frombuffer(b"".join(coded), "<u4"))
            with fs.open_output_stream(f"{root}/{name}.tmp") as out:
                out.write(data)
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [len(keys)], "n_ids": [n]})
            keys, coded, n, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                keys.append(d)
                coded.append(encode(text.as_py() or "") + end)
                n += len(coded[-1]) // 4
                if n >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files below ``folder``, globally in ascending doc_id order.

    Returns the manifest (part, seq, file, n_docs, n_ids), itself saved as Parquet beside the shards: only shards that
    it names count, so files of lost or repeated tasks do no harm. A null text is an empty one; documents
    without a doc_id come first; rows of equal doc_id stand in the order of their text's hash, then of their text; an
    empty table gives an empty manifest; other columns are ignored. Ranges are cut by doc_id and that hash, so a hot
    or missing doc_id is dealt out too, and a partition streams through its task shard by shard.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("copy", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "copy").sortWithinPartitions("doc_id", "copy", "text").select("doc_id", "text")
    made = ordered.mapInArrow(_writer(f"{folder}/shards", tokenizer_path, end_id, shard_ids), "part int, seq int, file string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            fs, path = _filesystem(file)
            with fs.open_input_stream(path) as f:
                shard = Shard(f.read())
            at, rows = 0, []
            for i in range(shard.n_docs):
                end = shard.ends.select(i)
                rows.append((shard.doc_id(i), base + at, end - at, zlib.crc32(shard.ids[at:end].astype("<u4").tobytes())))
                at = end
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row per document of the shard files: doc_id, start, n_tokens, ids_crc32.

    A shard's first global position is the ids of all partitions before it (one number a partition goes to the
    driver) and of the shards before it in its own partition.
    """
    totals, base, before = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = before
        before += r["n"]
    bases = manifest.sparkSession.createDataFrame(list(base.items()) or [], "part int, part_base long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(bases, "part")
    files = placed.select("file", (F.col("part_base") + F.col("inside")).alias("base")).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and return what the files hold."""
    return read_token_files(write_token_files(docs, new_folder(docs.sparkSession, "tokens"), tokenizer_path, end_id))
