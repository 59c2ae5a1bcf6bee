"""Best-fit packing of tokenized documents into sequences of a fixed length.

Two passes.  The first tokenizes each whole text where it is scanned (Arrow batches,
no shuffle of texts) and returns one light row per piece.  The second deals these rows
by a hash to lanes and packs every lane on its own: a bounded-space online best-fit
packer whose open bins hang on a bitset keyed by their free space.  A lane closes when
its rows end, so the waste beyond best fit is at most one lane's open tail; lanes are
sized by bytes (adaptive coalescing), so their number follows the data.

Defined results: null and empty texts give one piece that holds the end token only; very long
texts are tokenized whole and cut into pieces only afterwards; repeated rows are packed each for
itself; pieces of equal length go by id, number and content, and those that agree in all of it are
alike; an empty table gives no rows; a null id is kept; extra columns of the input, also ones
named like the added ones, are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import lean, table

CAPACITY = 1024
OPEN_BINS = 16384

# Pre-tokenization pattern and byte alphabet of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space beyond one character a gap up to which the rank-based encoder's pattern, which
#: steps back over runs of it, is sure to have room; texts with more run on ``tokenizers``.
SPARE_SPACE = 10_000

_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, as ``tokenizers`` gives them for the JSON file at ``path``
    without special tokens added.  A plain byte-level BPE whose ids follow the merge
    order runs on the faster rank-based encoder; any other file, and every text with very
    long white space, on ``tokenizers``."""
    if path in _encoders:
        return _encoders[path]
    loaded: list = []

    def slow(text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if not loaded:
            loaded.append(Tokenizer.from_file(path))
        return np.asarray(loaded[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    )
    if plain:
        made = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
        ids = [model["vocab"].get(x.replace(" ", ""), -1) for x in made]
        plain = ids == sorted(set(ids)) and -1 not in ids
    if plain:
        import tiktoken

        byte = _alphabet()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            if len(text) > SPARE_SPACE:
                words = text.split()
                if len(text) - sum(map(len, words)) - len(words) > SPARE_SPACE:
                    return slow(text)
            return bpe.encode_to_numpy(text, allowed_special="all")
    else:
        encode = slow
    _encoders[path] = encode
    return encode


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the shorter one first."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *((s, capacity) for s in range(head, length, capacity))]


class BestFitPacker:
    """Online best fit with at most ``open_bins`` open bins.

    Bit f of ``self.bits`` is set while an open bin has f free places.  A piece goes to
    the open bin with the least sufficient free space; if none fits, a bin opens, and
    when that is one too many the fullest open bin closes."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.n_open, self.n_bins = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    capacity: int = CAPACITY,
    piece_columns: dict[str, tuple[Callable[[np.ndarray], object], T.DataType]] | None = None,
) -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length`` and ``piece_columns``,
    each a function of the piece's uint32 ids with its type (default: ``ids``)."""
    columns = {"ids": (lambda x: x.astype("<i4"), T.ArrayType(T.IntegerType()))} if piece_columns is None else piece_columns
    id_type = docs.schema[id_col].dataType
    fields = [("doc_id", id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in [*fields, *((n, t) for n, (_, t) in columns.items())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, arrow = encoder(tokenizer), to_arrow_schema(schema)
        tail = np.asarray([] if end_id is None else [end_id], dtype=np.uint32)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), tail]).astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    if length:
                        part = ids[start : start + length]
                        for column, value in zip(out, (key, number, start, length, *(f(part) for f, _ in columns.values())), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def pack(piece_rows: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``.  Rows are dealt by a hash of id and piece and
    arrive longest first, by all orderable columns: rows that tie are alike, so a rerun of a lost
    task repeats its ids."""
    schema = T.StructType([*piece_rows.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer = BestFitPacker(capacity, open_bins)
        for batch in batches:
            at = [packer.place(n) for n in batch.column("length").to_pylist()]
            extra = [pa.array([first + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = piece_rows.repartition(F.xxhash64("doc_id", "piece", "start", "length"))
    ties = [c for c in piece_rows.columns if c != "length"]
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", *ties).mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, open_bins: int = OPEN_BINS, capacity: int = CAPACITY, **options) -> DataFrame:
    """``pieces`` then ``pack``: by default every piece comes with its token ids."""
    return pack(pieces(docs, tokenizer, capacity=capacity, **options), capacity=capacity, open_bins=open_bins)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_columns={"ids_crc32": (ids_crc32, T.LongType())})
