"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting happens in Spark: every task counts the words, and in a second pass the word pairs, of its
own texts in NumPy and ships sorted arrays, one per hash or id range; a range's arrays
are merged in one task, and ranges are as many as the data need.  The model is a
set of sorted arrays per range: word hashes with counts, continuation counts and context
statistics, and pairs (id of the history, id of the word) with counts.  It is written as a
Parquet table to the shared folder, some ``KEYS_PER_ROW`` keys a row, so that no JVM holds a
whole range.  A worker unpacks ranges once per machine into flat files
and memory-maps them; texts are scored by binary search, and nothing of the model passes
through the driver but a handful of totals.

P(w | h) = max(c(h, w) - D(c), 0) / c(h) + g(h) * P1(w), with P1 the same over continuation counts
and, below it, the uniform distribution over V + 1 words; D1, D2, D3+ come from
counts of counts.  A text is its words and one end; the history of the first is a start.
All pairs are kept: nothing is pruned.

Defined results: null and empty texts are one end; very long texts are counted and scored whole; counts
have 64 bits, and more than 2^32 - 2 distinct words raise an error, as pairs have 32 bits for each word; a null id's
fold is that of the empty text; ties need no rule; an empty table gives no rows; without training rows c = N = V = 0 and every word has
probability 1; repeated rows are counted and scored each; extra columns are ignored.
"""

from __future__ import annotations

import fcntl
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import doc_key_bucket, fresh_path, lean, small_batches, table

END = xxhash.xxh3_64_intdigest(b" end")  # no word holds a space
START_ID = 0  # the history of a first word; word ids start at 1
TOKENS_PER_RANGE = 4_000_000
BATCH_TOKENS = 2_000_000
KEYS_PER_ROW = 1 << 17
BATCH_BYTES = 4 << 20
STEP = 1 << 18  # items for which intermediate arrays are made at a time, and tokens scored at a time
FOLDS, HELD_OUT = 7, 2


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def token_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _joined(held: list[np.ndarray]) -> np.ndarray:
    """One array of all; ``held`` is emptied, so that they are not kept twice."""
    out = np.concatenate(held)
    held.clear()
    return out


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _distinct(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; ``held`` is emptied."""
    keys = _joined(held)
    keys.sort()
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts; ``held`` is emptied."""
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    held.clear()
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


def _by_range(keys: np.ndarray, counts: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Keys are sorted, and ranges ascend with them."""
    cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1), len(keys)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            part = counts[start:end]
            yield int(ranges[start]), keys[start:end].tobytes(), part.astype(np.uint8 if part.max() < 256 else np.uint32).tobytes()


def _blob_batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("range", "part", "n") else pa.binary()) for c, n in zip(columns, names, strict=True)], names=list(names))


def _blob_batches(rows: Iterable[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """(range, keys, counts), some ``BATCH_BYTES`` at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + len(row[2])
        if size >= BATCH_BYTES:
            yield _blob_batch(held, ("range", "keys", "counts"))
            held, size = [], 0
    if held:
        yield _blob_batch(held, ("range", "keys", "counts"))


def _token_batches(batches: Iterator[pa.RecordBatch], folds: int, held_out: int) -> Iterator[list[np.ndarray]]:
    """Token hashes of the training texts, some ``BATCH_TOKENS`` at a time."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc_key_bucket(key, folds) != held_out:
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size >= BATCH_TOKENS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _key_batches(batches: Iterator[pa.RecordBatch], keys_of: Callable[..., np.ndarray]) -> Iterator[list[np.ndarray]]:
    """``keys_of`` the rows, some ``BATCH_TOKENS`` keys at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(keys_of(*row))
            size += len(held[-1])
            if size >= BATCH_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hash_range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _merge(rows: DataFrame, make, shift: int = 0) -> DataFrame:
    """Rows (range, part, n, a, b, c, d) of blobs by ``make(keys, counts)``, parts of a range in
    the order of its keys; a holds n keys of 8 bytes.  Keys that differ in their last ``shift`` bits
    only stay together."""
    names, per_row = ("range", "part", "n", "a", "b", "c", "d"), KEYS_PER_ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def merged() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(held)
            start = part = 0
            while start < len(keys):
                end = start + per_row
                while end < len(keys) and keys[end] >> np.uint64(shift) == keys[end - 1] >> np.uint64(shift):
                    end += 1
                blobs = make(keys[start:end], counts[start:end])
                yield _blob_batch([(now, part, len(blobs[0]) // 8, *blobs, *[None] * (4 - len(blobs)))], names)
                start, part = end, part + 1

        for batch in batches:
            for number, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now and held:
                    yield from merged()
                now = number
                held.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint8 if len(counts) * 8 == len(keys) else np.uint32)))
        if held:
            yield from merged()

    # One range at a time is held, however many a task reads.
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(lean(run), "range long, part long, n long, a binary, b binary, c binary, d binary")


def _counts_of_counts(counts: np.ndarray) -> bytes:
    return np.bincount(np.minimum(counts, 5), minlength=6)[:6].astype(np.int64).tobytes()


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items counted 1, 2, 3, 4 times (n[1] to n[4])."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, start=1))


def _discount(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.asarray([0.0, *d])[np.minimum(counts, 3)]


class Ranges:
    """Memory-mapped arrays of a part of the model, unpacked once per machine."""

    def __init__(self, place: str, kind: str, columns: dict[str, str], only: str | None = None):
        root = _local(place)
        flat = os.path.join(root, "_flat")
        os.makedirs(flat, exist_ok=True)
        with open(os.path.join(flat, f"{kind}.lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(os.path.join(flat, f"{kind}.done")):
                self._unpack(root, flat, kind, columns)
        self.starts = np.fromfile(os.path.join(flat, f"{kind}.starts"), np.int64)
        total = int(self.starts[-1])
        self.columns = {c: np.memmap(os.path.join(flat, f"{kind}.{c}"), t, "r", shape=(total,)) if total else np.zeros(0, t) for c, t in columns.items()}
        self.keys = self.columns["a"]

    @staticmethod
    def _unpack(root: str, flat: str, kind: str, columns: dict[str, str]) -> None:
        files = sorted(os.path.join(root, f) for f in os.listdir(root) if f.endswith(".parquet"))
        rows = [r for f in files for r in zip(*(c.to_pylist() for c in pq.read_table(f, columns=["range", "part", "n"]).columns), strict=True)]
        order = sorted(range(len(rows)), key=rows.__getitem__)
        starts = np.cumsum([0, *(rows[i][2] for i in order)])
        place = np.empty(len(rows), np.int64)
        place[order] = starts[:-1]
        at, out = iter(place.tolist()), {c: open(os.path.join(flat, f"{kind}.{c}"), "wb") for c in columns}  # noqa: SIM115
        for f in files:
            for batch in pq.ParquetFile(f).iter_batches(8, columns=list(columns), use_threads=False):
                for *blobs, start in zip(*(batch[c] for c in columns), at, strict=False):
                    for (c, file), blob in zip(out.items(), blobs, strict=True):
                        file.seek(start * np.dtype(columns[c]).itemsize)
                        file.write(blob.as_py() or b"")
        for file in out.values():
            file.close()
        np.asarray(starts, np.int64).tofile(os.path.join(flat, f"{kind}.starts"))
        open(os.path.join(flat, f"{kind}.done"), "w").close()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted ``keys``, -1 where missing."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _local(place: str) -> str:
    """The folder as this machine sees it: shared ones directly, others through Spark's files."""
    if place.startswith("file:"):
        return "/" + place[5:].lstrip("/")
    if place.startswith("/"):
        return place
    return SparkFiles.get(os.path.basename(place))


def _publish(df: DataFrame, kind: str) -> str:
    """Writes a part of the model to the shared folder, for all workers."""
    spark = df.sparkSession
    place = fresh_path(spark, f"lm-{kind}")
    # Sizes are looked at after every row: the next reader takes a row group at a time.
    df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 1).parquet(place)
    if not place.startswith(("file:", "/")):
        spark.sparkContext.addFile(place, recursive=True)
    return place


_open: dict[str, Ranges] = {}


def _opened(place: str, kind: str, columns: dict[str, str]) -> Ranges:
    if place not in _open:
        _open[place] = Ranges(place, kind, columns)
    return _open[place]


WORD_COLUMNS = {"a": "u8", "b": "i8", "d": "i8"}
CONTINUED_COLUMNS = {"a": "u8", "b": "i8"}
CONTEXT_COLUMNS = {"a": "u8", "b": "f8"}
PAIR_COLUMNS = {"a": "u8", "b": "i8"}


def _count_of_history(words: Ranges, ids: np.ndarray) -> np.ndarray:
    """How often ids are histories: word ids as often as the word, the start as the end."""
    if not len(words.keys):
        return np.zeros(len(ids))
    end = words.find(np.asarray([END], np.uint64))[0]
    at = np.where(ids == START_ID, end + 1, ids).astype(np.int64) - 1
    return words.columns["b"][at].astype(np.float64)


def _tokens_before(words: Ranges, ids: np.ndarray) -> np.ndarray:
    """Training tokens whose history has a smaller id, from sums kept per range: no array of
    the vocabulary's size is made."""
    out = np.zeros(len(ids), np.int64)
    word = ids != START_ID
    at = ids[word].astype(np.int64) - 1
    ends = words.starts[1:] - 1
    base = np.concatenate([[0], np.cumsum(words.columns["d"][ends] + words.columns["b"][ends])])
    first = int(_count_of_history(words, np.asarray([START_ID], np.uint64))[0])
    out[word] = first + base[np.searchsorted(words.starts, at, side="right") - 1] + words.columns["d"][at]
    return out


def _pair_keys(words: Ranges, held: list[np.ndarray]) -> np.ndarray:
    """(history << 32) | word of every token; ``held`` is emptied."""
    sizes = np.asarray([len(t) for t in held])
    flat = _joined(held)
    distinct = np.unique(flat)
    ids = (words.find(distinct) + 1).astype(np.uint32)
    token = np.empty(len(flat), np.uint32)
    for at in range(0, len(flat), STEP):
        token[at : at + STEP] = ids[np.searchsorted(distinct, flat[at : at + STEP])]
    del flat, distinct, ids
    keys = np.empty(len(token), np.uint64)
    keys[1:] = token[:-1]
    keys[np.cumsum(sizes) - sizes] = START_ID
    keys <<= np.uint64(32)
    keys |= token
    return keys


def _pair_ranges(words: Ranges, keys: np.ndarray, per_range: int) -> np.ndarray:
    """Ranges of about equal numbers of tokens, in key order: a frequent history is spread over
    several of them by the word."""
    out = np.empty(len(keys), np.int64)
    for at in range(0, len(keys), STEP):
        part = keys[at : at + STEP]
        h, w = part >> np.uint64(32), (part & np.uint64(2**32 - 1)).astype(np.int64)
        out[at : at + STEP] = (_tokens_before(words, h) + _count_of_history(words, h) * (w / (len(words.keys) + 2))).astype(np.int64) // per_range
    return out


class BigramModel:
    """Places and totals of a trained model; small, and sent to every task."""

    words: str
    continued: str
    contexts: str
    pairs: str
    tokens = types = pair_types = 0
    pair_discounts = continued_discounts = (0.5, 0.75, 0.9)
    lower_share = 1.0  # of the continuation distribution that goes to the uniform one

    def score(self, texts: list[np.ndarray]) -> tuple[list, list, list, list]:
        """(n_tokens, n_known, base_score, score) for each text's token hashes; ``texts`` is emptied."""
        sizes = np.asarray([len(t) for t in texts])
        flat = _joined(texts)
        words = _opened(self.words, "words", WORD_COLUMNS)
        distinct, number = np.unique(flat, return_inverse=True)
        at = words.find(distinct)
        count = np.where(at >= 0, words.columns["b"][at] if len(words.keys) else 0, 0).astype(np.float64)
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        ids = (at + 1).astype(np.uint64)  # 0: unknown, as a word; as a history it is no key either
        continued = _opened(self.continued, "continued", CONTINUED_COLUMNS)
        found = continued.find(ids)
        c1 = np.where(found >= 0, continued.columns["b"][found] if len(continued.keys) else 0, 0).astype(np.int64)
        uniform = 1 / (self.types + 1)
        lower = np.maximum(c1 - _discount(c1, self.continued_discounts), 0) / max(self.pair_types, 1) + self.lower_share * uniform
        token = ids[number]
        history = np.empty_like(token)
        history[1:] = token[:-1]
        ends = np.cumsum(sizes)
        history[ends - sizes] = START_ID
        starts = np.zeros(len(flat), bool)
        starts[ends - sizes] = True
        usable = starts | (history > 0)
        keys = (history << np.uint64(32)) | token
        d_keys, d_number = np.unique(keys, return_inverse=True)
        pairs = _opened(self.pairs, "pairs", PAIR_COLUMNS)
        p_at = pairs.find(d_keys)
        c2 = np.where(p_at >= 0, pairs.columns["b"][p_at] if len(pairs.keys) else 0, 0).astype(np.int64)
        d_history = d_keys >> np.uint64(32)
        contexts = _opened(self.contexts, "contexts", CONTEXT_COLUMNS)
        h_at = contexts.find(d_history)
        total = _count_of_history(words, d_history)
        share = np.where(h_at >= 0, contexts.columns["b"][h_at] / np.maximum(total, 1) if len(contexts.keys) else 1, 1).astype(np.float64)
        top = np.maximum(c2 - _discount(c2, self.pair_discounts), 0) / np.maximum(total, 1)
        p_top, p_share = top[d_number], share[d_number]
        p = np.where(usable, p_top + p_share * lower[number], lower[number])
        logs = np.log10(p)
        first = ends - sizes
        return sizes.tolist(), np.add.reduceat((count > 0)[number].astype(np.int64), first).tolist(), np.add.reduceat(base[number], first).tolist(), np.add.reduceat(logs, first).tolist()


def train(docs: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> BigramModel:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _train(texts, folds, held_out)


def _train(texts: DataFrame, folds: int, held_out: int) -> BigramModel:
    # Ranges follow the input: about one per TOKENS_PER_RANGE tokens of about 6 characters.
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, chars // (6 * TOKENS_PER_RANGE))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _token_batches(batches, folds, held_out):
            keys, counts = _distinct(held)
            yield from _blob_batches(_by_range(keys, counts, _hash_range(keys, ranges)))

    blobs = "range long, keys binary, counts binary"
    model = BigramModel()
    model.words = _publish(_merge(texts.mapInArrow(lean(count_words, "kneser_ney:_words"), blobs), lambda k, c: (k.tobytes(), c.astype(np.int64).tobytes(), np.int64(c.sum()).tobytes(), (np.cumsum(c) - c).astype(np.int64).tobytes())), "words")
    spark = texts.sparkSession
    # Short rows, one per KEYS_PER_ROW words.
    totals = spark.read.parquet(model.words).select("n", "c").rdd.map(lambda r: (r[0], int(np.frombuffer(r[1], np.int64)[0]))).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    model.types, model.tokens = totals
    if model.types >= 2**32 - 2:
        raise ValueError("more distinct words than pair keys can hold")
    words_at, span = model.words, max(1, -(-(model.types + 1) // ranges))
    per_range = max(1, -(-(model.tokens + 1) // ranges))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _opened(words_at, "words", WORD_COLUMNS)
        for held in _token_batches(batches, folds, held_out):
            keys, counts = _distinct([_pair_keys(words, held)])
            yield from _blob_batches(_by_range(keys, counts, _pair_ranges(words, keys, per_range)))

    def make_pairs(keys: np.ndarray, counts: np.ndarray) -> tuple:
        return keys.tobytes(), counts.astype(np.int64).tobytes(), _counts_of_counts(counts)

    model.pairs = _publish(_merge(texts.mapInArrow(lean(count_pairs, "kneser_ney:_words"), blobs), make_pairs), "pairs")
    pairs = spark.read.parquet(model.pairs)
    model.pair_types, found = _sums(pairs)
    model.pair_discounts = d = discounts(found)

    def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many pairs of each history were seen once, twice, more often."""

        def history_and_class(a: bytes, b: bytes) -> np.ndarray:
            classes = np.minimum(np.frombuffer(b, np.int64), 3).astype(np.uint64)
            return ((np.frombuffer(a, np.uint64) >> np.uint64(32)) << np.uint64(2)) | classes

        for held in _key_batches(batches, history_and_class):
            keys, counts = _distinct(held)
            yield from _blob_batches(_by_range(keys, counts, (keys >> np.uint64(2)).astype(np.int64) // span))

    def make_contexts(keys: np.ndarray, counts: np.ndarray) -> tuple:
        """Histories and the mass that discounting takes from their pairs."""
        history = keys >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
        mass = np.add.reduceat(counts * np.asarray([0.0, *d])[(keys & np.uint64(3)).astype(np.int64)], first)
        return history[first].tobytes(), mass.astype(np.float64).tobytes()

    model.contexts = _publish(_merge(pairs.select("a", "b").mapInArrow(lean(count_contexts), blobs), make_contexts, shift=2), "contexts")

    def continue_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _key_batches(batches, lambda a: np.frombuffer(a, np.uint64) & np.uint64(2**32 - 1)):
            keys, counts = _distinct(held)
            yield from _blob_batches(_by_range(keys, counts, keys.astype(np.int64) // span))

    model.continued = _publish(_merge(pairs.select("a").mapInArrow(lean(continue_words), blobs), make_pairs), "continued")
    _, found = _sums(spark.read.parquet(model.continued))
    model.continued_discounts = discounts(found)
    if model.pair_types:
        taken = spark.read.parquet(model.continued).select("b").rdd.map(lambda r: float(_discount(np.frombuffer(r[0], np.int64), model.continued_discounts).sum())).sum()
        model.lower_share = taken / model.pair_types
    return model


def _sums(parts: DataFrame) -> tuple[int, np.ndarray]:
    """Items and counts of counts over all ranges: short rows, one per KEYS_PER_ROW items."""
    pick = parts.select("n", "c").rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.int64)))
    return pick.fold((0, np.zeros(6, np.int64)), lambda a, b: (a[0] + b[0], a[1] + b[1]))


def score(docs: DataFrame, model: BigramModel, *, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names, step = [x.split()[0] for x in schema.split(", ")], STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            start, held, size = 0, [], 0
            for end, text in enumerate(whole.column(1), start=1):
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size < step and end < whole.num_rows:
                    continue
                batch = whole.slice(start, end - start)
                sizes, known, base, own = model.score(held)
                start, held, size = end, [], 0
                fold = [doc_key_bucket(k, folds) == held_out for k in batch.column(0).to_pylist()]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run, "kneser_ney:_words"), schema)


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))
