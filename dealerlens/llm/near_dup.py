"""MinHash near-duplicates with an LSH forest, links confirmed on full shingle sets.

1. One pass hashes the word shingles of every whole text, and keeps per document the size
   of the set, a 128-bit key of the set and its MinHash signature.
2. Documents with equal sets form one class, whose least id stands for it.
3. Forest: each tree orders all classes by its own run of MinHash values.  Classes that
   share at least the first ``BASE_DEPTH`` values are neighbours.  The orders are dealt to
   partitions by range, so a region of any size is spread evenly; a region of more than
   ``REGION`` classes is read at greater depth: as stretches of its order, cut where the common
   prefix of two neighbours is shortest.  The number of trees follows from the threshold, so
   that the chance to miss a pair at the threshold is below ``MISS``.
4. In a region, classes whose estimated similarity is within 5 standard errors of the
   threshold are joined to a family by at most one edge per class; families are the
   connected components of all such edges.  Regions that were cut, by ``REGION`` or by a border of
   partitions, are completed: every class outside the region's largest family is compared with
   all classes of the region, in tasks of at most ``REGION`` classes, so that a cut loses no
   pair.  That costs as many comparisons as a region's size times its classes outside the
   largest family: copies of one text are cheap, large regions of unlike texts are not.
5. In each family exact similarities decide.  A family of more than ``FAMILY_SHINGLES`` shingles is
   dealt to blocks, and each pair of blocks is compared in a task of its own.  A task
   compares documents with all others of its blocks until every document outside the
   largest group has been compared, which finds all groups without listing all pairs.

Defined results: null and empty texts have an empty set and are linked with nothing; a null
id has a null component and is kept; rows of the same id are one document with all of its
texts, so they have one component; very long texts are read whole; links at exactly the threshold
count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import checkpointed, free_name, lean, small_or_shuffled, table
from .components import components

BASE_DEPTH, DEPTH = 4, 8
MISS = 1e-5
REGION = 4096
FAMILY_SHINGLES = 2_000_000
BLOCK_SHINGLES = 1_000_000
SHINGLE_WORDS, THRESHOLD = 5, (80, 100)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, of the whole."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ h[j : n - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def n_trees(threshold: tuple[int, int], miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (threshold[0] / threshold[1]) ** BASE_DEPTH))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20260)
    return r.integers(0, 2**63, count, dtype=np.uint64), r.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, xor: np.ndarray, times: np.ndarray) -> np.ndarray:
    least = np.full(len(xor), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (((shingles[at : at + 2048, None] ^ xor) * times) >> np.uint64(32)).min(0))
    return least


def signatures(docs: DataFrame, k: int, trees: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, prefixes, bytes): ``prefixes`` are the trees' 64-bit
    hashes of their first BASE_DEPTH values, ``bytes`` the low bytes of all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = _permutations(trees * DEPTH)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                rows[0].append(len(s))
                if not len(s):
                    for c in rows[1:]:
                        c.append(None)
                    continue
                sig = signature(s, xor, times)
                mixed = np.arange(trees, dtype=np.uint64)
                for d in range(BASE_DEPTH):
                    mixed = (mixed ^ sig.reshape(trees, DEPTH)[:, d]) * np.uint64(0xD6E8FEB86659FD93)
                    mixed ^= mixed >> np.uint64(32)
                rows[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows[2].append(mixed.tobytes())
                rows[3].append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["doc_id", "n_shingles", "set_key", "prefixes", "bytes"])

    take = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return take.mapInArrow(lean(run, "near_dup:_words"), "doc_id long, n_shingles long, set_key binary, prefixes binary, bytes binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of sorted rows that agree in the first ``keys`` columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def common_prefix(a: int, b: int) -> int:
    """How many of the values behind ``BASE_DEPTH`` two neighbours share, from their packed bytes."""
    return DEPTH - BASE_DEPTH - ((a ^ b).bit_length() + 7) // 8


def _stretches(rows: Iterator[tuple[int, int, int]], most: int) -> Iterator[tuple[int, list[tuple[int, int]], bool]]:
    """(prefix, [(rest, id)], whole) of sorted rows: regions, or parts of one that holds more than
    ``most`` rows or may go on beyond the first or last row.  Parts end where the common prefix of
    two neighbours is shortest, in the later half."""
    now, held, whole = None, [], False
    for prefix, rest, key in rows:
        if prefix != now:
            if held:
                yield now, held, whole
            now, held, whole = prefix, [], now is not None
        elif len(held) == most:
            at = min(range(max(1, most // 2), most), key=lambda i: common_prefix(held[i - 1][0], held[i][0]), default=1)
            whole = False
            yield now, held[:at], whole
            held = held[at:]
        held.append((rest, key))
    if held:
        yield now, held, False


def forest_regions(classes: DataFrame, trees: int) -> DataFrame:
    """(region, id, part_of): the neighbours of each tree's order.  ``part_of`` is null for whole
    regions, of two and more; parts of a region carry its number there."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            prefix = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            deep = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, trees, DEPTH)[:, :, BASE_DEPTH:]
            rest = np.zeros((n, trees), np.int64)
            for d in range(deep.shape[2]):
                rest = rest << 8 | deep[:, :, d]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), trees)
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(rest.reshape(-1)), pa.array(ids)], names=["prefix", "rest", "id"])

    most = REGION

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["region", "id", "part_of"])
        for prefix, rows, whole in _stretches((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), most):
            if len(rows) > 1 or not whole:
                region = xxhash.xxh3_64_intdigest(f"{prefix}:{rows[0]}".encode()) - 2**63
                out += [(region, r[1], None if whole else prefix) for r in rows]
            if len(out) > 20_000:
                yield made()
                out = []
        yield made()

    rows = classes.select("id", "prefixes", "bytes").mapInArrow(spread, "prefix long, rest long, id long")
    ordered = rows.repartitionByRange("prefix", "rest", "id").sortWithinPartitions("prefix", "rest", "id")
    return ordered.mapInArrow(lean(cut), "region long, id long, part_of long")


def _joined(similar, n: int) -> np.ndarray:
    """Group labels of 0..n-1, where ``similar(i)`` marks all that are linked with i.  Only
    members of the largest group may go uncompared."""
    label, done = np.arange(n), np.zeros(n, bool)
    while True:
        sizes = np.bincount(label, minlength=n)
        open_rows = np.flatnonzero(~done & (label != sizes.argmax() if sizes.max() > 1 else True))
        if not len(open_rows):
            return label
        for i in open_rows:
            if sizes[label[i]] > 1 and label[i] == sizes.argmax():
                continue
            done[i] = True
            labels = np.unique(label[similar(i)])
            if len(labels) > 1 or (len(labels) and labels[0] != label[i]):
                every = np.unique(np.append(labels, label[i]))
                label[np.isin(label, every)] = every[0]
                sizes = np.bincount(label, minlength=n)


def _stars(ids: list[int], label: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id of its group) for all but the least."""
    ids_of = np.asarray(ids, np.int64)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids_of)
    root = least[label]
    return [(a, b) for a, b in zip(ids_of.tolist(), root.tolist(), strict=True) if a != b]


def _edges_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])


def least_equal(trees: int, threshold: tuple[int, int]) -> int:
    """Equal bytes of two signatures from which on they are compared exactly."""
    t = threshold[0] / threshold[1]
    values = trees * DEPTH
    expected = t + (1 - t) / 256
    return max(1, math.floor(values * (expected - 5 * math.sqrt(expected * (1 - expected) / values))))


def family_edges(regions: DataFrame, classes: DataFrame, trees: int, threshold: tuple[int, int]) -> DataFrame:
    """Edges between classes that look similar enough by their signatures."""
    least = least_equal(trees, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, rows in _groups(batches, 1):
            if len(rows) < 2:
                continue
            m = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
            out += _stars([r[0] for r in rows], _joined(lambda i: np.flatnonzero((m == m[i]).sum(1) >= least), len(rows)))  # noqa: B023
            if len(out) > 20_000:
                yield _edges_batch(out)
                out = []
        yield _edges_batch(out)

    rows = regions.join(classes.select("id", "bytes"), "id").select("region", "id", "bytes")
    return rows.repartition("region").sortWithinPartitions("region", "id").mapInArrow(lean(run), "a long, b long")


def missing_edges(parts: DataFrame, families: DataFrame, classes: DataFrame, trees: int, threshold: tuple[int, int]) -> DataFrame:
    """Edges across the parts of regions that were cut: of every class outside its region's largest
    family with all of the region.  ``parts`` has (region, id, part_of)."""
    least = least_equal(trees, threshold)
    cut = parts.groupBy("part_of").agg(F.count("*").alias("n"), F.min("region").alias("low"), F.max("region").alias("high")).filter("low <> high")
    rows = parts.select("part_of", "id").join(cut.select("part_of", F.ceil(F.col("n") / REGION).cast("int").alias("blocks")), "part_of")
    rows = checkpointed(rows.join(families, "id", "left").withColumn("root", F.coalesce("root", "id")))
    largest = rows.groupBy("part_of", "root").agg(F.count("*").alias("n")).groupBy("part_of").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    rows = rows.join(largest, "part_of").withColumn("outside", F.col("root") != F.col("largest"))
    asking = rows.filter("outside").select("part_of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "root")
    asked_blocks = asking.select("part_of", "block").distinct()
    own = rows.select("part_of", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "id", "root").join(asked_blocks, ["part_of", "block"], "left_semi")
    dealt = own.unionByName(asking).join(classes.select("id", "bytes"), "id").select("part_of", "block", "asks", "id", "root", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, roots, held, m, out = None, [], [], [], None, []
        for batch in batches:
            for part, block, asks, key, root, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, block) != now:
                    now, ids, roots, held, m = (part, block), [], [], [], None
                if not asks:
                    ids.append(key)
                    roots.append(root)
                    held.append(data)
                    continue
                if not ids:
                    continue
                if m is None:
                    m = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
                    held = []
                like = (m == np.frombuffer(data, np.uint8)).sum(1) >= least
                # One edge to each other family.
                out += [(key, i) for i in {roots[i]: ids[i] for i in np.flatnonzero(like) if roots[i] != root}.values()]
                if len(out) > 20_000:
                    yield _edges_batch(out)
                    out = []
        yield _edges_batch(out)

    return dealt.repartition("part_of", "block").sortWithinPartitions("part_of", "block", "asks", "id").mapInArrow(lean(run), "a long, b long")


def exact_groups(sets: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Labels of the groups of sets that links of at least ``threshold`` join."""
    sizes = np.asarray([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(number.max()) + 1, np.int64)

    def similar(i: int) -> np.ndarray:
        own = number[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[number], ends - sizes)
        mark[own] = 0
        return np.flatnonzero(shared * threshold[1] >= threshold[0] * (sizes + sizes[i] - shared))

    return _joined(similar, len(sets))


def of_documents(ids: list[int], label: np.ndarray) -> np.ndarray:
    """``label`` with the groups joined that texts of one document are in."""
    _, doc = np.unique(np.asarray(ids, np.int64), return_inverse=True)
    while True:
        of_doc, of_label = np.full(len(ids), len(ids)), np.full(len(ids), len(ids))
        np.minimum.at(of_doc, doc, label)
        np.minimum.at(of_label, label, of_doc[doc])
        if (of_label[label] == label).all():
            return label
        label = of_label[label]


def same_document_edges(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes that hold texts of one document, for ids with several texts."""
    keyed = signed.filter("doc_id is not null").select("doc_id", "set_key", F.xxhash64("set_key").alias("k"))
    several = keyed.groupBy("doc_id").agg(F.min("k").alias("k1"), F.max("k").alias("k2")).filter("k1 <> k2").select("doc_id")
    return keyed.filter("set_key is not null").join(several, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()


def confirmed_edges(docs: DataFrame, members: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """Star edges of exact groups for ``members`` (id, family, block, n_blocks)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = members.withColumn("o", other).select("id", "family", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    n_dealt = members.agg(F.sum("n_blocks")).first()[0] or 0
    rows = texts.join(small_or_shuffled(dealt, n_dealt), "id").select("family", "i", "j", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, 3):
            found: dict[tuple, None] = {}
            sets, ids = [], []
            for key, text in group:
                s = shingle_set(text, k)
                if len(s) and (key, at := s.tobytes()) not in found:
                    found[(key, at)] = None
                    sets.append(s)
                    ids.append(key)
            if len(set(ids)) > 1:
                yield _edges_batch(_stars(ids, of_documents(ids, exact_groups(sets, threshold))))

    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id").mapInArrow(lean(run, "near_dup:_words"), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    trees = n_trees(threshold)
    signed = checkpointed(signatures(docs, k, trees, id_col, text_col))
    usable = signed.filter("set_key is not null and doc_id is not null")
    best = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "prefixes", "bytes")).alias("c"))
    classes = checkpointed(best.select("set_key", F.col("c.doc_id").alias("id"), "c.n_shingles", "c.prefixes", "c.bytes"))
    regions = checkpointed(forest_regions(classes, trees))
    edges = family_edges(regions, classes, trees, threshold)
    families = components(edges)
    parts = regions.filter("part_of is not null")
    edges = checkpointed(missing_edges(parts, families, classes, trees, threshold))
    if not edges.isEmpty():
        families = components(edges.unionByName(families.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    of_family = families.unionByName(families.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "family")
    sized = of_family.join(classes.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id")
    blocks = sized.groupBy("family").agg(F.sum("n").alias("n")).select("family", F.when(F.col("n") > FAMILY_SHINGLES, F.ceil(F.col("n") / BLOCK_SHINGLES)).otherwise(1).cast("int").alias("n_blocks"))
    members = checkpointed(sized.join(blocks, "family").select("id", "family", F.pmod(F.xxhash64("id"), "n_blocks").cast("int").alias("block"), "n_blocks"))
    edges = checkpointed(confirmed_edges(docs, members, k, threshold, id_col, text_col))
    # Groups of one-block families are final; edges of several blocks still have to meet.
    same = checkpointed(same_document_edges(signed, classes))
    repeated = not same.isEmpty()
    if repeated or members.filter("n_blocks > 1").limit(1).count():
        roots = components(edges.unionByName(same))
    else:
        roots = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    named = classes.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    if repeated:  # rows without words of such a document follow its others
        of_doc = out.join(same.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows of documents that are not the least of their component."""
    gone = free_name(docs, "_gone")
    dropped = checkpointed(near_duplicates(docs, id_col=id_col, **options).filter("not kept").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small_or_shuffled(dropped, dropped.count()), docs[id_col] == F.col(gone), "left_anti")


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=(85, 100))
