"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions.

A text is cut behind every line end, sentence end and clause end into paragraphs that keep their
separators, so that they add up to the text.  A paragraph's node is its SHA-256; a section
is a run of paragraphs that ends where a node's first hex digit is 0 or 1 (content decides
the cuts, so an edit moves no cut outside its own section); a section's node is the SHA-256
of its paragraphs' nodes, and the root that of the sections' nodes.  Equal texts have equal
roots; where roots differ, differing sections and, inside, differing paragraphs show the
edited places.

Likeness of two trees: the characters in paragraphs that both have, as Dice coefficient of
the two sets of paragraphs, from 0 to 1; 1 for equal roots.

An edit is located by descending both trees from the roots: the first and the last section that
differ, and inside them the first and the last paragraph.

Successors in descending id are found without a global sort in one task: ids are dealt to
ranges of about ``BUCKET_ROWS`` rows, each range is ordered on its own, and the head of the
next range is added to each as a last row.  Ranges have even widths; one that holds far more rows, as
ids are uneven, is split again at its own least and greatest id, until none does.

Defined results: null texts count as empty; the empty text has one empty paragraph; very long texts
and paragraphs count whole; rows of equal id follow one another by text, so ties do not matter; null
ids come last; the only row is its own successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import checkpointed, free_name, small_or_shuffled, table

BUCKET_ROWS = 1000
#: Rows of a range, as a multiple of BUCKET_ROWS, above which it is split.
UNEVEN, SPLITS = 8, 8
#: Keys up to which one task may order them all.
ONE_TASK_KEYS = 10_000
CUT = r"(?<=\n)|(?<=[.!?,;:|]\x20)"


def paragraphs(text: Column) -> Column:
    return F.split(text, CUT, -1)


def paragraph_nodes(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.sha2(p, 256))


def _runs(nodes: Column) -> Column:
    """The sections as their paragraphs' nodes, joined."""
    marked = F.transform(nodes, lambda n: F.when(F.substring(n, 1, 1).isin("0", "1"), F.concat(n, F.lit("|"))).otherwise(n))
    return F.filter(F.split(F.array_join(marked, ""), r"\|", -1), lambda s: s != "")


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def paragraph_keys(parts: Column) -> Column:
    """One number per distinct paragraph: a hash, with its length (31 bits, as long as a string gets)
    in the low bits."""
    key = lambda p: F.shiftleft(F.xxhash64(p), 31).bitwiseOR(F.length(p).cast("long"))
    return F.array_distinct(F.transform(parts, key))


def _weight(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + k.bitwiseAND(F.lit((1 << 31) - 1).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two trees' paragraph keys, weighted by characters."""
    both = _weight(a) + _weight(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * _weight(F.array_intersect(a, b)) / both)


def with_tree(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_parts``, ``_nodes``, ``_runs`` (each section's nodes, joined), ``_sections``, ``_root`` and ``_keys``."""
    return (
        df.withColumn(f"{prefix}_parts", paragraphs(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        .withColumns({f"{prefix}_nodes": paragraph_nodes(F.col(f"{prefix}_parts")), f"{prefix}_keys": paragraph_keys(F.col(f"{prefix}_parts"))})
        .withColumn(f"{prefix}_runs", _runs(F.col(f"{prefix}_nodes")))
        .withColumn(f"{prefix}_sections", F.transform(F.col(f"{prefix}_runs"), lambda s: F.sha2(s, 256)))
        .withColumn(f"{prefix}_root", root(F.col(f"{prefix}_sections")))
    )


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their starts."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def with_edited_range(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``: struct<first,last>, the paragraphs (from 0) of tree ``a`` between which it differs from tree ``b``,
    NULL at equal roots, where nothing below is compared; last is below first where ``b`` only has more."""
    runs_a, s_a, s_b, n_a, n_b = (F.col(x) for x in (f"{a}_runs", f"{a}_sections", f"{b}_sections", f"{a}_nodes", f"{b}_nodes"))
    front, sections = free_name(df, "front"), free_name(df, "sections")
    differ = F.col(f"{a}_root") != F.col(f"{b}_root")
    total = lambda runs: F.floor(F.aggregate(runs, F.lit(0), lambda x, s: x + F.length(s)) / 64).cast("int")

    def equal(runs: Column, whole: Column, n_a: Column, n_b: Column) -> Column:
        """Equal paragraphs from the start: those of the ``whole`` equal sections, then of the first that differs."""
        before = total(F.slice(runs, F.lit(1), whole))
        rest = lambda n: F.slice(n, before + 1, F.floor(F.coalesce(F.length(F.get(runs, whole)), F.lit(0)) / 64).cast("int"))
        return before + _shared(rest(n_a), rest(n_b))

    r = F.reverse
    # A column a step, so that each is computed once.
    df = df.withColumn(sections, F.when(differ, F.struct(_shared(s_a, s_b).alias("first"), _shared(r(s_a), r(s_b)).alias("last"))))
    most = F.least(F.size(n_a), F.size(n_b))
    df = df.withColumn(front, F.when(differ, F.least(equal(runs_a, F.col(sections)["first"], n_a, n_b), most)))
    back = F.least(equal(r(runs_a), F.col(sections)["last"], r(n_a), r(n_b)), most - F.col(front))
    return df.withColumn(name, F.when(differ, F.struct(F.col(front).alias("first"), (F.size(n_a) - 1 - back).alias("last")))).drop(sections, front)


def _within(key: Column, low: Column, width: Column) -> Column:
    """The least key of the range of ``width`` that ``key`` is in, counted from ``low``."""
    away = key.cast("decimal(20,0)") - low.cast("decimal(20,0)")
    return (low + F.floor(away / width) * width).cast("long")


def _ranges(df: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    """Adds ``range``: the start of the key's range, ranges of about ``size`` rows; that of
    null keys is below all others.  Also returns the number of rows."""
    s = df.agg(F.min(key).cast("long").alias("low"), F.max(key).cast("long").alias("high"), F.count("*").alias("n")).first()
    low, high = s["low"] or 0, s["high"] or 0
    width = max(1, -(-(high - low + 1) // max(1, -(-s["n"] // size))))
    k = F.col(key).cast("long")
    dealt = df.withColumn("range", F.coalesce(_within(k, F.lit(low).cast("long"), F.lit(width).cast("long")), F.lit(low - 1).cast("long")))
    for _ in range(SPLITS):
        held = dealt.groupBy("range").agg(F.count("*").alias("n"), F.min(k).alias("low"), F.max(k).alias("high"))
        crowded = held.filter((F.col("n") > UNEVEN * size) & (F.col("high") > F.col("low")))
        crowded = checkpointed(crowded.select(F.col("range").alias("r"), "low", F.ceil((F.col("high").cast("decimal(20,0)") - F.col("low") + 1) / F.ceil(F.col("n") / size)).cast("long").alias("width")))
        n = crowded.count()
        if not n:
            break
        found = dealt.join(small_or_shuffled(crowded, n), F.col("range") == F.col("r"), "left")
        dealt = found.withColumn("range", F.coalesce(_within(k, F.col("low"), F.col("width")), "range")).drop("r", "low", "width")
    return dealt, s["n"]


def next_lower(keys: DataFrame) -> DataFrame:
    """(key, lower): for distinct keys, the next smaller one; null for the least."""
    dealt, n = _ranges(keys, "key", BUCKET_ROWS)
    if n <= ONE_TASK_KEYS:
        return keys.withColumn("lower", F.lead("key").over(Window.orderBy(F.desc("key"))))
    inside = dealt.withColumn("lower", F.lead("key").over(Window.partitionBy("range").orderBy(F.desc("key"))))
    heads = dealt.groupBy("range").agg(F.max("key").alias("head"))
    links = next_lower(heads.select(F.col("range").alias("key"))).join(heads.withColumnRenamed("range", "lower"), "lower").select(F.col("key").alias("range"), "head")
    return inside.join(links, "range", "left").select("key", F.coalesce("lower", "head").alias("lower"))


def with_successor(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text without nulls) with ``next_text``: the text of the next row in
    descending id, after the last the first."""
    dealt, _ = _ranges(docs, "doc_id", BUCKET_ROWS)
    heads = dealt.groupBy("range").agg(F.max("doc_id").alias("head_id"))
    n_heads = heads.count()
    links = next_lower(heads.select(F.col("range").alias("key"))).select(F.col("key").alias("range"), "lower")
    top = heads.agg(F.max("range").alias("top"))
    links = links.join(F.broadcast(top), F.lit(True)).select("range", F.coalesce("lower", "top").alias("lower"))
    found = dealt.join(small_or_shuffled(heads.withColumnRenamed("range", "r"), n_heads), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    head_text = found.groupBy("range").agg(F.min("text").alias("text"))
    guards = links.join(head_text.withColumnRenamed("range", "lower"), "lower").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "range", F.lit(1).alias("guard"))
    order = Window.partitionBy("range").orderBy("guard", F.desc_nulls_last("doc_id"), "text")
    every = dealt.withColumn("guard", F.lit(0)).unionByName(guards)
    return every.withColumn("next_text", F.lead("text").over(order)).filter("guard = 0").drop("guard", "range")


def with_edited(df: DataFrame) -> DataFrame:
    """Adds ``edited``: the last half of ``text`` replaced from ``next_text``."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_edited(with_successor(docs)).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    df = with_tree(with_tree(df, "text", "own"), "edited", "ed").withColumn("next_keys", paragraph_keys(paragraphs(F.col("next_text"))))
    df = with_edited_range(df, "ed", "own", "where")
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("own_root").alias("fingerprint"),
        F.col("ed_root").alias("edited_fingerprint"),
        F.when(F.col("own_root") == F.col("ed_root"), 1.0).otherwise(likeness(F.col("own_keys"), F.col("ed_keys"))).alias("near_edited"),
        likeness(F.col("own_keys"), F.col("next_keys")).alias("near_next"),
        F.col("where.first").alias("edited_from_paragraph"),
        F.col("where.last").alias("edited_to_paragraph"),
    )
