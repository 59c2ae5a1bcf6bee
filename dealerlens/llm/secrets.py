"""Secret scans: three base patterns, and character Markov models for other random strings.

Everything is DataFrame functions.  Places of all matches of a pattern come from two
calls of the same engine: ``split`` gives the gaps between matches and
``regexp_extract_all`` the matches; their lengths add up to places in code points.

The method: maximal runs of ``MIN_RUN`` or more characters of ``ALPHABET`` are scored by two
first-order Markov models, one of random strings and one of ordinary identifiers; a run
whose mean log-likelihood ratio per transition exceeds ``THRESHOLD`` is a span of kind
"markov"; of a run that meets base spans, the parts beside them are scored each for itself.  The models are counted from labelled strings:
random ones are drawn from a hash, ordinary ones are words of ``SAMPLE_DOCS`` documents chosen by
a hash of their id (a documented bound of the fit) in three letter cases, with digits only as short
numbers between or behind letters, and the identifiers below.  The counted table has at most 2 * 66 * 66 rows, whatever the input.

Defined results: null texts count as empty and have no spans; very long texts and ones with very many
matches are scanned whole, in time in proportion; spans that start together go by kind; repeated
rows are scanned each; an empty table gives no rows and trains on the built-in samples; extra columns
are ignored by the query and kept by ``scan`` and ``redact``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import chosen_by_hash, every_column, free_name, table

# The base patterns of the contract.  Group 1 of assign is the value.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run of 24 or more, as [0-9a-f]+ with shorter ones dropped
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MIN_RUN = 20
#: Matches that one fold collects; those of a text are folded in chunks of it.
CHUNK = 64
RUN = r"[A-Za-z0-9+/_-]{20,}"
THRESHOLD = 0.6
SAMPLE_DOCS = 2000
RANDOM_STRINGS = 4000

#: Ordinary identifiers added to the words of the sample.
IDENTIFIERS = [
    "getElementById", "addEventListener", "removeEventListener", "createDocumentFragment", "requestAnimationFrame",
    "NullPointerException", "IllegalArgumentException", "ConcurrentModificationException", "AbstractSingletonProxyFactoryBean",
    "max_partition_bytes", "number_of_open_files", "average_response_time", "configuration_directory", "default_character_set",
    "/usr/local/share/applications", "/home/user/documents/projects", "/var/log/application/errors", "src/main/java/org/example",
    "tests/integration/test_connections", "node_modules/package/dist/index", "state-of-the-art", "application/vnd-openxmlformats",
    "internationalization", "uncharacteristically", "counterrevolutionaries", "responsibilities", "misunderstandings", "background-position",
]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _chunks(items: Column) -> Column:
    """The array in chunks of ``CHUNK``: what grows in a fold stays short, so that texts with very
    many matches take time in proportion."""
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, CHUNK))).otherwise(F.filter(F.array(items), lambda _: F.lit(False)))


def _running(values: Column, op) -> Column:
    """The fold of all earlier values by ``op``, from 0, for each value."""
    step = lambda a, v: F.struct(op(a["now"], v).alias("now"), F.concat(a["all"], F.array(a["now"])).alias("all"))
    return F.aggregate(values, F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all")), step, lambda a: a["all"])


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start,ord,end,kind,hit>> of all matches of ``pattern`` long enough."""
    order = KINDS.index(kind)
    found = _matches(text, pattern)
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,hit:string>>")
    values = _matches(text, pattern, 1) if kind == "assign" else found
    gaps = F.split(text, pattern, -1)
    parts = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value")), lambda p: F.struct(
        F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("n"), F.coalesce(F.length(p["value"]) >= LEAST.get(kind, 0), F.lit(False)).alias("keep"), p["hit"].alias("hit")))
    span = lambda a, p: F.struct((a + p["gap"]).alias("start"), F.lit(order).alias("ord"), (a + p["gap"] + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("hit"))

    def of_chunk(c: Column) -> Column:
        step = lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["n"]).alias("at"), F.when(p["keep"], F.concat(a["spans"], F.array(span(a["at"], p)))).otherwise(a["spans"]).alias("spans")
        )
        return F.aggregate(c["chunk"], F.struct(c["at"].alias("at"), empty.alias("spans")), step, lambda a: a["spans"])

    chunks = _chunks(parts)
    widths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + p["gap"] + p["n"]))
    placed = F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), _running(widths, lambda a, v: a + v).alias("at")), of_chunk))
    # The cheap test first: most texts have no match, and build nothing.
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def covered(text: Column, spans: Column, fill) -> Column:
    """``text`` with the spans, sorted by start, replaced by ``fill(n, first)``: a stretch of n code points
    that begins a cover (``first``) or goes on with one."""
    gap_type = "array<struct<at:int,start:int,end:int>>"

    def of_chunk(c: Column) -> Column:
        step = lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["end"] > a["at"], F.concat(a["gaps"], F.array(F.struct(a["at"].alias("at"), s["start"].alias("start"), s["end"].alias("end"))))).otherwise(a["gaps"]).alias("gaps"),
        )
        return F.aggregate(c["chunk"], F.struct(c["at"].alias("at"), F.array().cast(gap_type).alias("gaps")), step, lambda a: a["gaps"])

    chunks = _chunks(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
    gaps = F.transform(F.arrays_zip(chunks.alias("chunk"), _running(ends, F.greatest).alias("at")), of_chunk)

    def written(chunk: Column) -> Column:
        """A chunk's part of the text: cut out once, then read at its gaps."""
        low = F.get(chunk, F.lit(0))["at"]
        here = text.substr(low + 1, F.array_max(F.transform(chunk, lambda g: g["end"])) - low)
        piece = lambda g: F.when(g["start"] >= g["at"], F.concat(here.substr(g["at"] - low + 1, g["start"] - g["at"]), fill(g["end"] - g["start"], F.lit(True)))).otherwise(fill(g["end"] - g["at"], F.lit(False)))
        return F.array_join(F.transform(chunk, piece), "")

    whole = F.array_join(F.transform(F.filter(gaps, lambda c: F.size(c) > 0), written), "")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(whole, text.substr(last + 1, F.length(text)))).otherwise(text)


def transitions(strings: DataFrame) -> DataFrame:
    """(label, a, b, n): counted transitions between characters of ``ALPHABET``, for rows
    (text, label)."""
    pairs = strings.filter("length(text) > 1").select("label", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"))
    number = lambda c: F.expr(f"instr('{ALPHABET}', {c})")
    pairs = pairs.select("label", number("substring(text, i, 1)").alias("a"), number("substring(text, i + 1, 1)").alias("b"))
    return pairs.filter("a > 0 and b > 0").groupBy("label", "a", "b").agg(F.count("*").alias("n"))


def log_ratios(counts: list[tuple[int, int, int, int]], alpha: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at a * size + b, from (label, a, b, n)."""
    size = len(ALPHABET)
    n = {(label, a, b): c for label, a, b, c in counts}
    out = []
    for a in range(1, size + 1):
        sums = [alpha * size + sum(n.get((label, a, b), 0) for b in range(1, size + 1)) for label in (0, 1)]
        out += [math.log((n.get((1, a, b), 0) + alpha) / sums[1]) - math.log((n.get((0, a, b), 0) + alpha) / sums[0]) for b in range(1, size + 1)]
    return out


def labelled_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(text, label): 1 for random strings, 0 for ordinary identifiers."""
    spark: SparkSession = docs.sparkSession
    seed = spark.range(random_strings).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("h"))
    forms = F.explode(F.array(F.regexp_replace(F.base64("h"), "=", ""), F.lower(F.hex("h")), F.upper(F.conv(F.substring(F.hex("h"), 1, 15), 16, 36))))
    chosen = chosen_by_hash(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")), "k", sample_docs).filter("t is not null")
    word = chosen.select(F.explode(F.split("t", r"[^A-Za-z0-9+/_-]+")).alias("w")).filter(f"length(w) >= 8 and not w rlike '{HEX}|{ACCESS}' and w rlike '^([A-Za-z+/_-]{{3,}}[0-9]{{0,4}})+$'")
    cased = word.select(F.explode(F.array("w", F.lower("w"), F.upper("w"))).alias("text"))
    named = spark.createDataFrame([(x,) for x in IDENTIFIERS], "text string")
    return seed.select(forms.alias("text"), F.lit(1).alias("label")).unionByName(cased.unionByName(named).withColumn("label", F.lit(0)))


def train(docs: DataFrame, **options) -> list[float]:
    return log_ratios([tuple(r) for r in transitions(labelled_samples(docs, **options)).select("label", "a", "b", "n").collect()])


def mean_ratio(run: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a run of characters of ``ALPHABET``."""
    size = len(ALPHABET)
    ratios = F.array(*(F.lit(x) for x in model))
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = F.filter(codes, lambda c: c > 0)
    step = lambda a, c: F.struct(
        c.alias("last"), F.when(a["last"] > 0, a["sum"] + F.element_at(ratios, ((a["last"] - 1) * size + c).cast("int"))).otherwise(a["sum"]).alias("sum")
    )
    return F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"] / (F.length(run) - 1))


def scan(docs: DataFrame, model: list[float], *, text_col: str = "text", threshold: float = THRESHOLD, base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """All columns of ``docs`` with ``base_col`` and ``spans_col``: arrays of
    struct<start,ord,end,kind> in order of start, then kind; columns of these names are replaced."""
    text, whole, runs = (free_name(docs, x) for x in ("text_", "base_", "runs_"))
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = docs.withColumn(text, F.coalesce(docs[text_col].cast("string"), F.lit("")))
    places = [short(_placed(F.col(text), p, k)) for p, k in ((ASSIGN, "assign"), (ACCESS, "access"), (HEX, "hex"))]
    df = df.withColumn(whole, F.array_sort(F.concat(*places)))
    # What base spans cover is no run's part any more: the rest beside it is scored for itself.
    apart = covered(F.col(text), F.col(whole), lambda n, first: F.repeat(F.lit(" "), n))
    df = df.withColumn(runs, _placed(F.when(F.size(whole) > 0, apart).otherwise(F.col(text)), RUN, "markov"))
    random = short(F.filter(runs, lambda s: mean_ratio(s["hit"], model) > threshold))
    found = F.when(F.size(runs) > 0, F.array_sort(F.concat(F.col(whole), random))).otherwise(F.col(whole))
    kept = [x for x, c in zip(every_column(docs), docs.columns, strict=True) if c.lower() not in (base_col.lower(), spans_col.lower())]
    return df.select(*kept, F.col(whole).alias(base_col), found.alias(spans_col))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; columns stay as they are."""
    base, spans = free_name(docs, "base"), free_name(docs, "spans")
    found = scan(docs, model, text_col=text_col, base_col=base, spans_col=spans)
    text = F.col("`" + text_col + "`")
    clean = covered(text, F.col(spans), lambda n, first: F.when(first, F.lit(mark)).otherwise(F.lit("")))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*every_column(docs))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
