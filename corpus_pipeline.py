"""The corpus pipeline: toxicity, near-dedup, secret scans, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's documents.  All but the last
return the columns of ``documents``.  No stage drops or caps rows besides its own decision.

Defined results: an empty table gives no rows; extra columns of the documents stay until the
last stage; nulls, ties and repeated rows are treated as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealerlens.llm import mixing, near_dup, packing, secrets, toxicity
from dealerlens.llm._util import every_column, free_name, fresh_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxic")
    return toxicity.score(docs, model, out_col=name).filter(F.col(name) < 0.5).select(*every_column(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id."""
    return near_dup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the text is replaced by a mark, and ``n_chars`` follows."""
    return secrets.redact(docs, secrets.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*every_column(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards the target weights of their sources and shuffled."""
    taken = {c.lower() for c in docs.columns} & set(mixing.ADDED)
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in taken}
    mixed = mixing.mix(docs.withColumnsRenamed(aside))
    back = {v: k for k, v in aside.items()}
    return mixed.drop(*mixing.ADDED).withColumnsRenamed(back).select(*every_column(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all pieces with their places in sequences of 1024."""
    import public_tokenizers

    columns = {"ids": (lambda x: x.astype("<i4"), T.ArrayType(T.IntegerType())), "ids_crc32": (packing.ids_crc32, T.LongType())}
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), piece_columns=columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, near-duplicate components and a tokenizer have no SQL; the tests
#: hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        place = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
