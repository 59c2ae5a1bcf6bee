"""The pipeline against a plain version of each stage on a small table."""

import random

import corpus_pipeline as C
from dealerlens.llm import near_dup, secrets, toxicity

from .helpers import documents
from .test_models_search import family_texts, plain_groups


def write(spark, path, docs, labels):
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(3)
    texts = family_texts(7, 25, 5) + [None, "", "password=abcdef123 and words"]
    texts = [t if i % 6 else f"{t} vexqua vexrotion vexjio" for i, t in enumerate(texts)]
    docs = documents(spark, texts, sources=[r.choice(("a", "b", None)) for _ in texts])
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    write(spark, tmp_path, docs, labels)
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "minhash near-dedup", "secret scans", "source mixing", "best-fit packing"]
    model = toxicity.train(docs, labels)
    one = stages["toxicity"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and sorted(x.doc_id for x in one.collect()) == [i for i, t in enumerate(texts) if model.score(t) < 0.5]
    rows = sorted(one.collect(), key=lambda x: x.doc_id)
    two = stages["minhash near-dedup"](spark, one, str(tmp_path))
    label, _ = plain_groups([x.text for x in rows], near_dup.SHINGLE_WORDS, *near_dup.THRESHOLD)
    assert two.columns == docs.columns and sorted(x.doc_id for x in two.collect()) == [x.doc_id for i, x in enumerate(rows) if label[i] == i]
    three = stages["secret scans"](spark, two, str(tmp_path))
    assert three.columns == docs.columns and three.count() == two.count()
    for x in three.collect():
        assert x.text is None or x.n_chars == len(x.text)
        assert "password=abcdef123" not in (x.text or "")
    four = stages["source mixing"](spark, three, str(tmp_path))
    assert four.columns == docs.columns
    five = stages["best-fit packing"](spark, four, str(tmp_path))
    assert sum(x.piece == 0 for x in five.collect()) == four.count()
    assert secrets.THRESHOLD > 0 and C.ORACLE_SQL is None


def test_run_on_empty_and_small_tables(spark, tmp_path):
    write(spark, tmp_path / "e", documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert C.run(spark, f"{tmp_path}/e").count() == 0
    write(spark, tmp_path / "s", documents(spark, ["one", None, ""]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert C.run(spark, f"{tmp_path}/s").columns == ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
