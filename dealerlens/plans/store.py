"""Content-addressed tables, snapshots and the ledger of completed runs.

Tables are Parquet in new folders; a manifest row is written last, so a reader sees a whole
table or none.  All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RULES_VERSION


def content_key(df: DataFrame) -> DataFrame:
    """One row (rows, digest, schema) that no order of rows changes: the hashes of all rows,
    repeated rows counted, added up exactly."""
    names = sorted(df.columns)
    h = F.xxhash64(*(F.col(f"`{c}`") for c in names), *(F.col(f"`{c}`").isNull() for c in names)).cast("decimal(38,0)")
    shape = json.dumps([[c, dict(df.dtypes)[c]] for c in names] + [RULES_VERSION])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("_h")).select("rows", F.sha2(F.concat_ws("|", F.lit(shape), F.col("rows").cast("string"), F.col("_h")), 256).alias("digest"))


def digest(df: DataFrame) -> str:
    return content_key(df).first()["digest"]


def column_fingerprints(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(column, digest) of each column's values with their key."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.xxhash64(F.col(key), F.lit(t), F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).alias("h")) for c, t in df.dtypes if c != key))
    x = df.select(F.explode(each).alias("x")).select("x.*")
    return x.groupBy("column").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")), 256).alias("digest"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def safe_name(name: str) -> str:
    """A name that stays inside its folder."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or ".." in name:
        raise ValueError(f"unsafe name {name!r}")
    return name


def _write_manifest(spark: SparkSession, path: str, entries: dict) -> None:
    spark.createDataFrame([(json.dumps(entries, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest alone; no table is opened."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(path)
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x) for x in names if x.isdigit() and exists(spark, f"{root}/{x}/_SUCCESS"))


def publish(spark: SparkSession, root: str, entries: dict) -> None:
    """Makes ``entries`` the latest of ``root``: a folder of the next number, which is seen when whole.  Of two
    writers of one number the second fails."""
    _write_manifest(spark, f"{root}/{(_numbers(spark, root) or [0])[-1] + 1}", entries)


def latest(spark: SparkSession, root: str) -> dict:
    numbers = _numbers(spark, root)
    if not numbers:
        raise FileNotFoundError(root)
    return read_manifest(spark, f"{root}/{numbers[-1]}")


def save_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict | None = None) -> str:
    """Writes the tables to a new folder with checksums; the manifest comes last.  Returns
    the snapshot's name."""
    name = uuid.uuid4().hex
    entries = {"meta": meta or {}, "tables": {}}
    for table, df in tables.items():
        place = f"{root}/{name}/{safe_name(table)}"
        df.write.mode("errorifexists").parquet(place)
        entries["tables"][table] = digest(spark.read.parquet(place))
    _write_manifest(spark, f"{root}/{name}/manifest", entries)
    return name


def load_table(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    """A snapshot's table, its checksum verified; other tables stay closed."""
    entries = read_manifest(spark, f"{root}/{safe_name(name)}/manifest")
    if table not in entries["tables"]:
        raise ValueError(f"{table!r} has no checksum")
    df = spark.read.parquet(f"{root}/{name}/{safe_name(table)}")
    if digest(df) != entries["tables"][table]:
        raise ValueError(f"{table!r} is not what was saved")
    return df


def cached(spark: SparkSession, root: str, source: DataFrame, build) -> DataFrame:
    """``build(source)`` from the cache that the source's content names.  If the entry cannot be read, for whatever
    reason, it is built under a new name and the old one stays: a passing error costs a rebuild, no data."""
    key = digest(source)
    pointer = f"{root}/{key}"
    try:
        return load_table(spark, root, latest(spark, pointer)["snapshot"], "events")
    except Exception:  # noqa: BLE001 - nothing is deleted, so any error may mean a rebuild
        name = save_snapshot(spark, root, {"events": build(source)}, {"source": key})
    publish(spark, pointer, {"snapshot": name})
    return load_table(spark, root, name, "events")


class Ledger:
    """One completed run per request: an identical request gives it back, a run that began
    and did not end refuses another."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def run(self, request: dict, build, key: str | None = None) -> DataFrame:
        """``key`` names what may be run once; by default that is the request itself.  Another request under
        a key that was run is refused."""
        import hashlib

        key = key or hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
        begun, done = f"{self.root}/{key}.begun", f"{self.root}/{key}.done"
        if exists(self.spark, done):
            name = read_manifest(self.spark, done)["snapshot"]
            if read_manifest(self.spark, f"{self.root}/{name}/manifest")["meta"] != json.loads(json.dumps(request)):
                raise ValueError("this was run by another request")
            return load_table(self.spark, self.root, name, "result")
        if exists(self.spark, begun):
            raise RuntimeError("an earlier attempt of this request did not end")
        _write_manifest(self.spark, begun, request)
        name = save_snapshot(self.spark, self.root, {"result": build()}, request)
        _write_manifest(self.spark, done, {"snapshot": name})
        return load_table(self.spark, self.root, name, "result")


def export_csv(df: DataFrame, path: str) -> None:
    """A frozen CSV: refuses to replace one."""
    df.write.mode("errorifexists").option("header", True).csv(path)
