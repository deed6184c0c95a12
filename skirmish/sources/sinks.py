"""Writers: artifacts, verified checkpoints, upserts and insert-ignore."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators.joins import upsert


def artifact(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, kind: str) -> None:
    """Audit rows: kind and the row as JSON."""
    df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("payload")).write.mode("append").parquet(path)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't there yet, one a key."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def merge(path: str, new: DataFrame, keys: list[str], version: str, to: str) -> None:
    """The table at path with new rows merged, written to another path (a table isn't overwritten while it is read)."""
    upsert(new.sparkSession.read.parquet(path), new, keys, version).write.mode("overwrite").parquet(to)


def _aside(df: DataFrame, path: str) -> tuple[str, DataFrame]:
    """df written beside path, and read back: what is checked is what gets there."""
    at = f"{path.rstrip('/')}-checking-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return at, df.sparkSession.read.schema(df.schema).parquet(at)


def _replace(spark: SparkSession, source: str, path: str) -> None:
    """Put the folder source in path's place."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)
    fs.mkdirs(at.getParent())
    if not fs.rename(_folder(spark, source)[1], at):
        raise OSError(f"{path} could not be put in place")


def checkpoint(df: DataFrame, path: str, checks: dict[str, Column]) -> dict[str, int]:
    """df in place of what is at path, but only if no row violates a check; the counts of violations by name come back either way.

    df is computed once: it is written aside, what was written is checked, and then it is renamed or deleted.
    """
    spark = df.sparkSession
    aside, written = _aside(df, path)
    row = written.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]).first() if checks else None
    bad = {k: row[k] for k in checks}
    if any(bad.values()):
        _folder(spark, aside)[0].delete(_folder(spark, aside)[1], True)
    else:
        _replace(spark, aside, path)
    return bad


def manifest(df: DataFrame, by: str, time: str) -> DataFrame:
    """Counts and time range of each part, with a checksum of its rows that doesn't depend on their order."""
    row = F.xxhash64(*df.columns).bitwiseAND(0xFFFFFFFF)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.sum(row).alias("checksum"))


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of a path, which is any that Spark can write to, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _new_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already. Of several writers one succeeds."""
    from py4j.protocol import Py4JJavaError

    fs, at = _folder(spark, path)
    fs.mkdirs(at.getParent())
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise OSError(f"{path} could not be created") from e
    return True


#: A version with this file is whole; a writer claims a version by creating its file in the folder of claims.
WHOLE, CLAIMS = "_WHOLE", "_claims"


def load(tables: dict[str, DataFrame], path: str) -> int:
    """All tables as one new version of path, or none of them: they are written aside, renamed, and then marked as whole.

    A parent with its children, or a mart of several tables that is reloaded. Readers of the version before are not disturbed; a
    load that fails leaves nothing that `current` sees. A version's number is claimed by a file that is created only if it isn't
    there, so writers at the same time get different versions and never each other's tables. Returns the version's number.
    """
    spark = next(iter(tables.values())).sparkSession
    aside = f"{path}/_loading-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{aside}/{name}")
    version = (_versions(spark, path) or [0])[-1] + 1
    while not _new_file(spark, f"{path}/{CLAIMS}/{version:08d}"):
        version += 1
    fs, source = _folder(spark, aside)
    if not fs.rename(source, _folder(spark, f"{path}/version={version:08d}")[1]):
        raise OSError(f"version {version} of {path} could not be put in place")
    _new_file(spark, f"{path}/version={version:08d}/{WHOLE}")
    return version


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole, in order."""
    fs, at = _folder(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [n for n in found if fs.exists(_folder(spark, f"{path}/version={n:08d}/{WHOLE}")[1])]


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the newest version that load() has finished."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]:08d}/{name}")


def replace_children(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, key: str) -> dict[str, DataFrame]:
    """Both tables with the new parents put in: an old parent with the key goes, and all its old children do."""
    keys = new_parents.select(key).distinct()
    return {"parents": parents.join(keys, key, "left_anti").unionByName(new_parents), "children": children.join(keys, key, "left_anti").unionByName(new_children)}


def verified_checkpoint(df: DataFrame, path: str, keys: list[str], required: list[str], expected: int) -> DataFrame:
    """df at path, and the manifest of its files (file, bytes, sha256), if it has the expected number of rows, no key twice and
    no null in the required columns; else ValueError, and nothing is left. df is computed once: what was written is checked, then
    renamed. The manifest is written last, beside the data."""
    spark = df.sparkSession
    fs, at = _folder(spark, f"{path}/data")
    if fs.exists(at):
        raise ValueError(f"there is a checkpoint at {path} already")
    aside, written = _aside(df, path)
    row = written.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
    missing = sum(row[c] for c in required)
    twice = written.groupBy(*keys).count().filter("count > 1").count()
    if row.n != expected or missing or twice:
        fs.delete(_folder(spark, aside)[1], True)
        raise ValueError(f"checkpoint refused: {row.n} of {expected} rows, {twice} keys more than once, {missing} values missing")
    _replace(spark, aside, f"{path}/data")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    found.write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def lock_ledger(path: str, key: str, locked_at: str, starts_at: str):
    """A foreachBatch function that keeps locks which nothing can change: of each key the first lock ever written, if it was made before its start.

    A batch's accepted rows are written to path/locks/batch_id=N and the others, with a reason (`late`, `locked`, `no_start`), to
    path/refused/batch_id=N. A batch is judged only against the batches before it, so one that runs again after a failure gives the
    same rows and replaces its own, and no row of another batch is ever touched. Of locks of one key in a batch the earliest
    counts, ties to the smallest row hash. Rows without a key or without times are refused.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, at = _folder(spark, f"{path}/locks")
        earlier = [int(x.getPath().getName().removeprefix("batch_id=")) for x in fs.listStatus(at) if x.getPath().getName().startswith("batch_id=")] if fs.exists(at) else []
        rows = batch.withColumn("_hash", F.xxhash64(*batch.columns))
        first = rows.filter(F.col(locked_at) < F.col(starts_at)).groupBy(key).agg(F.min(F.struct(locked_at, "_hash")).alias("_first"))
        rows = rows.join(first, key, "left")
        if known := [f"{path}/locks/batch_id={n}" for n in earlier if n < batch_id]:
            rows = rows.join(spark.read.parquet(*known).select(key).withColumn("_known", F.lit(True)), key, "left")
        else:
            rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
        timed = F.col(locked_at).isNotNull() & F.col(starts_at).isNotNull() & F.col(key).isNotNull()
        reason = F.when(~timed, "no_start").when(F.col(locked_at) >= F.col(starts_at), "late").when(F.col("_known") | (F.struct(locked_at, "_hash") > F.col("_first")), "locked")
        judged = rows.withColumn("reason", reason).select(*batch.columns, "reason").persist()
        try:
            judged.filter("reason is null").drop("reason").dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/locks/batch_id={batch_id}")
            judged.filter("reason is not null").write.mode("overwrite").parquet(f"{path}/refused/batch_id={batch_id}")
        finally:
            judged.unpersist()

    return write


def locks(spark: SparkSession, path: str) -> DataFrame:
    """The locks of a ledger with the batch that each came in."""
    return spark.read.parquet(f"{path}/locks")
