"""Several tables published as one version: readers see all of the old ones or all of the new ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "version string, name string, path string, rows long"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, folder: str) -> list[str]:
    """The finished manifests, oldest first: numbered folders with the writer's mark of success."""
    path, system = _path(spark, f"{folder}/manifests")
    if not system.exists(path):
        return []
    paths = [str(s.getPath()) for s in system.listStatus(path)]
    return sorted(p for p in paths if (lambda mark: mark[1].exists(mark[0]))(_path(spark, f"{p}/_SUCCESS")))


def current(spark: SparkSession, folder: str) -> dict[str, tuple[str, str, int]]:
    """(version, path, rows) of each table of the newest version; nothing before the first."""
    finished = manifests(spark, folder)
    rows = spark.read.schema(MANIFEST).json(finished[-1]).collect() if finished else []
    return {r["name"]: (r.version, r.path, r.rows) for r in rows}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as the newest version has it. A reader that took it keeps it, as older versions' files stay."""
    found = current(spark, folder)
    if name not in found:
        raise KeyError(f"no version of {folder} has a table {name}")
    return spark.read.parquet(found[name][1])


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], version: str) -> dict[str, tuple[int, int]]:
    """Makes the tables the newest version, and gives each one's rows before (0 for a new one) and after.

    Tables are written beside what readers see, and the manifest that names them last, in one step. A run that failed on the way leaves
    the old version as it was, and can be run again under the same name; a version that is already the newest is left alone.
    Tables that aren't given are carried over. One writer at a time may publish to a folder.
    """
    before = current(spark, folder)
    if before and {v for v, _, _ in before.values()} == {version} and set(tables) <= set(before):
        return {name: (before[name][2], before[name][2]) for name in tables}
    entries = {name: (version, path, rows) for name, (_, path, rows) in before.items() if name not in tables}
    for name, table in tables.items():
        path = f"{folder}/tables/{name}/{version}-{uuid.uuid4().hex[:8]}"
        table.write.parquet(path)
        entries[name] = (version, path, spark.read.parquet(path).count())
    rows = [(v, name, path, n) for name, (v, path, n) in entries.items()]
    number = len(manifests(spark, folder))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifests/{number:09d}")
    return {name: (before.get(name, ("", "", 0))[2], entries[name][2]) for name in tables}
