"""A table as generations of files, named by a manifest: appends, compaction, one consistent view.

``path``/data/gen=<name> is one finished write; ``path``/manifest/<number> lists the generations that
are live. Whatever is not listed in the highest manifest is not read: a write that died leaves a
folder nobody looks at, and a compaction replaces what it has merged at once. One job writes a
table at a time, any number may read it; the generations a reader has found stay until
``remove_dead`` is called.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from kappaloom.session import path_exists

#: a generation whose files are smaller on average is worth merging with others
SMALL_FILE = 32 << 20


def _system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    system, folder = _system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []


def has_manifest(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/manifest")


def _latest(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in _names(spark, f"{path}/manifest") if n.isdigit()), default=-1)


def live_generations(spark: SparkSession, path: str) -> list[str]:
    """The generations that the highest manifest names; a bounded list, see ``compact``."""
    number = _latest(spark, path)
    if number < 0:
        return []
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    system, file = _system(spark, f"{path}/manifest/{number:09d}")
    stream = system.open(file)
    try:
        return json.loads(text.toString(stream, "UTF-8"))["live"]
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, live: list[str]) -> None:
    """Write the next manifest aside, then give it its name: readers see it whole or not at all."""
    number = _latest(spark, path) + 1
    system, aside = _system(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    stream = system.create(aside)
    stream.write(bytearray(json.dumps({"live": live}).encode()))
    stream.close()
    final = _system(spark, f"{path}/manifest/{number:09d}")[1]
    if system.exists(final) or not system.rename(aside, final):
        raise RuntimeError(f"another job has written manifest {number} of {path}")


def _write(rows: DataFrame, path: str, partition: list[str]) -> str:
    name = f"gen={uuid.uuid4().hex}"
    dealt = rows.hint("rebalance", *partition) if partition else rows.coalesce(1)  # few rows
    dealt.write.partitionBy(*partition).parquet(f"{path}/data/{name}")
    return name


def append(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Add the rows as a generation of their own."""
    spark = rows.sparkSession
    before = live_generations(spark, path)
    _publish(spark, path, [*before, _write(rows, path, partition)])


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All live rows; filters on partition columns skip whole folders."""
    live = live_generations(spark, path)
    return _read(spark, path, live, schema) if live else spark.createDataFrame([], schema)


def read_last(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest live generation alone."""
    return _read(spark, path, live_generations(spark, path)[-1:], schema)


def _read(spark: SparkSession, path: str, generations: list[str], schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.parquet(*[f"{path}/data/{g}" for g in generations]).drop("gen")


def files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """(files, bytes) of every live generation."""
    out = {}
    for g in live_generations(spark, path):
        system, folder = _system(spark, f"{path}/data/{g}")
        summary = system.getContentSummary(folder)
        out[g] = (summary.getFileCount(), summary.getLength())
    return out


def compact(spark: SparkSession, path: str, schema: str, partition: list[str], small: int = SMALL_FILE) -> int:
    """Merge the generations of small files into one; returns how many were merged.

    Generations of large files are left as they are, so a row is rewritten only until the files it lies in
    are large. One generation alone is not rewritten: its write has merged its files already.
    """
    sizes = files(spark, path)
    merged = [g for g, (n, size) in sizes.items() if size < n * small]
    if len(merged) < 2:
        return 0
    new = _write(_read(spark, path, merged, schema), path, partition)
    _publish(spark, path, [*[g for g in sizes if g not in merged], new])
    return len(merged)


def drop_partitions(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Remove these partition folders (a=1/b=2) from all live generations."""
    for g in live_generations(spark, path):
        for folder in folders:
            system, place = _system(spark, f"{path}/data/{g}/{folder}")
            system.delete(place, True)


def clear(spark: SparkSession, path: str) -> None:
    """Make the table empty; its files stay until ``remove_dead``."""
    if has_manifest(spark, path):
        _publish(spark, path, [])


def remove_dead(spark: SparkSession, path: str) -> int:
    """Delete generations and manifests that are no longer live; for when nobody reads an older view."""
    live, latest = set(live_generations(spark, path)), _latest(spark, path)
    dead = [f"data/{n}" for n in _names(spark, f"{path}/data") if n not in live]
    dead += [f"manifest/{n}" for n in _names(spark, f"{path}/manifest") if not n.isdigit() or int(n) < latest]
    for name in dead:
        system, place = _system(spark, f"{path}/{name}")
        system.delete(place, True)
    return len(dead)
