"""Writing state: latest per key, and every version.

Writers only ever add folders, named by run and batch. A batch that one run repeats replaces
its own folder, so a retry after a failure changes nothing; another run, such as a
stream with a new checkpoint on an old path, writes beside it, so older data is never at risk.

``compact`` folds the batches so far into a snapshot: one row per key, dealt into buckets by the hash of the key.
Only buckets that the batches touch are written anew. A manifest names the folder of every bucket and, for each
run, the last batch that is folded in; readers take the newest manifest and the batches after it. The manifest
appears in one step, so a reader sees the old state or the new one, and a compaction that dies before it leaves only
a folder that nothing names. A batch that is repeated after it was folded in is not read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.operators.agents import state_versions
from obsframe.sources import manifests

RUN, BATCH, BUCKET = "run", "batch", "__bucket"
SNAPSHOTS, MANIFESTS = "_snapshots", "_manifests"


def upsert_latest(df: DataFrame, key: str, order: list[str], path: str, batch: int, run: str) -> None:
    """Write the latest row of each key of one batch of a run."""
    _latest(df, key, order).write.mode("overwrite").parquet(f"{path}/{RUN}={run}/{BATCH}={batch}")


def read_latest(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key, by event order rather than by time of writing."""
    _, manifest = manifests.newest(spark, f"{path}/{MANIFESTS}")
    return _latest(_state(spark, path, manifest), key, [*order, BATCH, RUN]).drop(BATCH, RUN)


def compact(spark: SparkSession, path: str, key: str, order: list[str], buckets: int = 16) -> int:
    """Fold all batches written so far into the snapshot; the number of its manifest.

    ``buckets`` counts for the first snapshot, later ones keep its number. Batches of one run must be written in order.
    """
    number, manifest = manifests.newest(spark, f"{path}/{MANIFESTS}")
    found = _batches(spark, path, manifest)
    if not found:
        return number
    count = manifest.get("count", buckets)
    changes = _read_batches(spark, path, found).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
    touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())  # at most ``count`` numbers
    held = manifest.get("buckets", {})
    old = [held[str(b)] for b in touched if str(b) in held]
    if old:
        before = spark.read.schema(changes.drop(BUCKET).schema).parquet(*[f"{path}/{SNAPSHOTS}/{folder}" for folder in old])
        changes = changes.unionByName(before.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(count)).cast("int")))
    newest = F.max_by(F.struct(*[c for c in changes.columns if c not in (key, BUCKET)]), F.struct(*order, BATCH, RUN))
    merged = changes.groupBy(key, BUCKET).agg(newest.alias("r")).select(key, "r.*", BUCKET)
    folder = uuid.uuid4().hex
    merged.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{SNAPSHOTS}/{folder}")
    upto = dict(manifest.get("upto", {}))
    for run, batch in found:
        upto[run] = max(batch, upto.get(run, batch))
    manifests.publish(spark, f"{path}/{MANIFESTS}", number + 1, {
        "count": count, "upto": upto, "buckets": {**held, **{str(b): f"{folder}/{BUCKET}={b}" for b in touched}}})
    return number + 1


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove snapshot folders that none of the last ``keep`` manifests names, and batches that all of these have folded in.

    Readers that started on an older manifest, and writers of a compaction that is still running, must have ended.
    """
    number, _ = manifests.newest(spark, f"{path}/{MANIFESTS}")
    kept = [manifests.at(spark, f"{path}/{MANIFESTS}", n) for n in range(max(1, number - keep + 1), number + 1)]
    if not kept:
        return
    named = {folder.split("/")[0] for manifest in kept for folder in manifest["buckets"].values()}
    for folder in manifests.names(spark, f"{path}/{SNAPSHOTS}"):
        if folder not in named:
            manifests.remove(spark, f"{path}/{SNAPSHOTS}/{folder}")
    for run, batch in _batches(spark, path, {}):
        if all(batch <= manifest["upto"].get(run, -1) for manifest in kept):
            manifests.remove(spark, f"{path}/{RUN}={run}/{BATCH}={batch}")


def append_versions(df: DataFrame, path: str, batch: int, run: str) -> None:
    """Write every version of one batch of a run."""
    df.write.mode("overwrite").parquet(f"{path}/{RUN}={run}/{BATCH}={batch}")


def read_versions(spark: SparkSession, path: str, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """All versions, numbered from 1 per key, with the latest flagged."""
    return state_versions(spark.read.parquet(path).drop(BATCH, RUN), key, order, slices)


def _batches(spark: SparkSession, path: str, manifest: dict) -> list[tuple[str, int]]:
    """Finished batches that the manifest has not folded in, as (run, number)."""
    upto, out = manifest.get("upto", {}), []
    for folder in manifests.names(spark, path):
        if folder.startswith(f"{RUN}="):
            run = folder.removeprefix(f"{RUN}=")
            numbers = [int(n.removeprefix(f"{BATCH}=")) for n in manifests.names(spark, f"{path}/{folder}") if n.startswith(f"{BATCH}=")]
            out += [(run, n) for n in sorted(numbers) if n > upto.get(run, -1)
                    and manifests.exists(spark, f"{path}/{folder}/{BATCH}={n}/_SUCCESS")]
    return out


def _read_batches(spark: SparkSession, path: str, found: list[tuple[str, int]]) -> DataFrame:
    folders = [f"{path}/{RUN}={run}/{BATCH}={number}" for run, number in found]
    rows = spark.read.option("basePath", path).parquet(*folders)
    return rows.withColumns({RUN: F.col(RUN).cast("string"), BATCH: F.col(BATCH).cast("long")})


def _state(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """Rows of the snapshot and of the batches after it, with their run and batch."""
    found = _batches(spark, path, manifest)
    parts = [_read_batches(spark, path, found)] if found else []
    if manifest:
        parts.insert(0, spark.read.parquet(*[f"{path}/{SNAPSHOTS}/{folder}" for folder in manifest["buckets"].values()]))
    if not parts:
        return spark.read.parquet(path)  # says that there is nothing
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    others = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(key).agg(newest.alias("r")).select(key, "r.*")
