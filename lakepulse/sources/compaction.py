"""Compaction that leaves good files alone: small files are packed, and a manifest switches readers at once.

Packed files lie below ``_packed`` in the table's folder, manifests below ``_manifest``; both are hidden from readers of
the landed directories. A manifest names every file that counts. It is valid once Spark has committed it, so a run that
dies leaves readers with the one before; what it wrote is named by none.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakepulse.session import exists, written
from lakepulse.sources.listing import list_files

#: ``directory`` is that of the landed files, ``live`` is false for those that a packed file has replaced.
MANIFEST = "path string, size bigint, modified bigint, directory string, packed boolean, live boolean"
#: Bytes of small files that one window packs, in target sizes; a directory with more is dealt by hash first.
CHUNK = 256
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _versions(spark: SparkSession, root: str) -> list[int]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return sorted(int(s.getPath().getName().removeprefix("v")) for s in found)


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/_manifest/v{version:09d}"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest committed manifest, or that of ``version``; without any, an empty one."""
    valid = (v for v in reversed(_versions(spark, root)) if exists(spark, f"{_manifest_path(root, v)}/_SUCCESS"))
    version = next(valid, None) if version is None else version
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_manifest_path(root, version))


def pack(files: DataFrame, target: int, low: float = 0.75) -> DataFrame:
    """``directory, bin, path, size, packed`` of the files that should become one: ``directory, path, size, packed`` in.

    Files of at least ``low`` times ``target`` bytes stay as they are, and so does a file that has no other to join. A bin
    holds at most ``target`` bytes, except for its last file's. Files of a directory are taken by size, so that small
    ones meet; a directory with very many is dealt by hash first and leaves a few more bins.
    """
    small = files.where(F.col("size") < F.lit(int(target * low)))
    sizes = small.groupBy("directory").agg(F.ceil(F.sum("size") / F.lit(CHUNK * target)).alias("chunks"))
    dealt = small.join(sizes, "directory").withColumn(
        "chunk", F.pmod(F.xxhash64("path"), F.greatest("chunks", F.lit(1)))
    )
    w = Window.partitionBy("directory", "chunk").orderBy("size", "path")
    before = F.sum("size").over(w) - F.col("size")
    slot = F.floor(before / F.lit(target))
    slots = dealt.withColumn("slot", slot).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("directory", "chunk", "slot"))
    )
    chosen = F.md5(F.concat_ws("/", "directory", "chunk", "slot")).alias("bin")
    return slots.where(F.col("n") > 1).select("directory", chosen, "path", "size", "packed")


def _whole(files: DataFrame, target: int) -> DataFrame:
    """Bins for files that have to be rewritten in any case; those of ``target`` bytes and more get one each."""
    rest = files.where(F.col("size") >= target).select("directory", F.md5("path").alias("bin"), "path", "size", "packed")
    bins = pack(files, target, 1.0)
    alone = files.where(F.col("size") < target).join(bins.select("path"), "path", "left_anti")
    return bins.unionByName(rest).unionByName(
        alone.select("directory", F.md5("path").alias("bin"), "path", "size", "packed")
    )


def _read(spark: SparkSession, root: str, schema: str | T.StructType, landed: str, paths: list[tuple[str, bool]]) -> DataFrame:
    """The rows of these files, with ``_path``, the file's path below ``root``."""
    names = spark.createDataFrame([], schema).columns
    # Spark gives the paths of files as encoded URIs, however the folder is named.
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substring(F.regexp_replace(uri, _SCHEME, ""), len(re.sub(_SCHEME, "", root)) + 2, 1 << 20)
    scans = []
    for packed, base, kind in ((False, root, landed), (True, f"{root}/_packed", "parquet")):
        own = [f"{root}/{p}" for p, in_packed in paths if in_packed == packed]
        if own:
            rows = spark.read.schema(schema).option("basePath", base).format(kind).load(own)
            scans.append(rows.select(*names, below.alias("_path")))
    if not scans:
        return spark.createDataFrame([], schema).withColumn("_path", F.lit(""))
    return reduce(DataFrame.unionByName, scans)


def read_live(
    spark: SparkSession, root: str, schema: str | T.StructType, where: Column | None = None, landed: str = "parquet"
) -> DataFrame:
    """The table as the newest manifest has it; ``where`` is a filter on ``directory`` that prunes files.

    Spark needs the paths of the files it will read on the driver, as it does for any folder.
    """
    files = manifest(spark, root).where("live")
    chosen = files if where is None else files.where(where)
    paths = [(r.path, r.packed) for r in chosen.select("path", "packed").collect()]
    return _read(spark, root.rstrip("/"), schema, landed, paths).drop("_path")


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """What a manifest of this moment would name: the newest one's packed files, and all landed files there are now.

    Landed files that a packed one has replaced are known by path and time; once deleted, they aren't named any more.
    """
    known = manifest(spark, root)
    replaced = known.where("NOT live AND NOT packed").select("path", "modified", F.lit(False).alias("live"))
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")
    landed = list_files(spark, root).join(replaced, ["path", "modified"], "left").select(
        "path", "size", "modified", directory, F.lit(False).alias("packed"), F.coalesce("live", F.lit(True)).alias("live")
    )
    return landed.unionByName(known.where("live AND packed"))


def compact_small(
    spark: SparkSession,
    root: str,
    schema: str | T.StructType,
    target: int = 512 << 20,
    low: float = 0.75,
    landed: str = "parquet",
    files_at_once: int = 50_000,
) -> int:
    """Pack the table's small files and commit a new manifest; returns how many files were replaced.

    ``landed`` is the format of landed files: Parquet files from ``low * target`` bytes on stay; files of other formats are
    all rewritten. ``schema`` has the directories' columns too: packed files hold them as columns. Bins are written
    in rounds of about ``files_at_once`` files, as a round's paths pass the driver. One compaction at a time.
    """
    root = root.rstrip("/")
    files = written(current_files(spark, root), "files")
    live = files.where("live").drop("live")
    if landed == "parquet":
        chosen = pack(live, target, low)
    else:
        chosen = pack(live.where("packed"), target, low).unionByName(_whole(live.where("NOT packed"), target))
    bins = written(chosen, "bins")
    total = bins.count()
    rounds = -(-total // files_at_once)
    packed = None
    for k in range(rounds):
        mine = bins.where(F.pmod(F.xxhash64("bin"), F.lit(rounds)) == k)
        paths = [(r.path, r.packed) for r in mine.select("path", "packed").collect()]
        if not paths:
            continue
        generation = uuid.uuid4().hex[:12]
        rows = _read(spark, root, schema, landed, paths)
        rows = rows.join(mine.select(F.col("path").alias("_path"), "bin"), "_path", "left")
        lost = F.raise_error(F.concat(F.lit("a file outside the plan: "), "_path")).cast("string")
        folder = f"{root}/_packed/generation={generation}"
        rows = rows.withColumn("bin", F.coalesce("bin", lost)).drop("_path")
        rows.repartition("bin").write.partitionBy("bin").parquet(folder)
        found = list_files(spark, folder).withColumn("bin", F.regexp_extract("path", "bin=([0-9a-f]+)/", 1))
        made = found.join(mine.select("bin", "directory").distinct(), "bin").select(
            F.concat(F.lit(f"_packed/generation={generation}/"), "path").alias("path"),
            "size", "modified", "directory", F.lit(True).alias("packed"), F.lit(True).alias("live"),
        )
        packed = made if packed is None else packed.unionByName(made)
    gone = files.join(bins.select("path", F.lit(True).alias("gone")), "path", "left")
    rows = gone.withColumn("live", F.col("live") & F.col("gone").isNull()).drop("gone").where("live OR NOT packed")
    rows = rows if packed is None else rows.unionByName(packed)
    versions = _versions(spark, root)
    rows.coalesce(8).write.parquet(_manifest_path(root, versions[-1] + 1 if versions else 1))
    return total


def unreferenced(spark: SparkSession, root: str, keep: int = 1) -> DataFrame:
    """``path, size`` of files that none of the last ``keep`` committed manifests counts. Deletes nothing."""
    committed = [v for v in _versions(spark, root) if exists(spark, f"{_manifest_path(root, v)}/_SUCCESS")][-keep:]
    if not committed:
        return spark.createDataFrame([], "path string, size bigint")
    named = reduce(DataFrame.unionByName, [manifest(spark, root, v) for v in committed])
    counted = named.where("live").select("path").distinct()
    replaced = named.where("NOT live").select("path", "size").distinct()
    stray = list_files(spark, f"{root.rstrip('/')}/_packed").select(F.concat(F.lit("_packed/"), "path").alias("path"), "size")
    return replaced.unionByName(stray).join(counted, "path", "left_anti")
