"""Compaction: good files stay, rows stay, readers switch by a manifest, and a run that dies changes nothing."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakepulse.sources import compaction

SCHEMA = "id bigint, text string, day string"
FILES = "directory string, path string, size bigint, packed boolean"


def land(spark, root, lo, hi, files, day="01", mode="append", kind="parquet"):
    """Rows lo..hi of one day in so many files."""
    rows = spark.range(lo, hi).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(day).alias("day"))
    rows.repartition(files).write.mode(mode).partitionBy("day").format(kind).save(root)


def live_rows(spark, root, **options):
    rows = compaction.read_live(spark, root, SCHEMA, **options)
    return sorted((r.id, r.day) for r in rows.where(F.col("text") == F.sha2(F.col("id").cast("string"), 256)).collect())


def named(spark, root):
    return {r.path: r.packed for r in compaction.manifest(spark, root).where("live").collect()}


def expect(*parts):
    return sorted((i, day) for lo, hi, day in parts for i in range(lo, hi))


def test_small_files_meet_and_good_ones_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    land(spark, root, 0, 20_000, 1)  # about 800 kB
    land(spark, root, 20_000, 20_400, 4)
    land(spark, root, 30_000, 30_010, 1, "02")  # alone in its directory
    large = max(Path(root).glob("day=01/*.parquet"), key=lambda p: p.stat().st_size)
    before = large.stat().st_mtime_ns
    assert compaction.compact_small(spark, root, SCHEMA, target=1_000_000) == 4
    files = named(spark, root)
    assert f"day=01/{large.name}" in files and large.stat().st_mtime_ns == before
    assert sorted(files.values()) == [False, False, True]
    want = expect((0, 20_400, "01"), (30_000, 30_010, "02"))
    assert live_rows(spark, root) == want
    assert live_rows(spark, root, where=F.col("directory") == "day=02") == expect((30_000, 30_010, "02"))
    # Nothing is left to do, and the landed folder is as it was.
    assert compaction.compact_small(spark, root, SCHEMA, target=1_000_000) == 0
    assert named(spark, root) == files and live_rows(spark, root) == want
    assert spark.read.schema(SCHEMA).parquet(root).count() == 20_410


def test_what_lands_later_counts_from_the_next_manifest_on(spark, tmp_path):
    root = str(tmp_path / "t")
    land(spark, root, 0, 100, 3)
    compaction.compact_small(spark, root, SCHEMA)
    land(spark, root, 100, 200, 3)
    assert live_rows(spark, root) == expect((0, 100, "01"))
    assert compaction.compact_small(spark, root, SCHEMA) == 4  # the packed one is small, too
    assert live_rows(spark, root) == expect((0, 200, "01")) and list(named(spark, root).values()) == [True]


@pytest.mark.parametrize("dies", ["before the manifest", "within it"])
def test_a_run_that_dies_leaves_the_old_files_valid(spark, tmp_path, monkeypatch, dies):
    root = str(tmp_path / "t")
    land(spark, root, 0, 100, 3)
    compaction.compact_small(spark, root, SCHEMA)
    old = named(spark, root)
    land(spark, root, 100, 200, 3)
    if dies == "within it":
        compaction.compact_small(spark, root, SCHEMA)
        (tmp_path / "t/_manifest/v000000002/_SUCCESS").unlink()
    else:
        with monkeypatch.context() as m:
            m.setattr(compaction, "_manifest_path", lambda root, version: "nowhere://x")
            with pytest.raises(Exception, match="nowhere"):
                compaction.compact_small(spark, root, SCHEMA)
    assert named(spark, root) == old and live_rows(spark, root) == expect((0, 100, "01"))
    compaction.compact_small(spark, root, SCHEMA)
    assert live_rows(spark, root) == expect((0, 200, "01"))
    stray = {r.path for r in compaction.unreferenced(spark, root).collect()}
    assert not stray & set(named(spark, root)) and any(p.startswith("_packed/") for p in stray)


def test_unreferenced_files_can_go(spark, tmp_path):
    root = str(tmp_path / "t")
    assert compaction.unreferenced(spark, root).count() == 0
    for lo in (0, 100, 200):
        land(spark, root, lo, lo + 100, 3)
        compaction.compact_small(spark, root, SCHEMA)
    two = {r.path for r in compaction.unreferenced(spark, root, keep=2).collect()}
    gone = {r.path for r in compaction.unreferenced(spark, root).collect()}
    assert two < gone and len(gone) == 9 + 2
    for path in gone:
        (tmp_path / "t" / path).unlink()
    assert live_rows(spark, root) == expect((0, 300, "01"))
    land(spark, root, 300, 310, 1)
    compaction.compact_small(spark, root, SCHEMA)
    assert live_rows(spark, root) == expect((0, 310, "01"))
    assert compaction.manifest(spark, root).where("NOT live").count() == 1


def test_landed_json_is_rewritten_whole(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    land(spark, root, 0, 300, 3, kind="json")
    land(spark, root, 300, 310, 1, "02", kind="json")
    assert compaction.compact_small(spark, root, SCHEMA, landed="json") == 4
    assert set(named(spark, root).values()) == {True} and len(named(spark, root)) == 2
    assert live_rows(spark, root, landed="json") == expect((0, 300, "01"), (300, 310, "02"))


def test_names_that_need_encoding_and_several_rounds(spark, tmp_path):
    root = str(tmp_path / "a b+c%41")
    days = ["1 + 1", "100%", "x=y", "ü"]
    for k, day in enumerate(days):
        land(spark, root, k * 100, k * 100 + 100, 3, day)
    assert compaction.compact_small(spark, root, SCHEMA, files_at_once=3) == 12
    assert len(named(spark, root)) == 4
    assert live_rows(spark, root) == expect(*[(k * 100, k * 100 + 100, d) for k, d in enumerate(days)])


def test_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "none")
    assert live_rows(spark, root) == []
    assert compaction.compact_small(spark, root, SCHEMA) == 0 and live_rows(spark, root) == []


@pytest.mark.parametrize("n", [50, 5000])
def test_bins_hold_all_small_files_once_within_bounds(spark, n):
    """One directory with very many files, others with few; zero bytes and ties included."""
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b"]), f"f{i}", rng.choice([0, 10, 10, rng.randrange(1000)]), False) for i in range(n)]
    got = compaction.pack(spark.createDataFrame(rows, FILES), target=1000).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    assert len({r.path for r in got}) == len(got)
    assert all(len({r.directory for r in b}) == 1 and len(b) > 1 and r.size < 750 for b in bins.values() for r in b)
    assert all(sum(r.size for r in b) < 1000 + 750 for b in bins.values())
    small = {r[1] for r in rows if r[2] < 750}
    left = small - {r.path for r in got}
    assert len(left) <= 2 + n // 50
    total = sum(r[2] for r in rows if r[2] < 750)
    assert len(bins) <= total / 1000 + 3 + total / (1000 * compaction.CHUNK)
