"""Zone maps: a scan's cost from footers bounds what any row of the filter needs."""

import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakepulse.sources import zones

COLUMNS = "n bigint, x double, t string, at timestamp_ntz"


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """Files of several row groups: sorted and shuffled ones, NULLs, NaN, a column that one file lacks, no statistics."""
    root, rng = tmp_path_factory.mktemp("zones"), random.Random(5)
    groups = {}
    for f in range(6):
        n = 400
        ns = sorted(rng.randrange(10_000) for _ in range(n)) if f % 2 else [rng.choice([None, rng.randrange(10_000)]) for _ in range(n)]
        rows = {
            "n": pa.array([None] * n if f == 4 else ns, pa.int64()),
            "x": pa.array([rng.choice([None, float("nan"), rng.random()]) if f == 2 else f + i / n for i in range(n)], pa.float64()),
            "t": pa.array([f"word{f}{i:04d}" * (1 if i % 7 else 20) for i in range(n)], pa.string()),
            "at": pa.array([datetime(2024, 1, 1 + f, i // 60, i % 60) for i in range(n)], pa.timestamp("us")),
            "nested": pa.array([[{"a": i, "b": "z" * (i % 50)}] for i in range(n)]),
        }
        if f == 5:
            del rows["x"]
        path = root / f"day={f % 2}" / f"f{f}.parquet"
        path.parent.mkdir(exist_ok=True)
        pq.write_table(pa.table(rows), path, row_group_size=100, write_statistics=f != 3)
        file = pq.ParquetFile(path)
        for k in range(4):
            meta = file.metadata.row_group(k)
            sizes = {}
            for i in range(meta.num_columns):
                top = meta.column(i).path_in_schema.split(".")[0]
                sizes[top] = sizes.get(top, 0) + meta.column(i).total_compressed_size
            groups[f"day={f % 2}/f{f}.parquet", k] = (file.read_row_group(k).to_pylist(), sizes)
    return str(root), groups


def cost(spark, table, where, limit=0, columns=None):
    return zones.scan_cost(zones.zone_map(spark, table[0], COLUMNS), where, limit, columns).first()


def test_every_group_is_listed_with_its_bytes(spark, table):
    found = zones.zone_map(spark, table[0], COLUMNS).collect()
    assert {(r.path, r.row_group): (r.rows, r.column_bytes) for r in found} == {k: (100, sizes) for k, (_, sizes) in table[1].items()}
    everything = cost(spark, table, F.lit(True), columns=["n", "nested"])
    want = sum(s["n"] + s["nested"] for _, s in table[1].values())
    assert (everything.files, everything.row_groups, everything.rows, everything.bytes) == (6, 24, 2400, want)
    assert everything.over_limit == 1 and cost(spark, table, F.lit(True), 1 << 40).over_limit == 0


@pytest.mark.parametrize(
    ("column", "low", "high"),
    [("n", 2000, 2500), ("n", None, 300), ("n", 9900, None), ("x", 0.2, 0.4), ("x", 1.5, 1.5), ("t", "word10", "word11"),
     ("at", datetime(2024, 1, 2), datetime(2024, 1, 2, 1)), ("n", 20_000, 30_000)],
)
def test_the_cost_bounds_what_matching_rows_need(spark, table, column, low, high):
    zone = zones.zone_map(spark, table[0], COLUMNS)
    chosen = {(r.path, r.row_group) for r in zone.where(zones.between(column, low, high)).collect()}

    def fits(row):
        v = row.get(column)
        return v is not None and (low is None or v >= low) and (high is None or v <= high)

    needed = {k for k, (rows, _) in table[1].items() if any(map(fits, rows))}
    assert needed <= chosen
    # Where the footer has statistics, a group that is chosen without need has its bounds around the interval.
    assert len(chosen) < 24 and all(
        k in needed or "f3" in k[0] or (column == "x" and k[0][-9] in "25") or k[0].startswith("day=0") for k in chosen
    )
    both = cost(spark, table, zones.between(column, low, high) & F.col("path").startswith("day=1"))
    assert both.row_groups == len([k for k in chosen if k[0].startswith("day=1")])


def test_nulls(spark, table):
    zone = zones.zone_map(spark, table[0], COLUMNS)
    held = {(r.path, r.row_group) for r in zone.where(zones.is_null("n")).collect()}
    needed = {k for k, (rows, _) in table[1].items() if any(r["n"] is None for r in rows)}
    assert needed <= held and all(k in needed or "f3" in k[0] for k in held)
    assert not zone.where(zones.between("n", 0, 10_000)).where("path LIKE '%f4%'").count()


def test_an_empty_folder(spark, tmp_path):
    got = zones.scan_cost(zones.zone_map(spark, str(tmp_path), COLUMNS), F.lit(True), 0).first()
    assert (got.files, got.rows, got.bytes, got.over_limit) == (0, 0, 0, 0)
