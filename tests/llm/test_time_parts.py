"""Time partitions against a brute-force layout, and the files on disk."""

import calendar
import hashlib
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import queries, time_parts


def moment(click_id, ts):
    k = zlib.crc32(str(click_id).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = ts - timedelta(days=ts.weekday())
        return datetime(day.year, day.month, day.day)
    return ts


def tree(moments, limit):
    """(leaf, test of a moment) of each leaf, by walking down from the years."""
    out = []

    def count(low, high):
        return sum(low <= m < high for m in moments)

    def step(low, level):
        if level == "year":
            return [(f"{m:02d}", datetime(low.year, m, 1), datetime(low.year + m // 12, m % 12 + 1, 1)) for m in range(1, 13)]
        if level == "month":
            return [(f"{d:02d}", datetime(low.year, low.month, d), datetime(low.year, low.month, d) + timedelta(days=1)) for d in range(1, calendar.monthrange(low.year, low.month)[1] + 1)]
        return [(f"{h:02d}", low + timedelta(hours=h), low + timedelta(hours=h + 1)) for h in range(24)]

    def walk(members, above, level, below):
        run = None
        for name, low, high in members:
            n = count(low, high)
            if n > limit:
                run = None
                if level == "hour":
                    out.append([*above, name, name, low, high, n])
                else:
                    walk(step(low, level), (*above, name), below[0], below[1:])
            elif run is not None and run[-1] + n <= limit:
                run[-4], run[-2], run[-1] = name, high, run[-1] + n
            else:
                run = [*above, name, name, low, high, n]
                out.append(run)

    if moments:
        years = range(min(moments).year, max(moments).year + 1)
        walk([(f"{y:04d}", datetime(y, 1, 1), datetime(y + 1, 1, 1)) for y in years], (), "year", ["month", "day", "hour", ""])
    leaf = lambda r: "/".join([*r[:-5], f"{r[-5]}-{r[-4]}"])
    return [(leaf(r), r[-3], r[-2]) for r in out if r[-1]]


def layout(rows, limit):
    """(leaf, part) -> its rows in order; rows are (moment, arrived_at, click_id, ...)."""
    out = {}
    stamped = [r for r in rows if r[0] is not None]
    found = [(leaf, [r for r in stamped if low <= r[0] < high]) for leaf, low, high in tree([r[0] for r in stamped], limit)]
    if len(stamped) < len(rows):
        found.append(("null", [r for r in rows if r[0] is None]))
    for leaf, mine in found:
        mine.sort(key=lambda r: (r[0] or datetime.min, r[1] is not None, r[1] or datetime.min, r[2]))
        for i in range(0, len(mine), limit):
            out[leaf, i // limit + 1] = mine[i : i + limit]
    return out


def want(rows, limit, cut):
    old = layout([r for r in rows if r[1] is not None and r[1] < cut], limit)
    out = {}
    for key, mine in layout(rows, limit).items():
        fresh = sum(r[1] is None or r[1] >= cut for r in mine)
        stays = key in old and Counter(map(str, old[key])) == Counter(map(str, mine))
        sha = hashlib.sha256(",".join(str(r[2]) for r in mine).encode()).hexdigest()
        out[key] = (sha, len(mine), fresh, not stays)
    return out


def got(result):
    rows = result.collect()
    found = {(r["leaf"], r["part"]): (r["ids_sha256"], r["n_rows"], r["n_new"], r["rewritten"]) for r in rows}
    assert len(found) == len(rows)
    return found, {unquote(urlparse(r["path"]).path): r for r in rows}


def on_disk(paths, columns, id_of="click_id"):
    """The folder holds the returned files alone, each with its ids in order."""
    folder = next(iter(paths)).split("/leaf__=")[0]
    assert {str(p) for p in Path(folder).rglob("*.parquet")} == set(paths)
    for path, r in paths.items():
        t = pq.ParquetFile(path).read()
        assert t.column_names == columns and t.num_rows == r["n_rows"]
        assert hashlib.sha256(",".join(map(str, t[id_of].to_pylist())).encode()).hexdigest() == r["ids_sha256"]


def test_runs_of_siblings():
    assert time_parts.runs([1, 2, 3, 9, 0, 1, 0, 5, 1], 5) == [(0, 1, 3), (2, 2, 3), (4, 6, 1), (7, 7, 5), (8, 8, 1)]
    assert time_parts.runs([0, 0], 5) == [(0, 1, 0)] and time_parts.runs([], 5) == []


def shop(seed, n):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = start + timedelta(seconds=r.randrange(120 * 86400)) if r.random() < 0.6 else datetime(2024, 3, 5, 7) + timedelta(seconds=r.randrange(3000))
        ts = None if r.random() < 0.05 else ts
        arrived = (ts or start + timedelta(days=r.randrange(100))) + timedelta(minutes=r.randrange(60), days=30 if r.random() < 0.05 else 0)
        rows.append((i % (n - 40), ts, None if r.random() < 0.01 else arrived, r.choice(["a", None]), r.randrange(3), "x"))
    return rows + [rows[5]] * 90


@pytest.mark.parametrize("seed", [1, 2])
def test_layouts_equal_brute_force(spark, seed):
    rows = shop(seed, 1500)
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, n int, level string").repartition(3)
    limit, cut = 1 + len(rows) // 50, datetime(2024, 3, 1)
    order = time_parts.Order(queries.click_moment(), ("arrived_at", "click_id"), "click_id")
    result, _ = time_parts.rewrite(df, order, limit, F.col("arrived_at") < F.lit(cut).cast("timestamp_ntz"))
    found, paths = got(result)
    expected = want([(moment(r[0], r[1]), r[2], r[0], *r[3:]) for r in rows], limit, cut)
    assert found == expected
    assert (seed == 2 or any(not r[3] for r in found.values())) and any(p > 1 for _, p in found)
    assert "2024/03/05/07-07" in {leaf for leaf, _ in found} and "null" in {leaf for leaf, _ in found}
    on_disk(paths, df.columns)


def test_a_third_refresh_keeps_every_file(spark):
    rows = shop(3, 400)
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, n int, level string")
    order = time_parts.Order(queries.click_moment(), ("arrived_at", "click_id"), "click_id")
    first, lay = time_parts.rewrite(df, order, 20, F.lit(False))
    scratch = time_parts.Scratch(spark, "t")
    again = time_parts.refresh(time_parts.numbered(df, order, scratch), df.columns, order, 20, lay, scratch, F.lit(False), "x")
    a, b = got(first)[0], got(again)[0]
    assert {k: v[:2] for k, v in a.items()} == {k: v[:2] for k, v in b.items()}
    assert all(v[3] for v in a.values()) and not any(v[3] for v in b.values())


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame(shop(4, 50), "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, n int, level string")
    order = time_parts.Order(queries.click_moment(), ("arrived_at", "click_id"), "click_id")
    assert time_parts.rewrite(df.limit(0), order, 5, F.lit(True))[0].count() == 0
    one, _ = time_parts.rewrite(df.filter("ts is null"), order, 10**6, F.lit(False))
    assert {r["leaf"] for r in one.collect()} <= {"null"}
    with pytest.raises(ValueError):
        time_parts.rewrite(df.withColumnRenamed("n", "__row"), order, 5, F.lit(True))


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/clicks.parquet").collect()]
    result = queries.op13_time_parts(spark, folder)
    found, paths = got(result)
    assert found == want([(moment(r[0], r[1]), r[2], r[0], *r[3:]) for r in rows], 1 + len(rows) // 650, datetime(2024, 3, 1))
    on_disk(paths, spark.read.parquet(f"{folder}/clicks.parquet").columns)
    assert {r["columns"] for r in result.collect()} == {"click_id,ts,arrived_at,client_id,kind,value,props"}
