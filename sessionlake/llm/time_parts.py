"""Adaptive time partitions: a table as files of bounded size in time order, rewritten only where its rows have changed.

The years from the first to the last moment are siblings; a year, month or day of more than ``limit`` rows is split into all its months, days or hours. In time order
each sibling within the limit, even an empty one, joins the run of the sibling right before it while that stays within the limit, else it starts one. Leaves are the runs
that have rows, hours above the limit (runs of one) and all rows without a moment. A leaf's rows fill parts of ``limit`` rows in order; a part is one Parquet file.

* Counts: rows are counted by hour, and the levels above are sums of that. What is split is above the limit, so the siblings are bounded by rows / limit (and the years
  by the calendar), whatever the number of rows: they are grouped by parent in tasks, and broadcast to find a row's leaf, one small table for each level.
* Two-level ranking: the rows of leaves above the limit are dealt into key ranges over (leaf, order, row), which subdivide each leaf into buckets; a leaf's bucket counts are summed
  up, ``row_number`` runs only inside a bucket, and offset plus number gives the part. A row's number in the written table ends the key, so copies are divided too. No window spans a leaf.
* Files: rows are dealt by (leaf, part) and written in order, each part by one task, as it streams. What comes back is read from the files.
* Rewriting: a part stays if the files hold one of the same leaf, part and rows (their number and two sums of hashes over all columns). New files come first, then the
  replaced ones are deleted, so a failure loses nothing and a further run mends the folder.

Cases: rows without a moment are the leaf ``null``; nulls come first in order; equal rows are all written, and interchangeable; a null id is an empty one in digest and checksum;
an empty table writes nothing and has no leaves; a column named as one of ours (``__leaf`` ...) is an error, any other name is free.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import Scratch, partitions, shared_dir, ship

LEVELS = ("y", "m", "d", "h")
WIDTHS = (4, 2, 2, 2)
NULL_LEAF = "null"
OWN = ("__row", "__moment", "__leaf", "__rows", "__part", "__bucket", "__n", "__before", "__path", "__at", "leaf__", "part__", *[f"__{k}" for k in LEVELS])
PLACE = T.StructType([T.StructField("leaf__", T.StringType()), T.StructField("part__", T.IntegerType())])


def runs(counts: list[int], limit: int) -> list[tuple[int, int, int]]:
    """(first, last, rows) of the runs of siblings in order; those above the limit are in none."""
    out: list[tuple[int, int, int]] = []
    open_run = False
    for i, n in enumerate(counts):
        if n > limit:
            open_run = False
        elif open_run and out[-1][2] + n <= limit:
            out[-1] = (out[-1][0], i, out[-1][2] + n)
        else:
            out.append((i, i, n))
            open_run = True
    return out


@dataclass(frozen=True)
class Order:
    """How a table is laid out: the moment, and what follows it in the order of rows."""

    moment: Column
    then: tuple[str, ...]
    id: str


def calendar(moment: Column) -> dict[str, Column]:
    return {"y": F.year(moment), "m": F.month(moment), "d": F.dayofmonth(moment), "h": F.hour(moment)}


def leaves(rows: DataFrame, limit: int, scratch: Scratch, tag: str) -> DataFrame:
    """level, y, m, d, h (of a member, null below its level), leaf, rows: for each sibling that has rows, or may have, the leaf that holds it."""
    stamped = rows.filter(F.col("__moment").isNotNull())
    hours = scratch.write(stamped.groupBy(*[c.alias(k) for k, c in calendar(F.col("__moment")).items()]).agg(F.count(F.lit(1)).alias("n")), f"{tag}-hours")
    sums = {k: hours.groupBy(*LEVELS[:k]).agg(F.sum("n").alias("n")) for k in (1, 2, 3)} | {4: hours}
    ends = hours.agg(F.min("y").alias("low"), F.max("y").alias("high")).filter("low is not null")
    members = [ends.select(F.explode(F.sequence("low", "high")).alias("y"))]
    every = {
        2: F.sequence(F.lit(1), F.lit(12)),
        3: F.sequence(F.lit(1), F.dayofmonth(F.last_day(F.make_date("y", "m", F.lit(1))))),
        4: F.sequence(F.lit(0), F.lit(23)),
    }
    for k in (2, 3, 4):  # all members of what is above the limit: at most rows / limit parents
        members.append(sums[k - 1].filter(F.col("n") > limit).select(*LEVELS[: k - 1], F.explode(every[k]).alias(LEVELS[k - 1])))
    counted = []
    for k, m in enumerate(members, 1):
        names = list(LEVELS[:k])
        of = m.join(sums[k], names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))
        parents = F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), w, "0") for c, w in zip(LEVELS[: k - 1], WIDTHS, strict=False)])
        counted.append(of.select(F.lit(k).alias("level"), parents.alias("parent"), *[(F.col(c) if c in names else F.lit(None)).cast("int").alias(c) for c in LEVELS], "n"))
    siblings = counted[0]
    for more in counted[1:]:
        siblings = siblings.unionByName(more)

    def grouped(parent: pa.Table) -> pa.Table:
        """One parent's members in order: at most 31, or the years."""
        members = parent.to_pylist()
        level = members[0]["level"]
        own, width = LEVELS[level - 1], WIDTHS[level - 1]
        members.sort(key=lambda r: r[own])
        found = runs([r["n"] for r in members], limit)
        if level == len(LEVELS):
            found += [(i, i, r["n"]) for i, r in enumerate(members) if r["n"] > limit]
        out = []
        for first, last, n in found:
            name = "-".join(f"{members[i][own]:0{width}d}" for i in (first, last))
            leaf = f"{members[first]['parent']}/{name}" if level > 1 else name
            out += [{k: r[k] for k in ("level", *LEVELS)} | {"leaf": leaf, "rows": n} for r in members[first : last + 1] if n]
        return pa.Table.from_pylist(out, schema=shape_of)

    shape = ", ".join(["level int", *[f"{c} int" for c in LEVELS], "leaf string", "rows long"])
    shape_of = pa.schema([("level", pa.int32()), *[(c, pa.int32()) for c in LEVELS], ("leaf", pa.string()), ("rows", pa.int64())])
    return scratch.write(siblings.groupBy("level", "parent").applyInArrow(grouped, shape), f"{tag}-leaves")


def located(rows: DataFrame, limit: int, scratch: Scratch, tag: str) -> DataFrame:
    """The rows with __leaf and __rows (of the whole leaf)."""
    found, out = leaves(rows, limit, scratch, tag), rows
    at, n = [], []
    out = out.withColumns({f"__{k}": c for k, c in calendar(F.col("__moment")).items()})
    for k in (1, 2, 3, 4):
        names = LEVELS[:k]
        of = found.filter(F.col("level") == k).select(*[F.col(c).alias(f"__{c}") for c in names], F.col("leaf").alias(f"__leaf{k}"), F.col("rows").alias(f"__n{k}"))
        out = out.join(F.broadcast(of), [f"__{c}" for c in names], "left")  # siblings: bounded by rows / limit and the calendar
        at.append(F.col(f"__leaf{k}"))
        n.append(F.col(f"__n{k}"))
    lost = rows.filter(F.col("__moment").isNull()).agg(F.count(F.lit(1))).scalar()
    leaf = F.coalesce(*at, F.lit(NULL_LEAF))
    return out.select(*rows.columns, leaf.alias("__leaf"), F.coalesce(*n, lost).alias("__rows"))


def parted(rows: DataFrame, order: Order, limit: int, scratch: Scratch, tag: str) -> DataFrame:
    """The rows with __leaf and __part, by two-level ranking where a leaf has several parts."""
    spark = rows.sparkSession
    at = scratch.write(located(rows, limit, scratch, tag), f"{tag}-located")
    key = ["__moment", *order.then, "__row"]
    small = at.filter(F.col("__rows") <= limit).withColumn("__part", F.lit(1).cast("long"))
    ranged = at.filter(F.col("__rows") > limit).repartitionByRange(partitions(spark), "__leaf", *key)
    ranged = scratch.write(ranged.withColumn("__bucket", F.spark_partition_id()), f"{tag}-ranges")
    counts = ranged.groupBy("__leaf", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("__leaf").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = counts.select("__leaf", "__bucket", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__leaf", "__bucket").orderBy(*key)
    ranked = ranged.withColumn("__n", F.row_number().over(inside)).join(offsets, ["__leaf", "__bucket"])
    part = F.expr(f"(__before + __n - 1) div {limit}") + 1
    return small.unionByName(ranked.select(*at.columns, part.alias("__part")))


def _digests(columns: list[str], fresh: Column) -> list[Column]:
    """A part's size, its rows that ``fresh`` says are new, and two sums of hashes of whole rows."""
    hashes = [F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns], F.lit(salt)) for salt in (1, 2)]
    sums = [F.sum(h.cast("decimal(38,0)")).alias(f"s{i}") for i, h in enumerate(hashes)]
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(fresh, F.lit(True))).alias("n_new"), *sums]


def _write(rows: DataFrame, columns: list[str], order: Order, folder: str) -> None:
    """One file for each (leaf, part) into the folder."""
    key = ["__moment", *order.then, "__row"]
    # Not null, so that Spark's writer takes the order of the rows as it is.
    leaf, part = F.coalesce("__leaf", F.lit(NULL_LEAF)).alias("leaf__"), F.coalesce("__part", F.lit(0)).cast("int").alias("part__")
    named = rows.select(*columns, *[F.col(c).alias(f"__order{i}") for i, c in enumerate(key)], leaf, part)
    dealt = named.repartition(max(partitions(rows.sparkSession), 1), "leaf__", "part__")
    ordered = dealt.sortWithinPartitions("leaf__", "part__", *[f"__order{i}" for i in range(len(key))])
    ordered.select(*columns, "leaf__", "part__").write.mode("append").partitionBy("leaf__", "part__").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").option(
        "maxRecordsPerFile", "0"
    ).parquet(folder)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path of ids sorted by path and place: their SHA-256, comma-joined; ids stream by."""
    path, digest, n = None, None, 0
    names = ["path", "ids_sha256", "n_ids"]
    for b in batches:
        paths, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        start = 0
        while start < len(paths):
            end = start
            while end < len(paths) and paths[end] == paths[start]:
                end += 1
            if paths[start] != path:
                if digest is not None:
                    yield pa.record_batch([[path], [digest.hexdigest()], [n]], names=names)
                path, digest, n = paths[start], hashlib.sha256(), 0
            joined = ",".join("" if i is None else str(i) for i in ids[start:end])
            digest.update(("," if n else "").encode() + joined.encode())
            n += end - start
            start = end
    if digest is not None:
        yield pa.record_batch([[path], [digest.hexdigest()], [n]], names=names)


def _files(df: DataFrame, folder: str) -> DataFrame:
    held = df.sparkSession.read.schema(T.StructType([*df.schema.fields, *PLACE.fields])).parquet(folder)
    about = held.metadataColumn("_metadata")
    return held.select("*", about["file_path"].alias("__path"), about["row_index"].alias("__at"))


@dataclass
class Layout:
    """A folder of parts, and the digests of what it holds."""

    folder: str
    parts: DataFrame | None = None


def numbered(df: DataFrame, order: Order, scratch: Scratch) -> DataFrame:
    """The table with its moment and a number for each row, written once: what the number is must not change."""
    if clash := set(OWN) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are this operator's own")
    return scratch.write(df.select("*", order.moment.alias("__moment"), F.monotonically_increasing_id().alias("__row")), "rows")


def refresh(rows: DataFrame, columns: list[str], order: Order, limit: int, layout: Layout, scratch: Scratch, fresh: Column, tag: str) -> DataFrame:
    """Makes the folder hold ``rows``, and returns per file: leaf, part, path, ids_sha256, n_rows, n_new, rewritten.

    ``fresh`` says of a row that the folder's former files can't hold it.
    """
    spark = rows.sparkSession
    ship(spark)
    at = scratch.write(parted(rows, order, limit, scratch, tag), f"{tag}-parts")
    now = scratch.write(at.groupBy(F.col("__leaf").alias("leaf"), F.col("__part").alias("part")).agg(*_digests(columns, fresh)), f"{tag}-digests")
    plain = rows.select(*columns)
    old = layout.parts
    if old is None:
        stays, gone = None, None
        _write(at, columns, order, layout.folder)
    else:
        same = ["leaf", "part", "n_rows", "s0", "s1"]
        stays = scratch.write(now.filter("n_new = 0").join(old.select(*same, "path"), same).select("leaf", "part", "path"), f"{tag}-stays")
        gone = old.join(stays, "path", "left_anti").select("path")
        keys = stays.select(F.col("leaf").alias("__leaf"), F.col("part").alias("__part"))
        _write(at.join(keys, ["__leaf", "__part"], "left_anti"), columns, order, layout.folder)
        _delete(spark, gone)
    if now.isEmpty():
        files = spark.createDataFrame([], "leaf string, part long, path string, ids_sha256 string, n_rows long")
    else:
        held = _files(plain, layout.folder)
        ids = held.select("__path", F.col(order.id).cast("string").alias("id"), "__at").repartition(partitions(spark), "__path").sortWithinPartitions("__path", "__at")
        sums = ids.select("__path", "id").mapInArrow(_hashed, "path string, ids_sha256 string, n_ids long")
        names = held.groupBy(F.col("__path").alias("path")).agg(F.first("leaf__").alias("leaf"), F.first("part__").cast("long").alias("part"))
        files = names.join(sums, "path").select("leaf", "part", "path", "ids_sha256", F.col("n_ids").alias("n_rows"))
    kept = F.lit(False) if stays is None else F.col("kept").isNotNull()
    if stays is not None:
        files = files.join(stays.select("path", F.lit(True).alias("kept")), "path", "left")
    # A row for each file; its number of new rows is counted where its rows were placed.
    out = files.join(now.select("leaf", "part", "n_new", "s0", "s1"), ["leaf", "part"], "left")
    out = scratch.write(out.select("leaf", "part", "path", "ids_sha256", "n_rows", "n_new", (~kept).alias("rewritten"), "s0", "s1"), f"{tag}-files")
    layout.parts = out
    return out.drop("s0", "s1")


def _delete(spark, paths: DataFrame) -> None:
    """Deletes files, and the folders that are empty then; names come to the driver one partition at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in paths.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["path"]))
        fs = path.getFileSystem(conf)
        fs.delete(path, False)
        for _ in range(2):
            path = path.getParent()
            if fs.exists(path) and not fs.listStatus(path):
                fs.delete(path, False)


def rewrite(df: DataFrame, order: Order, limit: int, first: Column, tag: str = "time-parts") -> tuple[DataFrame, Layout]:
    """Writes the rows that ``first`` holds for into a new folder, then rewrites it for all rows; the final files and the layout."""
    scratch = Scratch(df.sparkSession, f"{tag}-steps")
    layout = Layout(f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")  # left there
    rows = numbered(df, order, scratch)
    known = F.coalesce(first, F.lit(False))
    refresh(rows.filter(known), df.columns, order, limit, layout, scratch, F.lit(True), "first")
    return refresh(rows, df.columns, order, limit, layout, scratch, ~known, "all"), layout
