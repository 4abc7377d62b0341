"""Extendible hashing: a directory over hash-prefix bits whose oversized buckets alone split.

A row's 60-bit hash is 24 bits of its key's MD5 followed by 36 bits of the whole row's, so the
rows of one hot key still part. A bucket is a prefix of those bits; a bucket whose rows exceed
the byte limit splits on its next bit, any other stays whole.
The directory (one row per bucket, so about total bytes / limit rows, whatever the number of
documents) is built from a histogram: rows are counted once by their first bits and
the sums are folded up towards the root. Bins that are still too large are counted again,
``STEP`` bits deeper, from their own rows only.

Cases: a null key is a key like any other; null text has 0 bytes; copies of one whole row
can't be parted by bits, so they fill numbered pages of their bucket, numbered part by part of the table and not in one task; a single row over the
limit stands alone and is marked ``oversized``. Very long texts count by their bytes. An empty table gives no rows. Columns
other than the keys and the text play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

STEP = 8
MOST_BITS = 60
KEY_DIGITS = 6  # hexadecimal digits of the key's hash; the row's hash has the rest


def _bits(h, depth: int):
    """The first ``depth`` of the hash's bits as a number."""
    return F.shiftright(h, MOST_BITS - depth)


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Buckets ``(depth, prefix, bytes, n_rows)`` of rows ``(h, n_bytes)`` under ``limit`` bytes each."""
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    top = min(MOST_BITS, max(1, (max(1, total // limit)).bit_length() + 4))
    leaves, base, level, pending = [], 0, 0, rows
    while True:
        deep = min(MOST_BITS, base + (top if base == 0 else STEP))
        bins = scratch.write(pending.groupBy(_bits(F.col("h"), deep).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), f"bins{level}")
        # Sums of every prefix between base and deep; a bucket is the shallowest that fits under its parent's split.
        depths = [d for d in range(base, deep + 1)]
        sums = reduce(DataFrame.unionByName, [bins.select(F.lit(d).alias("depth"), F.shiftright("prefix", deep - d).alias("prefix"), "bytes", "n_rows") for d in depths])
        sums = scratch.write(sums.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")), f"sums{level}")
        parent = sums.filter((F.col("bytes") > limit) & (F.col("n_rows") > 1)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fits = sums.filter((F.col("bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == MOST_BITS))
        child = fits.withColumn("up", F.shiftright("prefix", 1))
        leaves.append(child.join(parent, ["depth", "up"], "left_semi").drop("up"))
        if base == 0:
            leaves.append(fits.filter(F.col("depth") == 0))
        over = sums.filter((F.col("depth") == deep) & (F.col("bytes") > limit) & (F.col("n_rows") > 1)).select(F.col("prefix").alias("over"))
        if deep == MOST_BITS or over.isEmpty():
            return scratch.write(reduce(DataFrame.unionByName, leaves), "directory")
        pending = pending.join(over, _bits(F.col("h"), deep) == F.col("over"), "left_semi")
        base, level = deep, level + 1


def assign(docs: DataFrame, limit: int, keys: tuple[str, ...] = ("doc_id",), text: str = "text", tag: str = "sharding") -> DataFrame:
    """``docs``' keys with n_bytes, shard (its prefix bits, ``-page`` among copies of a row), local and global depth and ``oversized``."""
    scratch = Scratch(docs.sparkSession, tag)
    k = [f"k{i}" for i in range(len(keys))]
    key = F.concat_ws("\x1f", *[F.coalesce(docs[x].cast("string"), F.lit("\x1e")) for x in keys])
    row = F.concat_ws("\x1f", key, F.coalesce(docs[text], F.lit("\x1e")))
    h = F.conv(F.concat(F.substring(F.md5(key), 1, KEY_DIGITS), F.substring(F.md5(row), 1, MOST_BITS // 4 - KEY_DIGITS)), 16, 10).cast("long")
    rows = docs.select(*[docs[x].alias(y) for x, y in zip(keys, k, strict=True)], F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h"))
    rows = scratch.write(rows, "rows")
    found = directory(rows.select("h", "n_bytes"), limit, scratch)
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect()) or [0]  # at most MOST_BITS numbers
    # A row asks at each depth that the directory uses; just one of them has its prefix.
    asked = rows.withColumn("ask", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _bits(F.col("h"), d).alias("prefix")) for d in depths])))
    out = asked.select(*k, "n_bytes", "h", "ask.depth", "ask.prefix").join(found, ["depth", "prefix"])
    full = (F.col("depth") == MOST_BITS) & (F.col("bytes") > limit) & (F.col("n_rows") > 1)
    out = out.filter(~full).withColumn("page", F.lit(0).cast("long")).unionByName(_paged(out.filter(full), limit, k, scratch))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.substring(F.lpad(F.bin("prefix"), MOST_BITS, "0"), MOST_BITS + 1 - F.col("depth"), F.col("depth")))
    shard = F.when(F.col("page") > 0, F.concat_ws("-", name, F.col("page").cast("string"))).otherwise(name)
    return out.select(*[F.col(y).alias(x) for x, y in zip(keys, k, strict=True)], "n_bytes", shard.alias("shard"), F.col("depth").alias("local_depth"), F.lit(depths[-1]).alias("global_depth"), (F.col("n_bytes") > limit).alias("oversized"))


def _paged(rows: DataFrame, limit: int, k: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with the page of each copy: copies are numbered within the part of the table they stand in, after those of earlier parts."""
    copy = [*k, "n_bytes", "h"]
    rows = scratch.write(rows.withColumn("part", F.spark_partition_id()), "copies")
    parts = rows.groupBy(*copy, "part").agg(F.count(F.lit(1)).alias("n"))  # at most a row for each part of the table
    before = F.sum("n").over(Window.partitionBy(*copy).orderBy("part")) - F.col("n")
    starts = parts.select(*[F.col(c).alias(f"s_{c}") for c in (*copy, "part")], before.alias("before"))
    number = F.row_number().over(Window.partitionBy(*copy, "part").orderBy(F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*copy, "part")])
    a_page = F.greatest(F.lit(1), F.floor(limit / F.greatest(F.col("n_bytes"), F.lit(1))))
    numbered = rows.withColumn("i", number).join(starts, on).withColumn("page", F.floor((F.col("before") + F.col("i") - 1) / a_page))
    return numbered.drop("i", "part", *starts.columns)


def write(docs: DataFrame, path: str, limit: int, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> None:
    """The documents themselves, one folder for each shard; the keys must be unique."""
    where = assign(docs, limit, keys, text).select(*[F.col(x).alias(f"at{i}") for i, x in enumerate(keys)], "shard")
    on = reduce(lambda a, b: a & b, [docs[x].eqNullSafe(where[f"at{i}"]) for i, x in enumerate(keys)])
    docs.join(where, on).select(docs["*"], where["shard"]).repartition("shard").write.partitionBy("shard").parquet(path)
