"""I-Match fingerprints: sorted distinct mid-frequency terms, hashed over randomised lexicon subsets.

Terms are the lower-cased runs of letters and digits. The lexicon holds the terms whose inverse
document frequency ln(N / df), over all documents, lies in ``BAND``; the commonest and the
rarest terms say little and are left out. The lexicon has ``LANES`` times ``LEVELS`` fixed random subsets, which no document has a say in:
a term's hash gives it one of the lanes, and each level of a lane holds a random half of the level before. A text's whole list of lexicon terms
is held against every subset; those that fall in it are sorted, joined and hashed to eight hexadecimal digits. A lane's hashes follow
each other, coarsest level first, as far as it holds terms; lanes are parted by dots.

Likeness of two fingerprints: 1 if they are equal; else, over the levels that are fine enough for the two texts, the share of equal subset hashes among the
subsets that are not empty in both. The first such level is the coarsest one at which at most ``FULL`` of the lanes hold a term of either
text (so that about one term falls in a subset), or the finest that holds any; 0 if one text has no lexicon term.

Only DataFrame functions are used. The lexicon has at most (mean distinct terms of a text) * e^BAND[1]
terms; it is broadcast if it has no more than ``MOST_BROADCAST`` terms and joined by a shuffle beyond. Texts are put in order of id by ranges whose
bounds Spark samples, so neither clustered ids nor outliers fill a range, nor do rows without an id or copies of a row.

Cases: null text is empty; a text without lexicon terms gets ``x:`` and its MD5; equal ids follow each other by their text's MD5; a null
id comes first; the document after the last is the first (a lone document's is itself); an empty table gives no rows; very long
texts are read whole; further columns of any name are not read. Ids may be of any type that has an order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, free, partitions

BAND = (math.log(10), math.log(1000))
LANES, LEVELS = 16, 12
FULL = 12
MOST_BROADCAST = 500_000
RANGE_ROWS = 5_000


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, lane, depth): the terms in the band of inverse document frequency, counted over all of ``docs``, with their lane and finest level."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(docs[text], F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    most, least = n * math.exp(-band[0]), max(2.0, n * math.exp(-band[1]))
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    some = counts.filter((F.col("df") >= least) & (F.col("df") <= most)).select("term", h.alias("h"))
    rest = F.floor(F.col("h") / LANES).cast("long")
    depth = F.bit_count(rest.bitwiseAND(-rest) - 1)  # zero bits at its end
    return some.select("term", (F.col("h") % LANES).cast("int").alias("lane"), F.least(depth, F.lit(LEVELS - 1)).cast("int").alias("depth"))


def fingerprints(rows: DataFrame, lex: DataFrame, keys: list[str], text: str, known: Column | None = None) -> DataFrame:
    """``keys`` with lanes (each lane's hashes, coarsest first), fingerprint, and ``known`` of each row; ``keys`` must tell rows apart.

    A row's terms and one empty one are joined to the lexicon, and only those in it are grouped again; what else there is to know of the row stands beside its empty term alone.
    """
    lex = F.broadcast(lex) if lex.count() <= MOST_BROADCAST else lex
    mark = F.col("term") == ""
    more = F.struct(F.md5(F.col(text)).alias("md5"), (F.lit(None).cast("int") if known is None else known).alias("known"))
    each = rows.select(*keys, more.alias("more"), F.concat(terms(F.col(text)), F.array(F.lit(""))).alias("terms")).select(*keys, "more", F.explode("terms").alias("term"))
    each = each.select(*keys, "term", F.when(mark, F.col("more")).alias("more")).join(lex, "term", "left").filter(mark | F.col("lane").isNotNull())
    found = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("lane").isNotNull(), F.struct("term", "lane", "depth")))).alias("band"), F.first("more", ignorenulls=True).alias("more"))
    found = found.select(*keys, "band", F.col("more.md5").alias("__md5"), F.col("more.known").alias("known"))
    # Each column is named twice by the next, so that it is computed once and not for every element of a lambda.
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: F.filter("band", lambda x: x["lane"] == j))
    found = found.withColumn("own", F.when(F.size("band") >= 0, lanes))

    def hashes(own: Column) -> Column:
        levels = F.sequence(F.lit(0), F.array_max(F.transform(own, lambda x: x["depth"])))
        named = lambda level: F.transform(F.filter(own, lambda x: x["depth"] >= level), lambda x: x["term"])
        return F.coalesce(F.transform(levels, lambda level: F.substring(F.md5(F.array_join(named(level), " ")), 1, 8)), F.array().cast("array<string>"))

    found = found.withColumn("lanes", F.when(F.size("own") >= 0, F.transform("own", hashes)))
    name = F.when(F.size("band") == 0, F.concat(F.lit("x:"), F.col("__md5"))).otherwise(F.array_join(F.transform("lanes", lambda x: F.array_join(x, "")), "."))
    return found.select(*keys, "lanes", name.alias("fingerprint"), "known")


def likeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of two fingerprints given by their columns lanes and fingerprint."""
    both = F.arrays_zip(a["lanes"].alias("p"), b["lanes"].alias("q"))

    def level(i: Column) -> Column:
        held = F.size(F.filter(both, lambda z: (F.size(z["p"]) > i) | (F.size(z["q"]) > i)))
        same = F.size(F.filter(both, lambda z: F.coalesce(F.get(z["p"], i) == F.get(z["q"], i), F.lit(False))))
        return F.struct(held.alias("held"), same.alias("same"), i.alias("i"))

    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level)

    def share(found: Column) -> Column:
        first = F.least(F.size(F.filter(found, lambda x: x["held"] > FULL)), F.size(F.filter(found, lambda x: x["held"] > 0)) - 1)
        fine = F.filter(found, lambda x: (x["i"] >= first) & (x["held"] > 0))
        total = lambda c: F.aggregate(fine, F.lit(0), lambda n, x: n + x[c])
        return F.when(total("held") > 0, total("same") / total("held")).otherwise(F.lit(0.0))

    # One value per pair, named by a lambda's variable.
    shared = F.element_at(F.transform(F.array(levels), share), 1)
    return F.when(a["fingerprint"] == b["fingerprint"], F.lit(1.0)).when(a["fingerprint"].startswith("x:") | b["fingerprint"].startswith("x:"), F.lit(0.0)).otherwise(shared)


ORDER = ("id", "th", "salt")


def followed(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, guest, id, th, salt, t): every row in its range of ids, and each range's following row as its guest; in order of guest and ORDER within a range."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("id"), F.md5(t).alias("th"), F.monotonically_increasing_id().alias("salt"), t.alias("t"))
    n = max(partitions(docs.sparkSession), -(-docs.count() // RANGE_ROWS))
    rows = scratch.write(rows.repartitionByRange(n, *ORDER).withColumn("part", F.spark_partition_id()), "ranges")
    heads = rows.groupBy("part").agg(F.min(F.struct(*ORDER, "t")).alias("head"))  # a row for each range
    at = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = scratch.write(heads.withColumn("before", F.lag("part").over(at)), "heads")
    last = heads.agg(F.max("part").alias("last")).first()["last"]
    guests = heads.select(F.coalesce("before", F.lit(last)).cast("int").alias("part"), F.lit(1).alias("guest"), "head.*")
    return rows.select("part", F.lit(0).alias("guest"), *ORDER, "t").unionByName(guests.select("part", "guest", *ORDER, "t"))


def edited(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``followed`` rows numbered by seq, with n_chars and the text whose last quarter is the next text's beginning."""
    order = Window.partitionBy("part").orderBy("guest", *ORDER)
    rows = followed(docs, scratch, key, text).withColumn("seq", F.row_number().over(order)).withColumn("next", F.lead("t").over(order))
    n = F.length("t").cast("long")
    rows = rows.withColumn("n_chars", n).withColumn("m", F.floor(F.col("n_chars") / 4).cast("int"))
    return rows.withColumn("edited", F.when(F.col("guest") == 0, F.concat(F.expr("left(t, int(n_chars) - m)"), F.expr("left(coalesce(next, ''), m)")))).drop("m", "next", "th", "salt")


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    scratch = Scratch(docs.sparkSession, "imatch")
    lex = scratch.write(lexicon(docs, text), "lexicon")
    rows = edited(docs, scratch, key, text)
    free(docs.sparkSession)
    known = F.struct("guest", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    versions = F.array(F.struct(F.lit(0).alias("kind"), F.col("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    kinds = rows.select("part", "seq", known.alias("about"), F.when(F.col("guest") == 0, versions).otherwise(F.slice(versions, 1, 1)).alias("versions")).select("part", "seq", "about", F.explode("versions").alias("v"))
    kinds = kinds.select("part", "seq", "v.kind", F.col("v.t").alias("text"), "about")
    found = fingerprints(kinds, lex, ["part", "seq", "kind"], "text", F.when(F.col("kind") == 0, F.col("about")))
    fp = F.struct("lanes", "fingerprint")
    both = found.groupBy("part", "seq").agg(F.max(F.when(F.col("kind") == 0, fp)).alias("own"), F.max(F.when(F.col("kind") == 1, fp)).alias("new"), F.max("known").alias("known"))
    both = both.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("seq"))).select("own", "new", "next", "known.*").filter("guest = 0")
    side = lambda name: {c: F.col(f"{name}.{c}") for c in ("lanes", "fingerprint")}
    return both.select(F.col("id").alias(key), "n_chars", "edited_sha256", F.col("own.fingerprint").alias("fingerprint"), F.col("new.fingerprint").alias("edited_fingerprint"), likeness(side("own"), side("new")).alias("near_edited"), likeness(side("own"), side("next")).alias("near_next"))


def oracle_sql() -> str:
    """:func:`compare` in DuckDB SQL over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS seq FROM documents),
n AS (SELECT count(*) AS n FROM d),
s AS (SELECT doc_id, seq, t, length(t) AS n_chars, seq % n.n + 1 AS next_seq FROM d, n),
v AS (SELECT s.doc_id, s.seq, s.next_seq, s.n_chars, s.t, left(s.t, s.n_chars - s.n_chars // 4) || left(x.t, s.n_chars // 4) AS edited FROM s JOIN s x ON x.seq = s.next_seq),
k AS (SELECT seq, 0 AS kind, t FROM v UNION ALL SELECT seq, 1, edited FROM v),
w AS (SELECT seq, kind, unnest(list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM k),
lex AS (SELECT term, ('0x' || md5(term)[1:8])::BIGINT AS h FROM w WHERE kind = 0 GROUP BY term
  HAVING count(*) >= greatest(2.0, (SELECT n FROM n) * exp({-BAND[1]!r})) AND count(*) <= (SELECT n FROM n) * exp({-BAND[0]!r})),
x AS (SELECT term, h % {LANES} AS lane, least({LEVELS - 1}, CASE WHEN h < {LANES} THEN 64 ELSE bit_count(((h // {LANES}) & -(h // {LANES})) - 1) END) AS depth FROM lex),
sub AS (SELECT seq, kind, lane, l, md5(string_agg(term, ' ' ORDER BY term))[1:8] AS s FROM w JOIN x USING (term), range(0, {LEVELS}) g(l) WHERE depth >= l GROUP BY seq, kind, lane, l),
lanes AS (SELECT seq, kind, lane, string_agg(s, '' ORDER BY l) AS part FROM sub GROUP BY seq, kind, lane),
f AS (SELECT k.seq, k.kind, CASE WHEN count(part) = 0 THEN 'x:' || any_value(md5(t)) ELSE string_agg(coalesce(part, ''), '.' ORDER BY j) END AS fp
  FROM (SELECT * FROM k, range(0, {LANES}) r(j)) k LEFT JOIN lanes ON lanes.seq = k.seq AND lanes.kind = k.kind AND lanes.lane = j GROUP BY k.seq, k.kind),
pairs AS (SELECT seq, 1 AS what, seq AS other, 1 AS other_kind FROM v UNION ALL SELECT seq, 2, next_seq, 0 FROM v),
cells AS (SELECT p.seq, p.what, lane, l, s AS a, NULL AS b FROM pairs p JOIN sub ON sub.seq = p.seq AND sub.kind = 0
  UNION ALL SELECT p.seq, p.what, lane, l, NULL, s FROM pairs p JOIN sub ON sub.seq = p.other AND sub.kind = p.other_kind),
held AS (SELECT seq, what, l, count(*) AS held, count(*) FILTER (a = b) AS same FROM (SELECT seq, what, lane, l, max(a) AS a, max(b) AS b FROM cells GROUP BY seq, what, lane, l) GROUP BY seq, what, l),
start AS (SELECT seq, what, least(count(*) FILTER (held > {FULL}), count(*) - 1) AS first FROM held GROUP BY seq, what),
shares AS (SELECT seq, what, sum(same) / sum(held)::DOUBLE AS share FROM held JOIN start USING (seq, what) WHERE l >= first GROUP BY seq, what),
near AS (SELECT p.seq, p.what, CASE WHEN a.fp = b.fp THEN 1.0 WHEN a.fp[1:2] = 'x:' OR b.fp[1:2] = 'x:' THEN 0.0 ELSE coalesce(share, 0.0) END::DOUBLE AS near
  FROM pairs p JOIN f a ON a.seq = p.seq AND a.kind = 0 JOIN f b ON b.seq = p.other AND b.kind = p.other_kind LEFT JOIN shares h ON h.seq = p.seq AND h.what = p.what)
SELECT v.doc_id, v.n_chars::BIGINT AS n_chars, sha256(v.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, e.near AS near_edited, x.near AS near_next
FROM v JOIN f a ON a.seq = v.seq AND a.kind = 0 JOIN f b ON b.seq = v.seq AND b.kind = 1 JOIN near e ON e.seq = v.seq AND e.what = 1 JOIN near x ON x.seq = v.seq AND x.what = 2
"""
