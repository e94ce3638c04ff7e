"""Op 10, sampled splitters: balanced shards over a total order of keys.

Records are ordered by (md5 of the text, md5 of the id, id). A deterministic, size-weighted
sample of those keys gives quantile boundaries; records fall into the ranges between them, and
ranges that turn out overfull are cut again by boundaries sampled inside them. Sums over the ranges
and running sums inside each one give every record its place on the line of all bytes, and the line
is cut into equal shards. Copies of one text lie side by side and, being many, are cut
between shards like anything else, because the id is part of the key.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, carried, durable, packed, spread, table, unpacked

OUTPUTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
ROW_OVERHEAD = 16
#: Keys of a range, which one task puts in order.
RANGE_KEYS = 1_000_000
#: Rows of one key that are numbered by one task.
MOST_ALIKE = 10_000


def rank_in(bounds: list[str], key: Column) -> Column:
    """How many of the sorted bounds are not above key, looked up in two steps of about the square
    root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse, every = F.array(*map(F.lit, bounds[::step])), F.array(*map(F.lit, bounds))
    block = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.size(F.filter(F.slice(every, (block - 1) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner)


def _splitters(rows: DataFrame, part: list[str], pieces: Column, weight_step: Column) -> DataFrame:
    """Quantile boundaries of a size-weighted sample within each part.

    A row is drawn when its hash falls below size / weight_step, and stands for the larger of the
    two; boundaries are the first sampled key of every further quantile."""
    uniform = F.pmod(F.xxhash64("key", "size"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.select(*part, "key", pieces.alias("pieces"), F.greatest(F.col("size").cast("double"), weight_step).alias("w"), (uniform * weight_step < F.col("size")).alias("drawn")).filter("drawn")
    line = W.partitionBy(*part) if part else W.partitionBy()
    line_order = line.orderBy("key")
    quantile = F.floor((F.sum("w").over(line_order) - F.col("w") / 2) * F.col("pieces") / F.sum("w").over(line))
    return drawn.withColumn("q", quantile).groupBy(*part, "q").agg(F.min("key").alias("bound")).filter("q > 0")


def _bounds(keys: DataFrame, count: int, total: int, n_ranges: int, samples: int) -> list[str]:
    """Splitters of key, size, n and bytes (their product): n_ranges quantiles, and more inside every
    range that holds over twice its share of bytes or keys, until none with several keys does."""
    ideal = total / n_ranges
    sized = keys.select("key", F.col("bytes").alias("size"))
    bounds = sorted(r.bound for r in _splitters(sized, [], F.lit(n_ranges), F.lit(ideal / samples)).select("bound").collect())
    while True:
        placed = sized.withColumn("rng", rank_in(bounds, F.col("key")))
        held = placed.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("by_bytes", F.col("bytes") / ideal).withColumn("by_keys", F.col("n") * (n_ranges / count))
        full = held.filter("n > 1 and greatest(by_bytes, by_keys) > 2").collect()  # fewer than there are ranges
        if not full:
            return bounds
        of = lambda value: F.element_at(F.create_map(*[F.lit(x) for r in full for x in (r.rng, value(r))]), F.col("rng"))
        # a range is cut by what it has too much of
        crowded = of(lambda r: r.by_keys > r.by_bytes)
        pieces = of(lambda r: float(ceil(max(r.by_keys, r.by_bytes))))
        steps = {r.rng: (r.n if r.by_keys > r.by_bytes else r.bytes) / (max(r.by_keys, r.by_bytes) * samples) for r in full}
        step = of(lambda r: steps[r.rng])
        inner = placed.filter(F.col("rng").isin([r.rng for r in full])).withColumn("size", F.when(crowded, F.lit(1).cast("long")).otherwise(F.col("size")))
        more = {r.bound for r in _splitters(inner, ["rng"], pieces, step).select("bound").collect()} - set(bounds)
        if not more and max(steps.values()) <= 1:  # every key has been drawn
            return bounds
        # where a few keys outweigh all others, only a finer sample meets those
        bounds, samples = sorted({*bounds, *more}), samples if more else 8 * samples


def _numbered(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with the place of their key, and i, from 0, among those with the same one.

    Rows of a key are numbered where they meet it. A key of over MOST_ALIKE rows is numbered by input
    partition first, so that not even one that most rows have is put in order by one task; those
    numbers are written before they are used."""
    met = lambda df: df.join(places.drop("size"), "key")
    most = places.agg(F.max("n")).first()[0] or 1
    if most == 1:
        return met(rows).withColumn("i", F.lit(0).cast("long"))
    nth = lambda *part, order: (F.row_number().over(W.partitionBy(*part).orderBy(order)) - 1).cast("long")
    if most <= MOST_ALIKE:
        return met(rows).withColumn("i", nth("key", order="begun"))
    hot = durable(places.filter(F.col("n") > MOST_ALIKE).select("key"), "shard-repeated")
    held = durable(spread(rows, hot, ["key"], "left_semi", "_row").withColumn("m", F.monotonically_increasing_id()), "shard-repeats").withColumn("p", F.shiftright("m", 33))
    before = W.partitionBy("key").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    shifts = held.groupBy("key", "p").agg(F.count("*").alias("c")).select("key", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("b"))
    many = held.withColumn("own", nth("key", "p", order="m")).join(shifts, ["key", "p"]).withColumn("i", F.col("own") + F.col("b")).select(*rows.columns, "i")
    few = met(spread(rows, hot, ["key"], "left_anti", "_row")).withColumn("i", nth("key", order="begun"))
    own = durable(places.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "key", "left_semi").drop("size"), "shard-hot")
    return few.unionByName(spread(many, own, ["key"], "inner", "i"))


def assign_shards(df: DataFrame, n_shards: int = 40, text: str = "text", doc_id: str = "doc_id", ranges_per_shard: int = 8, samples_per_range: int = 32, columns: list[str] | None = None) -> DataFrame:
    """Adds size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) to every row, beside
    the given columns (all of df's if none are given).

    A null text has size 16 and the checksum of an empty one; a null id sorts as the text 'null';
    rows alike in id and text take consecutive places, in any order. Input columns named like an
    output are replaced. An empty table gives an empty result. A row larger than a shard's share makes
    its shard that much larger, as rows are never cut. Keys are put in order without their rows, in as
    many ranges as they need, and places are joined to the rows last."""
    keep = [c for c in carried(df, OUTPUTS) if columns is None or c in columns]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        packed(df, keep).alias("_row"),
        (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.concat_ws("-", F.md5(body.cast("binary")), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"))).alias("key"),
    )
    keys = durable(rows.groupBy("key", "size").agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size")), "shard-keys")
    total, count = keys.agg(F.sum("bytes"), F.count("*")).first()
    total, count = total or 1, count or 1
    bounds = _bounds(keys, count, total, max(n_shards * ranges_per_shard, -(-count // RANGE_KEYS)), samples_per_range)

    ranged = keys.withColumn("rng", rank_in(bounds, F.col("key")))
    before = W.orderBy("rng").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("rng").agg(F.sum("bytes").alias("b"), F.sum("n").alias("c")).select(
        "rng", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n0"))
    inside = W.partitionBy("rng").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = ranged.withColumn("begun", F.sum("bytes").over(inside) - F.col("bytes")).withColumn("place", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(offsets), "rng")
    places = durable(places.select("key", "size", "n", (F.col("begun") + F.col("b0")).alias("begun"), (F.col("place") + F.col("n0")).alias("place")), "shard-places")
    # the shard that holds the middle of a record, in whole numbers
    shard = lambda begun: F.least(F.lit(n_shards - 1), F.expr(f"((2 * ({begun}) + size) * {n_shards}) div (2L * {total})").cast("int"))
    # where each shard begins: in a key that several rows have, at the first of them that lies in it
    held = places.withColumn("s", F.explode(F.sequence(shard("begun"), shard("begun + (n - 1) * size"))))
    i = F.expr(f"greatest(0L, (2L * {total} * s - {n_shards}L * (2 * begun + size) + 2L * size * {n_shards} - 1) div (2L * size * {n_shards}))")
    starts = durable(held.groupBy("s").agg(F.min(F.col("place") + i).alias("p0")), "shard-starts")

    out = _numbered(rows, places).withColumn("shard", shard("begun + i * size")).join(F.broadcast(starts), F.col("shard") == F.col("s"))  # n_shards rows
    return out.select(
        *unpacked(keep), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") + F.col("i") - F.col("p0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), columns=["doc_id"])


#: The checksum's table is built bit by bit, for the reversed polynomial of CRC-32.
ORACLE = """
WITH RECURSIVE b(i, c, n) AS (
  SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, n + 1 FROM b WHERE n < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM b WHERE n = 8),
h AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS x FROM documents),
crc AS (
  SELECT doc_id, text, xor(list_reduce(
    list_transform(range(0, strlen(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT),
    lambda a, v: xor(t[(xor(a, v) & 255)::BIGINT + 1], a >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS crc
  FROM h, t),
k AS (
  SELECT doc_id, crc, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) || '-' || md5(coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM crc),
p AS (
  SELECT *, sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS begun, sum(size) OVER () AS total FROM k),
s AS (
  SELECT *, least(39, ((2 * begun + size) * 40) // (2 * total)) AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY key) - 1)::BIGINT AS slot, CAST(NULL AS INT) AS grown_shard
FROM s
"""
