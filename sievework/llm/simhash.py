"""Op 8, SimHash: document fingerprints, their likeness, and search by permuted block tables.

Every word votes with its weight for the bits of its 64-bit hash and against those it lacks; a
fingerprint has the bits that won. Votes are summed two to a 64-bit number, in 32 columns. Documents
within a Hamming radius r are found by cutting fingerprints into b > r blocks: fingerprints that
differ in r bits agree in b - r whole blocks, so one table for every choice of b - r blocks, keyed by
their bits, holds each such pair in one bucket at least; candidates are verified by counting bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, spread, table, words

BITS, LANES = 64, 32
#: Weight of a word: its length, this at most.
MOST_WEIGHT = 8
RADIUS, BLOCKS = 3, 5
#: Ids of a range, which one task puts in order.
RANGE_ROWS = 200_000
#: What tells a document from others, in their order: null ids come last.
PLACE = ("none", "at", "digest")
_PAIR = (1 << 32) + 1


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys and text, none twice -> keys and fp. A text without words has fingerprint 0; a tied
    bit is 0. A word weighs no more than it has bytes, so no half of a sum outgrows its 32 bits."""
    word = texts.select(*keys, F.explode_outer(words("text")).alias("word"))
    weight = F.when(F.col("word").isNull(), 0).otherwise(F.least(F.char_length("word"), F.lit(MOST_WEIGHT))).cast("long")
    word = word.select(*keys, F.coalesce(F.xxhash64("word"), F.lit(0)).alias("h"), weight.alias("w"))
    votes = word.groupBy(*keys).agg(F.sum("w").alias("w"), *[F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"v{k}") for k in range(LANES)])
    low, high = (lambda k: F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1))), (lambda k: F.shiftrightunsigned(f"v{k}", 32))
    bit = lambda count, at: F.when(2 * count > F.col("w"), F.lit((1 << at) - (1 << 64) * (at == 63))).otherwise(F.lit(0).cast("long"))
    halves = [bit(low(k), k) for k in range(LANES)], [bit(high(k), k + 32) for k in range(LANES)]
    either = [f"b{i}" for i in range(2)]
    for name, part in zip(either, halves, strict=True):
        total = part[0]
        for b in part[1:]:
            total = total.bitwiseOR(b)
        votes = votes.withColumn(name, total)
    return votes.select(*keys, F.col("b0").bitwiseOR(F.col("b1")).alias("fp"))


def likeness(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _table_keys(fp: str, blocks: int, radius: int) -> Column:
    """array<struct<t, key>>: a key for every choice of blocks - radius blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        masks.append(mask - (1 << 64) * (mask >> 63))
    return F.array(*[F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])


def within_radius(index: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n) of all and fp of the queries, both distinct -> query, fp, n: every indexed fingerprint
    within radius bits of a query. A pair is reported by the first table in which it meets."""
    side = lambda df, name: df.select(*df.columns, F.posexplode(_table_keys("fp", blocks, radius)).alias("_", "x")).select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns], F.col("x.t").alias(f"{name}_t"), F.col("x.key").alias(f"{name}_key"))
    q, i = side(queries, "q"), side(index, "i")
    first = F.array_min(F.transform(F.filter(F.arrays_zip(_table_keys("q_fp", blocks, radius).alias("a"), _table_keys("i_fp", blocks, radius).alias("b")), lambda z: z["a"]["key"] == z["b"]["key"]), lambda z: z["a"]["t"]))
    near = F.bit_count(F.col("q_fp").bitwiseXOR(F.col("i_fp"))) <= radius
    met = i.join(q, (F.col("i_t") == F.col("q_t")) & (F.col("i_key") == F.col("q_key")) & near & (first == F.col("i_t")))
    return met.select(F.col("q_fp").alias("query"), F.col("i_fp").alias("fp"), F.col("i_n").alias("n"))


def successors(rows: DataFrame) -> DataFrame:
    """Rows of PLACE and n_chars -> those, n and next_ of each: n documents at that place are followed
    by that one; the last by the first, and documents alike by each other.

    Places are ordered in ranges of some RANGE_ROWS, as many as there are; the last of a range is
    followed by the first of the next one, which a table of one row a range tells."""
    own = durable(rows.groupBy(*PLACE, "n_chars").agg(F.count("*").alias("n")), "places")
    ranges = max(1, -(-own.count() // RANGE_ROWS))
    ordered = durable(own.repartitionByRange(ranges, *PLACE).withColumn("rng", F.spark_partition_id()), "places-in-ranges")
    place = F.struct(*PLACE)
    around = W.orderBy("rng")
    firsts = ordered.groupBy("rng").agg(F.min(place).alias("first"))
    firsts = durable(firsts.select("rng", F.coalesce(F.lead("first").over(around), F.min("first").over(W.partitionBy())).alias("beyond")), "places-beyond")
    led = spread(ordered.withColumn("after", F.lead(place).over(W.partitionBy("rng").orderBy(*PLACE))), firsts, ["rng"], "inner", "at")
    after = F.coalesce("after", "beyond")
    alike = F.when(F.col("n") > 1, F.struct(place.alias("p"), (F.col("n") - 1).alias("n")))
    each = F.when(after == place, F.array(F.struct(place.alias("p"), F.col("n").alias("n")))).otherwise(F.array_compact(F.array(alike, F.struct(after.alias("p"), F.lit(1).cast("long").alias("n")))))
    return led.select(*PLACE, "n_chars", F.explode(each).alias("e")).select(*PLACE, "n_chars", "e.n", *[F.col(f"e.p.{c}").alias(f"next_{c}") for c in PLACE])


def fingerprint_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", query_step: int = 100) -> DataFrame:
    """One row a row of df: its id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and n_near: for ids divisible by query_step, how many other rows have
    fingerprints within RADIUS bits (else null).

    The edited text has the last half of the code points replaced by the next document's first. A
    null text is empty, a text of any length is read whole; rows are ordered by id, then by a hash of
    the text, null ids last; rows alike in both follow each other. A single row follows itself. An
    empty table gives an empty result; other columns of df are not read, whatever their names."""
    texts = df.select(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    links = durable(successors(texts.select(*PLACE, F.char_length("text").cast("long").alias("n_chars"))), "successors")
    if not links.filter("n > 1 or digest = next_digest and at = next_at and none = next_none").isEmpty():
        texts = texts.groupBy(*PLACE).agg(F.first("text").alias("text"))
    # the next document's part travels to its place, so each text is dealt once as a whole and once in part
    half = F.floor(F.col("n_chars") / 2).cast("int")
    ahead = links.select(*[F.col(c).alias(f"own_{c}") for c in PLACE], "n_chars", "n", *[F.col(f"next_{c}").alias(c) for c in PLACE])
    # texts keep their names on this side too, so that both joins read one exchange
    heads = ahead.join(texts, list(PLACE)).select(*[F.col(f"own_{c}").alias(c) for c in PLACE], "n_chars", "n", *[F.col(c).alias(f"next_{c}") for c in PLACE], F.substr("text", F.lit(1), half).alias("head"))
    rows = heads.join(texts, list(PLACE)).withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), "head"))
    keys = [*links.columns, "sha"]
    rows = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("part"), "text"), F.struct(F.lit(1).alias("part"), F.col("edited").alias("text")))).alias("t"))
    found = fingerprints(rows.select(*keys, "t.part", "t.text"), [*keys, "part"])
    found = found.groupBy(*keys).agg(F.max(F.when(F.col("part") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("part") == 1, F.col("fp"))).alias("edited_fp"))
    found = durable(found, "fingerprints")
    of = found.select(*[F.col(c).alias(f"next_{c}") for c in PLACE], F.col("fp").alias("next_fp")).distinct()
    out = found.join(of, [f"next_{c}" for c in PLACE])

    index = found.groupBy("fp").agg(F.sum("n").alias("n"))
    asked = ~F.col("none") & (F.col("at") % query_step == 0)
    near = within_radius(index, found.filter(asked).select("fp").distinct()).groupBy("query").agg((F.sum("n") - 1).alias("near"))
    out = spread(out, durable(near.withColumnRenamed("query", "fp"), "fingerprints-near"), ["fp"], "left", "at")
    return out.select("*", F.explode(F.expr("sequence(1L, n)")).alias("_")).select(
        F.when(~F.col("none"), F.col("at")).alias(doc_id), "n_chars", F.col("sha").alias("edited_sha256"), *[F.lpad(F.lower(F.hex(f)), 16, "0").alias(name) for f, name in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))],
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), F.when(asked, F.col("near")).alias("n_near"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
