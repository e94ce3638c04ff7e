"""Op 6, multivariate-hypergeometric splitting tree: mixing sources to target weights.

Each source is a line of words: its documents in a seeded random order, repeated as often as its
target needs, up to three times. The line is cut into blocks, and the blocks each source owes are
dealt to the output shards by a binary tree: every node gives half of its blocks to its left
child, split among the sources by a multivariate hypergeometric draw, so that every shard gets
what a random deal of all blocks would give it, while the quotas stay exact. A shard then reads its
own stretch of every source's line, and orders its blocks by a seeded hash. So a document's words go
to the shards, and to the places in them, that the tree gives the blocks they lie in.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TOKEN, carried, durable, packed, table, unpacked

OUTPUTS = ["size", "source_size", "target", "taken", "pieces"]
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Blocks are at least so many words, and so large that there are no more than about a million.
BLOCK_WORDS, MOST_BLOCKS = 512, 1 << 20
PIECES = "array<struct<pass:int,shard:int,from_word:bigint,to_word:bigint,order_key:bigint>>"
SHARDS, SEED = 32, 17
#: Bits of a place's order, and those that tell the slice of a shard it lies in.
ORDER_BITS, SLICE_BITS = 60, 12


def _hashed(digits: int, *parts: str) -> str:
    """SQL for so many hex digits of the parts' md5, as a number: the same in every engine."""
    return f"cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, {digits}), 16, 10) as bigint)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(skey, source, s) -> with w and target: shares of all words by weight, where no source gives
    more than three times its words and what is cut is shared among the rest by weight."""
    every = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    cap = MOST_REPEATS * F.col("s")
    filled = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    level = ranked.withColumn("cap", cap.cast("double")).withColumn("level", (F.sum("s").over(every) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(filled), F.lit(0.0))))
    # sources in the order in which they fill up: the first whose fill holds the level sets it
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))
    return level.withColumn("level", F.min(fits).over(every)["level"]).withColumn("target", F.least("cap", F.col("w") * F.col("level"))).drop("cap", "level")


def _hypergeometric(population: str, marked: str, draws: str, u: str) -> str:
    """SQL for an exact draw by inversion: how many of `draws` items are among the `marked`.

    Weights relative to the mode's follow from ratios of neighbours, upwards and downwards, ten
    standard deviations and more each way."""
    mode = f"least(greatest(({draws} + 1) * ({marked} + 1) div ({population} + 2), greatest(0L, {draws} + {marked} - {population})), {draws}, {marked})"
    reach = f"cast(12 * sqrt({draws} * 1.0D * {marked} / greatest({population}, 1L)) + 12 as bigint)"
    up = f"sequence(m, least(m + {reach}, least({draws}, {marked})))"
    down = f"sequence(m, greatest(m - {reach}, greatest(0L, {draws} + {marked} - {population})))"
    # state: weight of the next value, sum so far, value chosen
    rise = f"(({marked} - k) * 1.0D * ({draws} - k)) / ((k + 1D) * ({population} - {marked} - {draws} + k + 1D))"
    fall = f"(k * 1.0D * ({population} - {marked} - {draws} + k)) / (({marked} - k + 1D) * ({draws} - k + 1D))"
    start = "named_struct('w', {w}, 'sum', 0D, 'pick', cast(null as bigint))"
    total = lambda seq, ratio: f"aggregate({seq}, named_struct('w', 1D, 'sum', 0D), (a, k) -> named_struct('w', a.w * {ratio}, 'sum', a.sum + a.w), a -> a.sum)"
    find = lambda seq, ratio, at: f"aggregate({seq}, {start.format(w='1D')}, (a, k) -> named_struct('w', a.w * {ratio}, 'sum', a.sum + a.w, 'pick', coalesce(a.pick, if(a.sum + a.w >= {at}, k, null))), a -> coalesce(a.pick, m))"
    body = f"if(t.x <= t.up, {find(up, rise, 't.x')}, {find(down, fall, '(t.x - t.up + 1D)')})"
    # the mode is counted once: below it the sum starts at the mode's own weight
    sums = f"named_struct('up', {total(up, rise)}, 'down', {total(down, fall)} - 1D)"
    return (
        f"element_at(transform(array({mode}), m -> element_at(transform(transform(array({sums}), s -> named_struct('up', s.up, 'x', ({u}) * (s.up + s.down))), t -> {body}), 1)), 1)"
    )


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """One row with b, the blocks each source owes in rank order -> one row a leaf: shard and b.

    At every node a draw for each source in turn, given what is left of the population and of the
    draws, splits the node's blocks in two halves (the left one is rounded down)."""
    nodes = quotas.select("b", F.lit(0).alias("shard"))
    u = f"({_hashed(10, str(seed), 'depth', 'shard', 'i')} + 0.5D) / 1099511627776D"
    state = "named_struct('pop', cast({pop} as bigint), 'n', cast({n} as bigint), 'out', cast({out} as array<bigint>))"
    for level in range(depth):
        total = "aggregate(b, 0L, (x, y) -> x + y)"
        draw = _hypergeometric("acc.pop", "b[i]", "acc.n", u.replace("depth", str(level)))
        step = f"element_at(transform(array({draw}), x -> named_struct('pop', acc.pop - b[i], 'n', acc.n - x, 'out', array_append(acc.out, x))), 1)"
        left = f"if(size(b) = 0, cast(array() as array<bigint>), aggregate(sequence(0, size(b) - 1), {state.format(pop=total, n=f'{total} div 2', out='array()')}, (acc, i) -> {step}, acc -> acc.out))"
        nodes = nodes.withColumn("left", F.expr(left)).select("shard", F.explode(F.expr("array(named_struct('side', 0, 'b', left), named_struct('side', 1, 'b', zip_with(b, left, (x, y) -> x - y)))")).alias("c")).select((F.col("shard") * 2 + F.col("c.side")).alias("shard"), F.col("c.b").alias("b"))
    return nodes


def mix(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Every row of df, beside the given columns (all of df's if none are given), with size (words),
    source_size, target, taken and pieces: the stretches of its words that the output shards read,
    in which pass, and where each is put.

    n_shards is a power of two. Words are runs without ASCII white space; a null text has none. A
    null source is a source of its own, the last in order. A row without words is never taken, one of
    any length may lie in several pieces. Rows alike in id and text share the places of their order, in
    any order; equal fills of two sources are taken in the order of the sources. Input columns named
    like an output are replaced; an empty table gives an empty result."""
    if n_shards & (n_shards - 1):
        raise ValueError("n_shards must be a power of two")
    keep = [c for c in carried(df, OUTPUTS) if columns is None or c in columns]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        packed(df, keep).alias("_row"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("skey"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(TOKEN)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))).alias("perm"),
        F.md5(body.cast("binary")).alias("digest"),
    )
    narrow = durable(rows.drop("_row", "digest"), "mix-sizes")
    count, words = narrow.agg(F.count("*"), F.sum("size")).first()
    block = max(BLOCK_WORDS, -(-(words or 0) // MOST_BLOCKS))
    # as many hash buckets a source as keep each at some 20,000 rows, should one source hold all
    digits = max(2, round(log2(max(1, count / 20_000)) / 4 + 0.5))
    narrow = narrow.withColumn("bucket", F.substring("perm", 1, digits))
    buckets = durable(narrow.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")

    sources = buckets.groupBy("skey", "source").agg(F.sum("words").alias("s"))
    sources = durable(source_targets(sources).withColumn("quota", F.round("target").cast("long")), "mix-sources")
    owed = sources.agg(F.array_sort(F.collect_list(F.struct("rank", F.ceil(F.col("quota") / block).alias("b")))).alias("q")).select(F.col("q.b").alias("b"))
    leaves = splitting_tree(owed, int(log2(n_shards)), seed).select("shard", F.posexplode("b").alias("rank", "b"))
    upto = W.partitionBy("rank").orderBy("shard")
    cuts = leaves.withColumn("end", F.sum("b").over(upto)).groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"] * block).alias("ends"))
    plan = durable(sources.join(cuts, "rank", "left").select("skey", "s", "target", "quota", "ends"), "mix-plan")

    before = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("skey", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("b0")).join(plan, "skey")
    inside = W.partitionBy("skey", "bucket").orderBy("perm", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("bucket", F.substring("perm", 1, digits)).withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(offsets, ["skey", "bucket"]).withColumn("at", F.col("b0") + F.col("inside"))
    pieces = F.expr(f"""
        flatten(transform(if(size = 0 or s = 0 or quota <= at, cast(array() as array<bigint>), sequence(0L, (quota - at - 1) div s)), p ->
          transform(filter(transform(sequence(0, {n_shards - 1}), i -> named_struct(
              'i', i, 'lo', greatest(p * s + at, if(i = 0, 0L, ends[i - 1])), 'hi', least(p * s + at + size, quota, ends[i]))), x -> x.lo < x.hi),
            x -> named_struct('pass', cast(p as int), 'shard', x.i, 'from_word', x.lo - p * s - at, 'to_word', x.hi - p * s - at,
              'order_key', {_hashed(ORDER_BITS // 4, str(seed), 'x.i', 'skey', f'x.lo div {block}')}))))""").cast(PIECES)
    out = placed.withColumn("pieces", pieces)
    return out.select(*unpacked(keep), "size", F.col("s").alias("source_size"), "target", F.expr("aggregate(pieces, 0L, (x, y) -> x + y.to_word - y.from_word)").alias("taken"), "pieces")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """df's rows as the mix repeats them: whole rows, once for every pass that takes most of their words,
    in the shard and at the place of the longest piece. A shard's places are cut into slices by their order; a
    partition of the result holds whole slices, each in its order."""
    mixed = mix(df, **options)
    passes = F.expr("""transform(array_distinct(transform(pieces, x -> x.pass)), p -> transform(array(filter(pieces, x -> x.pass = p)), own -> named_struct(
        'words', aggregate(own, 0L, (a, x) -> a + x.to_word - x.from_word),
        'longest', array_max(transform(own, x -> named_struct('n', x.to_word - x.from_word, 'shard', x.shard, 'order_key', x.order_key)))))[0])""")
    keep = carried(mixed, OUTPUTS)
    placed = mixed.withColumn("_copies", F.filter(passes, lambda p: 2 * p["words"] >= F.col("size"))).select(packed(mixed, keep).alias("_row"), F.explode("_copies.longest").alias("_at"))
    slice_of = F.shiftright("_at.order_key", ORDER_BITS - SLICE_BITS)
    return placed.repartition(F.col("_at.shard"), slice_of).sortWithinPartitions("_at.shard", "_at.order_key").select(*unpacked(keep))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: n_pieces, and places, pass:shard:from:to:order of each piece."""
    mixed = mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    said = F.transform("pieces", lambda x: F.concat_ws(":", *[x[c] for c in ("pass", "shard", "from_word", "to_word", "order_key")]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("pieces").cast("long").alias("n_pieces"), F.array_join(said, ",").alias("places"))


def _oracle() -> str:
    """The tree is walked source by source: a row a draw, and two rows a node that is done."""
    depth = int(log2(SHARDS))
    gammas = lambda k: f"(lgamma({k} + 1) + lgamma(b[i] - {k} + 1) + lgamma(n - {k} + 1) + lgamma(pop - b[i] - n + {k} + 1))"
    weight = f"exp({gammas('m')} - {gammas('k')})"
    child = lambda node, b: f"{{'level': level + 1, 'node': {node}, 'i': 1, 'pop': coalesce(list_sum({b}), 0)::BIGINT, 'n': (coalesce(list_sum({b}), 0) // 2)::BIGINT, 'b': {b}, 'lf': []::BIGINT[]}}"
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS perm, md5(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, 3.0 * s AS cap FROM g),
v AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS w FROM r),
l AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM v
  WINDOW f AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT level FROM l WHERE level <= cap::DOUBLE / w ORDER BY cap::DOUBLE / w, source ASC NULLS LAST LIMIT 1),
t AS (SELECT rank, source, s, least(cap::DOUBLE, w * (SELECT level FROM z)) AS target, round(least(cap::DOUBLE, w * (SELECT level FROM z)))::BIGINT AS quota FROM l),
k AS (SELECT greatest({BLOCK_WORDS}, ceil(sum(size) / {MOST_BLOCKS}))::BIGINT AS block FROM d),
o AS (SELECT list(ceil(quota / (SELECT block FROM k))::BIGINT ORDER BY rank) AS b FROM t),
tree(level, node, i, pop, n, b, lf) AS (
  SELECT 0, 0, 1, list_sum(b)::BIGINT, (list_sum(b) // 2)::BIGINT, b, []::BIGINT[] FROM o
  UNION ALL
  SELECT y.level, y.node, y.i, y.pop, y.n, y.b, y.lf FROM (
    SELECT unnest(CASE WHEN i <= len(b) THEN [{{'level': level, 'node': node, 'i': i + 1, 'pop': (pop - b[i])::BIGINT, 'n': (n - x)::BIGINT, 'b': b, 'lf': list_append(lf, x)}}]
      ELSE [{child('2 * node', 'lf')}, {child('2 * node + 1', 'list_transform(range(1, len(b) + 1), lambda j: (b[j] - lf[j])::BIGINT)')}] END) AS y
    FROM (
      SELECT *, coalesce(ks[list_filter(range(1, len(ks) + 1), lambda j: list_sum(ws[1:j]) >= u * list_sum(ws))[1]], m)::BIGINT AS x FROM (
        SELECT *, list_transform(ks, lambda k: {weight}) AS ws FROM (
          SELECT *, list_concat(range(m, least(m + reach, n, b[i]) + 1), list_transform(range(1, m - greatest(m - reach, 0, n + b[i] - pop) + 1), lambda k: m - k)) AS ks,
            (('0x' || substr(md5('{SEED}:' || level || ':' || node || ':' || (i - 1)), 1, 10))::BIGINT + 0.5) / 1099511627776.0::DOUBLE AS u FROM (
            SELECT *, least(greatest((n + 1) * (b[i] + 1) // (pop + 2), 0, n + b[i] - pop), n, b[i])::BIGINT AS m,
              trunc(12 * sqrt(n * 1.0::DOUBLE * b[i] / greatest(pop, 1)) + 12)::BIGINT AS reach FROM tree WHERE level < {depth})))))),
e AS (
  SELECT node AS shard, rank, sum(b[rank]) OVER (PARTITION BY rank ORDER BY node) * (SELECT block FROM k) AS hi FROM tree, t WHERE level = {depth}),
ends AS (SELECT shard, rank, coalesce(lag(hi) OVER (PARTITION BY rank ORDER BY shard), 0)::BIGINT AS lo, hi::BIGINT AS hi FROM e),
p AS (
  SELECT d.rid, d.size, t.rank, coalesce('s' || d.source, 'n') AS skey, t.s, t.target, t.quota,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY perm, digest ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS spot
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT rid, skey, pass, shard, pass * s + spot AS origin, greatest(pass * s + spot, lo) AS a, least(pass * s + spot + size, quota, hi) AS z
  FROM p JOIN ends USING (rank), range(3) g(pass) WHERE greatest(pass * s + spot, lo) < least(pass * s + spot + size, quota, hi)),
c AS (
  SELECT rid, sum(z - a) AS taken, count(*) AS n, string_agg(concat_ws(':', pass, shard, a - origin, z - origin,
    ('0x' || substr(md5(concat_ws(':', {SEED}, shard, skey, a // (SELECT block FROM k))), 1, {ORDER_BITS // 4}))::BIGINT), ',' ORDER BY pass, shard) AS places FROM x GROUP BY rid)
SELECT doc_id, d.size, s AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n, 0)::BIGINT AS n_pieces, coalesce(places, '') AS places
FROM d JOIN p USING (rid) LEFT JOIN c USING (rid)"""


ORACLE = _oracle()
