"""Order statistics that no single task has to sort for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: int | Column, *keys: str) -> Column:
    """A shuffling key: md5 of the seed and the keys, the same in every engine and partitioning."""
    return F.md5(F.concat_ws("|", (F.lit(seed) if isinstance(seed, int) else seed).cast("string"), *[F.col(k).cast("string") for k in keys]))


def shuffled_rank(df: DataFrame, part: list[str], order: Column, ties: list[str], name: str = "rank") -> DataFrame:
    """Adds name: each row's place, from 1, within part, by a uniform hex key and then ties.

    Rows are ranked within (part, the key's first two digits); counts of those buckets, 256 a part at
    most, shift the ranks. So a part that holds most rows is ranked by 256 tasks."""
    rows = df.withColumn("_key", order).withColumn("_bucket", F.substring("_key", 1, 2))
    before = W.partitionBy(*part).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1) if part else W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = rows.groupBy(*part, "_bucket").agg(F.count("*").alias("_n")).select(*part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    same = F.lit(True)
    for c in (*part, "_bucket"):
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    own = F.row_number().over(W.partitionBy(*part, "_bucket").orderBy("_key", *ties))
    ranked = rows.withColumn("_own", own).alias("r").join(shifts.alias("s"), same)
    return ranked.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("_own") + F.col("_shift")).cast("long").alias(name))


#: How far around a quantile its exact value is sought, in shares of the rows; and the number of rows
#: from which that is many times the error of the approximate quantiles. Fewer rows are all ordered.
BRACKET, ENOUGH = 1e-3, 20_000
#: Of approximate quantiles: their error is one part in so many of the rows, a fifth of the bracket.
ACCURACY = 5_000


#: Groups whose brackets are broadcast at most.
MOST_GROUPS = 100_000


def column_quantiles(df: DataFrame, columns: list[str], at: dict[str, float]) -> dict[str, dict[str, float | None]]:
    """For each column, every name of at with its exact quantile (linear interpolation), and n, mean and
    sd (population); nulls and NaN are left out, and a column without values has None.

    Values stay in their rows: one pass for moments and approximate quantiles, one to count what lies
    below their brackets, and only what lies inside, some BRACKET of all, is dealt out and ordered."""
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    rows = df.select(*[v.alias(f"v{i}") for i, v in enumerate(value.values())])
    edges = F.array(*[F.lit(min(max(q + d, 0.0), 1.0)) for q in at.values() for d in (-BRACKET, BRACKET)])
    # one row, of a few numbers a column
    first = rows.agg(*[f(f"v{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max), ("e", lambda c: F.percentile_approx(c, edges, F.lit(ACCURACY))))]).first()
    out: dict[str, dict[str, float | None]] = {c: {"n": first[f"n{i}"], "mean": first[f"mean{i}"], "sd": first[f"sd{i}"], **dict.fromkeys(at)} for i, c in enumerate(columns)}
    bracket = {}
    for i in range(len(columns)):
        n = first[f"n{i}"]
        for k, q in enumerate(at.values()):
            if n:
                low = first[f"lo{i}"] if n < ENOUGH or q <= 2 * BRACKET else first[f"e{i}"][2 * k]
                high = first[f"hi{i}"] if n < ENOUGH or q >= 1 - 2 * BRACKET else first[f"e{i}"][2 * k + 1]
                bracket[i, k] = low, high
    if not bracket:
        return out
    below = rows.agg(*[F.count_if(F.col(f"v{i}") < low).alias(f"b{i}_{k}") for (i, k), (low, _) in bracket.items()]).first()
    inside = F.array_compact(F.array(*[F.when(F.col(f"v{i}").between(low, high), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"v{i}").alias("v"))) for (i, k), (low, high) in bracket.items()]))
    # equal values are one row with their number
    counted = rows.select(F.explode(inside).alias("x")).groupBy("x.i", "x.k", "x.v").agg(F.count("*").alias("c"))
    start, position = {}, {}
    for i, k in bracket:
        start[i, k], position[i, k] = below[f"b{i}_{k}"], list(at.values())[k] * (first[f"n{i}"] - 1)
    of = lambda held, kind: F.create_map(*[F.lit(x) for (i, k), v in held.items() for x in (i * len(at) + k, kind(v))])[F.col("i") * len(at) + F.col("k")]
    upto = of(start, int) + F.sum("c").over(W.partitionBy("i", "k").orderBy("v"))
    placed = counted.select("i", "k", "v", "c", upto.alias("upto"), F.floor(of(position, float)).alias("low"), F.ceil(of(position, float)).alias("high"))
    holds = lambda p: F.max(F.when((F.col("upto") > F.col(p)) & (F.col("upto") - F.col("c") <= F.col(p)), F.col("v")))
    for r in placed.groupBy("i", "k").agg(holds("low").alias("a"), holds("high").alias("b")).collect():  # a row a quantile
        out[columns[r.i]][list(at)[r.k]] = r.a + (r.b - r.a) * (position[r.i, r.k] - int(position[r.i, r.k]))
    return out


def quantiles(df: DataFrame, part: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """part and one column a name of at: exact quantiles with linear interpolation; nulls are left out.

    Approximate quantiles bracket each one; rows below a bracket are counted, and only those inside,
    some BRACKET of all, are ordered."""
    rows = df.select(*part, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    edges = [min(max(q + d, 0.0), 1.0) for q in at.values() for d in (-BRACKET, BRACKET)]
    rough = rows.groupBy(*part).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias("_e"))
    # the ends of the range stand in for a bracket that touches them
    spec = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("pos"), F.when((F.col("_n") < ENOUGH) | F.lit(q <= 2 * BRACKET), F.col("_min")).otherwise(F.col("_e")[2 * k]).alias("lo"), F.when((F.col("_n") < ENOUGH) | F.lit(q >= 1 - 2 * BRACKET), F.col("_max")).otherwise(F.col("_e")[2 * k + 1]).alias("hi"))
        for k, (name, q) in enumerate(at.items())]))
    wanted = rough.select(*part, spec.alias("_s")).select(*part, "_s.*")
    same = F.lit(True)
    for c in part:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}"))
    few = not part or rows.select(*part).distinct().limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    met = rows.alias("r").join(F.broadcast(wanted.alias("w")) if few else wanted.alias("w"), same)
    met = met.select(*[F.col(f"w.{c}") for c in part], "name", "pos", "lo", "hi", "_v")
    below = met.groupBy(*part, "name").agg(F.count_if(F.col("_v") < F.col("lo")).alias("_below"))
    # equal values are one row with their number
    inside = met.filter("_v between lo and hi").groupBy(*part, "name", "pos", "_v").agg(F.count("*").alias("_c"))
    keys = [*part, "name"]
    both = F.lit(True)
    for c in keys:
        both &= F.col(f"i.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = inside.alias("i").join(below.alias("b"), both).select(*[F.col(f"i.{c}") for c in keys], "pos", "_v", (F.col("_below") + F.sum("_c").over(W.partitionBy(*[F.col(f"i.{c}") for c in keys]).orderBy("_v"))).alias("_upto"), F.col("_c"))
    low, high = F.floor("pos"), F.ceil("pos")
    holds = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col("_v")))
    picked = placed.groupBy(*keys).agg(holds(low).alias("_lo"), holds(high).alias("_hi"), F.max("pos").alias("pos"))
    picked = picked.withColumn("q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("pos") - F.floor("pos")))
    return picked.groupBy(*part).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at])
