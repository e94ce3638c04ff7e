"""Rules that batches of photos must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BATCH, ID, LABEL, PHOTOS_PER_BATCH, DatasetError

#: Cases that an error's message lists; it says how many more there are.
LISTED = 1000


def told(cases: DataFrame, *order: str) -> tuple[int, list]:
    """(how many rows there are, the first LISTED of them in order)."""
    n = cases.count()
    return n, cases.orderBy(*order).limit(LISTED).collect() if n else []


def and_more(n: int, listed: list[str], joint: str = ", ") -> str:
    return joint.join(listed) + (f" and {n - len(listed)} more" if n > len(listed) else "")


def batch_counts(df: DataFrame, batch: str = BATCH, size: int = PHOTOS_PER_BATCH) -> DataFrame:
    """Batches without exactly size rows. A null batch is not reported."""
    return df.filter(F.col(batch).isNotNull()).groupBy(batch).agg(F.count("*").alias("n")).filter(F.col("n") != size)


def class_conflicts(df: DataFrame, batch: str = BATCH, label: str = LABEL) -> DataFrame:
    """Batches of more than one class, with their classes in order."""
    return df.filter(F.col(batch).isNotNull()).groupBy(batch).agg(F.array_sort(F.collect_set(label)).alias("classes")).filter(F.size("classes") > 1)


def duplicate_ids(df: DataFrame, batch: str = BATCH, key: str = ID) -> DataFrame:
    """Ids that a batch has more than once."""
    return df.filter(F.col(batch).isNotNull()).groupBy(batch, key).agg(F.count("*").alias("n")).filter("n > 1")


def batch_issues(df: DataFrame, batch: str = BATCH, label: str = LABEL, key: str = ID, size: int = PHOTOS_PER_BATCH) -> DataFrame:
    """(batch, reason, detail, rows) of every broken rule; rows: the ids concerned, in order as texts.

    Counts and classes of all batches come first; ids are gathered of broken batches only."""
    rows = df.filter(F.col(batch).isNotNull()).select(F.col(batch).alias("batch"), F.col(label).alias("label"), F.col(key).cast("string").alias("id"))
    facts = rows.groupBy("batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("classes"))
    broken = facts.filter((F.col("n") != size) | (F.size("classes") > 1))
    ids = rows.join(broken.select("batch"), "batch", "left_semi").groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("rows"))
    reason = lambda holds, name, detail: F.when(holds, F.struct(F.lit(name).alias("reason"), detail.alias("detail")))
    reasons = F.array_compact(F.array(
        reason(F.col("n") != size, "row_count", F.concat(F.lit("rows: "), F.col("n").cast("string"))),
        reason(F.size("classes") > 1, "class_conflict", F.concat(F.lit("classes: "), F.array_join("classes", ", ")))))
    named = broken.join(ids, "batch").select("batch", F.explode(reasons).alias("r"), "rows").select("batch", "r.reason", "r.detail", "rows")
    repeated = rows.groupBy("batch", F.coalesce("id", F.lit("null")).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("rows"))
    return named.unionByName(repeated.select("batch", F.lit("duplicate_id").alias("reason"), F.concat(F.lit("ids: "), F.array_join("rows", ", ")).alias("detail"), "rows"))


def assert_clean(df: DataFrame, **columns: str) -> DataFrame:
    """df itself, or an error that tells how many issues there are and lists the first."""
    n, issues = told(batch_issues(df, **columns).drop("rows"), "batch", "reason")
    if n:
        raise DatasetError(f"{n} batch issues: " + and_more(n, [f"{r.batch}: {r.reason} ({r.detail})" for r in issues], "; "))
    return df
