"""Op 5, MinHash near-duplicates with tensored banding.

A document's set of word shingles gives two small collections of half keys, each half the hash of
a few minhashes. Every pair of a half of the first and one of the second collection is the key of
one table: m + m halves stand for m * m tables, so minhashes are computed for about the square root
of the number of tables. A pair at the least similarity shares no half of one collection with
probability (1 - s**k)**m, 5e-5 for the default k = 2 and m = 12.

Copies (equal sets) are one class with one representative. Only halves that two representatives
share form keys. In each bucket the smallest id is linked with the others; links are confirmed on
the full sets. Documents that then share a bucket with another component are compared too, within
families whose rarest shingles meet (an exact prefix filter), block by block inside tasks, so no
link between the buckets' members is lost, while a group of copies or near copies costs one
comparison a member, and documents that have only a common passage cost none. Components come from
alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, marked, packed, small_batches, spread, table, unpacked, without
from .textnum import Words, mix, runs, slices

SHINGLE = 5
#: Least similarity, in hundredths.
PERCENT = 75
HALVES, PER_HALF = 12, 2
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Documents in a block of a family.
BLOCK = 256
#: Partners of one pivot that share a task.
PARTNERS = 512
OUTPUTS = ["doc_id", "n_shingles", "component_id", "kept"]


def _distinct_shingles(body: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    words = Words(body, offsets, "token")
    hashes, first = runs(words.hashes, words.first, n)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, n + 1, dtype=np.uint64)
    return mix(at * np.uint64(0xD1B54A32D192ED03)), mix(at * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def _halves(sets: list[np.ndarray], halves: int, per_half: int) -> np.ndarray:
    """(sets, 2 * halves) keys; sets are not empty."""
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    line = np.concatenate(sets)
    out = np.zeros((len(sets), 2 * halves), np.uint64)
    xor, odd = _seeds(2 * halves * per_half)
    for h in range(2 * halves):
        key = np.full(len(sets), np.uint64(h + 1))
        for k in range(h * per_half, (h + 1) * per_half):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((line ^ xor[k]) * odd[k], begins))
        out[:, h] = key
    return out


def signatures(df: DataFrame, shingle: int = SHINGLE, halves: int = HALVES, per_half: int = PER_HALF) -> DataFrame:
    """(id, text) -> id, n_shingles, s1 and s2 (a 128-bit sum of the set), halves (null for an empty set)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, body, offsets in slices(batch.column(1)):
                sets = _distinct_shingles(body, offsets, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                sums = np.array([[int(mix(s + np.uint64(k)).sum()) if len(s) else 0 for s in sets] for k in (1, 2)], np.uint64).reshape(2, -1).view(np.int64)
                full = np.flatnonzero(n)
                lists: list[list[int] | None] = [None] * len(sets)
                if len(full):
                    keys = _halves([sets[i] for i in full], halves, per_half).view(np.int64).tolist()
                    for i, k in zip(full.tolist(), keys, strict=True):
                        lists[i] = k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(lists, pa.list_(pa.int64()))], ["id", "n_shingles", "s1", "s2", "halves"])

    return df.mapInArrow(make, "id long, n_shingles long, s1 long, s2 long, halves array<long>")


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    """(id, text) -> id, set: the hashes of the distinct shingles, in order."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, body, offsets in slices(batch.column(1)):
                packed = [s.tobytes() for s in _distinct_shingles(body, offsets, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(packed, pa.binary())], ["id", "set"])

    return df.mapInArrow(make, "id long, set binary")


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts with one of the ids. Texts stay where they are: ids are broadcast if they are few;
    beyond that a bitmap of them is, and some texts without one of the ids come along."""
    ids = durable(ids.distinct(), "near-ids")
    if ids.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(ids), "id", "left_semi")
    return marked(texts, ids, "id").filter("_hit").drop("_hit")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are alike enough. texts: (id, text)."""
    sets = durable(_sets(_of_ids(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), shingle), "near-sets")
    # a pivot with many partners takes them in parts of some PARTNERS, each with the pivot's set once
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    pivots = sets.join(parts, sets["id"] == parts["a"]).select("a", F.col("set").alias("set_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts")
    most = parts.agg(F.max("parts")).first()[0] or 1
    dealt = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    if most > 1:
        many = durable(parts.filter("parts > 1"), "near-pivots")
        many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
        dealt = dealt.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    else:
        dealt = dealt.withColumn("part", F.lit(0).cast("long"))
    rows = dealt.join(pivots.drop("parts"), ["a", "part"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if (blob := x.as_py()) != last:
                    last, held = blob, _unpack(blob)
                other = _unpack(y.as_py())
                both = len(held) + len(other) - len(np.union1d(held, other))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return durable(rows.select("a", "b", "set_a", "set_b").mapInArrow(judge, "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> node, component (the smallest node reachable), for nodes that have links.

    Alternating large-star and small-star steps until all links are stars: every node then hangs on
    its component's smallest, which hangs on none."""
    links = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while not _stars(links):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        links = durable(small, "star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).filter("ups > 1 or ups + downs > 1 and ups > 0").isEmpty()


def _buckets(sigs: DataFrame, halves: int) -> tuple[DataFrame, DataFrame]:
    """(classes: s1, s2, n_shingles -> rep; buckets: key, pivot, rep) of buckets with two or more
    representatives, one of all that have the same members."""
    classes = durable(sigs.filter("n_shingles > 0 and id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep")), "near-classes")
    own = sigs.join(classes.select(F.col("rep").alias("id"), "s1", "s2", "n_shingles"), ["id", "s1", "s2", "n_shingles"])
    each = own.select(F.col("id").alias("rep"), F.posexplode("halves").alias("at", "half"))
    shared = each.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    side = lambda first: F.collect_set(F.when((F.col("at") < halves) == F.lit(first), F.col("half")))
    kept = each.join(shared, "half").groupBy("rep").agg(side(True).alias("x"), side(False).alias("y"))
    keys = durable(kept.select("rep", F.explode(F.flatten(F.transform("x", lambda x: F.transform("y", lambda y: F.xxhash64(x, y))))).alias("key")), "near-keys")
    members = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot"), F.max("rep").alias("top"), F.bit_xor(F.xxhash64("rep")).alias("sum")).filter("n > 1")
    alone = members.groupBy("n", "pivot", "top", "sum").agg(F.min("key").alias("key")).select("key", "pivot")
    return classes, durable(keys.join(alone, "key"), "near-buckets")


def _labelled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets whose members are in different components; comp: a member's component."""
    named = buckets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return named.join(mixed, "key")


def _families(sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp, set) -> id, family: documents that a chain of rare shingles holds together.

    In any order of all shingles, two sets that are alike enough share one among the first
    n - ceil(n * percent / 100) + 1 of each. Here those that one component alone has come first, then
    rare ones, by exact counts: counts in a table of fixed size are noise in a large corpus, and chains
    of middling shingles then tie most documents into one family. A shingle of one component
    links nothing, so what is left of a document is its first few shared ones, if any."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_unpack(blob.as_py()).view(np.int64) for blob in batch.column(2)]
            size = np.array([len(s) for s in held], np.int64)
            at = pa.array(np.repeat(np.arange(len(held)), size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(size, size)), pa.array(np.concatenate(held))], ["id", "comp", "n", "s"])

    rows = sets.select("id", "comp", "set").mapInArrow(each, "id long, comp long, n long, s long")
    shared = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s", "df")
    own = W.partitionBy("id", "n")
    placed = rows.join(shared, "s").select("id", "comp", "n", "s", F.count("*").over(own).alias("shared"), F.row_number().over(own.orderBy("df", "s")).alias("place"))
    first = placed.filter(f"place <= shared + 1 - ({percent} * n + 99) div 100").select("id", "comp", "s")
    first = durable(first, "near-prefixes")
    chained = first.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("a")).filter("lo <> hi").select("s", "a")
    found = components(first.join(chained, "s").select("a", F.col("id").alias("b")).distinct())
    return found.select(F.col("node").alias("id"), F.col("component").alias("family"))


def _linked(group: pa.Table, percent: int) -> pa.Table:
    """Of two blocks of a family (id, comp, side, set), links that unite what is alike: each
    document with the first one of its new component, unless that is old."""
    sets = [_unpack(x.as_py()) for x in group["set"]]
    ids, comp, side = (group[c].to_numpy() for c in ("id", "comp", "side"))
    size = np.array([len(s) for s in sets])
    line, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, place, n = np.unique(line, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # places among shingles that several have
    common = np.zeros((len(sets), len(sets)), np.float32)
    keep = n[place] > 1
    column, row = shared[place[keep]], doc[keep]
    for lo in range(0, int((n > 1).sum()), 4096):
        part = (column >= lo) & (column < lo + 4096)
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[part], column[part] - lo] = 1
        common += held @ held.T
    both = size[:, None] + size[None, :] - common
    alike = (100 * common.astype(np.int64) >= percent * both.astype(np.int64)) & (comp[:, None] != comp[None, :])
    # pairs within a block are judged where both of its sides are that block
    alike &= (side[:, None] != side[None, :]) | (side.min() == side.max())
    label = np.unique(comp, return_inverse=True)[1]
    first = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, label, np.arange(len(ids)))
    own = first[label]  # the first document of each old component stands for all of it
    x, y = np.nonzero(np.triu(alike | alike.T, 1))
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, own[x], low[own[y]])
        np.minimum.at(new, own[y], low[own[x]])
        new = new[new]
        if (new == low).all():
            break
        low = new
    root = low[own]
    moved = np.flatnonzero((root != own) & (own == np.arange(len(ids))))
    return pa.table({"a": pa.array(ids[root[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})


def _family_links(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, comp) -> links (a, b) between components, each confirmed on full sets.

    A family is cut into blocks of about BLOCK documents, a large component's apart from the others';
    every two blocks meet in one group, but those of one component do not. Only links leave it."""
    comps = F.broadcast(rest) if rest.count() <= BROADCAST_IDS else rest
    sets = durable(_sets(_of_ids(texts, rest.select("id")), shingle).join(comps, "id"), "near-sets")
    member = durable(_families(sets, percent).join(rest, "id"), "near-families")
    sized = member.groupBy("family", "comp").agg(F.count("*").alias("n")).withColumn("large", F.when(F.col("n") >= BLOCK, F.col("comp")))
    parts = sized.groupBy("family", F.coalesce("large", F.lit(-1).cast("long")).alias("part")).agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    before = W.partitionBy("family").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = durable(parts.select("family", "part", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("begin"), F.sum("blocks").over(W.partitionBy("family")).alias("all")), "near-parts")
    # rows of the few large components and families meet their numbers where they are, or dealt by id too
    large = spread(member, durable(sized.filter("large is not null").select("family", "comp", F.col("large").alias("part")), "near-large"), ["family", "comp"], "left", "id")
    placed = spread(large.withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))), parts, ["family", "part"], "inner", "id")
    placed = placed.withColumn("block", F.col("begin") + F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda k: (F.col("part") == -1) | (k < F.col("begin")) | (k >= F.col("begin") + F.col("blocks")))
    met = placed.select("family", "id", "comp", "block", F.explode(other).alias("k"))
    met = met.select("family", "id", "comp", F.col("block").alias("side"), F.least("block", "k").alias("lo"), F.greatest("block", "k").alias("hi"))
    groups = met.join(sets.select("id", "set"), "id").select("family", "lo", "hi", "id", "comp", "side", "set").groupBy("family", "lo", "hi")
    return durable(groups.applyInArrow(lambda g: _linked(g, percent), "a long, b long").distinct(), "near-links")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, halves: int = HALVES, per_half: int = PER_HALF) -> DataFrame:
    """One row a row of df: doc_id (long), n_shingles, component_id and kept.

    Words are runs without ASCII white space, A-Z lower case. A text of fewer words than a shingle
    is one shingle; one without words, or null, has none and is linked with nothing: its
    component is itself. A text of any length is read whole; an empty table gives an empty result. A null id has no component and is not kept. Rows that share an id are one
    node; each of them gets that node's component. Other columns of df are not read, whatever their names."""
    small_batches(df.sparkSession)
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sigs = durable(signatures(texts, shingle, halves, per_half), "near-signatures")
    classes, buckets = _buckets(sigs, halves)
    star = buckets.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))

    # each document with its smallest pivot; then those that share a bucket with another component,
    # in families held together by their rarest shingles
    first = durable(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-pairs")
    links = confirmed(first, texts, shingle, percent)
    found = components(links)
    rest = durable(_labelled(buckets, found).select(F.col("rep").alias("id"), "comp").distinct(), "near-rest")
    if not rest.isEmpty():
        found = components(links.union(_family_links(rest, texts, shingle, percent)))

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of df that stay, as they are, when of each group of near-duplicates one document does:
    the one with the smallest id.

    Rows alike in id and text are one document, of which one row stays: the first by a hash of all
    columns. Rows of one id with different texts are different documents, and so are rows without an
    id; such ones are named by 2**62 and up, after all others, by a hash of id and text. Rows without
    words are linked with nothing and stay, but for repeats of an id. Texts of any length are read
    whole, an empty table gives an empty one, and columns keep their names and values, whatever they are."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(packed(df, df.columns).alias("_row"), F.col(f"`{doc_id}`").cast("long").alias("id"), body.alias("text")).withColumn("digest", F.xxhash64("text"))
    held = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("unlike"))
    again = durable(held.filter("n > 1").select("id", "unlike"), "near-repeated")
    repeats, nameless = not again.isEmpty(), not df.filter(F.col(f"`{doc_id}`").isNull()).isEmpty()
    rows = spread(rows, again, ["id"], "left", "digest") if repeats else rows.withColumn("unlike", F.lit(None).cast("boolean"))
    own_name = F.lit(1 << 62) + F.pmod(F.xxhash64("id", "digest"), F.lit((1 << 62) - 1))
    rows = rows.withColumn("sid", F.when(F.col("id").isNull() | F.col("unlike"), own_name).otherwise(F.col("id")))
    near = near_duplicates(rows.select("sid", "text"), "text", "sid", **options)
    gone = durable(near.filter("not kept").select(F.col("doc_id").alias("sid")).distinct(), "near-gone")
    rows = without(rows, gone, "sid", "digest")
    if not repeats and not nameless:
        return rows.select(*unpacked(df.columns))
    several = F.col("unlike").isNotNull() | (F.col("id").isNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(f"_row.`{c}`") for c in df.columns]
    one = rows.filter(several).groupBy("sid").agg(F.min_by("_row", F.xxhash64(*columns)).alias("_row"))
    return rows.filter(~several).select("_row").unionByName(one.select("_row")).select(*unpacked(df.columns))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.s FROM s JOIN r USING (s)),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM t x JOIN t y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
c(doc_id, id) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.id FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c.id)::BIGINT AS component_id, d.doc_id = min(c.id) AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n"""
