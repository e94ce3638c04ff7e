"""Op 4, multipart credential linking: secret scans.

Strong parts are matched by their form alone. Weak parts (client identifiers, long random-looking
tokens, endpoints) would be noise by themselves: an interval join within scopes of a document links
parts of different roles, and a weak part is reported only where parts of complementary roles stand
in its scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, sql_text, table

# The contract's base patterns, in its order. The number is the group whose length,
# and the last value the least length, that a match must have.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Weak parts; they take part only where a complementary part is near.
WEAK = (
    ("client", r"""([Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 2, 4),
    ("random", r"[A-Za-z0-9+/]+", 0, 40),
    ("endpoint", r"[a-z]+://[A-Za-z0-9.:@/_-]+", 0, 12),
)
#: What each kind of part stands for in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "client": "id", "random": "secret", "endpoint": "endpoint"}
ORDER = {kind: k for k, (kind, *_) in enumerate((*BASE, *WEAK))}
#: Code points between two linked parts at most.
SCOPE = 256
PART = "struct<start:int,ord:int,kind:string,end:int>"


#: Matches whose places are summed up together.
STEP = 256


def _searched(pattern: str, group: int, least: int, kind: str) -> str:
    """A run's matches are maximal, so its least length, less what comes before the run, can go
    into the search itself; the text left out has no match that is long enough."""
    before = len(pattern.partition("[")[0])
    return pattern[:-1] + f"{{{least - before},}}" if group == 0 and kind != "endpoint" else pattern


def _linear(pattern: str, kind: str) -> str:
    """The same matches in one pass over the text: a scheme is tried at the beginning of a run of
    letters alone, where the leftmost match begins, and gives nothing back."""
    return pattern.replace("[a-z]+", "(?<![a-z])[a-z]++") if kind == "endpoint" else pattern


def matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """array<PART> of all leftmost non-overlapping matches whose group has least characters.

    Splitting at the pattern gives the stretches between the matches, so places follow from the
    running length of both, summed by STEP matches first. A text without any match costs one search."""
    column, kind_sql, p = "_text", sql_text(kind), sql_text(_linear(_searched(pattern, group, least, kind), kind))
    part = f"named_struct('start', at, 'ord', {ORDER[kind]}, 'kind', {kind_sql}, 'end', at + length(y.m[i]))"
    return F.expr(f"""
        if({column} rlike {p},
          element_at(transform(transform(transform(
            array(named_struct('m', regexp_extract_all({column}, {p}, 0), 'g', regexp_extract_all({column}, {p}, {group}), 's', split({column}, {p}, -1))),
            x -> named_struct('m', x.m, 'g', x.g, 's', x.s, 'n', if(size(x.m) = 0, cast(array() as array<int>), transform(x.m, (m, i) -> length(m) + length(x.s[i]))))),
            x -> named_struct('m', x.m, 'g', x.g, 's', x.s, 'n', x.n, 'upto', aggregate(sequence(0, size(x.n) div {STEP}), cast(array(0) as array<int>),
              (a, k) -> array_append(a, element_at(a, -1) + aggregate(slice(x.n, k * {STEP} + 1, {STEP}), 0, (b, c) -> b + c))))),
            y -> transform(filter(transform(y.g, (g, i) -> if(length(g) >= {least}, i, null)), i -> i is not null),
              i -> element_at(transform(array(y.upto[i div {STEP}] + aggregate(slice(y.n, i div {STEP} * {STEP} + 1, i % {STEP}), 0, (b, c) -> b + c) + length(y.s[i])), at -> {part}), 1))), 1),
          cast(array() as array<{PART}>))""")


def _joined(parts: str) -> str:
    return f"array_join(transform(array_sort({parts}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def scan_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of df: its id, parts (all base matches), linked (weak parts with a complement
    in their scope), and the counts and strings that sum them up.

    A null or empty text has no spans; a text of any length is searched whole, in time that follows
    its length. Rows that share an id and a text share one result; repeated rows give repeated
    results, an empty table an empty one; spans that begin alike are in the order of the kinds; other
    columns of df are not read, whatever their names. A weak part that overlaps a base
    match is that match's, and not reported again."""
    kinds = [*BASE, *WEAK]
    body = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = body.select("id", F.md5(F.col("_text").cast("binary")).alias("digest"), *[matches(F.col("_text"), p, g, n, kind).alias(kind) for kind, p, g, n in kinds])
    base, weak = (F.concat(*[F.col(k) for k, *_ in group]) for group in (BASE, WEAK))
    found = durable(found.select("id", "digest", base.alias("parts"), weak.alias("weak")), "secret-parts")

    # the interval join: parts meet in the scope-sized bins they touch, of one document
    part = lambda c: found.filter(F.size("weak") > 0).select("id", "digest", F.explode(c).alias("p")).distinct()
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    binned = lambda df, lo, hi: df.select("id", "digest", "p", role[F.col("p.kind")].alias("role"), F.explode(F.sequence(F.floor(lo / SCOPE), F.floor(hi / SCOPE))).alias("bin"))
    left = binned(part("weak"), F.col("p.start") - SCOPE, F.col("p.end") + SCOPE).alias("l")
    right = binned(part(F.concat("parts", "weak")), F.col("p.start"), F.col("p.end")).alias("r")
    near = (F.col("r.p.start") <= F.col("l.p.end") + SCOPE) & (F.col("r.p.end") >= F.col("l.p.start") - SCOPE)
    apart = (F.col("r.p.start") >= F.col("l.p.end")) | (F.col("r.p.end") <= F.col("l.p.start"))
    met = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.digest") == F.col("r.digest")) & (F.col("l.bin") == F.col("r.bin")) & near & apart & (F.col("l.role") != F.col("r.role")))
    linked = met.groupBy("l.id", "l.digest", F.col("l.p").alias("p")).agg(F.collect_set("r.role").alias("roles"))
    # an endpoint or identifier needs a secret; a secret without a keyword needs an identifier
    enough = F.when(F.col("p.kind") == "random", F.array_contains("roles", "id")).otherwise(F.array_contains("roles", "secret"))
    linked = linked.filter(enough).groupBy("id", "digest").agg(F.collect_set("p").alias("linked"))

    out = found.alias("f").join(linked.alias("k"), F.col("f.id").eqNullSafe(F.col("k.id")) & (F.col("f.digest") == F.col("k.digest")), "left")
    empty = F.expr(f"cast(array() as array<{PART}>)")
    free = F.filter(F.coalesce("k.linked", empty), lambda w: ~F.exists("f.parts", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    out = out.select(F.col("f.id").alias("id"), F.col("f.parts").alias("parts"), free.alias("linked"))
    count = lambda kind: F.size(F.filter("parts", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        F.col("id").alias(doc_id), *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(F.expr(_joined("parts")), 256).alias("base_sha256"), F.expr(_joined("concat(parts, linked)")).alias("spans"), "parts", "linked")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("parts", "linked")


def _oracle() -> str:
    def spans(kind: str, pattern: str, group: int, least: int) -> str:
        p = "'" + _searched(pattern, group, least, kind).replace("'", "''") + "'"
        return f"""
  SELECT rid, doc_id, '{kind}' AS kind, {ORDER[kind]} AS ord, start, "end" FROM (
    SELECT rid, doc_id, g[i] AS part, (list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS start, start + length(m[i]) AS "end" FROM (
      SELECT rid, doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS g, regexp_split_to_array(text, {p}) AS s, unnest(range(1, len(regexp_extract_all(text, {p}, 0)) + 1)) AS i FROM d)) WHERE length(part) >= {least}"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS ({' UNION ALL '.join(spans(*x) for x in BASE)}),
w AS ({' UNION ALL '.join(spans(*x) for x in WEAK)}),
a AS (SELECT *, CASE kind {' '.join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items())} END AS role FROM (SELECT * FROM b UNION ALL SELECT * FROM w)),
k AS (
  SELECT DISTINCT l.rid, l.doc_id, l.kind, l.ord, l.start, l."end" FROM a l JOIN a r ON l.rid = r.rid AND r.start <= l."end" + {SCOPE} AND r."end" >= l.start - {SCOPE}
    AND (r.start >= l."end" OR r."end" <= l.start) AND r.role <> l.role AND r.role = CASE WHEN l.kind = 'random' THEN 'id' ELSE 'secret' END
  WHERE l.ord >= {len(BASE)} AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = l.rid AND b.start < l."end" AND l.start < b."end")),
s AS (SELECT rid, string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, ord) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM k) GROUP BY rid),
c AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh, string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, ord) AS base FROM b GROUP BY rid)
SELECT d.doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nc, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)"""


ORACLE = _oracle()
