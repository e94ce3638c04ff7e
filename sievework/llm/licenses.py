"""Op 1, positional rare-token index: licence scans.

Templates are lists of phrases. A phrase is held as its content words with their places and the
function words that follow each, its gaps. The postings of the templates are keyed by each phrase's
anchor, the word with the highest inverse document frequency in the scanned corpus. A file's licence
words are looked up there; an entry gives the relative places at which the other words must stand
and what fills the gaps, and a phrase is found where all of it does: word for word. A template is
reported when all its mandatory phrases are found at places that agree on where it begins.

Everything after the one pass over the texts runs on their licence words, each kept with its place
and the few words after it. As gaps hold no licence word, places that agree are neighbours there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, sql_text, table, words

#: Gaps in phrases; never looked up, but verified.
FUNCTION_WORDS = frozenset("a an and any as be by for from in is it of on or that the this to under with without".split())


@dataclass(frozen=True)
class Template:
    """label; notice: the words of the licence's own text or of a usual notice; phrases: those of
    its phrases that must all be there."""

    label: str
    notice: str
    phrases: tuple[str, ...]


# The contract's base phrases, and wording of public licence texts and notices.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    Template("mit", "mit license", ("mit license",)),
    Template("apache", "apache license", ("apache license",)),
    Template("gpl", "general public license", ("general public license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "person obtaining a copy")),
    Template("mit-notice", "released under the mit license", ("released under the mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "distribute this software for any purpose")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("creative-commons", "creative commons attribution", ("creative commons attribution",)),
)
#: Places of one template's phrases may differ by so many words from where its notice has them.
SLACK = 8


@dataclass(frozen=True)
class Phrase:
    """text: all its words; content: those that are looked up, with their places; gaps: for each of
    those, the function words that follow it."""

    number: int
    template: int
    start: int
    text: tuple[str, ...]
    content: tuple[tuple[int, str], ...]
    gaps: tuple[tuple[str, ...], ...]


def _phrases(templates: tuple[Template, ...]) -> list[Phrase]:
    found = []
    for t, template in enumerate(templates):
        notice = template.notice.split()
        for text in template.phrases:
            own = text.split()
            start = next(i for i in range(len(notice)) if notice[i : i + len(own)] == own)
            content = tuple((k, w) for k, w in enumerate(own) if w not in FUNCTION_WORDS)
            if len(content) < 2 or content[0][0]:
                raise ValueError(f"a phrase begins with one of two or more content words: {text}")
            ends = [*(k for k, _ in content[1:]), len(own)]
            gaps = tuple(tuple(own[k + 1 : end]) for (k, _), end in zip(content, ends, strict=True))
            found.append(Phrase(len(found), t, start, tuple(own), content, gaps))
    return found


def _postings(phrases: list[Phrase], df: dict[str, int]) -> str:
    """SQL for a map from anchors to entries: the phrase, how far before the anchor it starts, the gap
    after the anchor, and its other words by their distance in licence words and in words."""
    gap = lambda words: f"array({', '.join(map(sql_text, words))})" if words else "cast(array() as array<string>)"
    by_word: dict[str, list[str]] = {}
    for p in phrases:
        k = min(range(len(p.content)), key=lambda i: (df.get(p.content[i][1], 0), p.content[i][1]))
        at, anchor = p.content[k]
        others = ", ".join(f"named_struct('d', {i - k}, 'dp', {o - at}, 'w', {sql_text(w)}, 'gap', {gap(p.gaps[i])})" for i, (o, w) in enumerate(p.content) if i != k)
        by_word.setdefault(anchor, []).append(f"named_struct('phrase', {p.number}, 'back', {at}, 'gap', {gap(p.gaps[k])}, 'others', array({others}))")
    return "map(" + ", ".join(f"{sql_text(w)}, array({', '.join(es)})" for w, es in by_word.items()) + ")"


def _report(phrases: list[Phrase], templates: tuple[Template, ...]) -> tuple[Column, Column]:
    """(labels, score) from places: array<struct<phrase, start>>."""
    labels, scores = [], []
    for t, template in enumerate(templates):
        own = [p for p in phrases if p.template == t]
        begins = lambda p: f"transform(filter(places, x -> x.phrase = {p.number}), x -> x.start - {p.start})"
        rest = " and ".join([f"exists({begins(p)}, o -> abs(o - b) <= {SLACK})" for p in own[1:]]) or "true"
        whole = F.expr(f"exists({begins(own[0])}, b -> {rest})")
        labels.append(F.when(whole, F.lit(template.label)))
        size = sum(len(p.content) for p in own)
        covered = " + ".join(f"if(exists(places, x -> x.phrase = {p.number}), {len(p.content)}, 0)" for p in own)
        content = sum(w not in FUNCTION_WORDS for w in template.notice.split())
        scores.append(F.when(whole, F.lit(0.5) + F.lit(0.5 * size / content)).otherwise(F.lit(0.5) * F.expr(f"({covered}) / {float(size)}D")))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ","), F.round(F.greatest(*scores), 6)


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row a row of df: its id, n_words, places (of base phrases and all others: phrase number
    and first word), n_base, first_word, last_word, base_labels, labels and score.

    The first templates are the base ones. A null or empty text has no words, no labels and score
    0; a text of any length is read whole, as one row; repeated rows give repeated results, an empty
    table an empty one; a phrase that several templates have counts for each; other columns of df are
    not read, whatever their names. score is the largest
    over the templates: half the share of its phrases that is found, or, if the template is
    reported, a half and half the share of its notice that its phrases make up."""
    phrases = _phrases(templates)
    vocabulary = sorted({w for p in phrases for _, w in p.content})
    widest = max(len(g) for p in phrases for g in p.gaps)
    held = F.transform("w", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word"), F.slice("w", i + 2, F.lit(widest)).alias("after"))))
    hits = durable(df.select(F.col(doc_id).alias("id"), words(text).alias("w")).select("id", F.size("w").cast("long").alias("n_words"), F.array_compact(held).alias("hits")), "licence-hits")
    # at most one row a licence word
    counts = hits.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").count().collect()
    found = F.expr(f"""
        flatten(transform(hits, (h, j) -> coalesce(transform(filter(element_at({_postings(phrases, dict(map(tuple, counts)))}, h.word),
            e -> slice(h.after, 1, size(e.gap)) = e.gap
              and forall(e.others, o -> coalesce(get(hits, j + o.d).word = o.w and get(hits, j + o.d).pos = h.pos + o.dp and slice(get(hits, j + o.d).after, 1, size(o.gap)) = o.gap, false))),
          e -> named_struct('phrase', e.phrase, 'start', h.pos - e.back)), cast(array() as array<struct<phrase:int,start:int>>))))""")
    labels, score = _report(phrases, templates)
    base = F.expr(f"transform(filter(places, x -> x.phrase < {len(BASE)}), x -> x.start)")
    base_labels = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.expr(f"exists(places, x -> x.phrase = {k})"), F.lit(label)) for k, (_, label) in enumerate(BASE)]))), ",")
    return hits.withColumn("places", found).select(
        F.col("id").alias(doc_id), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        base_labels.alias("base_labels"), labels.alias("labels"), score.alias("score"), "places")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def _oracle() -> str:
    phrases = _phrases(TEMPLATES)
    starts = ",\n  ".join(
        f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {o + 1}] = {word!r}' for o, word in enumerate(p.text))}) AS p{p.number}" for p in phrases)
    labels, scores = [], []
    for t, template in enumerate(TEMPLATES):
        own = [p for p in phrases if p.template == t]
        rest = " AND ".join(f"len(list_filter(p{p.number}, lambda o: abs((o - {p.start}) - (b - {own[0].start})) <= {SLACK})) > 0" for p in own[1:]) or "true"
        whole = f"len(list_filter(p{own[0].number}, lambda b: {rest})) > 0"
        size, content = sum(len(p.content) for p in own), sum(w not in FUNCTION_WORDS for w in template.notice.split())
        covered = " + ".join(f"CASE WHEN len(p{p.number}) > 0 THEN {len(p.content)} ELSE 0 END" for p in own)
        labels.append(f"CASE WHEN {whole} THEN '{template.label}' END")
        scores.append(f"CASE WHEN {whole} THEN 0.5::DOUBLE + {0.5 * size / content!r}::DOUBLE ELSE 0.5::DOUBLE * ({covered}) / {size}::DOUBLE END")
    base = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE)]
    joined = lambda xs: "array_to_string(list_sort(list_filter([" + ",\n  ".join(xs) + "], lambda x: x IS NOT NULL)), ',')"
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words,
  {starts} FROM d),
b AS (SELECT *, list_concat(p0, list_concat(p1, p2)) AS base FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word,
  {joined(base)} AS base_labels,
  {joined(labels)} AS labels,
  round(greatest({', '.join(scores)}), 6) AS score
FROM b"""


ORACLE = _oracle()
