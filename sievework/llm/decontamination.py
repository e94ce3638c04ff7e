"""Op 3, distributed positional inverted index: benchmark decontamination.

The documents are read once into an index that is stored in segments, one for some text of one task:
for every term that the benchmark has, the places in the segment's documents. Everything after that
reads the index, not the texts. A benchmark window is sought by its rarest terms in the whole corpus:
their lists, moved back by the terms' offsets in the window, are intersected, and the lists of its
other terms must hold what remains. Places where the rarest terms stand close to their offsets, but
the window as a whole does not, are proximity matches.

Results are kept by a text's digest, for texts with matches alone, and joined to the documents last;
no text is ever written or dealt out. The benchmark is taken in blocks of a bounded number of words,
and an index holds the terms of as many blocks as MOST_TERMS allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, durable, packed, small_batches, spread, table, unpacked
from .textnum import Words, pack, slices, unpack, word_counts

WINDOW = 13
#: Terms of a window whose lists are intersected.
ANCHORS = 3
#: How far from its offset a rare term may stand in a proximity match.
SLACK = 4
#: Words of benchmark text sought at a time (a block's tables take some 100 bytes a word; an item is
#: never cut), and terms of an index (8 bytes each in every task).
BLOCK_WORDS, MOST_TERMS = 250_000, 2_000_000


def _words_of(texts: list[str]) -> Words:
    parts = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), "word")


def _numbers(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Vocabulary numbers of words, -1 for others."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


class Block:
    """The windows of some benchmark items, as numbers of a vocabulary that holds all their words."""

    def __init__(self, items: list[tuple[str | None, str]], vocabulary: np.ndarray, window: int) -> None:
        self.names = [name for name, _ in items]
        w = _words_of([text for _, text in items])
        terms = _numbers(vocabulary, w.hashes)
        count = np.diff(w.first)
        item = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(terms)) - w.first[:-1][item]
        begin = np.flatnonzero((at + window <= count[item]) | ((at == 0) & (count[item] < window)))
        self.item = item[begin]
        self.length = np.minimum(window, count[self.item])
        # -1 beyond a short item's end
        reach = begin[:, None] + np.arange(window)
        inside = np.arange(window) < self.length[:, None]
        self.terms = np.where(inside, terms[np.minimum(reach, max(len(terms) - 1, 0))], -1) if len(terms) else np.zeros((0, window), np.int64)
        # windows with the same words are one search
        self.terms, back = np.unique(self.terms, axis=0, return_inverse=True) if len(self.terms) else (self.terms, np.zeros(0, np.int64))
        self.length = (self.terms >= 0).sum(axis=1)
        order = np.argsort(back.ravel(), kind="stable")
        self.items_of = self.item[order]
        self.items_first = np.searchsorted(back.ravel()[order], np.arange(len(self.terms) + 1))

    def choose(self, frequency: np.ndarray) -> None:
        """Anchors: each window's terms by how rare they are in the documents, then by their offset."""
        rank = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        self.anchor_at = np.argsort(rank, axis=1, kind="stable")[:, :ANCHORS]


class Segment:
    """Part of the index: places of terms in the words of some documents, one list a term, in order.

    Places are on one line on which documents lie a window and more apart."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray, first: np.ndarray, window: int) -> None:
        self.gap = window + SLACK + 1
        doc = np.searchsorted(first, places, "right") - 1
        place = places + self.gap * doc
        self.first, self.width = first, int(first[-1]) + self.gap * len(first) + window + 1
        self.postings = np.repeat(terms, sizes) * self.width + place
        self.doc = doc
        self.line = np.full(self.width, -1)
        self.line[place] = np.repeat(terms, sizes)

    @staticmethod
    def columns(words: Words, vocabulary: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Terms, sizes of their lists and places, packed."""
        term = _numbers(vocabulary, words.hashes)
        used = np.flatnonzero(term >= 0)
        places = used[np.argsort(term[used], kind="stable")]
        terms, sizes = np.unique(term[used], return_counts=True)
        steps = np.diff(places, prepend=0)
        begins = np.cumsum(sizes) - sizes
        steps[begins] = places[begins]  # a list's first place is as it is, the others are steps
        return pack(np.diff(terms, prepend=0)), pack(sizes), pack(steps)

    @classmethod
    def read(cls, terms: bytes, sizes: bytes, places: bytes, first: np.ndarray, window: int) -> Segment:
        n, steps = unpack(sizes, np.int64), unpack(places, np.int64)
        total = np.cumsum(steps)
        begins = np.cumsum(n) - n
        before = np.where(begins > 0, total[np.maximum(begins - 1, 0)], 0)
        return cls(np.cumsum(unpack(terms, np.int64)), n, total - np.repeat(before, n), first, window)

    def search(self, block: Block) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(whether each word is hit; texts and items of exact matches; those of proximity matches)."""
        picked = np.take_along_axis(block.terms, block.anchor_at, 1)
        postings, width = self.postings, self.width
        lo = np.searchsorted(postings, picked[:, 0] * width)
        size = np.searchsorted(postings, (picked[:, 0] + 1) * width) - lo
        w = np.repeat(np.arange(len(picked)), size)
        k = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        start, doc = postings[k] % width - block.anchor_at[w, 0], self.doc[k]
        exact, near = start >= 0, block.length[w] > 1
        for a in range(1, picked.shape[1]):
            t, key = picked[w, a], start + block.anchor_at[w, a]
            seek = t * width + key
            i = np.searchsorted(postings, seek)
            at = postings[np.minimum(i, len(postings) - 1)] if len(postings) else seek
            exact &= (t < 0) | (at == seek)
            below = postings[np.maximum(i - 1, 0)] if len(postings) else seek
            near &= (t < 0) | (np.minimum(np.abs(at - seek), np.abs(seek - below)) <= SLACK)
        # the lists of the other terms
        e = np.flatnonzero(exact)
        for j in range(block.terms.shape[1]):
            e = e[(block.terms[w[e], j] < 0) | (self.line[np.minimum(start[e] + j, width - 1)] == block.terms[w[e], j])]
        mark = np.zeros(width + block.terms.shape[1] + 1, np.int64)
        np.add.at(mark, start[e], 1)
        np.add.at(mark, start[e] + block.length[w[e]], -1)
        n_words = int(self.first[-1])
        hit = np.cumsum(mark)[np.arange(n_words) + self.gap * (np.searchsorted(self.first, np.arange(n_words), "right") - 1)] > 0

        def pairs(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(which):
                return doc[which], w[which]
            d, win = np.unique(np.stack([doc[which], w[which]]), axis=1)
            many = block.items_first[win + 1] - block.items_first[win]
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            both = np.unique(np.stack([np.repeat(d, many), block.items_of[np.repeat(block.items_first[win], many) + inner]]), axis=1)
            return both[0], both[1]

        return hit, pairs(e), pairs(np.setdiff1d(np.flatnonzero(near), e))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in blocks of about block_words words, read block by block."""
    block, held = [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(text, F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        held += len(r.t) // 2 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _vocabularies(blocks: Iterator[list[tuple[str | None, str]]], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of blocks, their terms) of consecutive blocks with some most terms together."""
    n, held = 0, np.zeros(0, np.uint64)
    for block in blocks:
        more = np.union1d(held, _words_of([t for _, t in block]).hashes)
        if n and len(more) > most:
            yield n, held
            n, more = 0, np.unique(_words_of([t for _, t in block]).hashes)
        n, held = n + 1, more
    if n:
        yield n, held


INDEX = "docs array<binary>, first array<int>, terms binary, sizes binary, places binary"


def index(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(key, text) -> the stored index of the vocabulary's terms, a row a segment."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)  # MOST_TERMS numbers, or one block's

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, body, offsets in slices(batch.column(1)):
                words = Words(body, offsets, "word")
                columns = [[batch.column(0).slice(row, end - row).to_pylist()], [words.first.tolist()], *([x] for x in Segment.columns(words, sent.value))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["docs", "first", "terms", "sizes", "places"])

    return durable(texts.mapInArrow(write, INDEX), "benchmark-index")


def _frequency(held: DataFrame, size: int) -> np.ndarray:
    """How often each term of the index occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.cumsum(unpack(terms, np.int64))] += unpack(sizes, np.int64)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["term", "n"])

    # at most one row a term of the index
    counts = held.select("terms", "sizes").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[counts["term"].to_numpy()] = counts["n"].to_numpy()
    return out


FOUND = "key binary, block int, bits binary, items array<string>, near array<string>"


def _sought(held: DataFrame, block: Block, number: int, window: int) -> DataFrame:
    """The documents of the index with matches of a block's windows: a bit for every word that is hit,
    and the items with exact and with proximity matches."""
    sent = held.sparkSession.sparkContext.broadcast(block)  # some 100 bytes a word of BLOCK_WORDS

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                first = np.array(r["first"], np.int64)
                hit, exact, near = Segment.read(r["terms"], r["sizes"], r["places"], first, window).search(block)
                sets: dict[int, tuple[set, set]] = {}
                for side, (docs, items) in enumerate((exact, near)):
                    for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                        sets.setdefault(d, (set(), set()))[side].add(block.names[i])
                docs = sorted(sets)
                columns = [[r["docs"][d] for d in docs], [number] * len(docs), [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in docs], *([list(sets[d][k]) for d in docs] for k in (0, 1))]
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "block", "bits", "items", "near"])

    return held.mapInArrow(find, FOUND)


def _united(group: pa.Table) -> pa.Table:
    """What all blocks found in one text."""
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group["bits"]])
    items, near = ({i for x in group[c].to_pylist() for i in x} for c in ("items", "near"))
    return pa.table({"key": group["key"].slice(0, 1), "n_hit": pa.array([int(np.unpackbits(bits).sum())], pa.int64()), "items": pa.array([list(items)], pa.list_(pa.string())), "near": pa.array([list(near - items)], pa.list_(pa.string()))})


def matches(texts: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(key, text) -> key, n_hit, items (with exact matches) and near (items with proximity matches
    alone), a row a key of texts with either. Texts with one key must be alike."""
    small_batches(texts.sparkSession)
    read = lambda: _blocks(benchmark, item_id, item_text, block_words)
    again, number, found = read(), 0, None
    for n, vocabulary in _vocabularies(read(), most_terms):
        held = index(texts, vocabulary)
        frequency = _frequency(held, len(vocabulary))
        for items in islice(again, n):
            block = Block(items, vocabulary, window)
            if len(block.terms):
                block.choose(frequency)
                own = durable(_sought(held, block, number, window), "benchmark-found")
                found, number = own if found is None else found.unionByName(own), number + 1
    result = "key binary, n_hit long, items array<string>, near array<string>"
    if found is None:
        return texts.sparkSession.createDataFrame([], result)
    # copies of a text have the same matches: one is left before texts are dealt by key
    return found.dropDuplicates(["key", "block"]).groupBy("key").applyInArrow(_united, result)


OUTPUTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"]


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", columns: list[str] | None = None, **options) -> DataFrame:
    """Every row of df, beside the given columns (all of df's if none are given), with n_words,
    n_hit, n_items, items_sha256, contaminated and n_near_items (items with proximity matches only).

    Words: A-Z lower case, runs of 0-9, a-z and what lies beyond ASCII. A null or empty text has no
    words and no hits; a text of any length is indexed whole. Items are told apart by their id; one
    without words has no windows; all without an id count as one and have no name in items_sha256.
    Repeated rows give repeated results, an empty table an empty one; an empty benchmark leaves every
    document clean; of equally rare terms the first of a window is taken first. Input columns named
    like an output are replaced."""
    keep = [c for c in carried(df, OUTPUTS) if columns is None or c in columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = df.select(F.unhex(F.md5(body.cast("binary"))).alias("key"), body.alias("text"))
    found = matches(keyed, benchmark, item_id, item_text, **options)
    none = F.array().cast("array<string>")
    found = durable(found.select(
        F.col("key").alias("_key"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), F.size("near").cast("long").alias("n_near_items")), "benchmark-matches")
    rows = df.select(body.alias("_text"), packed(df, keep).alias("_row"), F.unhex(F.md5(body.cast("binary"))).alias("_key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, body, offsets in slices(batch.column(0)):
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(word_counts(body, offsets, "word"), pa.int64())], ["_row", "_key", "_words"])

    rows = rows.mapInArrow(count, rows.drop("_text").schema.add("_words", "long"))
    hit, zero = F.coalesce("n_hit", F.lit(0).cast("long")), F.lit(0).cast("long")
    return spread(rows, found, ["_key"], "left", "_row").select(
        *unpacked(keep), F.col("_words").alias("n_words"), hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.array_join(none, ",").cast("binary"), 256)).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("_words"))).alias("contaminated"), F.coalesce("n_near_items", zero).alias("n_near_items"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: n_near_items."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, i, n.n, array_to_string(w[i:i + n.n - 1], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM n) n WHERE i + n.n - 1 <= len(w)),
h AS (SELECT rid, i, n.n, item_id FROM g JOIN n USING (n, s)),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid),
f AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
q AS (SELECT DISTINCT least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS ws, item_id FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
u AS (SELECT *, ws[j] AS word FROM (SELECT DISTINCT n, ws, unnest(range(1, n + 1)) AS j FROM q) WHERE n > 1),
a AS (SELECT ws, n, list({'j': j, 'word': word} ORDER BY r) AS anchors FROM (
  SELECT u.*, row_number() OVER (PARTITION BY ws ORDER BY coalesce(f.n, 0), j) AS r FROM u LEFT JOIN f USING (word)) WHERE r <= 3 GROUP BY ws, n),
o AS (SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT unnest(anchors).word FROM a)),
m AS (SELECT DISTINCT o.rid, a.ws, a.n, o.i - a.anchors[1].j + 1 AS s FROM o JOIN a ON o.word = a.anchors[1].word
  WHERE EXISTS (SELECT 1 FROM o y WHERE y.rid = o.rid AND y.word = a.anchors[2].word AND abs(y.i - (o.i - a.anchors[1].j + a.anchors[2].j)) <= 4)
    AND (len(a.anchors) < 3 OR EXISTS (SELECT 1 FROM o y WHERE y.rid = o.rid AND y.word = a.anchors[3].word AND abs(y.i - (o.i - a.anchors[1].j + a.anchors[3].j)) <= 4))),
e AS (SELECT DISTINCT m.rid, q.item_id FROM m JOIN d USING (rid) JOIN q ON q.ws = m.ws WHERE m.s < 1 OR d.w[m.s:m.s + m.n - 1] <> m.ws),
x AS (SELECT rid, count(*) AS n_near FROM (SELECT * FROM e EXCEPT SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid) LEFT JOIN x USING (rid)"""
