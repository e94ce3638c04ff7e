"""Op 7, deleted interpolation: scoring texts with a bigram model.

A token's probability mixes its share among what followed the token before it, its share of all
tokens, and an even share: weights depend on how often the context occurred, in octaves, and are
learned by expectation-maximisation on a held-out fold of the training documents, each of which is
deleted from the counts while its own tokens are predicted.

Counting works on chunks of a few megabytes of text. A chunk sends its distinct keys (64-bit hashes,
in order) with their counts to buckets, which are ranges of the hash; a bucket adds up the counts of
all chunks and answers each with the totals of its keys, in its order. So a common token or pair
costs one entry a chunk, not one row an occurrence, and no table of counts is ever held whole.

Chunks times buckets would grow with the square of the input. So a chunk sends to FAN buckets at
most; where more are needed, the packets that groups of some FAN chunks send to a bucket are merged
first, cut anew into the smaller buckets inside it, and the totals go back the same way.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, small_batches, table
from .textnum import Words, mix, pack, unpack

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Text of a chunk, and of what a bucket counts, in bytes; one longer document is a chunk alone.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 2 << 20
#: Buckets that a chunk or a group of chunks sends to, and chunks of a group.
FAN = 2048
#: Packed bytes that a task of a shuffle takes, some.
TASK_BYTES = 64 << 20
_END, _START = mix(np.array([0x656E64, 0x7374617274], np.uint64))
#: Cells of the held-out counts: octaves of the context's count by eighths of an octave of both shares.
CONTEXTS, SHARES, STEP = 40, 320, 8
CHUNK = "chunk string, deleted boolean, ids array<long>, sizes array<int>, body binary"


def _remainder(doc_id: int | None) -> int:
    """crc32(id as text) mod FOLDS; a null id is in no fold but the training one."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> chunks, the deleted fold's documents in chunks of their own."""
    ids: dict[bool, list] = {False: [], True: []}
    texts: dict[bool, list[bytes]] = {False: [], True: []}
    held = {False: 0, True: 0}

    def flush(kind: bool) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([
            pa.array([uuid.uuid4().hex]), pa.array([kind]), pa.array([ids[kind]], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts[kind]]], pa.list_(pa.int32())), pa.array([zstandard.compress(b"".join(texts[kind]), 6)], pa.binary())], ["chunk", "deleted", "ids", "sizes", "body"])
        ids[kind], texts[kind], held[kind] = [], [], 0
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            d, t = doc_id.as_py(), (text.as_py() or "").encode()
            kind = _remainder(d) == DELETED
            ids[kind].append(d)
            texts[kind].append(t)
            held[kind] += len(t)
            if held[kind] >= CHUNK_BYTES:
                yield flush(kind)
    for kind in (False, True):
        if ids[kind]:
            yield flush(kind)


class Chunk:
    """A chunk's tokens as numbers: doc of each, and the place of its token and pair among the
    chunk's distinct ones; training: which tokens are learned from."""

    def __init__(self, ids: list[int | None], sizes: list[int], body: bytes) -> None:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        w = Words(np.frombuffer(zstandard.decompress(body), np.uint8), offsets, "token")
        n, count = len(ids), np.diff(w.first)
        at = np.cumsum(count + 1) - 1
        token = np.full(int(count.sum()) + n, _END, np.uint64)
        inside = np.ones(len(token), bool)
        inside[at] = False
        token[inside] = w.hashes
        before = np.concatenate([[_START], token[:-1]])
        before[np.concatenate([[0], at[:-1] + 1])] = _START
        self.ids, self.doc = ids, np.repeat(np.arange(n), count + 1)
        self.fold = np.array([_remainder(d) for d in ids])
        self.training = (self.fold != HELD_OUT)[self.doc]
        # the context's count is the token's own, or for a text's first token the number of texts
        self.keys: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        for keys in (np.concatenate([token, [_START]]), mix(before * np.uint64(0x9E3779B97F4A7C15) + token)):
            distinct, place = np.unique(keys, return_inverse=True)
            self.keys.append(distinct)
            self.place.append(place[: len(token)])
        self.context = np.searchsorted(self.keys[0], before)
        self.first = before == _START

    def counts(self) -> list[np.ndarray]:
        out = [np.bincount(p[self.training], minlength=len(k)) for p, k in zip(self.place, self.keys, strict=True)]
        out[0][np.searchsorted(self.keys[0], _START)] = int((self.fold != HELD_OUT).sum())
        return out


def _bucket_bounds(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(keys, _bucket_bounds(buckets)), [len(keys)]])


def _partial(buckets: int):
    """Chunks -> kind, bucket, chunk, keys, counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                chunk = Chunk(r["ids"], r["sizes"], r["body"])
                rows: list[list] = [[], [], [], [], []]
                for kind, (keys, counts) in enumerate(zip(chunk.keys, chunk.counts(), strict=True)):
                    cut = _cut(keys, buckets)
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        own = keys[cut[b] : cut[b + 1]]
                        step = np.concatenate([own[:1], np.diff(own)])
                        for column, value in zip(rows, (kind, b, r["chunk"], pack(step), pack(counts[cut[b] : cut[b + 1]].astype(np.uint64))), strict=True):
                            column.append(value)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["kind", "bucket", "chunk", "keys", "counts"])

    return work


def _joint(packets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of some packets, the place of each packet's keys among them, their counts, and
    where each packet begins."""
    keys = [np.cumsum(unpack(x.as_py(), np.uint64)) for x in packets["keys"]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, place, np.concatenate([unpack(x.as_py(), np.uint64) for x in packets["counts"]]), np.concatenate([[0], np.cumsum([len(k) for k in keys])])


def _total(group: pa.Table) -> pa.Table:
    """One bucket: the totals of every chunk's keys, and, without a chunk, how many keys and counts there are."""
    distinct, place, counts, cuts = _joint(group)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
    answers = [pack(total[place[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    kind, bucket, n = group["kind"][0].as_py(), group["bucket"][0].as_py(), group.num_rows
    start = np.searchsorted(distinct, _START)
    own = distinct != _START if kind == 0 and start < len(distinct) else np.ones(len(distinct), bool)
    return pa.table({
        "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "chunk": pa.array([*group["chunk"].to_pylist(), None], pa.string()),
        "totals": pa.array([*answers, None], pa.binary()), "n_keys": pa.array([0] * n + [int((total[own] > 0).sum())], pa.int64()), "n_tokens": pa.array([0] * n + [int(total[own].sum())], pa.int64())})


def _merged(buckets: int, subs: int):
    """The packets of a group of chunks to one bucket -> what the group sends to its smaller buckets."""

    def work(key: tuple, packets: pa.Table) -> pa.Table:
        kind, bucket, group = (k.as_py() for k in key)
        keys, place, counts, _ = _joint(packets)
        total = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.uint64)
        cut = _cut(keys, buckets)
        own = [b for b in range(bucket * subs, (bucket + 1) * subs) if cut[b] < cut[b + 1]]
        parts = [(keys[cut[b] : cut[b + 1]], total[cut[b] : cut[b + 1]]) for b in own]
        return pa.table({
            "kind": pa.array([kind] * len(own), pa.int32()), "bucket": pa.array(own, pa.int32()), "chunk": pa.array([str(group)] * len(own)),
            "keys": pa.array([pack(np.concatenate([k[:1], np.diff(k)])) for k, _ in parts], pa.binary()), "counts": pa.array([pack(n) for _, n in parts], pa.binary())})

    return work


def _passed_on(key: tuple, packets: pa.Table, answers: pa.Table) -> pa.Table:
    """The totals of a group's keys in one bucket -> the answers to each of its chunks."""
    _, place, _, cuts = _joint(packets)
    order = np.argsort(answers["bucket"].to_numpy())
    total = np.concatenate([unpack(answers["totals"][int(k)].as_py(), np.uint64) for k in order])
    return pa.table({"kind": packets["kind"], "bucket": packets["bucket"], "chunk": packets["chunk"], "totals": pa.array([pack(total[place[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _totals(sent: DataFrame, chunks: int, buckets: int, subs: int, fan: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(answers: chunk, kind, bucket, totals; sizes: kind, n_keys, n_tokens) from packets to buckets,
    each of which is cut into subs smaller ones."""
    answered = "kind int, bucket int, chunk string, totals binary, n_keys long, n_tokens long"
    if subs == 1:
        every = durable(sent.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_total, answered), "lm-totals")
        return every.filter("chunk is not null").select("chunk", "kind", "bucket", "totals"), every.filter("chunk is null")
    keys = ["kind", "bucket", "group"]
    sent = durable(sent.withColumn("group", F.pmod(F.crc32(F.col("chunk").cast("binary")), F.lit(max(1, ceil(chunks / fan))))), "lm-packets").repartition(tasks, *keys)
    inner = sent.groupBy(*keys).applyInArrow(_merged(buckets * subs, subs), "kind int, bucket int, chunk string, keys binary, counts binary")
    every = durable(inner.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_total, answered), "lm-totals")
    back = every.filter("chunk is not null").select("kind", "bucket", F.expr(f"bucket div {subs}").cast("int").alias("top"), F.col("chunk").cast("long").alias("group"), "totals").repartition(tasks, "kind", "top", "group")
    answers = sent.groupBy(*keys).cogroup(back.groupBy("kind", "top", "group")).applyInArrow(_passed_on, "kind int, bucket int, chunk string, totals binary")
    return durable(answers, "lm-answers").select("chunk", "kind", "bucket", "totals"), every.filter("chunk is null")


def _restored(left: pa.Table, right: pa.Table) -> tuple[Chunk, list[np.ndarray]]:
    """A chunk and the totals of its keys, from its row and its answers."""
    r = left.slice(0, 1).to_pylist()[0]
    chunk = Chunk(r["ids"], r["sizes"], r["body"])
    answers = sorted(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["totals"].to_pylist(), strict=True), key=lambda x: x[:2])
    return chunk, [np.concatenate([unpack(t, np.uint64) for k, _, t in answers if k == kind]).astype(np.int64) for kind in (0, 1)]


def _octave(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1.0).astype(np.int64), CONTEXTS - 1)


def _share_cell(p: np.ndarray) -> np.ndarray:
    """0 for no share, else eighths of an octave below 1, from 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.round(-STEP * np.log2(p)), 1, SHARES - 1), 0).astype(np.int64)


def _share(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** ((1.0 - cell) / STEP), 0.0)


def _own(place: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """How often each token's key occurs in the token's own document."""
    _, back, n = np.unique(doc * size + place, return_inverse=True, return_counts=True)
    return n[back]


def held_out_cells(left: pa.Table, right: pa.Table, n_all: int) -> pa.Table:
    """Counts of a deleted chunk's tokens by context octave and shares, its own document left out."""
    chunk, (tokens, pairs) = _restored(left, right)
    doc, (t, p) = chunk.doc, chunk.place
    c2 = pairs[p] - _own(p, doc, len(pairs))
    c1 = tokens[t] - _own(t, doc, len(tokens))
    as_context = np.concatenate([t, chunk.context])
    own_context = _own(as_context, np.concatenate([doc, doc + doc.max() + 1]), len(tokens))[len(t) :]
    # a token is the context of the next one, so what a document has of it as context is what it has
    context = tokens[chunk.context] - own_context
    size = np.bincount(doc)[doc]
    p2 = np.where(context > 0, c2 / np.maximum(context, 1), 0.0)
    cell = (_octave(np.maximum(context, 0)) * SHARES + _share_cell(p2)) * SHARES + _share_cell(c1 / np.maximum(n_all - size, 1))
    cells, n = np.unique(cell, return_counts=True)
    return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})


def learn_weights(cells: np.ndarray, n: np.ndarray, n_types: int, rounds: int = 60) -> np.ndarray:
    """(CONTEXTS, 3): weights of the pair's share, the token's share and the even share, by EM."""
    octave, p2, p1 = cells // (SHARES * SHARES), _share(cells // SHARES % SHARES), _share(cells % SHARES)
    parts = np.stack([p2, p1, np.full(len(cells), 1.0 / (n_types + 1))], axis=1)
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXTS, 1))
    for _ in range(rounds):
        mixed = weights[octave] * parts
        mixed *= (n / mixed.sum(axis=1))[:, None]
        # one token's worth of prior for each part keeps every weight above nought
        total = np.stack([np.bincount(octave, mixed[:, k], CONTEXTS) for k in range(3)], axis=1) + [0.1, 0.5, 0.4]
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def score_chunk(left: pa.Table, right: pa.Table, n_all: int, n_types: int, weights: np.ndarray) -> pa.Table:
    chunk, (tokens, pairs) = _restored(left, right)
    doc, (t, p) = chunk.doc, chunk.place
    n = len(chunk.ids)
    c1, context = tokens[t], tokens[chunk.context]
    w = weights[_octave(context)]
    p2 = np.where(context > 0, pairs[p] / np.maximum(context, 1), 0.0)
    likely = w[:, 0] * p2 + w[:, 1] * c1 / max(n_all, 1) + w[:, 2] / (n_types + 1)
    base = np.log10((c1 + 1) / (n_all + n_types + 1))
    return pa.table({
        "doc_id": pa.array(chunk.ids, pa.int64()), "held_out": pa.array(chunk.fold == HELD_OUT), "n_tokens": pa.array(np.bincount(doc, minlength=n), pa.int64()),
        "n_known": pa.array(np.bincount(doc, weights=c1 > 0, minlength=n).astype(np.int64)), "train_tokens": pa.array(np.full(n, n_all, np.int64)),
        "base_score": pa.array(np.bincount(doc, weights=base, minlength=n)), "score": pa.array(np.bincount(doc, weights=np.log10(likely), minlength=n))})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of df: its id and the columns of SCORES.

    Tokens: A-Z lower case, runs without ASCII white space, then one end. A null text is empty and
    has the end alone. Learns from rows whose crc32(id) mod 7 is not 2; among them, those with 3 give
    the held-out counts. A null id is learned from. Repeated rows count each time; without training
    rows every token gets the even share; an empty table gives an empty result. A text of any length
    is read whole; one over CHUNK_BYTES is a chunk by itself. Scores do not depend on the order or the
    partitions of the rows, but for the last digits of their sums. Other columns of df are not read,
    whatever their names."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    chunks = durable(rows.mapInArrow(_chunks, CHUNK), "lm-chunks")
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    needed = max(1, ceil(size / BUCKET_BYTES))
    subs = ceil(needed / FAN)  # smaller buckets in each of those that a chunk sends to
    buckets = ceil(needed / subs)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(2 * size / TASK_BYTES))
    sent = chunks.mapInArrow(_partial(buckets), "kind int, bucket int, chunk string, keys binary, counts binary")
    answers, sizes = _totals(sent, chunks.count(), buckets, subs, FAN, tasks)
    n_types, n_all = sizes.filter("kind = 0").agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()

    deleted, replies = chunks.filter("deleted"), answers.repartition(tasks, "chunk")
    few = deleted.select("chunk")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    met = deleted.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.join(few, "chunk", "left_semi").repartition(tasks, "chunk").groupBy("chunk"))
    cells = met.applyInArrow(lambda a, b: held_out_cells(a, b, n_all), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells.sort()  # sums in the same order every time
    found = np.array([(r.cell, r.n) for r in cells], np.int64).reshape(-1, 2)  # no more than there are cells
    weights = learn_weights(found[:, 0], found[:, 1], n_types)
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda a, b: score_chunk(a, b, n_all, n_types, weights), SCORES)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
