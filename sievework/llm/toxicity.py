"""Op 2, compression-distance classification: toxicity.

Two zstandard dictionaries are made from labelled text. The toxic one is trained by the library on the
words of toxic documents that hold a stretch which saves bytes in those and hardly occurs in ordinary
ones; the ordinary one holds common ordinary words. A window, here one word with its borders, is compressed behind either dictionary,
and the difference of the lengths, given the window's length, tells how much likelier such a window
is in toxic documents. Every window is followed by the same tail, which both dictionaries hold, so
that block overhead cancels and the matcher looks at the whole window. The thresholds on a
document's strongest windows are calibrated by logistic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, packed, small_batches, table, unpacked
from .textnum import slices

#: The sample that is learned from: so many rows of a class, and so many bytes of text, at most.
ROWS_PER_CLASS, SAMPLE_BYTES = 1000, 8 << 20
#: What a row counts beside its text, so that not even empty texts come in any number.
ROW_BYTES = 64
FOLDS = 5
LEVEL = 6
#: Stretches of so many bytes may enter the toxic dictionary, from words of so many at most.
SHORTEST, LONGEST, WORD_BYTES = 5, 12, 40
STRETCHES, COMMON_WORDS = 96, 400
#: Size of the toxic dictionary, and the trainer's lengths of segments and of what it counts in them.
TOXIC_BYTES, SEGMENT, PIECE = 512, 16, 6
#: A document's strongest windows that count.
STRONGEST = 4
#: What a toxic document that is passed over weighs against an ordinary one that is rejected.
MISS_COST = 3.0
TAIL = bytes(range(128, 192))
GAINS, LENGTHS = 12, 16
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(256)).lower()


def _windows(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_LOWER))


@dataclass
class Model:
    """toxic, ordinary: dictionaries' contents; evidence: log likelihood ratio by gain and length;
    weights: of 1, the strongest windows' evidence, and the log of the number of windows."""

    toxic: bytes
    ordinary: bytes
    evidence: np.ndarray
    weights: np.ndarray


class Scorer:
    """A model at work in one process; keeps a bounded table of windows it has met."""

    def __init__(self, model: Model, keep: int = 200_000) -> None:
        self.model, self.keep, self.known = model, keep, {}
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.by = []
        for content in (model.toxic, model.ordinary):
            d = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=options)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=options))

    def cell(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves, and the window's length."""
        found = self.known.get(word)
        if found is None:
            window = b" " + word + b" " + TAIL
            gain = len(self.by[1].compress(window)) - len(self.by[0].compress(window))
            found = min(max(gain, 0), GAINS - 1) * LENGTHS + min(max(len(word) - 3, 0), LENGTHS - 1)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, windows: list[bytes]) -> np.ndarray:
        best = np.zeros(STRONGEST)
        if windows:
            seen = np.bincount([self.cell(w) for w in windows], minlength=GAINS * LENGTHS)
            own = np.flatnonzero(seen)
            strong = np.sort(np.repeat(self.model.evidence[own], np.minimum(seen[own], STRONGEST)))[::-1][:STRONGEST]
            best[: len(strong)] = np.maximum(strong, 0)
        return np.concatenate([[1.0], best, [np.log1p(len(windows))]])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-self.features(_windows(text)) @ self.model.weights)))


def _stretches(words: set[bytes], n: int, pieces: set[bytes] | None) -> set[bytes]:
    """Stretches of n bytes of the words and their borders, made of two of the pieces, if given."""
    out: set[bytes] = set()
    for w in words:
        if n - 2 <= len(w) <= WORD_BYTES:
            b = b" " + w + b" "
            if pieces is None:
                out.update(b[i : i + n] for i in range(len(b) - n + 1))
            else:
                out.update(b[i : i + n] for i in range(len(b) - n + 1) if b[i : i + n - 1] in pieces and b[i + 1 : i + n] in pieces)
    return out


def _telling(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> list[bytes]:
    """Stretches by the bytes they save in toxic documents beyond what they would save in ordinary
    ones, none inside another or half made of pieces of others, the best first. A stretch is in enough documents only if both its shorter pieces are, so
    lengths are counted one after the other."""
    least = max(3, 0.02 * len(toxic))
    inside: dict[bytes, int] = {}
    outside: Counter[bytes] = Counter()
    pieces = shorter = None
    for n in range(SHORTEST, LONGEST + 1):
        count: Counter[bytes] = Counter()
        for d in toxic:
            count.update(_stretches(d, n, pieces))
        own = {s: k for s, k in count.items() if k >= least}
        pieces = set(own)
        for d in ordinary:
            outside.update(_stretches(d, n, shorter) & pieces)
        inside |= own
        shorter = pieces
        if not pieces:
            break
    ratio = len(toxic) / max(len(ordinary), 1)
    value = {s: (n - 4 * max(outside[s], outside[s] * ratio)) for s, n in inside.items() if n > 8 * (outside[s] + 0.5) * ratio}
    chosen: list[bytes] = []
    held: set[bytes] = set()
    for s in sorted(value, key=lambda s: (-value[s] * (len(s) - SHORTEST + 2), s)):
        pieces = {s[i : i + SHORTEST] for i in range(len(s) - SHORTEST + 1)}
        if value[s] >= least and 2 * len(pieces & held) <= len(pieces) and not any(c in s for c in chosen):
            chosen.append(s)
            held |= pieces
            if len(chosen) == STRETCHES:
                break
    return chosen


def _toxic_dictionary(toxic: list[set[bytes]], telling: list[bytes]) -> bytes:
    """The library's dictionary of each toxic document's words with a telling stretch; of too few of
    them it makes none, and the stretches themselves stand for it."""
    parts = re.compile(b"|".join(re.escape(x) for s in telling if (x := s.strip())) or rb"(?!)")
    tells = {w for d in toxic for w in d if parts.search(w)}
    samples = [b" " + b" ".join(found) + b" " for d in toxic if (found := sorted(d & tells))]
    try:
        return zstandard.train_dictionary(TOXIC_BYTES, samples, k=SEGMENT, d=PIECE).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(reversed(telling))


def train(rows: list[tuple[str, int]], totals: tuple[int, int]) -> Model | None:
    """From (text, label); totals: how many rows of either class there are, sampled or not."""
    held: dict[bytes, bytes] = {}  # one object a word, however often it occurs
    windows = [([held.setdefault(w, w) for w in _windows(t.encode())], y) for t, y in rows]
    del held
    toxic, ordinary = ([set(w) for w, y in windows if y == label] for label in (1, 0))
    if not toxic or not ordinary:
        return None
    common = Counter(w for d in ordinary for w in d)
    content = _toxic_dictionary(toxic, _telling(toxic, ordinary))
    del toxic, ordinary
    frequent = b" ".join(reversed([w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]]))
    model = Model(content, frequent[-max(len(content), 256) :], np.zeros(GAINS * LENGTHS), np.zeros(STRONGEST + 2))
    scorer = Scorer(model, keep=50_000)
    count = np.zeros((2, GAINS * LENGTHS))
    for w, y in windows:
        if w:
            count[y] += np.minimum(np.bincount([scorer.cell(x) for x in w], minlength=GAINS * LENGTHS), STRONGEST)
    smooth = np.array([[2.0], [0.5]])
    rate = (count + smooth) / (count.sum(axis=1, keepdims=True) + smooth * GAINS * LENGTHS)
    model.evidence = np.log(rate[1]) - np.log(rate[0])
    x = np.array([scorer.features(w) for w, _ in windows])
    y = np.array([label for _, label in windows], float)
    # rows stand for all of their class
    share = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    share *= len(y) / share.sum()
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    ridge = 0.05 * np.eye(len(b))
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (share * (y - p)) - ridge @ b)
    model.weights = b / scale
    model.weights[0] += np.log(MISS_COST)  # so that 0.5 is where both mistakes cost the same
    return model


def fold(doc_id: str, folds: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def _fitting(sized: DataFrame, most: int) -> list:
    """Of rows with id, bytes and h, the first ROWS_PER_CLASS in order of h that together keep to most
    bytes, passing over those that do not fit. A sixteenth of the bytes may stay unused: filling them
    with ever shorter texts would skew the sample."""
    out, left, after = [], most, None
    while len(out) < ROWS_PER_CLASS and 16 * left > most:
        rest = sized.filter(F.col("bytes") <= left)
        if after is not None:
            rest = rest.filter((F.col("h") > after.h) | ((F.col("h") == after.h) & (F.col("id") > after.id)))
        asked = ROWS_PER_CLASS - len(out)
        found = rest.orderBy("h", "id").limit(asked).collect()
        for r in found:
            if r.bytes <= left:
                out.append(r)
                left -= r.bytes
        if len(found) < asked:
            break
        after = found[-1]
    return out


def learn(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[Model | None, float]:
    """A model, if both classes have labelled rows outside the held-out fold, and the share of class 1.

    Learns from a sample bounded by ROWS_PER_CLASS and SAMPLE_BYTES, the first ids in the order of a
    hash that fit; one that does not is passed over. Where none of a class fits, the beginning of its
    shortest stands for it. Equal hashes are in the order of the ids. Null labels and ids are left out,
    a null text is empty; an id with several labels has the largest; a repeated id comes with all its
    rows or not at all. Other columns are not read, whatever their names."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    rows = df.filter(fold(doc_id, FOLDS) != 0).select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    known = rows.select("id", (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("bytes")).join(marked, "id")
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sized = known.groupBy("id", "y").agg(F.sum("bytes").alias("bytes"), F.xxhash64("id").alias("h"))
    picked = {r.id: y for y in (0, 1) for r in _fitting(sized.filter(F.col("y") == y), SAMPLE_BYTES // 2)}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return None, share
    ids = df.sparkSession.createDataFrame([(k, y) for k, y in picked.items()], "id long, y int")
    lone = [y for y in (0, 1) if y not in picked.values()]
    sample = rows.join(F.broadcast(ids), "id").select("id", "text", "y").collect()  # bounded as said
    for y in lone:
        part = F.substring("text", 1, SAMPLE_BYTES // 8).alias("text")  # of four bytes a code point at most
        sample += known.filter(F.col("y") == y).orderBy("bytes", F.xxhash64("id"), "id").limit(1).join(rows, "id").select("id", part, "y").orderBy("text").limit(1).collect()
    sample.sort(key=lambda r: (r.id, r.text))
    return train([(r.text, r.y) for r in sample], (n0, n1)), share


def score_toxicity(df: DataFrame, model: Model | None, share: float = 0.0, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row of df, beside the given columns (all of df's if none are given), with score and predicted.

    A null text scores like an empty one, which has no windows and gets what a text without evidence
    gets; a text of any length is scored whole. Without a model every score is the share of class 1.
    Input columns named like an output are replaced; repeated rows give repeated results, rows alike in
    text the same score, an empty table an empty result."""
    small_batches(df.sparkSession)
    outputs = ["score", "predicted"]
    keep = [c for c in carried(df, outputs) if columns is None or c in columns]
    if model is None:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    rows = df.select(F.col(text).alias("_text"), packed(df, keep).alias("_row"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a few KB and a small table

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for row, end, body, offsets in slices(batch.column(0)):
                scores = [scorer.score(body[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), pa.array(scores, pa.float64())], ["_row", "score"])

    scored = rows.mapInArrow(work, rows.select("_row").schema.add("score", "double"))
    return scored.select(*unpacked(keep), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, share = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, share, columns=["doc_id"]).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
