"""Plain versions of the pipeline's stages, over lists of rows."""

import collections
import hashlib
import math
import re
import zlib

import xxhash
import zstandard

from sievework.llm import mixing, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def toxic_sample(rows, labels):
    """(text, label) that the model is trained on, in order, and how many labelled rows there are of
    either label. rows: (id, text); labels: id -> label."""
    known = [(i, t or "", labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    picked = []
    for y in (0, 1):
        sizes = collections.Counter()
        for i, t, label in known:
            if label == y:
                sizes[i] += len(t.encode()) + toxicity.ROW_BYTES
        left, n, signed = toxicity.SAMPLE_BYTES // 2, 0, lambda x: x - (x >> 63 << 64)
        for i in sorted(sizes, key=lambda i: (signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)), i)):
            if n < toxicity.ROWS_PER_CLASS and sizes[i] <= left and 16 * left > toxicity.SAMPLE_BYTES // 2:
                picked.append(i)
                left, n = left - sizes[i], n + 1
    sample = sorted((i, t, y) for i, t, y in known if i in picked)
    return [(t, y) for _, t, y in sample], tuple(sum(y == k for *_, y in known) for k in (0, 1))


def toxic_score(model, text):
    """Every word compressed anew behind either dictionary."""
    options = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    behind = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options) for x in (model.toxic, model.ordinary)]
    words = [w.encode() for w in WORD.findall((text or "").translate(LOWER))]
    evidence, lengths = [], {}
    for w in words:
        if w not in lengths:
            lengths[w] = [len(z.compress(b" " + w + b" " + toxicity.TAIL)) for z in behind]
        gain = min(max(lengths[w][1] - lengths[w][0], 0), toxicity.GAINS - 1)
        evidence.append(model.evidence[gain * toxicity.LENGTHS + min(max(len(w) - 3, 0), toxicity.LENGTHS - 1)])
    strongest = [max(e, 0.0) for e in sorted(evidence, reverse=True)[: toxicity.STRONGEST]]
    features = [1.0, *strongest, *[0.0] * (toxicity.STRONGEST - len(strongest)), math.log1p(len(words))]
    return 1 / (1 + math.exp(-sum(f * w for f, w in zip(features, model.weights, strict=True))))


def near_groups(texts):
    """Numbers of texts -> the smallest number of its group, over all pairs."""
    sets = []
    for t in texts:
        w = TOKEN.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                p, q = root(a), root(b)
                group[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(sets))]


def deduplicated(rows):
    """rows: (id, text, ...). One of each group, the smallest id, missing ids last and by their text."""
    alike = {}
    for r in rows:
        alike.setdefault((r[0], r[1] or "") if r[0] is not None or TOKEN.search(r[1] or "") else object(), r)
    rows = sorted(alike.values(), key=lambda r: (r[0] is None, r[0] or 0))
    group = near_groups([r[1] for r in rows])
    return [r for i, r in enumerate(rows) if group[i] == i]


def contaminated(text, windows):
    w = WORD.findall((text or "").translate(LOWER))
    hit = set()
    for k in range(len(w)):
        for n in range(1, 14):
            if tuple(w[k : k + n]) in windows and len(w) >= k + n:
                hit |= set(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def benchmark_windows(items):
    out = set()
    for text in items:
        w = WORD.findall((text or "").translate(LOWER))
        out |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    return out


def targets(sizes):
    """source -> target, the excess over three times a source's words dealt out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def mixed(rows):
    """rows: (id, text, source). As often as the mix reads most of them."""
    size = lambda r: len(TOKEN.findall(r[1] or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += size(r)
    out = []
    for source, target in targets(sizes).items():
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}"), md5(r[1] or "")))
        at, quota = 0, round(target)
        for r in own:
            n = size(r)
            read = [max(0, min(at + p * sizes[source] + n, quota) - (at + p * sizes[source])) for p in range(3)]
            out += [r] * sum(x > 0 and 2 * x >= n for x in read)
            at += n
    return out


def sharded(rows, n_shards=40):
    """rows: (id, text, ...) -> those with size, shard and slot."""
    size = lambda r: len((r[1] or "").encode()) + 16
    line = sorted(rows, key=lambda r: md5(r[1] or "") + "-" + md5("null" if r[0] is None else str(r[0])))
    total, begun, slots, out = sum(map(size, rows)), 0, collections.Counter(), []
    for r in line:
        shard = min(n_shards - 1, (2 * begun + size(r)) * n_shards // (2 * total))
        out.append((*r, size(r), shard, slots[shard]))
        slots[shard] += 1
        begun += size(r)
    return out
