"""Operators against plain versions of themselves on small tables."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib
from itertools import accumulate

import duckdb
import numpy as np
import plain
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import common, decontamination, licenses, lm, mixing, neardup, pii, secrets, sharding, simhash, textnum, toxicity
from sievework.llm.common import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())
WORD, TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_vector_words_are_the_regular_expressions(found):
    for kind, pattern in (("word", WORD), ("token", TOKEN)):
        got = [h for _, _, body, offsets in textnum.slices(pa.array(found, pa.string())) for h in [textnum.Words(body, offsets, kind)]]
        counts = [n for w in got for n in np.diff(w.first).tolist()]
        want = [pattern.findall(t.translate(LOWER)) for t in found]
        assert counts == [len(w) for w in want]
        names = dict(zip([h for w in got for h in w.hashes.tolist()], [x for w in want for x in w], strict=True))
        assert [names[h] for w in got for h in w.hashes.tolist()] == [x for w in want for x in w]


def test_regular_words_hash_apart():
    thue = lambda n, x: "".join(x[i.bit_count() % 2] for i in range(n))
    found = " ".join(thue(n, x) for n in (2, 64, 1024, 2048, 4096, 65536) for x in ("ab", "ba"))
    _, _, body, offsets = next(textnum.slices(pa.array([found + " a aa aaa"])))
    hashes = textnum.Words(body, offsets, "token").hashes
    assert len(hashes) == 15 == len(set(hashes.tolist()))


def test_long_slices_hash_like_short_ones():
    pad = "z" * (textnum._SAFE + 9)
    one, two = (textnum.Words(*next(textnum.slices(pa.array([t])))[2:], "token").hashes for t in (pad + " some words", "some words"))
    assert one[1:].tolist() == two.tolist()


def test_slices_cover_all_rows():
    col = pa.array(["a" * (textnum.SLICE_BYTES + 5), None, "b", "", "c" * 10] * 3)
    rows = [(a, b) for a, b, _, _ in textnum.slices(col)]
    assert rows[0][0] == 0 and rows[-1][1] == 15 and all(x[1] == y[0] for x, y in zip(rows, rows[1:], strict=False))


def test_decontamination(spark, docs, texts, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = WORD.findall(r.text.translate(LOWER))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(r.item_id))
    hits = 0
    for blocks, terms in ((10**6, 10**6), (400, 10**6), (400, 150)):  # in one block, in several, and with several indexes
        got = {r.doc_id: r for r in decontamination.find_contamination(docs, bench, block_words=blocks, most_terms=terms).collect()}
        for i, t in texts.items():
            w = WORD.findall(t.translate(LOWER))
            hit, items = set(), set()
            for k in range(len(w)):
                if own := windows.get(tuple(w[k : k + 13])):
                    items |= own
                    hit |= set(range(k, k + 13))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
            hits += len(hit)
    assert hits


def test_proximity_matches_are_not_exact_ones(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(1, item), (2, item.replace("zeta", "zeta extra")), (3, "nothing here"), (4, "beta alpha " + item[11:]), (5, "one x two one two"), (6, "nu mu x"), (7, "alpha of one two y two")]
    items = [(1, item), (2, "one two"), (3, "mu nu")]
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (2, 0), 2: (1, 1), 3: (0, 0), 4: (1, 1), 5: (1, 0), 6: (0, 1), 7: (1, 0)}
    c = duckdb.connect()
    for name, table, key in (("documents", rows, "doc_id"), ("benchmark", items, "item_id")):
        c.register(name, pa.table({key: [r[0] for r in table], "text": [r[1] for r in table]}))
    assert {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, n_items, n_near_items FROM ({decontamination.ORACLE})").fetchall()} == got


def test_near_duplicates_in_large_families(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for i in range(700):  # one family of many near and not so near copies
        own = list(base)
        for k in rng.sample(range(120), rng.randint(0, 9)):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(45))) for i in range(150)]  # only a passage in common
    rows += [(2000 + i, rows[i % 5][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            common = len(x & y)
            if 100 * common >= 75 * (len(x) + len(y) - common):
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in ids} and len(set(got.values())) > 100


def test_chains_of_middling_shingles_make_no_family(spark, monkeypatch):
    """Neighbours share a fifth of their shingles, among nearly two million others."""
    rng = random.Random(5)
    parts = [[f"{rng.getrandbits(40):x}" for _ in range(600)] for _ in range(601)]
    rows = [(i, " ".join(parts[i] + [f"{rng.getrandbits(40):x}" for _ in range(1800)] + parts[i + 1])) for i in range(600)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(8)
    made, durable = {}, neardup.durable
    monkeypatch.setattr(neardup, "durable", lambda df, name: made.setdefault(name, durable(df, name)))
    rest = durable(texts.select("id", F.col("id").alias("comp")), "rest")
    assert neardup._family_links(rest, texts, 5, 75).isEmpty() and made["near-families"].isEmpty()


def test_texts_stay_where_they_are_if_ids_are_many(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "id long, text string")
    ids = texts.filter("id % 10 = 0").select("id")
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = neardup._of_ids(texts, ids)
        assert "Exchange hashpartitioning" not in met._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.id for r in ids.collect()} <= {r.id for r in met.collect()} and met.count() < 250


def test_only_marked_rows_are_dealt_out_if_many_keys_are_gone(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "sid long, digest string")
    gone = neardup.durable(rows.filter("sid % 10 = 0").select("sid"), "gone")
    dealt, spread = [], common.spread
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "spread", lambda rows, *a: dealt.append(rows) or spread(rows, *a))
    assert sorted(r.sid for r in common.without(rows, gone, "sid", "digest").collect()) == [i for i in range(2000) if i % 10]
    assert 200 <= dealt[0].count() < 250


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 40)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 41 + 30
    assert neardup.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_halves_recall():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        common, own = rng.integers(0, 2**63, 300), rng.integers(0, 2**63, (2, 50))
        a, b = (np.unique(np.concatenate([common, o]).astype(np.uint64)) for o in own)  # 300 of 400: exactly 0.75
        h = neardup._halves([a, b], neardup.HALVES, neardup.PER_HALF)
        same = h[0] == h[1]
        missed += not (same[: neardup.HALVES].any() and same[neardup.HALVES :].any())
    assert missed <= 2


def test_simhash(docs, texts):
    def fp(t):
        votes, total = [0] * 64, 0
        for w in WORD.findall(t.translate(LOWER)):
            h, k = xxhash.xxh64_intdigest(w.encode(), seed=42), min(len(w), simhash.MOST_WEIGHT)
            total += k
            for b in range(64):
                votes[b] += k * (h >> b & 1)
        return sum(1 << b for b in range(64) if 2 * votes[b] > total)

    ids = sorted(texts)
    prints = {i: fp(texts[i]) for i in ids}
    got = {r.doc_id: r for r in simhash.fingerprint_documents(docs).collect()}
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r, other, following_fp = got[i], fp(edited), prints[ids[(k + 1) % len(ids)]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{prints[i]:016x}", f"{other:016x}")
        assert r.near_edited == pytest.approx(1 - (prints[i] ^ other).bit_count() / 64) and r.near_next == pytest.approx(1 - (prints[i] ^ following_fp).bit_count() / 64)
        assert r.n_near == (sum((prints[i] ^ p).bit_count() <= simhash.RADIUS for p in prints.values()) - 1 if i % 100 == 0 else None)


def test_documents_follow_each_other_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 7)
    rows = [(i, f"text {i}") for i in range(100, 160)] + [(3, "same")] * 4 + [(3, "other")] * 2 + [(None, "none")] * 3
    got = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    line = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), seed=42) - (xxhash.xxh64_intdigest(r[1].encode(), seed=42) >> 63 << 64)))
    want = collections.Counter()
    for (i, t), (_, following) in zip(line, line[1:] + line[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    alone = simhash.fingerprint_documents(spark.createDataFrame([(1, "abcd")] * 3, "doc_id long, text string")).collect()
    assert [r.edited_sha256 for r in alone] == [hashlib.sha256(b"abab").hexdigest()] * 3


def test_block_tables_miss_nothing(spark):
    rng = random.Random(3)
    queries = [rng.getrandbits(64) for _ in range(20)]
    index = set()
    for q in queries:
        for d in range(6):
            x = q
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            index.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.within_radius(spark.createDataFrame([(signed(x), 1) for x in index], "fp long, n long"), spark.createDataFrame([(signed(q),) for q in queries], "fp long"))
    want = {(signed(q), signed(x)) for q in queries for x in index if (q ^ x).bit_count() <= 3}
    rows = [(r.query, r.fp) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.fixture(scope="module")
def plain_scores(texts):
    """id -> n_tokens, n_known, train_tokens, held_out, base_score, score, from dictionaries of counts."""
    tokens = {i: [*TOKEN.findall(t.translate(LOWER)), "\0end"] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}
    train = [i for i in tokens if fold[i] != 2]
    one = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(one.values()), len(one)
    two = collections.Counter(p for i in train for p in zip(["\0start", *tokens[i]], tokens[i], strict=False))
    one["\0start"] = len(train)
    octave = lambda c: min(int(math.log2(c + 1)), lm.CONTEXTS - 1)
    cell = lambda p: min(max(1 + round(-lm.STEP * math.log2(p)), 1), lm.SHARES - 1) if p > 0 else 0
    share = lambda c: 2.0 ** ((1 - c) / lm.STEP) if c else 0.0
    held = collections.Counter()
    for i in train:
        if fold[i] == lm.DELETED:
            pairs = list(zip(["\0start", *tokens[i]], tokens[i], strict=False))
            own1, own2, as_context = collections.Counter(tokens[i]), collections.Counter(pairs), collections.Counter(a for a, _ in pairs)
            for a, w in pairs:
                context = one[a] - as_context[a]
                held[octave(context), cell((two[a, w] - own2[a, w]) / context if context else 0), cell((one[w] - own1[w]) / (n - len(tokens[i])))] += 1
    weights = {o: (0.4, 0.4, 0.2) for o in range(lm.CONTEXTS)}
    for _ in range(60):
        total = {o: [0.1, 0.5, 0.4] for o in range(lm.CONTEXTS)}
        for (o, c2, c1), k in held.items():
            parts = [w * x for w, x in zip(weights[o], (share(c2), share(c1), 1 / (v + 1)), strict=True)]
            for j in range(3):
                total[o][j] += k * parts[j] / sum(parts)
        weights = {o: [x / sum(t) for x in t] for o, t in total.items()}
    out = {}
    for i, ws in tokens.items():
        score = 0.0
        for a, w in zip(["\0start", *ws], ws, strict=False):
            l2, l1, l0 = weights[octave(one[a])]
            score += math.log10(l2 * (two[a, w] / one[a] if one[a] else 0) + l1 * one[w] / n + l0 / (v + 1))
        out[i] = len(ws), sum(one[w] > 0 for w in ws), n, fold[i] == 2, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws), score
    return out


@pytest.mark.parametrize("fan", [2048, 2])
def test_language_model(docs, plain_scores, monkeypatch, fan):
    """In one step, and with packets of chunks merged by groups on their way to smaller buckets."""
    if fan == 2:
        monkeypatch.setattr(lm, "FAN", fan)
        monkeypatch.setattr(lm, "BUCKET_BYTES", 60_000)
    got = {r.doc_id: r for r in lm.score_documents(docs.repartition(6)).collect()}
    assert set(got) == set(plain_scores)
    for i, want in plain_scores.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == want[:4]
        assert (r.base_score, r.score) == pytest.approx(want[4:], rel=1e-9)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_mixture_weights_climb():
    cells = np.array([(3 * lm.SHARES + 9) * lm.SHARES + 60, (3 * lm.SHARES) * lm.SHARES + 60, (3 * lm.SHARES) * lm.SHARES])
    n = np.array([70, 25, 5])
    likely = lambda w: (n * np.log((w[cells // lm.SHARES**2] * np.stack([lm._share(cells // lm.SHARES % lm.SHARES), lm._share(cells % lm.SHARES), np.full(3, 1e-4)], 1)).sum(1))).sum()
    a, b = lm.learn_weights(cells, n, 9999, 1), lm.learn_weights(cells, n, 9999, 50)
    assert likely(b) >= likely(a) and np.allclose(b.sum(axis=1), 1) and b[3, 0] > b[3, 2]


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (np.cumsum(textnum.unpack(textnum.pack(np.concatenate([x[:1], np.diff(x)])), np.uint64)) == x).all()


def test_toxicity_on_held_out_rows(spark, larger):
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    model, share = toxicity.learn(docs, labels)
    rows = docs.join(labels, "doc_id").filter(toxicity.fold("doc_id", toxicity.FOLDS) == 0)
    out = toxicity.score_toxicity(rows, model, share).select("toxic", "predicted").toPandas()
    hit = ((out.toxic == 1) & (out.predicted == 1)).sum()
    assert hit >= 0.8 * (out.toxic == 1).sum() and ((out.toxic == 0) & (out.predicted == 1)).sum() <= 0.01 * len(out)


def test_base_spans_are_the_patterns():
    text = "a.b@c.de x@y, 1.2.3.4 300.1.1.1, 4111 1111 1111 1111 +1 (555) 010-9999 a@b.c@d.e +12 é 10.0.0.256"
    found = []
    for k, kind in enumerate(pii.KINDS):
        found += [(k, *m.span()) for m in pii.BASE[kind].finditer(text) if pii._valid(kind, m.group())]
    assert pii.base_spans(text) == found and {k for k, *_ in found} == {0, 1, 2, 3}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.@+-% \n1é", max_size=40))
def test_emails_from_at_signs(text):
    assert list(pii._emails(text)) == [m.span() for m in pii.BASE["email"].finditer(text)]


FIELD = functools.cache(pii.train_field)


def spans_of(text):
    base = pii.base_spans(text)
    return pii.field_spans(FIELD(), [text], [base])[0]


def test_field_finds_what_it_was_not_shown():
    hit = said = there = 0
    for atoms, gold in pii._examples(random.Random(31), 150):
        best = set(FIELD().best(pii.Line([atoms])))
        hit, said, there = hit + len(best & gold), said + len(best), there + len(gold)
    assert hit >= 0.95 * there and hit >= 0.95 * said
    text = "call (555) 010-2222 or write jo at host dot com now"
    assert {(pii.KINDS[k], text[a:b]) for k, a, b in spans_of(text)} == {("phone", "(555) 010-2222"), ("email", "jo at host dot com")}


def test_long_lists_lose_no_number():
    text, want = "", []
    for i in range(340):
        own = f"(555) 010-{i:04d}" if i % 2 else f"555-010-{i:04d}"
        want.append((pii.KINDS.index("phone"), len(text), len(text) + len(own)))
        text += own + "; "
    assert len(text) > 5000 and list(pii._islands(text)) == [(0, len(text))]
    assert spans_of(text) == want


@pytest.mark.parametrize("own", ["jo [at] host [dot] com", "ann.lee [at] theon [dot] co [dot] uk", "jo at host DOT com", "JO AT HOST DOT COM", "jo at host.com"])
def test_spelled_addresses_fit_a_segment(own):
    assert spans_of(f"please write {own} now") == [(0, 13, 13 + len(own))]


@pytest.mark.parametrize("text", ["a" * 10**6, "7" * 10**6, "1." * 200_000, " ".join(str(7919 * i % 10**9) for i in range(50_000)), "at-" * 200_000, "@" * 300_000], ids=["letters", "digits", "dots", "numbers", "words", "signs"])
def test_long_runs_take_seconds(text):
    began = time.monotonic()
    base = pii.base_spans(text)
    pii.field_spans(FIELD(), [text], [base])
    assert time.monotonic() - began < 15


def plain_features(atoms, a, b):
    """What holds for atoms[a:b], told from its text."""
    part = atoms[a:b]
    span, digits = "".join(part), [x for x in part if x[0] in "0123456789"]
    n, octets = sum(map(len, digits)), span.split(".")
    alnum = lambda x: x[0] in "0123456789" or x[0].isalpha() or x[0] > "\x7f"
    number = lambda x: all(c in "0123456789" for c in x) and x != ""
    letters = any(alnum(x) and x[0] not in "0123456789" for x in part)
    at, dot = "at" in [x.lower() for x in part[1:-1]], any(x.lower() in ("dot", ".") for x in part[1:-1])
    four = len(octets) == 4 and all(map(number, octets))
    top = part[-1].lower() in pii._TOP
    cut = max([k for k in range(a) if atoms[k] == "\n"], default=-1)
    before = {x.lower() for x in atoms[max(cut + 1, a - pii.CUE_REACH) : a]}
    cued = [bool(before & set(pii._CUES[k])) for k in pii.KINDS]
    on = {
        "bias": True, "luhn": not letters and 13 <= n <= 19 and pii.luhn("".join(digits)), "digits_13_19": 13 <= n <= 19, "digits_9_15": 9 <= n <= 15, "digits_7_8": 7 <= n <= 8, "year_like": n <= 4, "long_run": n > 19,
        "four_octets": four and all(int(x[:4]) <= 255 for x in octets), "octets_bad": four and any(int(x[:4]) > 255 for x in octets), "decimal": len(digits) == 2 and "." in span,
        "grouped_3": len(digits) >= 3 and all(2 <= len(x) <= 4 for x in digits), "grouped_4": len(digits) >= 3 and all(len(x) == 4 for x in digits[:-1]), "at_inside": "@" in part[1:-1], "spelled_at": at and dot,
        "spelled_form": at and dot and (top or "[" in span or "(" in span) and len(span) <= pii.LONGEST_ADDRESS and bool(pii._SPELLED.fullmatch(span)), "dot_top": top,
        "plus_first": span[0] == "+", "punctuation_first": not alnum(part[0]) and span[0] not in "+(", "punctuation_last": span[-1] in ".,;:!?-/", "paren": "(" in span and ")" in span, "one_atom": len(part) == 1, "only_digits": len(part) == 1 and n > 0,
        "has_letters": letters, "space_inside": any(x.isspace() for x in part), "spaces_4": sum(x.isspace() for x in part) == 4, "spaces_more": sum(x.isspace() for x in part) > 4,
        "alnum_beside": (alnum(part[0]) and a > 0 and (alnum(atoms[a - 1]) or atoms[a - 1] in "._-@")) or (alnum(part[-1]) and b < len(atoms) and alnum(atoms[b])),
    }
    shared = [float(on[k]) for k in pii.FEATURES[: pii.SHARED]]
    return [np.array([*shared, cued[k], any(cued[:k] + cued[k + 1 :])], float) for k in range(len(pii.KINDS))]


def plain_candidates(atoms, weights):
    """(start, end, label) -> score of all spans that could be an entity."""
    out = {}
    for a in range(len(atoms)):
        for b in range(a + 1, min(a + pii.MOST_ATOMS, len(atoms)) + 1):
            part = atoms[a:b]
            if "\n" in part or part[0].isspace() or part[-1].isspace() or not any(x[0] in "0123456789@" or x.lower() == "at" for x in part):
                continue
            out.update({(a, b, k + 1): float(weights[k] @ x) for k, x in enumerate(plain_features(atoms, a, b))})
    return out


def plain_best(atoms, weights):
    """By a table over boundaries, as the rule for ties says."""
    found = plain_candidates(atoms, weights)
    spans = {}
    for (a, b, label), score in found.items():
        if score > 0 and score > spans.get((a, b), (0, 0))[0]:
            spans[a, b] = score, label
    top, last = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1)
    for b in range(1, len(atoms) + 1):
        top[b], last[b] = top[b - 1], last[b - 1]
        for a in range(b):
            if (a, b) in spans and top[a] + spans[a, b][0] > top[b]:
                top[b], last[b] = top[a] + spans[a, b][0], (a, b)
    out, b = [], len(atoms)
    while last[b]:
        a, b = last[b]
        out.append((a, b, spans[a, b][1]))
        b = a
    return out[::-1]


def test_best_segmentation_is_that_of_a_plain_search():
    rng = np.random.default_rng(6)
    some = [pii._ATOM.findall(t) for t in ("at 1.2 b", "call 555 010-2222, 4111 1111 1111 1111\n+1 (5) 77 at x dot com.", "mail a1@b.c 1.2.3.4 a_7 300.1.1.1", "é9 8.", " ", "host [at] b (dot) io 99999999999999999999")]
    some += [atoms for atoms, _ in pii._examples(random.Random(8), 12)]
    for weights in (FIELD().weights, pii.Field(rng.normal(0, 0.5, FIELD().weights.shape)).weights):
        field = pii.Field(weights)
        for atoms in some:
            assert field.best(pii.Line([atoms])) == plain_best(atoms, weights)
        whole, begin = [], 0
        for atoms in some:  # islands on one line are as ones alone
            whole += [(a + begin, b + begin, k) for a, b, k in field.best(pii.Line([atoms]))]
            begin += len(atoms) + 1
        assert field.best(pii.Line(some)) == whole


def test_best_segmentation_beats_all_others():
    rng = np.random.default_rng(16)
    atoms = pii._ATOM.findall("at 1.2 b")
    for _ in range(5):
        field = pii.Field(rng.normal(0, 0.7, FIELD().weights.shape))
        found = plain_candidates(atoms, field.weights)

        @functools.cache
        def highest(k):
            return 0.0 if k == len(atoms) else max([highest(k + 1), *(s + highest(b) for (a, b, _), s in found.items() if a == k)])

        assert sum(found[x] for x in field.best(pii.Line([atoms]))) == pytest.approx(highest(0))


def test_field_likelihood_is_that_of_all_segmentations():
    weights = np.random.default_rng(6).normal(0, 0.5, (len(pii.KINDS), len(pii.FEATURES)))
    atoms = pii._ATOM.findall("at 1.2 b")
    found = plain_candidates(atoms, weights)
    total = collections.defaultdict(float)
    total[0] = 1.0
    for i in range(len(atoms)):
        total[i + 1] += total[i]
        for (a, b, _), s in found.items():
            if a == i:
                total[b] += total[i] * math.exp(s)
    gold = next(iter(found))
    line = pii.Line([atoms[:]])
    likely, grad = pii.likelihood(weights, line, {gold})
    assert likely == pytest.approx(found[gold] - math.log(total[len(atoms)]))
    for k, f in ((0, 0), (2, pii.FEATURES.index("year_like")), (3, pii.FEATURES.index("space_inside"))):  # the gradient is the slope
        up = weights.copy()
        up[k, f] += 1e-6
        assert (pii.likelihood(up, line, {gold})[0] - likely) / 1e-6 == pytest.approx(grad[k, f], abs=1e-4)


def plain_islands(text):
    """Every hint's stretch, whole words at both ends, united where they touch."""
    marks = set()
    for m in re.finditer(r"[0-9@+]|\b(?:dot\b|at\b[\])]?\s?[a-z0-9-]{1,63}\.[a-z])", text, re.IGNORECASE):
        lo, hi = max(0, m.start() - pii.MARGIN), min(len(text), m.end() + pii.MARGIN)
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        marks.add((lo, hi))
    out = []
    for lo, hi in sorted(marks):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def test_personal_data_rows_are_those_of_a_plain_version(spark, docs, texts):
    got = {r.doc_id: r for r in pii.find_personal_data(docs, field=FIELD()).collect()}
    more = 0
    for i, text in texts.items():
        base = [(k, *m.span()) for k, kind in enumerate(pii.KINDS) for m in pii.BASE[kind].finditer(text) if pii._valid(kind, m.group())]
        every = set(base)
        for lo, hi in plain_islands(text):
            atoms = pii._ATOM.findall(text[lo:hi])
            at = [lo, *accumulate(map(len, atoms), initial=lo)][1:]
            said = {x.lower() for x in atoms}
            if sum(x[0] in "0123456789" for x in atoms) >= 2 or said & {"@", "dot"} or {"at", "."} <= said:
                for a, b, label in plain_best(atoms, FIELD().weights):
                    if not any(x < at[b] and at[a] < y for _, x, y in base):
                        every.add((label - 1, at[a], at[b]))
        more += len(every) - len(base)
        name = lambda x: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(x))
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in range(4))
        assert (r.base, r.spans, r.n_spans) == (name(base), name(every), len(every))
    assert sum(r.n_spans for r in got.values()) > more


def test_splitting_tree_is_exact_and_fair(spark):
    quota = [40, 30, 20, 10, 0]
    leaves = mixing.splitting_tree(spark.createDataFrame([(quota,)], "b array<long>"), 3, 5).orderBy("shard").collect()
    assert [sum(x) for x in zip(*[r.b for r in leaves], strict=True)] == quota and {sum(r.b) for r in leaves} <= {12, 13}
    draw = mixing._hypergeometric("pop", "marked", "n", "u")
    got = {r.x: r["count"] / 4000 for r in spark.range(4000).selectExpr("30L pop", "12L marked", "10L n", "(id + 0.5D) / 4000 u").selectExpr(f"{draw} x").groupBy("x").count().collect()}
    for k in range(2, 8):
        assert got[k] == pytest.approx(math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10), abs=0.002)


def test_mixing_goes_by_the_tree(spark, docs, small, monkeypatch):
    """Pieces follow the leaves, and another tree gives other rows."""
    mine = {r.doc_id: r.places for r in mixing.op6_mixing(spark, small).collect()}
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, depth, seed: real(quotas, depth, seed + 1))
    other = {r.doc_id: r.places for r in mixing.op6_mixing(spark, small).collect()}
    assert sum(mine[i] != other[i] for i in mine) > len(mine) // 3
    monkeypatch.undo()
    order = []
    for r in mixing.mix(docs).collect():
        for k in {p["pass"] for p in r.pieces}:
            own = [p for p in r.pieces if p["pass"] == k]
            if 2 * sum(p.to_word - p.from_word for p in own) >= r.size:
                best = max(own, key=lambda p: (p.to_word - p.from_word, p.shard, p.order_key))
                order.append((best.shard, best.order_key, r.doc_id))
    parts = collections.defaultdict(list)
    for r in mixing.mixed_documents(docs).withColumn("part", F.spark_partition_id()).collect():
        parts[r.part].append(r.doc_id)
    assert sorted(i for p in parts.values() for i in p) == sorted(i for *_, i in order)
    places = collections.defaultdict(list)
    for s, o, i in sorted(order):
        places[i].append((s, o))
    for ids in parts.values():  # in each partition a walk through places in order meets every copy
        low = (-1, -1)
        for i in ids:
            low = min(x for x in places[i] if x >= low)


def test_mix_pieces_are_disjoint_and_meet_quotas(docs):
    out = mixing.mix(docs).cache()
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect():
        assert abs(r.t - r.g) <= 1 and r.t <= 3 * r.s
    assert out.filter("taken > 3 * size").isEmpty()
    pieces = out.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*").collect()
    held = collections.defaultdict(list)
    for p in pieces:
        held[p.doc_id, p["pass"]].append((p.from_word, p.to_word))
    assert all(a[1] <= b[0] for spans in held.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    loads = collections.Counter()
    for p in pieces:
        loads[p.shard] += p.to_word - p.from_word
    assert max(loads.values()) - min(loads.values()) <= 4 * mixing.BLOCK_WORDS * 20


def test_shards_split_hot_copies(spark):
    rows = [(i, "the same text " * 30) for i in range(400)] + [(1000 + i, f"text {i} " * (i % 50)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.assign_shards(df, n_shards=8).cache()
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * max(len(t) + 16 for _, t in rows)
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect():
        assert (r.lo, r.hi, r.d) == (0, r.n - 1, r.n)


@pytest.mark.parametrize("alike", [10_000, 5])
def test_rows_alike_take_consecutive_places(spark, monkeypatch, alike):
    monkeypatch.setattr(sharding, "MOST_ALIKE", alike)
    rows = [(7, "again and again")] * 300 + [(i, f"text {i}") for i in range(100)] * 2 + [(None, None)] * 9
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n_shards=8).collect()
    want = plain.sharded(rows, 8)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.size, r.shard, r.slot) for r in got), key=key) == sorted(((i, *rest) for i, _, *rest in want), key=key)


def test_overfull_ranges_are_cut_until_none_is_left(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_KEYS", 40)
    rows = [(i, f"text {i} " * (400 if i % 97 == 0 else 1)) for i in range(2000)] + [(5000, "x" * 300_000)]
    keys = spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), len(t) + 16, 1, len(t) + 16) for _, t in rows], "key string, size long, n long, bytes long")
    total = sum(len(t) + 16 for _, t in rows)
    bounds = sharding._bounds(keys, len(rows), total, 64, 2)  # samples so few that ranges turn out overfull
    held = keys.withColumn("rng", sharding.rank_in(bounds, F.col("key"))).groupBy("rng").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert bounds == sorted(set(bounds)) and all(r.n == 1 or (r.b <= 2 * total / 64 and r.n <= 2 * len(rows) / 64) for r in held)
    got = sorted((r.shard, r.slot, r.doc_id) for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4, ranges_per_shard=2).collect())
    assert got == sorted((shard, slot, i) for i, _, _, shard, slot in plain.sharded(rows, 4))


def test_licence_text_and_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    df = spark.createDataFrame([(1, mit), (2, "x MIT License y Apache license, MIT license"), (3, "Permission is granted to any person"), (4, "under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].labels == "mit-text" and got[1].n_base == 0 and got[1].score > 0.5
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 6, "apache,mit")
    assert got[3].labels == "" and got[4].labels == "cc-by-nc"


def test_licence_phrases_are_verified_word_for_word(spark):
    texts = ["redistribution license use in source license binary forms x the following conditions are met", "released foo bar mit license", "released under the mit license", "redistribution and use in source and binary forms the following conditions are met",
             "redistribution and use in source or binary forms the following conditions are met", "free of charge permission is hereby granted free of charge person obtaining a copy", "distribute this software for any purpose permission to use copy modify", "permission is hereby granted free of"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].labels for i in range(8)] == ["", "mit", "mit,mit-notice", "bsd", "", "mit-text", "", ""]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(range(8)), "text": texts}))
    sql = c.execute(licenses.ORACLE)
    names = [x[0] for x in sql.description]
    for r in sql.fetchall():
        assert r == tuple(got[r[0]][n] for n in names)
    phrases, scanned = licenses._phrases(licenses.TEMPLATES), {i: WORD.findall(t) for i, t in enumerate(texts)}
    for i, w in scanned.items():
        want = {(p.number, k) for p in phrases for k in range(len(w)) if tuple(w[k : k + len(p.text)]) == p.text}
        assert {(x.phrase, x.start) for x in got[i].places} == want


def test_secrets_link_parts(spark):
    key = "k" + "Ab3" * 14
    df = spark.createDataFrame([(1, f"id AKIA{'A' * 16} and {key}"), (2, key), (3, "password=abc password: 'abcdefg' " + "0f" * 14), (4, "client_id=4711 secret = hunter22 https://host.example/x")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert got[1].n_access == 1 and [x.kind for x in got[1].linked] == ["random"] and got[2].spans == ""
    assert (got[3].n_assign, got[3].n_hex) == (1, 1) and {x.kind for x in got[4].linked} == {"client", "endpoint"}


@pytest.mark.parametrize("text", ["a" * 10**6, "7" * 10**6, " ".join(str(7919 * i % 10**9) for i in range(100_000)), " ".join(f"{i:032x}" for i in range(30_000)), "password=abcdefg " * 50_000], ids=["letters", "digits", "numbers", "keys", "assignments"])
def test_long_runs_are_scanned_in_seconds(spark, text):
    began = time.monotonic()
    r = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.monotonic() - began < 20
    starts = [m.start() for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [x.start for x in r.parts if x.kind == "hex"] == starts and r.n_assign == text.count("password")


def test_long_secrets_reach_what_follows(spark):
    key = "Ab3x" * 250
    df = spark.createDataFrame([(1, f"token={key} https://host.example/x"), (2, f"{key} AKIA{'A' * 16}"), (3, f"secret={key} {'- ' * 150}https://host.example/x")], "doc_id long, text string")
    got = {r.doc_id: [x.kind for x in r.linked] for r in secrets.scan_secrets(df).collect()}
    assert got == {1: ["endpoint"], 2: ["random"], 3: []}


def test_toxicity_passes_over_documents_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 8000)
    monkeypatch.setattr(toxicity, "ROW_BYTES", 0)
    rows = [(i, "vile rotten words " * (1 if i % 4 else 400) if i % 2 else "calm plain words " * (1 if i % 4 else 400)) for i in range(1, 60)]
    long = [(i, t * 400 if i % 3 == 0 and len(t) < 40 else t) for i, t in rows]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample, totals: seen.append(sample))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in long], "doc_id long, toxic int")
    toxicity.learn(spark.createDataFrame(long, "doc_id long, text string"), labels)
    kept = {i for i, t in long if len(t) <= 4000 and zlib.crc32(str(i).encode()) % toxicity.FOLDS}
    assert sorted(y for _, y in seen[0]) == sorted(i % 2 for i in kept)
    toxicity.learn(spark.createDataFrame([(i, t * 400) for i, t in rows], "doc_id long, text string"), labels)
    assert sorted(y for _, y in seen[1]) == [0, 1] and sum(len(t) for t, _ in seen[1]) <= 8000
