"""Op 9, semi-Markov conditional random field: personal data.

A text's islands, stretches around digits, at signs, plus signs and spelled dots, are cut into atoms. A segment is
a run of up to MOST_ATOMS atoms with a label; its score is a weighted sum of features of the whole
span (shape, digits, checksums, separators, the words beside it) and of its label, and a dynamic
programme over boundaries and labels finds the best segmentation. The weights maximise the
conditional likelihood of generated, labelled islands, with the same programme summing over all
segmentations. Exact matches of the base patterns are reported as they are; the field adds spans in
forms that those do not cover.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .textnum import slices

KINDS = ("email", "ip", "card", "phone")
# The contract's base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The address pattern in one pass: from the beginning of a run of digits, where the leftmost match begins.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
#: A host's label has 63 characters at most.
_DIGIT, _HINT = re.compile("[0-9]"), re.compile(r"[0-9@+]+|\b(?:dot\b|at\b[\])]?\s?[a-z0-9-]{1,63}\.[a-z])", re.IGNORECASE)
LABELS = ("other", *KINDS)
#: "first.last [at] host [dot] co [dot] uk" has 21; two more spelled dots still fit.
MOST_ATOMS = 32
#: Code points of context on either side of a hint.
MARGIN = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))
    if kind == "card":
        digits = match.replace(" ", "").replace("-", "")
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= sum(c.isascii() and c.isdigit() for c in match) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern's matches, from the at signs: a match begins with the run before one."""
    begin, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > begin and (c := text[low - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at)):
            yield low, m.end()
            begin = m.end()
        at = text.find("@", max(at + 1, begin))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, kind in enumerate(KINDS[1:], 1):
            if (kind == "ip" and "." not in text) or (kind == "phone" and "+" not in text):
                continue
            found += [(k, *m.span()) for m in (_IP if kind == "ip" else BASE[kind]).finditer(text) if _valid(kind, m.group())]
    return found


_ATOM = re.compile(r"[A-Za-z\x80-\U0010FFFF]+|[0-9]+|[^A-Za-z0-9\x80-\U0010FFFF]")
#: A whole address with its at sign spelled, and the most code points an address may have.
_SPELLED = re.compile(r"[a-z0-9_%+-]+(?:\.[a-z0-9_%+-]+)*(?: at | ?[\[(] ?at ?[\])] ?)[a-z0-9-]+(?:(?:\.| dot | ?[\[(] ?dot ?[\])] ?)[a-z0-9-]+)+", re.IGNORECASE)
LONGEST_ADDRESS = 320
_CUES = {"email": ("email", "mail", "contact"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "fax", "mobile")}
#: Atoms before a span in which a cue counts.
CUE_REACH = 6
_TOP = frozenset("com org net edu de fr es io info example".split())
#: Of a span; the last two differ by label: a cue of its kind, or of another, stands before.
FEATURES = (
    "bias", "luhn", "digits_13_19", "digits_9_15", "digits_7_8", "year_like", "long_run", "four_octets", "octets_bad", "decimal", "grouped_3", "grouped_4", "at_inside", "spelled_at", "spelled_form", "dot_top",
    "plus_first", "punctuation_first", "punctuation_last", "paren", "one_atom", "only_digits", "has_letters", "space_inside", "spaces_4", "spaces_more", "alnum_beside", "cue_before", "other_cue",
)
SHARED = len(FEATURES) - 2
#: Starts whose spans are scored together.
STARTS = 4096
#: Attributes of an atom: digits, whether they make an octet, checksum sums of them with those at even
#: and at odd places doubled, then what kind of atom it is.
_ATTRIBUTES = ("digits", "octet", "even", "odd", "digit", "letter", "space", "newline", "at_sign", "at_word", "dot", "dot_word", "top", "open", "close", "bracket", "plus", "ends", "joins", *(f"cue_{k}" for k in KINDS))


def _attributes(x: str) -> tuple[int, ...]:
    digit, low = x[0] in "0123456789", x.lower()
    letter = x[0].isascii() and x[0].isalpha() or x[0] > "\x7f"
    doubled = [[int(c) * (1 + (i % 2 == parity)) for i, c in enumerate(x)] if digit and len(x) <= 19 else [] for parity in (0, 1)]
    even, odd = (sum(d - 9 * (d > 9) for d in own) for own in doubled)
    return tuple(int(v) for v in (
        len(x) if digit else 0, digit and int(x[:4]) <= 255, even, odd, digit, letter, x.isspace(), x == "\n", x == "@", low == "at", x == ".", low == "dot", low in _TOP, x == "(", x == ")", x in "[(", x == "+",
        x in ".,;:!?-/", x in "._-@", *(low in _CUES[k] for k in KINDS)))


class _Known(dict):
    """Attributes of atoms that have been met; begun anew when there are many."""

    MOST = 100_000

    def __missing__(self, x: str) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        self[x] = _attributes(x) if x else (0,) * 7 + (1,) + (0,) * (len(_ATTRIBUTES) - 8)
        return self[x]


_KNOWN = _Known()


class Line:
    """Atoms of several islands one after the other, each followed by an empty one that no span holds."""

    def __init__(self, islands: list[list[str]]) -> None:
        self.atoms = [x for island in islands for x in (*island, "")]
        number = {x: k for k, x in enumerate(dict.fromkeys(self.atoms))}
        table = np.array([_KNOWN[x] for x in number], np.int32)
        number = np.fromiter(map(number.__getitem__, self.atoms), np.int64, len(self.atoms))
        self.is_ = {name: table[number, k] for k, name in enumerate(_ATTRIBUTES)}
        n, of = len(self.atoms), self.is_
        upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        of["short"], of["four"] = (of["digits"] >= 2) & (of["digits"] <= 4), of["digits"] == 4
        of["long"] = of["digits"] > 19
        self.upto = {name: upto(of[name]) for name in ("digits", "digit", "letter", "space", "at_sign", "at_word", "dot", "dot_word", "open", "close", "bracket", "short", "four", "long")}
        # checksum sums along the line, doubling digits at even or at odd places of it
        swap = self.upto["digits"][:-1] % 2 == 1
        self.doubled = upto(np.where(swap, of["odd"], of["even"])), upto(np.where(swap, of["even"], of["odd"]))
        places = np.arange(n)
        self.limit = np.minimum.accumulate(np.where(of["newline"] == 1, places, n)[::-1])[::-1]  # the next barrier
        self.last_digit = np.maximum.accumulate(np.where(of["digit"] == 1, places, -1))
        last = np.maximum.accumulate(np.where(of["newline"] == 1, places, -1))
        reach = np.maximum(places - CUE_REACH, last + 1)
        self.cued = np.stack([(c := upto(of[f"cue_{k}"]))[places] - c[np.minimum(reach, places)] > 0 for k in KINDS])

    def spans(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of all spans that could be an entity and begin in lo to hi, by start, then
        end: bounded in atoms, with a digit, an at sign or the word, and no white space at either end."""
        a = np.flatnonzero((self.is_["space"][lo:hi] == 0) & (self.is_["newline"][lo:hi] == 0)) + lo
        b = a[:, None] + np.arange(1, MOST_ATOMS + 1)
        inside = b <= self.limit[a][:, None]
        b = np.where(inside, b, a[:, None] + 1)
        some = sum(self.upto[k][b] - self.upto[k][a][:, None] for k in ("digit", "at_sign", "at_word")) > 0
        row, column = np.nonzero(inside & some & (self.is_["space"][b - 1] == 0))
        return a[row], b[row, column]

    def features(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(SHARED, spans): which of the features that all labels share hold for each span."""
        of = self.is_
        count = lambda k: self.upto[k][b] - self.upto[k][a]
        within = lambda k: np.where(b - a > 2, self.upto[k][b - 1] - self.upto[k][np.minimum(a + 1, b - 1)], 0) > 0
        n, runs, letters, spaces, dots = count("digits"), count("digit"), count("letter") > 0, count("space"), count("dot")
        alone = (b - a == 1)
        parity = self.upto["digits"][b] % 2
        total = np.where(parity == 0, self.doubled[0][b] - self.doubled[0][a], self.doubled[1][b] - self.doubled[1][a])
        octets = (b - a == 7) & (runs == 4) & (dots == 3)
        for k in range(0, 7, 2):
            octets &= of["digit"][np.minimum(a + k, len(self.atoms) - 1)] == 1
        fits = octets.copy()
        for k in range(0, 7, 2):
            fits &= of["octet"][np.minimum(a + k, len(self.atoms) - 1)] == 1
        final = np.maximum(self.last_digit[b - 1], a)
        but_last = self.upto["four"][final] - self.upto["four"][a]
        spelled_at = within("at_word") & (within("dot_word") | within("dot"))
        first, last = a, b - 1
        alnum = (of["digit"] == 1) | (of["letter"] == 1)
        before, after = np.maximum(a - 1, 0), np.minimum(b, len(self.atoms) - 1)
        beside = alnum[first] & ((a > 0) & (alnum[before] | (of["joins"][before] == 1))) | alnum[last] & (b < len(self.atoms)) & alnum[after]
        top = of["top"][last] == 1
        spelled = np.zeros(len(a), bool)
        for k in np.flatnonzero(spelled_at & (top | (count("bracket") > 0))).tolist():
            span = "".join(self.atoms[a[k] : b[k]])
            spelled[k] = len(span) <= LONGEST_ADDRESS and _SPELLED.fullmatch(span) is not None
        held = {
            "bias": np.ones(len(a), bool), "luhn": ~letters & (n >= 13) & (n <= 19) & (total % 10 == 0), "digits_13_19": (n >= 13) & (n <= 19), "digits_9_15": (n >= 9) & (n <= 15), "digits_7_8": (n >= 7) & (n <= 8), "year_like": n <= 4, "long_run": n > 19,
            "four_octets": fits, "octets_bad": octets & ~fits, "decimal": (runs == 2) & (dots > 0), "grouped_3": (runs >= 3) & (count("short") == runs), "grouped_4": (runs >= 3) & (but_last == runs - 1),
            "at_inside": within("at_sign"), "spelled_at": spelled_at, "spelled_form": spelled, "dot_top": top,
            "plus_first": of["plus"][first] == 1, "punctuation_first": ~alnum[first] & (of["plus"][first] == 0) & (of["open"][first] == 0), "punctuation_last": of["ends"][last] == 1, "paren": (count("open") > 0) & (count("close") > 0),
            "one_atom": alone, "only_digits": alone & (n > 0), "has_letters": letters, "space_inside": spaces > 0, "spaces_4": spaces == 4, "spaces_more": spaces > 4, "alnum_beside": beside,
        }
        return np.stack([held[k] for k in FEATURES[:SHARED]])

    def cues(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, spans): whether a cue of the label's kind stands before a span, and one of another."""
        own = self.cued[:, a]
        return own, (own.sum(axis=0) - own) > 0


def scores(weights: np.ndarray, shared: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(labels, spans)."""
    return weights[:, :SHARED] @ shared + weights[:, SHARED, None] * own + weights[:, SHARED + 1, None] * other


class Field:
    """weights: a row of feature weights for every label but 'other', whose one-atom segments score 0.

    They are multiples of 2**-10, so sums of them are exact in any order and on any machine."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = np.round(weights * 1024) / 1024

    def best(self, line: Line) -> list[tuple[int, int, int]]:
        """The entities of the highest-scoring segmentation: (start, end, label), in atoms.

        Only spans that score above nought can be in it. Taken by their end, each either extends the
        best segmentation of what lies before its start or is left out. Of equal ones the one whose last
        entity ends first wins, then the longer entity, then the first label."""
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for lo in range(0, len(line.atoms), STARTS):
            a, b = line.spans(lo, min(lo + STARTS, len(line.atoms)))
            if len(a):
                s = scores(self.weights, line.features(a, b).astype(np.float64), *line.cues(a))
                label, top = s.argmax(axis=0), s.max(axis=0)
                good = top > 0
                for column, value in zip(parts, (a, b, label + 1, top), strict=True):
                    column.append(value[good])
        if not parts[0]:
            return []
        a, b, label, score = (np.concatenate(x) for x in parts)
        order = np.lexsort((a, b))
        a, b, label, score = (x[order] for x in (a, b, label, score))
        free = np.searchsorted(b, a, "right").tolist()  # how many spans end before this one begins
        best, taken = [0.0], []
        for k, (before, own) in enumerate(zip(free, score.tolist(), strict=True)):
            taken.append(best[before] + own > best[k])
            best.append(best[before] + own if taken[k] else best[k])
        out, k = [], len(taken)
        while k > 0:
            if taken[k - 1]:
                out.append((int(a[k - 1]), int(b[k - 1]), int(label[k - 1])))
                k = free[k - 1]
            else:
                k -= 1
        return out[::-1]


def likelihood(weights: np.ndarray, line: Line, gold: set[tuple[int, int, int]]) -> tuple[float, np.ndarray]:
    """Log likelihood of the gold entities among all segmentations of a line, and its gradient, by sums
    over segmentations from either end."""
    n = len(line.atoms)
    a, b = line.spans(0, n)
    shared, (own, other) = line.features(a, b).astype(np.float64), line.cues(a)
    s = scores(weights, shared, own, other)
    each = np.exp(s)
    step = np.zeros((n + 1, n + 1))
    step[a, b] = each.sum(axis=0)
    forward, backward = np.ones(n + 1), np.ones(n + 1)
    for k in range(1, n + 1):
        forward[k] = forward[k - 1] + forward[:k] @ step[:k, k]
    for k in range(n - 1, -1, -1):
        backward[k] = backward[k + 1] + step[k, k + 1 :] @ backward[k + 1 :]
    off = -each * (forward[a] * backward[b] / forward[n])
    place = {ab: k for k, ab in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
    likely = -np.log(forward[n])
    for x, y, label in gold:
        off[label - 1, place[x, y]] += 1
        likely += s[label - 1, place[x, y]]
    return float(likely), np.concatenate([off @ shared.T, (off * own).sum(axis=1)[:, None], (off * other).sum(axis=1)[:, None]], axis=1)


def _examples(rng: random.Random, n: int) -> Iterator[tuple[list[str], set[tuple[int, int, int]]]]:
    """Generated islands: entities and look-alikes between invented words."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "the", "and", "ti", "en", "ou", "é", "la", "ch")) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))))

    def phone() -> str:
        return rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}"))

    def email() -> str:
        name, host, top = word().replace("é", "e"), word().replace("é", "e"), rng.choice(("com", "org", "net", "de"))
        return rng.choice((f"{name}.{digits(2)}@{host}.{top}", f"{name}@{host}.{top}", f"{name} at {host} dot {top}", f"{name} [at] {host} [dot] {top}", f"{name}.{word().replace('é', 'e')} [at] {host} [dot] co [dot] uk", f"{name} at {host}.{top}"))

    make = {"email": email, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    other = (
        lambda: digits(rng.randint(1, 5)), lambda: str(rng.randint(1900, 2035)), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{digits(1)},{digits(3)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: digits(rng.choice((6, 8, 9, 10, 11, 12, 20, 24))),
        lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()}.{word()}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(3)}.{rng.randint(256, 999)}.{digits(2)}.{digits(3)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{digits(1)}+{digits(1)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: "".join(d for d in digits(16) if d) if rng.random() < 0.5 else f"#{digits(7)}",
    )
    for _ in range(n):
        atoms: list[str] = []
        gold: set[tuple[int, int, int]] = set()
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 3)):
                atoms += [*_ATOM.findall(word()), " "]
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                if rng.random() < 0.25:
                    atoms += [rng.choice(_CUES[kind]), *rng.choice(([" "], [":", " "]))]
                own = _ATOM.findall(make[kind]())
                if len(own) > MOST_ATOMS:
                    raise ValueError(f"no segment holds {''.join(own)!r}: {len(own)} atoms")
                gold.add((len(atoms), len(atoms) + len(own), LABELS.index(kind)))
                atoms += own
            else:
                own = _ATOM.findall(rng.choice(other)())
                span = "".join(own)
                if not any(BASE[k].fullmatch(span) and _valid(k, span) for k in KINDS):
                    atoms += own
            atoms += rng.choice(([" "], [".", " "], [",", " "]))
        atoms += _ATOM.findall(word())
        yield atoms, gold


def train_field(n: int = 300, rounds: int = 8, seed: int = 9) -> Field:
    """Stochastic gradient ascent with a small ridge on generated islands; the same every time."""
    rng = random.Random(seed)
    weights = np.zeros((len(KINDS), len(FEATURES)))
    examples = [(Line([atoms]), gold) for atoms, gold in _examples(rng, n)]
    squares = np.full_like(weights, 1e-3)
    for _ in range(rounds):
        rng.shuffle(examples)
        for line, gold in examples:
            grad = likelihood(weights, line, gold)[1] - 1e-3 * weights
            squares += grad * grad
            weights += 0.5 * grad / np.sqrt(squares)
    return Field(weights)


def _islands(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches with hints, margins included; ones that touch are one, however long, and
    words at either end are whole."""
    begin = end = -1
    for m in _HINT.finditer(text):
        if m.end() + MARGIN <= end:
            continue
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while lo > max(end, 0) and not text[lo - 1].isspace():  # no word is cut
            lo -= 1
        if hi <= end:
            continue
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if begin >= 0 and lo <= end:
            end = hi
            continue
        if begin >= 0:
            yield begin, end
        begin, end = lo, hi
    if begin >= 0:
        yield begin, end


def field_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the field's entities that touch no base match."""
    islands, where = [], []
    for k, text in enumerate(texts):
        for begin, end in _islands(text):
            atoms = _ATOM.findall(text[begin:end])
            said = {x.lower() for x in set(atoms)}
            if sum(x[0] in "0123456789" for x in atoms) < 2 and said.isdisjoint(("@", "dot")) and not {"at", "."} <= said:
                continue  # too little for any kind
            islands.append(atoms)
            where.append((k, begin))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not islands:
        return found
    line = Line(islands)
    at = np.concatenate([[0], np.cumsum([len(x) for x in line.atoms])]).tolist()
    firsts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in islands])]).tolist()
    taken = []
    for own in base:
        spans = sorted((a, b) for _, a, b in own)
        taken.append(([a for a, _ in spans], list(accumulate((b for _, b in spans), max))))
    for a, b, label in field.best(line):
        i = bisect_right(firsts, a) - 1
        k, begin = where[i]
        lo, hi = (at[x] - at[firsts[i]] + begin for x in (a, b))
        starts, ends = taken[k]
        before = bisect_left(starts, hi)  # base matches that begin before this one's end
        if not before or ends[before - 1] <= lo:
            found[k].append((label - 1, lo, hi))
    return [sorted(x) for x in found]


OUTPUT = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long"


def find_personal_data(df: DataFrame, text: str = "text", doc_id: str = "doc_id", field: Field | None = None) -> DataFrame:
    """One row a row of df: its id, the counts of base matches, base and spans as kind:start:end by
    kind and start (code points, end exclusive), and the number of spans.

    A null or empty text has none; a text of any length is read whole, in time that follows its
    length; repeated rows give repeated results, an empty table an empty one; of equal segmentations
    the one that Field.best names is taken; other columns of df are not read, whatever their names."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(field or train_field())  # some hundred weights
    rows = df.select(F.col(text).alias("_text"), F.col(doc_id).alias("id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            for row, end, body, offsets in slices(batch.column(0)):
                texts = [body[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                base = [base_spans(t) for t in texts]
                every = [sorted({*x, *y}) for x, y in zip(base, field_spans(sent.value, texts, base), strict=True)]
                counts = [pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in range(len(KINDS))]
                arrays = [*counts, pa.array(map(said, base), pa.string()), pa.array(map(said, every), pa.string()), pa.array(map(len, every), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), *arrays], ["id", *(x.split(" ")[0] for x in OUTPUT.split(", "))])

    schema = rows.select("id").schema
    for part in OUTPUT.split(", "):
        schema = schema.add(*part.split(" "))
    return rows.mapInArrow(work, schema).withColumnRenamed("id", doc_id)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")
