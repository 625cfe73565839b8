"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from functools import cache, lru_cache
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import Chain, emissions, train, viterbi
from .common import over_batches

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does; saying so keeps long runs from being tried digit by digit.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

#: Labels of the chain: outside, or first and further words of a span of a kind.
LABELS = ["O"] + [f"{p}-{k}" for k in ("email", "ip", "card", "phone", "name", "id") for p in "BI"]
INDEX = {x: i for i, x in enumerate(LABELS)}
BUCKETS = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost first, found from each @.

    The part before an @ can't hold another, so all that precedes it back to a foreign character, or to the last match,
    belongs to the leftmost match; long words without an @ cost nothing.
    """
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans (start, end, kind), sorted by start, then by kind as listed."""
    found = []
    found += [(s, e, 0) for s, e in emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


#: Letters by case, digits and other non-ASCII bytes become one sign each; marks stay as they are.
SHAPE = bytes(0x58 if 0x41 <= c <= 0x5A else 0x78 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.S)
# Words that announce a span, titles, first names, and common words that start with a capital without being a name.
CUES = "name names mr mrs ms dr prof contact ssn passport iban phone tel call mobile fax email mail card visa ip address account social security number no id is my dear sincerely regards by signed licence license named called from at dot host server".split()
FIRST = "Anna Maria John Peter Laura Ahmed Wei Carlos Sofia Ivan Julia Marc Elena David Nina Paul".split()
COMMON = "the of and then was with into from here under water light some other people along great small time being where almost quiet early late strange weather nobody somebody department sales support office house garden river city street summer winter morning evening monday friday january march general public national open free new old first last next little good bad red blue green black white north south east west king queen lord lady".split()
#: What a word is in the lexicon: a class of its own for each cue, one each for first names and common words.
LEXICON = {w.lower(): "first" for w in FIRST} | {w: "common" for w in COMMON} | {w: f"cue:{w}" for w in CUES}


def _buckets(names: list[bytes]) -> list[int]:
    from zlib import crc32

    return [crc32(n) & (BUCKETS - 1) for n in names]


@lru_cache(1 << 16)
def shape_features(shape: bytes) -> tuple[int, ...]:
    """Features of a word's shape: collapsed runs, with digit counts, ends and marks. Shapes are few, so they are cached."""
    short = RUN.sub(rb"\1", shape)
    digits, names = shape.count(b"0"), [b"all", b"short:" + short[:12]]
    names += [b"digits:%d" % min(digits, 20), b"head:" + shape[:2], b"tail:" + shape[-2:]]
    names += [b"has:" + bytes([c]) for c in sorted(set(shape) - set(b"Xx0"))]
    if digits:
        names += [b"groups:" + b"-".join(b"%d" % min(len(g), 20) for g in re.findall(rb"0+", shape)[:6])]
    return tuple(sorted(set(_buckets(names))))


#: Byte tables: white space, small letters (0: no letter).
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SMALL = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint64)
SHAPES = np.frombuffer(SHAPE, np.uint8)
PRIME = np.uint64(0x9E3779B97F4A7C15)
STEP = 0x100000001B3


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(1, n), STEP, dtype=np.uint64))


def _cue_hash(word: bytes) -> int:
    return int((SMALL[np.frombuffer(word, np.uint8)] * PRIME * _powers(len(word))).sum(dtype=np.uint64))


CUE_NAMES = sorted((w.encode() for w in LEXICON), key=_cue_hash)
CUE_HASHES = np.array([_cue_hash(c) for c in CUE_NAMES], np.uint64)
CLASSES = sorted(set(LEXICON.values()))
CUE_CLASS = np.array([CLASSES.index(LEXICON[c.decode()]) + 1 for c in CUE_NAMES])


class Reader:
    """Turns texts into rows of distinct (shape, class) features, found by hashing all words of a batch in a few array steps.

    The class is that of the word's letters, marks after them left out, in ``LEXICON``. Rows are few; one reader serves a task.
    """

    def __init__(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.features: list[tuple[int, ...]] = []

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row, its line's number over all texts, and its text's number."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = ~BLANK[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        first, length = edge[::2], edge[1::2] - edge[::2]
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        chars = np.flatnonzero(inside)
        begin = np.cumsum(length) - length
        power = _powers(int(length.max()))[np.arange(len(chars)) - np.repeat(begin, length)]
        power *= PRIME
        bytes_ = raw[chars]
        shape = np.add.reduceat(SHAPES[bytes_] * power, begin)
        word = np.add.reduceat(SMALL[bytes_] * power, begin)
        at = np.minimum(np.searchsorted(CUE_HASHES, word), len(CUE_HASHES) - 1)
        cue = np.where(CUE_HASHES[at] == word, CUE_CLASS[at], 0)
        keys, one, back = np.unique(shape + cue.astype(np.uint64) * PRIME, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)
        rows = np.where(known, self.rows[where] if len(self.keys) else 0, -1)
        for i in np.flatnonzero(~known):
            k = one[i]
            rows[i] = len(self.features)
            name = _buckets([b"is:" + CLASSES[cue[k] - 1].encode()]) if cue[k] else []
            self.features.append((*shape_features(raw[first[k] : first[k] + length[k]].tobytes().translate(SHAPE)), *name))
        if not known.all():
            self.keys, self.rows = np.concatenate([self.keys, keys[~known]]), np.concatenate([self.rows, rows[~known]])
            order = np.argsort(self.keys)
            self.keys, self.rows = self.keys[order], self.rows[order]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return rows[back], np.searchsorted(np.flatnonzero(raw == 10), first), np.searchsorted(ends, first, side="right")


#: Syllables that invented names and words are made of, so that shapes and contexts are learned and no list of names.
SYLLABLES = [a + b for a in ("", "b", "ch", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "sh") for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "os")]


def labelled_table(rows: int = 5000, seed: int = 5, other: bool = False) -> list[list[tuple[str, str]]]:
    """A small labelled table: sentences of (word, label), filled in from patterns by a seeded rule.

    With ``other``, formats, cues and names are others: what a model of the first ones hasn't seen.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    made = lambda low, high: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(low, high))))
    upper = lambda n: "".join(chr(65 + int(x)) for x in rng.integers(0, 26, n))
    hexa = lambda n: "".join("0123456789abcdef"[int(x)] for x in rng.integers(0, 16, n))
    given = lambda: pick(FIRST) if rng.random() < 0.3 and not other else made(2, 4).capitalize()
    family = lambda: pick([made(2, 4).capitalize(), made(2, 4).capitalize(), f"{made(1, 3).capitalize()}-{made(1, 3).capitalize()}", f"O'{made(1, 3).capitalize()}", f"Mc{made(1, 3).capitalize()}"])

    def filler(n: int) -> list[tuple[str, str]]:
        words = []
        for _ in range(n):
            w = pick(CUES) if rng.random() < 0.1 else pick(COMMON) if rng.random() < 0.4 else made(1, 5)
            w = w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.03 else w
            w += pick(["", "", "", "", ",", ".", "###", "***", "&&&", "%%%", "$$$", "!!"] if rng.random() < 0.5 else [""])
            if rng.random() < 0.08:  # numbers, dates, prices, versions and marks that are nobody's
                w = pick([num(1), num(2), num(4), num(6), f"{num(1)}.{num(2)}", f"{num(2)}%", f"${num(3)}", f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(2)}:{num(2)}", f"({num(4)})", "|", num(9), num(40), "@" + w, w + "+", f"{upper(1)}{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)},{num(3)}", f"{num(3)}-{num(3)}"])
            words.append((w, "O"))
        return words

    def value(kind: str) -> str:
        if kind == "email":
            user, host = f"{made(1, 3)}.{made(1, 3)}", f"{made(2, 4)}.{pick(['com', 'org', 'net'])}"
            if other:
                return pick([f"{made(2, 4)}(at){host}", f"{made(1, 3)}é{made(1, 2)}@{host}", f"{made(2, 3)}@{made(1, 3)}ü{made(1, 2)}.de"])
            return pick([f"{user}@{host}", f"{made(2, 4)}{num(2)}@mail{num(1)}.example.org", f"{made(1, 3)}ü{made(1, 3)}@{host}", f"{made(2, 4)}@{made(1, 2)}é{made(1, 2)}.{pick(['com', 'fr'])}", f"{user}(at){host}", f"{user}[at]{host}"])
        if kind == "ip":
            long = ":".join(hexa(int(rng.integers(1, 5))) for _ in range(8))
            return pick([long, f"{hexa(4)}:{hexa(3)}::{hexa(1)}", f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}"]) if other else pick([".".join(str(x) for x in rng.integers(1, 256, 4)), long, f"{hexa(4)}:{hexa(4)}::{hexa(4)}:{hexa(1)}", f"2001:db8::{hexa(2)}"])
        if kind == "card":
            digits = num(15)
            digits += next(d for d in "0123456789" if luhn(digits + d))
            four = [digits[k : k + 4] for k in range(0, 16, 4)]
            return pick([".".join(four), "/".join(four)]) if other else pick(["".join(four), " ".join(four), "-".join(four), ".".join(four), "_".join(four)])
        if kind == "phone":
            if other:
                return pick([f"({num(3)}){num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(2)} {num(7)}", f"0{num(3)}/{num(7)}"])
            return pick([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)}-{num(3)}-{num(7)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(4)}.{num(4)}", f"0{num(2)}/{num(8)}", *[pick([" ", "-", ".", "/"]).join(num(int(n)) for n in rng.integers(2, 5, int(rng.integers(3, 5)))) + num(2)] * 3])
        if kind == "name":
            return pick([f"{given()} {family()}", f"{given()} {upper(1)}. {family()}"]) if other else pick([f"{given()} {family()}", f"{given()} {family()}", f"{given()} {upper(1)}. {family()}", f"{given()} {given()} {family()}", f"{given()} {pick(['van', 'de', 'von', 'di'])} {family()}"])
        if other:
            return pick([f"{upper(2)}{num(7)}", f"{num(8)}{upper(1)}", f"{num(2)}-{num(7)}", f"{upper(2)} {num(2)} {num(2)} {num(2)} {upper(1)}", f"IT{num(2)} {upper(1)}{num(3)} {num(4)} {num(4)} {num(4)}"])
        return pick([f"{num(3)}-{num(2)}-{num(4)}", f"{pick(['DE', 'FR', 'ES', 'IT', 'NL'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)}", f"{upper(1)}{num(7)}", f"{upper(1)}{num(8)}", num(9), f"{num(2)} {num(2)} {num(2)} {num(3)}", f"{upper(2)}{num(6)}{upper(1)}", f"{num(7)}{upper(1)}", f"{upper(1)}-{num(7)}", f"{upper(2)}{num(2)}{upper(4)}{num(14)}", *[upper(int(rng.integers(0, 3))) + num(int(rng.integers(5, 10))) + upper(int(rng.integers(0, 2))), " ".join([upper(2), *(num(int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 5))))]), f"{num(int(rng.integers(2, 4)))}-{num(int(rng.integers(4, 8)))}"] * 2])

    def span(kind: str) -> list[tuple[str, str]]:
        words = value(kind).split()
        words[-1] += pick(["", "", "", ",", ".", ";", ")"])
        return [(w, f"{'B' if i == 0 else 'I'}-{kind}") for i, w in enumerate(words)]

    cues = {"email": ["email:", "mail", "E-mail:", "write to", "contact"], "ip": ["IP", "address", "host", "server", "ip:"], "card": ["card", "Visa:", "card number"], "phone": ["Tel:", "call", "phone:", "mobile", "fax", "phone number is", "call me at"], "name": ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Name:", "Contact:", "my name is", "Dear", "Regards,", "Sincerely,", "signed by", "is called", "named"], "id": ["SSN", "IBAN:", "passport", "passport no.", "ID", "id number", "account", "licence", "social security number", "passport number is"]}
    if other:
        cues = {"email": ["mail:", "email is"], "ip": ["IP:", "IP address"], "card": ["Card:", "card no."], "phone": ["phone", "tel.", "mobile:"], "name": ["My name is", "Mr", "Name", "Signed,", "dear Mr."], "id": ["Passport:", "ID no.", "IBAN", "licence number"]}
    said = lambda w: pick([w, w, w.capitalize(), w.lower(), w.rstrip(":."), w.rstrip(":.") + ":"])
    cue = lambda kind: [(w, "O") for w in said(pick(cues[kind])).split()]
    table = []
    for _ in range(rows):
        kind = pick(["email", "ip", "card", "phone", "name", "name", "id", "id", "", "", "", "", ""])
        body = filler(int(rng.integers(0, 12)))
        if kind:
            # Names, ids and cards are spans after a cue alone; other kinds stand without one as well.
            lead = cue(kind) if other or kind in ("name", "id", "card") or rng.random() < 0.5 else []
            body += lead + span(kind)
        elif rng.random() < 0.7:  # capitals and codes without a cue are nobody's; nor are common words after one
            kind = pick(["name", "id", "card", "common", "cue", "ended", "ended"])
            if kind == "common":
                body += [(pick(["Mr.", "Dr.", "Dear", "Contact:", "Name:"]), "O"), *((pick(COMMON).capitalize(), "O") for _ in range(2))]
            elif kind == "cue":
                body += [*cue(pick(list(cues))), (made(1, 4), "O")]
            elif kind == "ended":  # a sentence ends between the cue and the capitals
                body += [(pick([w for w in CUES if len(w) > 3 or w in ("is", "by", "at", "my", "no")]) + pick([".", ".", "!", "###", "***", ","]), "O"), *((made(1, 4).capitalize() + pick(["", "", ".", ","]), "O") for _ in range(int(rng.integers(1, 4))))]
            else:
                body += [(w, "O") for w in value(kind).split()]
        table.append(body + filler(int(rng.integers(0, 8))))
    return table


#: Places of the words around whose features a word sees, and its own.
NEAR = (0, -1, 1, -2, 2)


def _flat(rows: np.ndarray, features: list[tuple[int, ...]], line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For training: each word's features, and apart from them those of its neighbours in the line."""
    flat, counts = [], []
    for i in range(len(rows)):
        own = [f + k * BUCKETS for k, d in enumerate(NEAR) if 0 <= i + d < len(rows) and line[i + d] == line[i] for f in features[rows[i + d]]]
        flat += own
        counts.append(len(own))
    return np.array(flat, np.int64), np.array(counts, np.int64)


@cache
def model() -> Chain:
    """The chain, trained on the labelled table; some seconds, on the driver."""
    table, reader, data = labelled_table(), Reader(), []
    for i in range(0, len(table), 200):
        part = table[i : i + 200]
        rows, line, _ = reader.read([" ".join(w for w, _ in row).encode() for row in part])
        gold = np.array([INDEX[x] for row in part for _, x in row])
        lengths = np.bincount(line)
        data.append((*_flat(rows, reader.features, line), lengths[lengths > 0], gold))
    return train(data, len(NEAR) * BUCKETS, len(LABELS), rounds=10, rate=0.3, seed=3)


def _shifted(line: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that have a word ``d`` further on in their line, and the places of these."""
    k = abs(d)
    first = np.flatnonzero(line[k:] == line[:-k]) if k < len(line) else np.zeros(0, np.int64)
    return (first, first + k) if d > 0 else (first + k, first)


class Tagger:
    """Viterbi over lines. Lines that can't but be all outside are left out, by an exact bound.

    If each word's score for O beats its other labels by more than any step between labels can win over O to O,
    then no path beats the one that stays outside.
    """

    def __init__(self, chain: Chain) -> None:
        self.chain, self.reader, self.done = chain, Reader(), 0
        self.slack = float(max(chain.move.max() - chain.move[0, 0], 0) + max(chain.start.max() - chain.start[0], 0))

    def _tables(self) -> None:
        """Scores of each distinct row as seen from each of the places around it."""
        features = self.reader.features
        if self.done < len(features):
            flat, sizes = np.concatenate([np.array(f, np.int64) for f in features]), np.array([len(f) for f in features])
            emit = self.chain.emit.reshape(len(NEAR), BUCKETS, -1)
            self.tables = [emissions(Chain(self.chain.start, self.chain.move, emit[k]), flat, sizes) for k in range(len(NEAR))]
            self.margins = [t[:, 0] - t[:, 1:].max(axis=1) for t in self.tables]
            self.done = len(features)

    def tag(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Labels by word, for those texts that have a label other than O."""
        rows, line, text = self.reader.read(texts)
        if not len(rows):
            return {}
        self._tables()
        margin = self.margins[0][rows]
        for k, d in enumerate(NEAR[1:], 1):
            here, there = _shifted(line, d)
            margin[here] += self.margins[k][rows[there]]
        open_ = np.zeros(int(line[-1]) + 1, bool)
        open_[line[margin <= self.slack]] = True
        some = np.flatnonzero(open_[line])
        if not len(some):
            return {}
        at, near = rows[some], line[some]
        scores = self.tables[0][at]
        for k, d in enumerate(NEAR[1:], 1):
            here, there = _shifted(near, d)
            scores[here] += self.tables[k][at[there]]
        labels = np.zeros(len(rows), np.int8)
        labels[some] = viterbi(scores, np.unique(near, return_counts=True)[1], self.chain)
        size = np.bincount(text, minlength=len(texts))
        begin = np.cumsum(size) - size
        return {int(k): labels[begin[k] : begin[k] + size[k]] for k in np.unique(text[labels > 0])}


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """A span without marks at its ends; a bracket stays if its other half is within."""
    while e > s and (text[e - 1] in ".,;:!?\"'|#*$%&" or (text[e - 1] == ")" and "(" not in text[s:e])):
        e -= 1
    while s < e and (text[s] in "\"'|#*$%&" or (text[s] == "(" and ")" not in text[s:e])):
        s += 1
    return s, e


def learned_spans(text: str, labels: np.ndarray | None, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of runs of labels that no fixed pattern's span touches and whose value can be what they say, without marks at their ends."""
    if labels is None:
        return []
    words, found, i = [m.span() for m in WORDS.finditer(text)], [], 0
    for i in np.flatnonzero(np.asarray(labels) % 2 == 1).tolist():  # a B of any kind begins a span
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        s, e = trimmed(text, words[i][0], words[j - 1][1])
        kind = LABELS[labels[i]][2:]
        if e > s and valid(kind, text[s:e]):
            found.append((s, e, kind))
    spans, at, reach = [], 0, -1
    for s, e, kind in found:  # both lists are sorted by start
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= s:
            spans.append((s, e, kind))
    return spans


# Words within names that start small.
PARTICLES = frozenset("van von de der den di da del la le".split())


def valid(kind: str, value: str) -> bool:
    """Whether a value can be of a kind at all: check digits of cards, form of addresses, digits of numbers."""
    digits = NO_DIGIT.sub("", value)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        try:
            return bool(ip_address(value))
        except ValueError:
            return False
    if kind == "email":
        return bool(re.search(r"[^@]@[^@]+\.|[(\[]at[)\]]", value))
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "id":
        return len(digits) >= 5
    words = value.split()
    bare = [w for w in words if w.rstrip(",") not in PARTICLES]
    return not digits and 2 <= len(words) <= 6 and 2 <= len(set(bare)) == len(bare) and all(w[0].isupper() and (w[-1].isalpha() or len(w) == 2) for w in bare)


def find_personal(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs`` (doc_id, text): arrays of (start, end, kind) in code points.

    ``base`` holds the fixed patterns' spans, ``spans`` these and the chain's. Null and empty texts
    have none; texts of any length are read whole, in runs of lines. Repeated rows are each read, and have the same spans; ids may be null
    or repeat. An empty table gives no rows.
    """
    chain = docs.sparkSession.sparkContext.broadcast(model())

    def make():
        tagger = Tagger(chain.value)

        def apply(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            labels = tagger.tag([t.encode("utf-8", "surrogatepass") for t in texts])
            base = [base_spans(t) for t in texts]
            more = [learned_spans(t, y, b) for t, y, b in zip(texts, map(labels.get, range(len(texts))), base, strict=True)]
            as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
            rank = {k: i for i, k in enumerate([*KINDS, "name", "id"])}
            both = [sorted(b + m, key=lambda x: (x[0], rank[x[2]])) for b, m in zip(base, more, strict=True)]
            return {"doc_id": batch.column(0), "base": [as_rows(b) for b in base], "spans": [as_rows(x) for x in both]}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start: int, end: int, kind: string>>"
    return over_batches(docs.select("doc_id", "text"), f"doc_id {kind}, base {spans}, spans {spans}", "text", make, 1 << 20)


def joined(spans: str):
    """An array of spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
