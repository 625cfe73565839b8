"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

KINDS = ["assign", "access", "hex", "learned"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the network looks at besides the fixed patterns' spans: runs of twelve token characters or more with a digit and a
#: letter, or with a capital after a small letter. No part of it goes back, so long runs cost their length.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])|(?=[A-Z0-9+/_-]*+[a-z][a-z0-9+/_-]*+[A-Z]))[A-Za-z0-9+/_-]{12,}+={0,2}")
#: Candidates of a form of their own: signed tokens of three parts, private keys between their lines, passwords within addresses.
SIGNED = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)?")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-----END [A-Z0-9 ]{0,40}-----)?")
ADDRESS = re.compile(r"://[^\s/:@\"'<>]{1,64}:([^\s/@\"'<>]{4,128})@")
#: Words that names in programs are made of; a learned scan must leave such names alone.
NAMED = "account action active add address after all api app array async auth background base before block body buffer build button by byte cache call camel case change char check class clear click client close code collection column command common component config connection constant container content context controller copy count create current custom data database date default delete description detail device dialog disable document double download element email enable end entity entry error event execute export factory field file filter find first flag float folder format form frame from function get global graph group handle handler has header height helper here history host html id identifier image import in index info init inner input insert instance int interface internal invoice is item iterator job json key label language last layer layout length level limit line link list listener load local location log login main manager map mapping max member memory menu message method metric min mode model module month move name network new next node not null number object of on open operation option order out output page panel parameter parent parse part path pattern payment percent permission phone pixel player point position post prefix previous print process product profile project property provider public query queue random range read record reference remove render report request required reset resource response result return role root row rule run sample save scale schema screen search section select send sequence server service session set setting shape show size sort source space stack start state status step stop store stream string style submit suffix summary switch system tab table tag target task template test text thread time timeout title to toggle total transaction tree type undo unit update upload url use user util valid validate value vector version view visible wait warning width window with word work wrapper write year zone".split()
HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans (start, end, kind), by start, then by kind as listed."""
    found = []
    lower = text.lower() if not text.islower() else text
    if any(h in lower for h in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


#: Characters by class: the net tells letters and digits apart, other marks by themselves, the rest as one.
ALPHABET = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:\"' \n@#$%&*|()<>,;!?{}[]\\")}
LEFT, INSIDE, RIGHT = 24, 48, 8
WIDTH, SIZE, FILTERS, HIDDEN = 5, 10, 24, 16


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate, or of a window in it, between its contexts. Of one longer than INSIDE both ends are shown to the net."""
    body = text[start:end]
    if len(body) > INSIDE:
        body = body[: INSIDE // 2] + body[-INSIDE // 2 :]
    pieces = (text[max(0, start - LEFT) : start].rjust(LEFT, "\0"), body.ljust(INSIDE, "\0"), text[end : end + RIGHT].ljust(RIGHT, "\0"))
    return np.array([ALPHABET.get(c, 0 if c == "\0" else 1) for c in "".join(pieces)], dtype=np.int64)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Windows over a whole candidate: of INSIDE characters, each half over the last; a shorter one is its own."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(k, k + INSIDE) for k in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


LENGTH = LEFT + INSIDE + RIGHT
ZONE = np.repeat(np.array([0, 1, 2]), [LEFT, INSIDE, RIGHT])


@dataclass
class Net:
    """Embedding of characters, a convolution, the maximum and mean over the candidate's and the contexts' places, two dense layers."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5,) * 8

    def forward(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        seen = w["embed"][codes]
        padded = np.pad(seen, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        wide = np.concatenate([padded[:, k : k + LENGTH] for k in range(WIDTH)], axis=2)
        maps = np.maximum(wide @ w["conv"] + w["bias"], 0)
        live = (codes != 0).astype(np.float32)
        tops, pools = [], []
        for zone in (ZONE == 1, ZONE != 1):
            part = maps[:, zone] * live[:, zone, None]
            tops.append(part.argmax(axis=1))
            pools += [part.max(axis=1), part.sum(axis=1) / np.maximum(1, live[:, zone].sum(axis=1, keepdims=True))]
        pooled = np.concatenate(pools, axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        return {"seen": seen, "wide": wide, "maps": maps, "live": live, "tops": tops, "pooled": pooled, "hidden": hidden, "logit": hidden @ w["out"] + w["out_bias"]}

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.forward(codes)["logit"] + self.shift)))

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(codes)
        wrong = (1 / (1 + np.exp(-f["logit"])) - gold) / len(gold)
        g = {"out": f["hidden"].T @ wrong, "out_bias": wrong.sum(keepdims=True)}
        hidden = np.outer(wrong, w["out"]) * (f["hidden"] > 0)
        g |= {"dense": f["pooled"].T @ hidden, "dense_bias": hidden.sum(axis=0)}
        pooled = hidden @ w["dense"].T
        maps = np.zeros_like(f["maps"])
        rows, cols = np.arange(len(codes))[:, None], np.arange(FILTERS)[None]
        for k, zone in enumerate((ZONE == 1, ZONE != 1)):
            places = np.flatnonzero(zone)
            top, mean = pooled[:, 2 * k * FILTERS : (2 * k + 1) * FILTERS], pooled[:, (2 * k + 1) * FILTERS : (2 * k + 2) * FILTERS]
            maps[rows, places[f["tops"][k]], cols] += top
            maps[:, places] += mean[:, None] / np.maximum(1, f["live"][:, places].sum(axis=1))[:, None, None]
        maps *= (f["maps"] > 0) * f["live"][:, :, None]
        g |= {"conv": np.tensordot(f["wide"], maps, ([0, 1], [0, 1])), "bias": maps.sum(axis=(0, 1))}
        wide, seen = maps @ w["conv"].T, np.zeros((len(codes), LENGTH + WIDTH - 1, SIZE), np.float32)
        for k in range(WIDTH):
            seen[:, k : k + LENGTH] += wide[:, :, k * SIZE : (k + 1) * SIZE]
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], codes, seen[:, WIDTH // 2 : WIDTH // 2 + LENGTH])
        return g


def candidates(text: str) -> list[tuple[int, int]]:
    """What the network judges besides the fixed patterns' spans, by start: candidates of a form of their own, and runs that touch none of them."""
    own = [m.span() for m in SIGNED.finditer(text)] if "eyJ" in text else []
    own += [m.span() for m in KEY_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    own += [m.span(1) for m in ADDRESS.finditer(text)] if "://" in text else []
    own.sort()
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    return sorted(own + [r for r, taken in zip(runs, touching(runs, own), strict=True) if not taken])


#: The highest threshold.
SURE = 0.95
#: What a candidate is made of; each kind has a threshold of its own.
MADE_OF = ["hex", "alphanumeric", "joined", "base64", "path", "signed", "key block", "address"]


def kind_at(text: str, start: int, end: int) -> int:
    """The kind of a candidate where it stands."""
    value = text[start:end]
    if value.startswith("-----BEGIN"):
        return 6
    if value.startswith("eyJ") and "." in value:
        return 5
    return 7 if text[end : end + 1] == "@" and "://" in text[max(0, start - 70) : start] else made_of(value)


def made_of(value: str) -> int:
    if re.fullmatch(r"[0-9a-fA-F-]+", value):
        return 0
    if value.isalnum():
        return 1
    return 3 if re.search(r"[+=]", value) else 4 if "/" in value else 2


def labelled_findings(rows: int = 10000, seed: int = 17, other: bool = False) -> list[tuple[str, int, int, int]]:
    """Labelled candidates (text, start, end, secret or not), made by a seeded rule from public formats and look-alikes.

    With ``other``, formats, look-alikes and contexts are others: what a model of the first ones hasn't seen.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    run = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    mixed = low + up + num
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "en", "or", "is")]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) if rng.random() < 0.7 else run(low, int(rng.integers(3, 9)))
    secret = [
        lambda: "AKIA" + run(up + num, 16),
        lambda: "ghp_" + run(mixed, 36),
        lambda: "sk-" + run(mixed, 40),
        lambda: "xoxb-" + run(num, 11) + "-" + run(mixed, 24),
        lambda: "AIza" + run(mixed + "_-", 35),
        lambda: run(hexa, int(pick([20, 32, 40, 64]))),
        lambda: run(mixed + "+/", 40),
        lambda: run(mixed, int(rng.integers(14, 48))),
        lambda: run(mixed + "+/", 42) + "==",
        lambda: run(low + num, int(rng.integers(20, 40))),
        lambda: run(up + num, int(rng.integers(20, 40))),
        lambda: word() + "_" + run(mixed, int(rng.integers(20, 40))),
    ]
    code = mixed + "_-"
    special = [
        lambda: "eyJ" + run(code, int(rng.integers(16, 40))) + ".eyJ" + run(code, int(rng.integers(20, 90))) + "." + run(code, int(pick([43, 86]))),
        lambda: f"-----BEGIN {pick(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\n" + "\n".join(run(mixed + "+/", 64) for _ in range(int(rng.integers(1, 5)))) + "\n-----END PRIVATE KEY-----",
        lambda: f"{pick(['postgres', 'mysql', 'amqp', 'redis', 'https', 'mongodb'])}://{word()}:{pick([lambda: word() + run(num, 2) + word(), lambda: run(mixed, 14), lambda: run(mixed + '$!%', 10)])()}@{word()}",
    ]
    secret += special
    sets = [hexa, low + num, up + num, mixed, mixed + "_-", mixed + "+/", low + up]
    secret += [lambda: pick(["", "", run(low, 2) + "_", run(up, 2), run(low, 3) + "-", word()[:5] + "-", f"{word()[:4]}_{word()[:4]}_"]) + run(pick(sets), int(rng.integers(18, 70)))] * 8
    secret += [lambda: run(pick(sets[:5]), int(rng.integers(16, 40))) + pick("-_") + run(low, int(rng.integers(1, 4))) + run(num, int(rng.integers(0, 3)))] * 2
    plain = [
        lambda: f"{word()}_{word()}_{word()}_{run(num, 2)}",
        lambda: f"{word()}-{word()}-{word()}-{run(num, 4)}",
        lambda: f"{word()}/{word()}/{word()}{run(num, 1)}/{word()}",
        lambda: "-".join(run(hexa, n) for n in (8, 4, 4, 4, 12)),
        lambda: f"{run(num, 4)}-{run(num, 2)}-{run(num, 2)}T{run(num, 6)}Z",
        lambda: word() + word() + word() + run(num, int(rng.integers(1, 4))),
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(2, 6)))) + run(num, int(rng.integers(0, 3))),
        lambda: word() + "".join(word().capitalize() for _ in range(int(rng.integers(1, 5)))),
        lambda: "x" * int(rng.integers(10, 20)) + run(num, 6),
        lambda: "=" * 12 + word() + run(num, 2) + "=" * 8,
        lambda: word() * 4 + run(num, 1),
        lambda: f"ISBN{run(num, 13)}",
        lambda: run(num, 14) + pick(["px", "ms", "km", "kb"]),
        lambda: "/".join([*(word() for _ in range(int(rng.integers(2, 7)))), pick(["v", "page", "img"]) + run(num, 2)]),
        lambda: f"{word().upper()}-{run(num, 5)}-{word().upper()}",
    ]
    piece = lambda: pick([word, word, word, lambda: word().capitalize(), lambda: word().upper(), lambda: run(num, int(rng.integers(1, 9))), lambda: word() + run(num, int(rng.integers(1, 4)))])()
    plain += [lambda: pick(["-", "_", "/", "=", "--", ""]).join(piece() for _ in range(int(rng.integers(2, 8))))] * 10
    known = NAMED[1::2] if other else NAMED[::2]  # what isn't learned from is held out
    named = lambda: pick(known)
    several = lambda least, most: [named() for _ in range(int(rng.integers(least, most)))]
    names = [
        lambda: named() + "".join(x.capitalize() for x in several(2, 6)),
        lambda: "".join(x.capitalize() for x in several(2, 6)),
        lambda: "_".join(several(3, 6)) + pick(["", "", "_" + run(num, int(rng.integers(1, 4)))]),
        lambda: "_".join(several(2, 5)).upper() + "_" + run(num, int(rng.integers(1, 5))),
        lambda: "-".join(several(2, 6)) + "-" + run(num, int(rng.integers(1, 5))),
        lambda: "/".join(several(2, 6)) + "/" + named() + run(num, 1),
        lambda: pick(["IMG", "DSC", "VID", "PXL", "scan", "report", "invoice"]) + "_" + run(num, int(pick([4, 8]))) + pick(["", "_" + run(num, 6)]),
        lambda: pick(["ISBN", "EAN", "RFC", "DOI", "ISO", "SKU"]) + pick(["", "-"]) + run(num, int(rng.integers(8, 14))),
        lambda: "".join(x.capitalize() for x in several(2, 4)) + pick(["V", "Test", "Step"]) + run(num, int(rng.integers(1, 3))) + "".join(x.capitalize() for x in several(1, 3)),
        lambda: pick(["https", "ftp"]) + f"://{named()}:" + pick(["****", "<password>", "${PASSWORD}", "{password}", "%s%s"]) + f"@{named()}",
    ]
    near = ['key = "', "secret: ", "export TOKEN=", 'auth="', "Bearer ", "aws ", "credentials ", "password=", "api_key: "]
    far = ["see ", "in the file ", "version ", "at ", "the ", "https://example.org/", "uuid ", "part ", "id ", "|", "### "]
    if other:
        secret = [
            lambda: "glpat-" + run(mixed, 20),
            lambda: "npm_" + run(mixed, 36),
            lambda: "dop_v1_" + run(hexa, 64),
            lambda: "hf_" + run(low + up, 34),
            lambda: "AC" + run(hexa, 32),
            lambda: "pk_live_" + run(mixed, 24),
            lambda: "ya29-" + run(mixed + "_-", 60),
            lambda: run(hexa, 16) + "-" + pick(["us1", "eu2", "us14"]),
            lambda: run(mixed, int(rng.integers(16, 64))),
            lambda: run(mixed + "/+", 64) + "==",
            lambda: run(low + num, 30),
        ]
        plain = [
            lambda: f"IMG_{run(num, 8)}_{run(num, 6)}",
            lambda: f"SKU-{run(num, 5)}-{word().upper()}",
            lambda: f"{word()}Of{word().capitalize()}And{word().capitalize()}",
            lambda: f"{word()}-{word()}-{word()}-{word()}-{run(num, 1)}",
            lambda: "/".join(word() for _ in range(4)) + "/" + run(num, 4),
            lambda: "-".join(run(hexa.upper(), n) for n in (8, 4, 4, 4, 12)),
            lambda: f"{run(num, 4)}{run(num, 2)}{run(num, 2)}-{word()}-{word()}",
            lambda: f"{word()}={run(num, 3)}/{word()}={run(num, 3)}",
            lambda: f"the_{word()}_in_the_{word()}2",
            lambda: "_" * 10 + word() + run(num, 1) + "_" * 10,
        ]
        secret += special
        near = ["PAT: ", "key is ", "'credential': '", "TOKEN=", "login ", "x-api-key: "]
        far = ["photo ", "of ", "www.example.net/", "as ", "item ", "file=", "* ", "under "]
    plain = plain + names * (len(plain) // len(names))
    found = []
    for _ in range(rows):
        gold = int(rng.random() < 0.5)
        value = pick(secret if gold else plain)()
        lead = pick(near) if rng.random() < (0.6 if gold else 0.15) else pick(far)
        left = " ".join(word() for _ in range(int(rng.integers(0, 6)))) + " " + lead
        if rng.random() < 0.3:
            left = pick(["", "", left.strip() + "\n"])  # at the beginning of a text or of a line
        text = left + value + pick(['"', " ", "\n", ", ", ";"]) + word()
        # The span is that of the candidate which the value makes with what stands before it, as a scan finds it.
        run_ = next(((s, e) for s, e in candidates(text) if s < len(left) + len(value) and e > len(left)), None)
        if run_:
            found.append((text, *run_, gold))
    return found


def judged(net: Net, texts: list[str], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """For each span (text, start, end) the highest probability of its windows."""
    parts = [(n, i, s, e) for n, (i, start, end) in enumerate(spans) for s, e in windows(start, end)]
    likely = np.zeros(len(spans))
    for k in range(0, len(parts), 512):
        some = parts[k : k + 512]
        np.maximum.at(likely, [x[0] for x in some], net.probability(np.stack([encode(texts[i], s, e) for _, i, s, e in some])))
    return likely


def scored(net: Net, table: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of labelled findings the probabilities, what they are made of, and the labels."""
    likely = judged(net, [x[0] for x in table], [(i, x[1], x[2]) for i, x in enumerate(table)])
    return likely, np.array([kind_at(t, s, e) for t, s, e, _ in table]), np.array([x[3] for x in table])


@cache
def model(recall: float = 0.97, seed: int = 23) -> Net:
    """Train by Adam on findings of the first formats; calibrate by Platt's scaling, and set for each kind the highest
    threshold whose recall is ``recall`` or more, on findings held out and on ones of other formats."""
    rng = np.random.default_rng(seed)
    table, held = labelled_findings(), labelled_findings(900, seed=18) + labelled_findings(1800, seed=19, other=True)
    codes, gold = np.stack([encode(t, s, e) for t, s, e, _ in table]), np.array([x[3] for x in table], np.float32)
    shape = {"embed": (len(ALPHABET) + 2, SIZE), "conv": (WIDTH * SIZE, FILTERS), "bias": (FILTERS,), "dense": (4 * FILTERS, HIDDEN), "dense_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
    net = Net({k: (rng.standard_normal(s) * (0.0 if "bias" in k else np.sqrt(2 / max(s[0], 8)))).astype(np.float32) for k, s in shape.items()})
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    t = 0
    for _ in range(7):
        for part in np.array_split(rng.permutation(len(table)), len(table) // 64):
            t += 1
            for k, g in net.gradients(codes[part], gold[part]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] -= (0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    logit, y = net.forward(np.stack([encode(t, s, e) for t, s, e, _ in held]))["logit"].astype(np.float64), np.array([x[3] for x in held])
    spread, scale, shift = float(logit.std()), 1.0, 0.0
    for _ in range(1000):  # Newton would do; plain steps on two numbers are enough
        p = 1 / (1 + np.exp(-(scale * logit / spread + shift)))
        scale -= float(((p - y) * logit / spread).mean())
        shift -= float((p - y).mean())
    net.scale, net.shift = scale / spread, shift
    likely, kind, y = scored(net, held)
    # A kind that is all but certain gets no threshold next to 1: what is a little less so than any finding seen is one as well.
    net.thresholds = tuple(min(SURE, float(np.quantile(likely[(y == 1) & (kind == k)], 1 - recall, method="lower"))) for k in range(len(MADE_OF)))
    return net


def touching(spans: list[tuple], others: list[tuple]) -> list[bool]:
    """Of spans by start, which touch one of ``others`` (start, end, ...); those are sorted by start as well."""
    out, at, reach = [], 0, -1
    for s, e, *_ in spans:
        while at < len(others) and others[at][0] < e:
            reach = max(reach, others[at][1])
            at += 1
        out.append(reach > s)
    return out


def scan(texts: list[str], net: Net) -> list[tuple[list, list]]:
    """For each text the base spans and all spans (start, end, kind, probability)."""
    jobs, base = [], []
    for i, text in enumerate(texts):
        found = base_spans(text)
        base.append(found)
        jobs += [(i, s, e, kind) for s, e, kind in found]
        more = candidates(text)
        jobs += [(i, s, e, "learned") for (s, e), taken in zip(more, touching(more, found), strict=True) if not taken]
    likely = judged(net, texts, [(i, s, e) for i, s, e, _ in jobs])
    spans: list[list] = [[] for _ in texts]
    for (i, s, e, kind), p in zip(jobs, likely, strict=True):
        if kind != "learned" or p >= net.thresholds[kind_at(texts[i], s, e)]:
            spans[i].append((s, e, kind, float(p)))
    return [(b, sorted(x, key=lambda y: (y[0], KINDS.index(y[2])))) for b, x in zip(base, spans, strict=True)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs`` (doc_id, text): arrays of (start, end, kind, probability) in code points.

    Null texts are empty and hold none. Base spans stay whatever the network says; it gives them a probability, and adds
    candidates above their kind's threshold that touch no base span. Texts of any length are scanned whole. Repeated rows are scanned
    one by one, ids may be null or repeat, and an empty table gives no rows.
    """
    net = docs.sparkSession.sparkContext.broadcast(model())

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            found = scan([t or "" for t in batch.column(1).to_pylist()], net.value)
            base = [[{"start": s, "end": e, "kind": k} for s, e, k in b] for b, _ in found]
            spans = [[{"start": s, "end": e, "kind": k, "probability": p} for s, e, k, p in x] for _, x in found]
            return {"doc_id": batch.column(0), "base": base, "spans": spans}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", "text"), f"doc_id {kind}, base array<struct<start: int, end: int, kind: string>>, spans array<struct<start: int, end: int, kind: string, probability: double>>", "text", make)


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, *_ in spans:
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Replace every span found in ``text`` by a mark; a column ``n_chars`` follows the new text. Rows and columns stay."""
    net = docs.sparkSession.sparkContext.broadcast(model())

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = [None if t is None else redact(t, x) for t, (_, x) in zip(texts, scan([t or "" for t in texts], net.value), strict=True)]
            return {name: batch.column(i) if i != at else new for i, name in enumerate(batch.schema.names)}

        return apply

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    clean = over_batches(docs, schema, "text", make)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
