"""Secret scans with a character convolutional network over every candidate and its context.

Base patterns find what has a known form; their spans always stay. Besides, every candidate is judged by a small network in
numpy: one-hot characters of the candidate and its surroundings, a convolution, maxima and means over the candidate and over
the context, and a logistic output. A candidate is a run of ``[A-Za-z0-9+/_.=-]`` that is no plain word or number: of 8 or more
characters if it mixes digits with letters or has a capital behind a small letter, of 16 or more if it has a letter at all.

The network is trained on labelled findings: a table made by rules, and a bounded sample of the documents' own candidates.
Of the latter a secret is what a base pattern found, shown without the keyword that told it; harmless is only what a rule of
its own tells to be a path, a host, a version, a date or words (``harmless``). Whatever else the documents hold has no label and
is not learned from, as what the base patterns miss is just what the network is for. Its outputs are calibrated on the part
held out from training (a logistic curve; no text is in both parts), and the threshold is the greatest that keeps the recall
asked for on the held-out secrets of either source. ``left_out`` tells the recall on kinds of keys that training never saw.

Defined cases: null counts as empty and has no span; offsets are code points, ends exclusive; a candidate that overlaps a
base span adds nothing; a candidate longer than the network's window is judged by windows over all of it and over its parts
between separators, and the greatest score counts; texts of any length are scanned whole, ``BLOCK`` windows at a time;
repeated rows are scanned alike. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, unused, with_text_struct, written

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}", re.ASCII)
#: Characters of a candidate with digits or inner capitals, and of one of small or capital letters alone.
LEAST_MIXED, LEAST_LETTERS = 8, 16
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
WORDS = ("password", "passwd", "secret", "token", "api")

#: Characters of the candidate and of either side that the network sees at once; windows over longer ones start ``STEP`` apart.
INSIDE, AROUND = 48, 24
STEP = INSIDE // 2
#: What separates the parts of a longer candidate.
SEPARATORS = re.compile(r"[/.=]+")
#: Windows that are scored at once.
BLOCK = 4096
WIDTH = INSIDE + 2 * AROUND
KERNEL, FILTERS, HIDDEN = 5, 24, 16
RECALL = 0.98
#: Bounds of the findings sampled from the documents, for each label (those of the least hashes), and of the table made by rules.
FROM_DOCUMENTS, BY_RULES = 1000, 10_000
Finding = tuple[str, str, str, int]  # text before, candidate, text after, label

_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_RUN = bytes(1 if chr(c) in string.ascii_letters + string.digits + "+/_.=-" and c < 128 else 0 for c in range(256))


# -- labelled findings ----------------------------------------------------------


_LETTERS, _DIGITS = string.ascii_letters, string.digits
_SYLLABLES = (
    "an", "the", "or", "tion", "ing", "er", "con", "pre", "ment", "ly", "re", "de", "ver", "sta", "lo", "ma", "ti", "user", "data", "node", "sh", "th", "wh", "nd", "st", "ed", "ble", "ough",
    "sch", "ch", "ung", "keit", "lich", "heit", "zu", "ge", "und", "tz", "stein", "elle", "eau", "que", "eux", "ou", "ion", "ais", "cion", "ado", "os", "la", "rr", "llo", "ez", "ij", "oe", "ska", "czy", "ov", "aja",
)


class _Maker:
    """Draws of a random generator."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def take(self, alphabet: str, least: int, most: int | None = None) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(least, most or least)))

    def word(self, least: int = 1, most: int = 3) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(least, most)))

    def prose(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def mixed(self, alphabet: str, least: int, most: int) -> str:
        """With a digit and a letter."""
        while True:
            out = self.take(alphabet, least, most)
            if any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
                return out


#: Kinds of keys, and of what only looks like one.
SECRETS: dict[str, Callable[[_Maker], str]] = {
    "letters_digits": lambda m: m.take(_LETTERS + _DIGITS, 20, 48),
    "base64": lambda m: m.take(_LETTERS + _DIGITS + "+/", 24, 60) + m.r.choice(("", "=", "==")),
    "hex_small": lambda m: m.take("0123456789abcdef", m.r.choice((32, 40, 48, 64))),
    "hex_capital": lambda m: m.take("0123456789ABCDEF", m.r.choice((32, 40, 64))),
    "prefixed": lambda m: m.r.choice(("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "pk_test_", "npm_", "hf_")) + m.take(_LETTERS + _DIGITS, 20, 40),
    "access": lambda m: "AKIA" + m.take(string.ascii_uppercase + _DIGITS, 16),
    "browser": lambda m: "AIza" + m.take(_LETTERS + _DIGITS + "_-", 35),
    "three_parts": lambda m: "eyJ" + m.take(_LETTERS + _DIGITS + "_-", 16, 30) + "." + m.take(_LETTERS + _DIGITS + "_-", 16, 30),
    "short": lambda m: m.mixed(_LETTERS + _DIGITS, 10, 16),
    "short_small": lambda m: m.mixed(string.ascii_lowercase + _DIGITS, 10, 16),
    "small_letters_digits": lambda m: m.take(string.ascii_lowercase + _DIGITS, 18, 48),
    "letters": lambda m: m.take(_LETTERS, 16, 40),
    "small_letters": lambda m: m.take(string.ascii_lowercase, 18, 40),
    "grouped": lambda m: "-".join(m.take(string.ascii_uppercase + _DIGITS, 5) for _ in range(m.r.randint(3, 6))),
}
HARMLESS: dict[str, Callable[[_Maker], str]] = {
    "host": lambda m: f"{m.word()}.{m.r.randint(1, 99)}-{m.word()}.example.{m.r.choice(('com', 'net', 'org'))}",
    "snake": lambda m: f"{m.word()}_{m.word()}_{m.word()}_{m.r.randint(0, 99)}",
    "date": lambda m: f"{m.r.randint(1990, 2030)}-{m.r.randint(1, 12):02}-{m.r.randint(1, 28):02}T{m.r.randint(0, 23):02}",
    "path": lambda m: f"/usr/{m.word()}/{m.word()}/{m.word()}{m.r.randint(0, 9)}.txt",
    "archive": lambda m: f"{m.word()}-{m.r.randint(0, 9)}.{m.r.randint(0, 20)}.{m.r.randint(0, 20)}-{m.word()}.tar.gz",
    "url": lambda m: f"www.{m.word()}{m.r.randint(0, 99)}.example.org/{m.word()}/{m.r.randint(0, 999)}",
    "numbered": lambda m: f"{m.word(2, 3)}{m.r.randint(0, 99)}{m.word(2, 3)}",
    "camel": lambda m: "".join(m.word().capitalize() for _ in range(m.r.randint(2, 4))) + m.r.choice(("", str(m.r.randint(0, 9)))),
    "number": lambda m: "-".join(str(m.r.randint(100, 9999)) for _ in range(4)) + "x",
    "filler": lambda m: m.r.choice("ab0=-_.") * m.r.randint(16, 40) + "1a",
    "setting": lambda m: f"{m.word()}={m.r.randint(0, 99)}/{m.word()}={m.r.randint(0, 99)}",
    "long_word": lambda m: m.word(6, 9),
    "short_numbered": lambda m: m.word(2, 4) + m.r.choice((".", "-", "_", "")) + str(m.r.randint(0, 2030)),
    "words": lambda m: m.r.choice("._-/").join(m.word(1, 3) for _ in range(m.r.randint(3, 5))),
    "unit": lambda m: f"{m.r.randint(1, 9999)}{m.r.choice(('x', 'px', 'km', 'th', 'v'))}{m.r.randint(1, 9999)}{m.word(1, 2)}",
}
_BEFORE_SECRET = ("token = ", "key: ", "Authorization: Bearer ", "secret=", 'client_secret = "', "use ", "-p ", "credential ", "export AUTH=", "", "with key ", "auth:")
_BEFORE_EITHER = ("", "we use ", "the ", "with ", "for ", "in ", "(", "see ", "config/", ": ")
_BEFORE_HARMLESS = ("see ", "at https://", "file ", "version ", "from ", "mailto ", "", "on ", "id ", "by ", "the ", "path=")


def labelled_findings(n: int = BY_RULES, seed: int = 11, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[Finding]:
    """A labelled table made by rules, half secrets; kinds ``without`` are left out, with ``only`` all secrets are of these."""
    m = _Maker(seed)
    secrets = [f for k, f in SECRETS.items() if k not in without and (not only or k in only)]
    harmless = list(HARMLESS.values())
    out = []
    for k in range(n):
        label = k % 2
        body = m.r.choice((str, str, str.lower, str.upper))(m.r.choice(secrets if label else harmless)(m))  # keys are keys in one case, too
        if m.r.random() < 0.3:  # what stands around a key often tells nothing
            lead, after = m.r.choice(_BEFORE_EITHER), m.r.choice((" ", ",", ".", "\n", " for ", " now ")) + m.prose(3)
        elif label:
            lead, after = m.r.choice(_BEFORE_SECRET), m.r.choice(('"', "", " ", "\n", ";")) + " " + m.prose(3)
        else:
            lead, after = m.r.choice(_BEFORE_HARMLESS), m.r.choice((" ", ",", ".", "\n", "/")) + m.prose(3)
        before = m.prose(m.r.randint(0, 5)) + " " + lead
        out.append((before, body, after, label))
    return out


_PART = re.compile(r"(?:[A-Z]?[a-z]{1,14}|[A-Z]{1,4}|v?[0-9]{1,4}|[a-z]{1,14}[0-9]{1,4})")
_VOWELS = re.compile(r"[aeiouy]")


def harmless(run: str) -> bool:
    """Whether all parts of a run are words with enough vowels, or short numbers: paths, hosts, versions, dates, file names."""
    parts = [p for p in re.split(r"[+/_.=-]+|(?<=[a-z])(?=[A-Z])", run) if p]
    for p in parts:
        small = [c for c in p if c.islower()]
        if not _PART.fullmatch(p) or (len(small) > 4 and not 0.2 <= len(_VOWELS.findall(p)) / len(small) <= 0.7):
            return False
    return len(parts) > 0


def told_findings(text: str) -> Iterator[Finding]:
    """A text's candidates with a label of their own: what the base patterns find, and what ``harmless`` tells; of a long one its first ``INSIDE`` characters."""
    data = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, data, text.lower())
    named = _Spans([x for x in base if x[1] == 0])
    for s, kind, e in base:
        if kind and named.meet(s, e):  # shown as that value already
            continue
        before = text[max(0, s - AROUND) : s]
        if kind == 0:  # the keyword goes, what stands between it and the value stays
            m = ASSIGN.match(text, s)
            before, s = before + text[m.end(1) : m.start(2)], m.start(2)
        elif kind == 1:
            s += len("AKIA")
        if is_candidate(text[s:e]):
            yield before[-AROUND:], text[s : min(e, s + INSIDE)], text[e : e + AROUND], 1
    taken = _Spans(base)
    for s, e in candidates(text, data):
        if not taken.meet(s, e) and harmless(text[s:e]):
            yield text[max(0, s - AROUND) : s], text[s : min(e, s + INSIDE)], text[e : e + AROUND], 0


def document_findings(docs: DataFrame, text_col: str = "text", bound: int = FROM_DOCUMENTS) -> list[Finding]:
    """Distinct findings of all documents, at most ``bound`` of each label: those of the least hashes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f for t in b.column(0).to_pylist() for f in told_findings(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["before", "body", "after", "label"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    found = written(texts.mapInArrow(run, "before string, body string, after string, label int").distinct(), "findings")
    order = [F.xxhash64("before", "body", "after"), F.col("before"), F.col("body"), F.col("after")]
    return [tuple(r) for label in (1, 0) for r in found.filter(F.col("label") == label).orderBy(*order).limit(bound).collect()]


# -- the network ----------------------------------------------------------------


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each ASCII character: vowels and other letters in either case, digits, each symbol on its own; 0 is no character."""
    out = np.full(128, 1, np.int64)  # control characters
    for c in range(32, 127):
        ch = chr(c)
        out[c] = 2 + (0 if ch in "ghijklmnopqrstuvwxyz" and ch not in "iou" else 1 if ch in "abcdef" and ch not in "ae" else 2 if ch in "aeiou" else 3 if ch in "AEIOU" else 4 if ch.isupper() else 5 if ch.isdigit() else 6 + "+/_.=-:\"' ".find(ch) if ch in "+/_.=-:\"' " else 16)
    return out


N_CLASSES = 20


def encode(before: str, body: str, after: str) -> np.ndarray:
    """Classes of ``WIDTH`` characters; a longer candidate shows its first and last halves."""
    if len(body) > INSIDE:
        body = body[: INSIDE // 2] + body[-INSIDE // 2 :]
    line = before[-AROUND:].rjust(AROUND, "\x00") + body.ljust(INSIDE, "\x00") + after[:AROUND].ljust(AROUND, "\x00")
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points == 0, 0, np.where(points < 128, _classes()[np.minimum(points, 127)], N_CLASSES - 1))


def _windows(classes: np.ndarray) -> np.ndarray:
    """One-hot windows: rows x places x (KERNEL * N_CLASSES)."""
    hot = np.eye(N_CLASSES, dtype=np.float32)[classes]
    hot[classes == 0] = 0
    places = WIDTH - KERNEL + 1
    return np.concatenate([hot[:, k : k + places] for k in range(KERNEL)], axis=2)


_PLACES = WIDTH - KERNEL + 1
_BODY = slice(AROUND - KERNEL + 1, AROUND + INSIDE)


class Network:
    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 0.15, (KERNEL * N_CLASSES, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.15, (4 * FILTERS, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.3, (HIDDEN, 1)), np.zeros(1)]
        self.w = [x.astype(np.float32) for x in self.w]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.report: list[dict] = []

    def _forward(self, x: np.ndarray):
        w1, b1, w2, b2, w3, b3 = self.w
        conv = np.maximum(x @ w1 + b1, 0)
        outside = np.ones(_PLACES, bool)
        outside[_BODY] = False
        inner, outer = conv[:, _BODY], conv[:, outside]
        pooled = np.concatenate([inner.max(1), inner.mean(1), outer.max(1), outer.mean(1)], axis=1)
        hidden = np.maximum(pooled @ w2 + b2, 0)
        return conv, inner, outer, outside, pooled, hidden, (hidden @ w3 + b3)[:, 0]

    def logits(self, classes: np.ndarray) -> np.ndarray:
        out = [self._forward(_windows(classes[i : i + 256]))[-1] for i in range(0, len(classes), 256)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale * self.logits(classes) + self.shift)))

    def step(self, classes: np.ndarray, y: np.ndarray, state: list, rate: float, turn: int) -> None:
        """One step of Adam on the logistic loss."""
        x = _windows(classes)
        conv, inner, outer, outside, pooled, hidden, logit = self._forward(x)
        w1, b1, w2, b2, w3, b3 = self.w
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y))[:, None].astype(np.float32)
        g5, g6 = hidden.T @ d, d.sum(0)
        dh = (d @ w3.T) * (hidden > 0)
        g3, g4 = pooled.T @ dh, dh.sum(0)
        dp = dh @ w2.T
        dconv = np.zeros_like(conv)
        for part, at, lo in ((inner, np.flatnonzero(~outside), 0), (outer, np.flatnonzero(outside), 2 * FILTERS)):
            best = at[part.argmax(1)]
            rows, cols = np.arange(len(part))[:, None], np.arange(FILTERS)[None, :]
            dconv[:, at] += dp[:, None, lo + FILTERS : lo + 2 * FILTERS] / len(at)
            dconv[rows, best, cols] += dp[:, lo : lo + FILTERS]
        dconv *= conv > 0
        g1, g2 = np.tensordot(x, dconv, axes=([0, 1], [0, 1])), dconv.sum((0, 1))
        for k, g in enumerate((g1, g2, g3, g4, g5, g6)):
            m, v = state[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            self.w[k] = (self.w[k] - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)


def held_out(findings: list[Finding]) -> list[bool]:
    """Marks the findings of every fifth body of either label, in the order of the bodies' hashes."""
    out: set[tuple[int, str]] = set()
    for label in (0, 1):
        bodies = {f[1] for f in findings if f[3] == label}
        out |= {(label, b) for b in sorted(bodies, key=lambda b: (zlib.crc32(b.encode("utf-8", "surrogatepass")), b))[::5]}
    return [(f[3], f[1]) in out for f in findings]


def train(*sources: list[Finding], epochs: int = 12, recall: float = RECALL, seed: int = 5) -> Network:
    """Fits on four fifths of the findings of all sources, calibrates and sets the threshold on the rest.

    ``Network.report`` tells, for each source, the held-out secrets and others, and the shares of either that are told secret.
    """
    findings = [f for source in sources for f in source]
    owner = np.array([k for k, source in enumerate(sources) for _ in source])
    x = np.array([encode(b, c, a) for b, c, a, _ in findings])
    y = np.array([label for *_, label in findings], np.float32)
    out = np.array([h for source in sources for h in held_out(source)], bool)
    fit, held = np.flatnonzero(~out), np.flatnonzero(out)
    net, turn = Network(seed), 0
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in net.w]
    for epoch in range(epochs):
        fit = np.random.default_rng(seed + epoch).permutation(fit)
        for at in range(0, len(fit), 64):
            turn += 1
            net.step(x[fit[at : at + 64]], y[fit[at : at + 64]], state, 3e-3, turn)
    z, t = net.logits(x[held]).astype(float), y[held].astype(float)
    for _ in range(300 if len(held) else 0):  # Platt's curve by gradient steps
        p = 1 / (1 + np.exp(-(net.scale * z + net.shift)))
        net.scale -= 0.05 * float(((p - t) * z).mean())
        net.shift -= 0.05 * float((p - t).mean())
    told = net.scores(x[held]) if len(held) else np.zeros(0)
    least = [np.sort(told[(t == 1) & (owner[held] == k)]) for k in range(len(sources))]
    net.threshold = float(min((s[int((1 - recall) * len(s))] for s in least if len(s)), default=1.0))
    for k in range(len(sources)):
        mine = owner[held] == k
        yes, no = told[mine & (t == 1)], told[mine & (t == 0)]
        net.report.append({"secrets": len(yes), "found": float((yes >= net.threshold).mean()) if len(yes) else None, "others": len(no), "false": float((no >= net.threshold).mean()) if len(no) else None})
    return net


def left_out(kinds: tuple[str, ...], *more: list[Finding], n: int = 600) -> tuple[float, float]:
    """Trained without these kinds of keys: the shares told secret of fresh keys of the kinds, and of fresh harmless findings."""
    net = train(labelled_findings(without=kinds), *more)
    fresh = labelled_findings(n, seed=99, only=kinds)
    told_ = net.scores(np.array([encode(*f[:3]) for f in fresh])) >= net.threshold
    label = np.array([f[3] for f in fresh]) == 1
    return float(told_[label].mean()), float(told_[~label].mean())


# -- scanning -------------------------------------------------------------------


def base_spans(text: str, data: bytes, folded: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place, end)``; cheap tests of the whole text come before the patterns."""
    out = []
    if any(w in folded for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\x01" * 24 in data.translate(_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, data: bytes) -> list[tuple[int, int]]:
    if b"\x01" * LEAST_MIXED not in data.translate(_RUN):
        return []
    return [m.span() for m in CANDIDATE.finditer(text) if is_candidate(m.group())]


_TELLING = re.compile(r"[0-9]|[a-z][A-Z]", re.ASCII)


def is_candidate(run: str) -> bool:
    """Whether a run may be a key: with digits or inner capitals from 8 characters on, of letters alone from 16."""
    n = len(run)
    return n >= LEAST_MIXED and (n >= LEAST_LETTERS or _TELLING.search(run) is not None) and run.translate(_NO_LETTERS) != run


class _Spans:
    """Spans in the order of their starts, to be asked for an overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.reach = [s for s, _, _ in spans], []
        for _, _, e in spans:
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def meet(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.reach[k - 1] > s


def views(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """What the network judges of a candidate: all of it at once, or its ends, overlapping windows, and its parts' windows."""

    def view(s: int, e: int) -> np.ndarray:
        return encode(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND])

    def windows(s: int, e: int) -> Iterator[np.ndarray]:
        for at in range(s, max(s + 1, e - INSIDE), STEP):
            yield view(at, min(e, at + INSIDE))
        if e - s > INSIDE:
            yield view(e - INSIDE, e)

    yield view(start, end)
    if end - start <= INSIDE:
        return
    yield from windows(start, end)
    at = start
    for s, e in [*(m.span() for m in SEPARATORS.finditer(text, start, end)), (end, end)]:
        if (at > start or s < end) and is_candidate(text[at:s]):
            yield from windows(at, s)
        at = e


_NO_LETTERS = {ord(c): None for c in string.ascii_letters}


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, text_col: str = "text", findings: list[Finding] | None = None) -> DataFrame:
    """Adds ``n_assign, n_access, n_hex, base_sha256, spans, n_model``; ``findings`` replace those of the documents for training."""
    prepare(docs.sparkSession)
    net = train(labelled_findings(), document_findings(docs, text_col) if findings is None else findings)

    def kernel(texts: list[str]) -> pa.Array:
        base, asked, owners = [], [], []
        told_secret: set[tuple[int, int, int]] = set()

        def judge() -> None:
            if asked:
                told_secret.update(owners[k] for k in np.flatnonzero(net.scores(np.array(asked)) >= net.threshold).tolist())
            asked.clear()
            owners.clear()

        for k, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass")
            spans = base_spans(text, data, text.lower())
            base.append(spans)
            for s, e in candidates(text, data):
                for classes in views(text, s, e):
                    asked.append(classes)
                    owners.append((k, s, e))
                    if len(asked) >= BLOCK:
                        judge()
        judge()
        added: dict[int, list[tuple[int, int, int]]] = {}
        taken = {k: _Spans(base[k]) for k, _, _ in told_secret}
        for k, s, e in told_secret:
            if not taken[k].meet(s, e):
                added.setdefault(k, []).append((s, 3, e))
        rows = []
        for k, spans in enumerate(base):
            counts = [sum(x[1] == kind for x in spans) for kind in range(3)]
            extra = added.get(k, [])
            rows.append((*counts, hashlib.sha256(told(spans).encode()).hexdigest(), told(sorted(spans + extra)), len(extra)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_NAMES)

    tmp = unused(docs, "_secrets")
    out = with_text_struct(docs, text_col, tmp, kernel, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
    return out.withColumns({c: F.col(f"{tmp}.{c}") for c in _NAMES}).drop(tmp)


_NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]
