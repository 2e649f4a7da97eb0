"""Personal data by candidate gradient boosting.

Plain patterns give the base spans, which always stay. High-recall generators propose further, overlapping candidates of the
same kinds in looser forms; boosted trees score them by format and context; a threshold for each kind, set on calibrated
scores of held-out examples of other forms, selects which of them are added. All examples are generated with fixed seeds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import doc_text, slices

KINDS = ("email", "ip", "card", "phone")
#: Precision on the held-out examples at which a kind's threshold is set.
PRECISION = 0.99
EXAMPLES = 6000
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 24

# --- base spans ------------------------------------------------------------------------------------------------

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, non-overlapping for each kind, failing matches dropped."""
    out = []
    if "@" in text:  # the local part is the run that ends at the sign, not before the last match's end
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# --- candidates and features -----------------------------------------------------------------------------------

_GENERATORS = {
    "ip": [
        re.compile(r"[0-9]{1,3}(?:[ ]?(?:\[\.\]|\(\.\)|\.)[ ]?[0-9]{1,3}){3}"),
        re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])"),
    ],
    "card": [re.compile(r"[0-9]{4}(?:[ ]?[-._/ ][ ]?[0-9]{4}){2}[ ]?[-._/ ][ ]?[0-9]{1,7}"), re.compile(r"[0-9]{13,19}")],
    "phone": [
        re.compile(r"(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-][0-9]{2,4}[ ./-]?[0-9]{3,4}(?:[ .-][0-9]{2,4})?"),
        re.compile(r"(?<![0-9])[0-9]{9,12}(?![0-9])"),
        re.compile(r"(?<![0-9])0[0-9](?:[ .-][0-9]{2}){4}(?![0-9])"),
        re.compile(r"(?<![0-9])\(?0[0-9]{1,3}\)?[ ]?[ /-][ ]?[0-9]{5,8}(?![0-9])"),
    ],
}
_MARK = re.compile(r"[ ]?(?:\(at\)|\[at\]|\{at\}|@)[ ]?|[ ]at[ ](?=[\w-]{1,64}(?:[ ]dot[ ]|\.\w))", re.I)
_HOST = re.compile(r"[\w-]{1,64}(?:(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?|[ ]dot[ ]|\.|[ ]\.[ ])[A-Za-z][\w-]{1,63}){1,4}", re.I)
_CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "host", "address", "server", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "ruf"),
}
_AGAINST = re.compile(r"\b(?:version|order|invoice|isbn|token|page|section|chapter|serial|id|ref|date)\b")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Every generator's spans, overlaps and all. Written-out addresses start from their sign for "at", the rest needs a digit."""
    out = set()
    if "@" in text or "at" in text.lower():
        for m in _MARK.finditer(text):
            start = m.start()
            while start and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
                start -= 1
            if start < m.start() and (host := _HOST.match(text, m.end())):
                out.add(("email", start, host.end()))
    if _DIGIT.search(text):
        out.update((kind, *m.span()) for kind, patterns in _GENERATORS.items() for p in patterns for m in p.finditer(text))
    return sorted(out)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    number = digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    before = text[max(0, start - 32) : start].lower()
    edge = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    parts = [int(g) for g in re.findall("[0-9]{1,9}", span)]
    return [
        KINDS.index(kind), len(span), len(number), len(groups), max(groups, default=0), min(groups, default=0),
        float(luhn(number)) if number else 0.0, max(parts, default=0) <= 255, span.count(" "), span.count("-"), span.count("."), span.count("/"),
        "(" in span, "[" in span, "@" in span, " dot " in span.lower() or "dot]" in span.lower() or "dot)" in span.lower(), edge[0].isalnum(), edge[1].isalnum(),
        edge[0] in "+#$.-_/", edge[1] in "%-_/", any(w in before for w in _CONTEXT[kind]), _AGAINST.search(before) is not None,
        span.count(":"), number[:1] in ("3", "4", "5", "6"), groups[-1] if groups else 0, groups[0] if groups else 0, span[:2] == "00", sum(c.isalpha() for c in span),
        before.rstrip(" ")[-1:].isdigit() + 2 * text[end : end + 2].lstrip(" ")[:1].isdigit(),
    ]


# --- generated examples ----------------------------------------------------------------------------------------


class _Maker:
    """Draws for templates; a template is a function of a maker that gives (cue before the span, span)."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *x):
        return x[int(self.rng.integers(len(x)))]

    def n(self, k: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, k)))

    def word(self) -> str:
        return "".join(self.pick("an", "er", "th", "on", "re", "la", "sch", "en", "ou", "ti", "os", "ge") for _ in range(int(self.rng.integers(1, 5))))

    def words(self, most: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(0, most))))

    def user(self) -> str:
        return self.word() + self.pick(".", "_", "", "-") + self.pick(self.word(), self.n(2))

    def tld(self) -> str:
        return self.pick("com", "org", "net", "de", "fr", "es", "io", "eu")

    def part(self, top: int = 256) -> str:
        return str(self.rng.integers(0, top))

    def hexes(self, k: int = 8, top: int = 65536) -> str:
        return ":".join(f"{int(x):x}" for x in self.rng.integers(1, top, k))

    def cue(self, kind: str, share: float = 0.6) -> str:
        return self.pick(*_CONTEXT[kind]) + self.pick(": ", " ", " is ", ". ") if self.rng.random() < share else ""

    def false_cue(self) -> str:
        return self.pick("", "", "order ", "token ", "serial ", "ref ", "invoice ", "date ", "page ", "isbn ")

    def card(self, valid: bool, size: int = 16) -> str:
        head = self.pick("4", "5", "3", "6") + self.n(size - 2)
        last = next(d for d in "0123456789" if luhn(head + d))
        return head + (last if valid else str((int(last) + int(self.rng.integers(1, 10))) % 10))

    def fours(self, number: str, sep: str) -> str:
        return sep.join(number[i : i + 4] for i in range(0, len(number), 4))


#: Templates by kind and label. The trees learn from the first set; scale and thresholds are set on the second, whose forms differ.
_TRAINING = {
    ("email", 1): [lambda m: (m.cue("email"), m.user() + (p := m.pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), ("[at]", ".")))[0] + m.word() + p[1] + m.tld())],
    ("email", 0): [lambda m: (m.pick("", "", m.cue("email")), m.word() + " at " + m.word() + "." + m.word())],
    ("ip", 1): [lambda m: (m.cue("ip"), m.pick("[.]", "(.)", " . ", "[.]").join(m.part() for _ in range(4))), lambda m: (m.cue("ip"), m.hexes())],
    ("ip", 0): [
        lambda m: (m.pick("version ", "section ", "", "chapter "), ". ".join(m.n(int(m.rng.integers(1, 4))) for _ in range(4))), lambda m: ("", ".".join(str(m.rng.integers(256, 999)) for _ in range(4))),
        lambda m: ("", ":".join(f"{int(x):02d}" for x in m.rng.integers(0, 60, 4))),
    ],
    ("card", 1): [lambda m: (m.cue("card"), m.fours(m.card(True), m.pick(".", "/", " - ", "_", " . ")))],
    ("card", 0): [lambda m: (m.false_cue(), m.fours(m.card(False), m.pick(".", "/", " - ", "_", " . "))), lambda m: (m.false_cue(), m.card(False)), lambda m: (m.false_cue(), m.n(int(m.rng.integers(13, 20)))), lambda m: (m.n(16) + " ", m.card(True))],
    ("phone", 1): [
        lambda m: (m.cue("phone"), m.pick(f"({m.n(3)}) {m.n(3)}-{m.n(4)}", f"{m.n(3)}-{m.n(3)}-{m.n(4)}", f"{m.n(3)}.{m.n(3)}.{m.n(4)}", f"00{m.n(2)} {m.n(3)} {m.n(4)}")),
        lambda m: (m.cue("phone", 1), m.pick(f"0{m.n(2)} {m.n(7)}", f"0{m.n(3)}/{m.n(6)}", f"0{m.n(1)} {m.n(2)} {m.n(2)} {m.n(2)} {m.n(2)}", f"{m.n(3)} {m.n(3)} {m.n(4)}")),
    ],
    ("phone", 0): [
        lambda m: (m.false_cue(), m.pick(f"{m.rng.integers(1900, 2100)}-{m.n(2)}-{m.n(3)}", f"{m.n(2)}/{m.n(2)}/{m.rng.integers(1900, 2100)}", m.n(10), m.n(12), f"{m.n(4)} {m.n(4)} {m.n(4)}", f"{m.n(2)} {m.n(3)} {m.n(3)}", f"{m.n(3)} {m.n(3)}")),
        lambda m: (m.false_cue(), " ".join(m.n(2) for _ in range(5))), lambda m: (m.pick("", m.n(4) + " ", m.n(2) + " "), " ".join(m.n(4) for _ in range(int(m.rng.integers(3, 5))))),
    ],
}
_CALIBRATION = {
    ("email", 1): [lambda m: (m.cue("email"), m.user() + (p := m.pick(("{at}", "{dot}"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" AT ", " DOT "), ("@ ", " . ")))[0] + m.word() + p[1] + m.pick("", m.word() + p[1]) + m.tld())],
    ("email", 0): [lambda m: (m.pick("look ", "arrive ", ""), m.word() + " at " + m.pick("noon", "home", m.word()) + "." + m.word().title())],
    ("ip", 1): [lambda m: (m.cue("ip"), m.pick(" [.] ", ". ", "(.)").join(str(m.rng.integers(100, 256)) for _ in range(4))), lambda m: (m.cue("ip", 1), m.hexes(int(m.rng.integers(6, 9)), 4096))],
    ("ip", 0): [lambda m: (m.pick("version ", "section "), ".".join(str(m.rng.integers(260, 4000)) for _ in range(4))[:15]), lambda m: (m.pick("at ", ""), ":".join(f"{int(x):02d}" for x in m.rng.integers(0, 24, 4))), lambda m: (m.pick("mac ", ""), ":".join(f"{int(x):02d}" for x in m.rng.integers(10, 99, 5)))],
    ("card", 1): [lambda m: (m.cue("card", 0.8), m.fours(m.card(True), m.pick("/", " . ", "_", " _ ", ". ")))],
    ("card", 0): [lambda m: (m.pick("token ", "id ", "", "tracking "), m.n(int(m.rng.integers(13, 20)))), lambda m: (m.pick("serial ", "part ", ""), m.fours(m.card(False), m.pick(" / ", ".", "_"))), lambda m: (m.n(15) + " " + m.n(17) + " ", m.card(True))],
    ("phone", 1): [lambda m: (m.cue("phone", 0.8), m.pick(f"({m.n(3)}) {m.n(3)} {m.n(4)}", f"0{m.n(3)}-{m.n(3)}-{m.n(3)}", f"00{m.n(2)}-{m.n(3)}-{m.n(4)}", f"0{m.n(2)}/{m.n(7)}", f"0{m.n(1)}.{m.n(2)}.{m.n(2)}.{m.n(2)}.{m.n(2)}"))],
    ("phone", 0): [lambda m: (m.pick("isbn ", "order ", "ref ", "", "id "), m.pick(f"{m.rng.integers(1900, 2100)}.{m.n(2)}.{m.n(3)}", m.n(9), m.n(11), f"{m.n(3)} {m.n(2)} {m.n(4)}", f"{m.n(2)}-{m.n(3)}-{m.n(3)}"))],
}


def _examples(n: int, seed: int = 5, templates: dict | None = None) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): looser forms of personal data, and look-alikes that are none."""
    m, out = _Maker(seed), []
    for _ in range(n):
        kind, yes = m.pick(*KINDS), int(m.rng.random() < 0.5)
        cue, span = m.pick(*(templates or _TRAINING)[kind, yes])(m)
        text = f"{m.words(5)} {cue}"
        out.append((f"{text}{span} {m.words(5)}", kind, len(text), len(text) + len(span), yes))
    return out


# --- boosted trees ---------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Depth-wise trees over binned features, as arrays: feature, cut, and leaf values."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    start: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5,) * len(KINDS)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.raw(x) + self.scale[1])))


def fit_boosted(x: np.ndarray, y: np.ndarray) -> Boosted:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Boosted(edges, [], float(np.log(y.mean() / (1 - y.mean()))))
    b, f = model.bins(x), np.full(len(x), model.start)
    flat = b + np.arange(x.shape[1]) * (BINS + 1)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        at = np.zeros(len(x), np.int64)
        for node in range(2**DEPTH - 1):
            own = at == node
            if own.sum() >= 8:
                size = x.shape[1] * (BINS + 1)
                gs = np.bincount(flat[own].ravel(), np.repeat(g[own], x.shape[1]), size).reshape(x.shape[1], -1).cumsum(1)
                hs = np.bincount(flat[own].ravel(), np.repeat(h[own], x.shape[1]), size).reshape(x.shape[1], -1).cumsum(1)
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
                best = int(gain.argmax())
                feature[node], cut[node] = divmod(best, BINS + 1)
            if 2 * node + 1 < 2 ** (DEPTH + 1) - 1:
                at[own] = 2 * node + 1 + (b[own, feature[node]] > cut[node])
        leaf_of = at - (2**DEPTH - 1)
        leaf = RATE * np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + 1)
        model.trees.append((feature, cut, leaf))
        f += leaf[leaf_of]
    return model


@lru_cache(maxsize=2)
def trained(seed: int = 5) -> Boosted:
    """Trees on EXAMPLES generated examples; scale and thresholds on as many others, half of them of other forms."""

    def drawn(rows):
        return np.array([features(t, k, s, e) for t, k, s, e, _ in rows], float), np.array([r[4] for r in rows], float)

    model = fit_boosted(*drawn(_examples(EXAMPLES, seed)))
    x, truth = drawn(_examples(EXAMPLES // 2, seed + 1, _CALIBRATION) + _examples(EXAMPLES // 2, seed + 2))
    raw, a, c = model.raw(x), 1.0, 0.0
    for _ in range(30):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(a * raw + c)))
        w, r = p * (1 - p) + 1e-6, truth - p
        hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        da, dc = np.linalg.solve(hess, [(r * raw).sum(), r.sum()])
        a, c = a + da, c + dc
    model.scale = (a, c)
    p, thresholds = model.probability(x), []
    for k in range(len(KINDS)):
        own = x[:, 0] == k
        order = np.argsort(-p[own], kind="stable")
        scores, right = p[own][order], np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        last = int(good[-1]) if len(good) else -1
        thresholds.append(1.1 if last < 0 else float(scores[last] + scores[min(last + 1, len(scores) - 1)]) / 2)
    model.thresholds = tuple(thresholds)
    return model


class _Free:
    """Disjoint stretches of a text, sorted: whether a span touches one is told from its neighbours."""

    def __init__(self, spans):
        self.start, self.end = [], []
        for s, e in sorted(spans):
            if self.end and s < self.end[-1]:
                self.end[-1] = max(self.end[-1], e)
            else:
                self.start.append(s)
                self.end.append(e)

    def clear(self, s: int, e: int) -> bool:
        k = bisect_right(self.end, s)
        return k == len(self.start) or e <= self.start[k]

    def take(self, s: int, e: int) -> None:
        k = bisect_right(self.end, s)
        self.start.insert(k, s)
        self.end.insert(k, e)


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Boosted) -> list[list[tuple[str, int, int]]]:
    """Accepted candidates that touch no base span; of overlapping ones the highest score, then the longest, then the first."""
    owner, spans, rows, free = [], [], [], []
    for i, text in enumerate(texts):
        free.append(_Free((s, e) for _, s, e in base[i]))
        for kind, s, e in candidates(text):
            if free[i].clear(s, e):
                owner.append(i)
                spans.append((kind, s, e))
                rows.append(features(text, kind, s, e))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    p = model.probability(np.array(rows, float))
    accepted = np.flatnonzero(p >= np.array(model.thresholds)[[KINDS.index(k) for k, _, _ in spans]])
    for j in sorted(accepted.tolist(), key=lambda j: (-p[j], spans[j][1] - spans[j][2], spans[j])):
        _, s, e = spans[j]
        if free[owner[j]].clear(s, e):
            out[owner[j]].append(spans[j])
            free[owner[j]].take(s, e)
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _passes(batches, model):
    for batch in batches:
        for part in slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            yield part, texts, base, added_spans(texts, base, model)


_FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base counts by kind, base_sha256, spans (base and added, by kind, then start).

    Offsets are code points, end exclusive. A null text counts as empty: no spans, the hash of the empty text. A text of any
    length is searched whole, in time that grows with it. Of overlapping added spans the highest score stays, then the longest,
    then the first. Null ids, repeated rows, empty tables and clashing extra columns are allowed; row count is kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(trained())  # of fixed size

    def run(batches):
        for part, texts, base, added in _passes(batches, held.value):
            count = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(in_order(b + a)) for b, a in zip(base, added, strict=True)])],
                names=[c.split()[0] for c in _FIELDS.split(", ")],
            )

    return doc_text(docs).mapInArrow(run, _FIELDS)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans of two kinds become one. Other columns stay.

    n_chars, where there is one, is the new length. A null text stays null, an empty one empty; texts of any length are searched
    whole; repeated rows are redacted alike; an empty table gives none.
    """
    held, schema = docs.sparkSession.sparkContext.broadcast(trained()), docs.schema
    base_columns = docs.columns

    def run(batches):
        for part, texts, base, added in _passes(batches, held.value):
            done = []
            for i, text in enumerate(texts):
                spans = sorted([(s, e, k) for k, s, e in base[i] + added[i]])
                if not spans:
                    done.append(text if part.column("text")[i].is_valid else None)
                    continue
                pieces, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        pieces += [text[at:s], f"[{k.upper()}]"]
                    at = max(at, e)
                done.append("".join([*pieces, text[at:]]))
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(done, pa.string()))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
    if "n_chars" in base_columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out
