"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds choose.

Four base patterns (e-mail, IP address, card, phone) always count. High-recall generators propose further, overlapping
spans: addresses written with "at" and "dot" in words, brackets or blanks, and every stretch of a run of digits, from one
group's start to another's end, that has a fitting number of digits in a few groups (and, for a card, a valid checksum). Gradient-boosted trees over format and context features
score each candidate.

They are trained on examples, whatever the size of the table: made-up entities (seeded, `ENTITIES` of each kind) and the
base spans of a bounded sample of documents (some `SAMPLE_ROWS`, the first `SAMPLE_CHARS` characters of each, chosen by
a hash of the row) are written in other forms and set into neutral sentences and into places of the sample. Negatives are
made-up decoys (dates, versions, order numbers, large numbers, places on the web) and those candidates of the sample that
cannot be what their kind says (parts of longer runs, dates, bare digits); all others might be personal data and teach
nothing. Calibration uses forms, decoys and documents that training has not seen: a logistic fit gives probabilities, and each kind gets the lowest
threshold that reaches `PRECISION` there. Chosen spans that overlap neither a base span nor a better candidate are
added. Prediction reads whole texts, some `GATHER` candidates at a time.

Defined cases: null counts as empty and has no spans; an empty sample leaves the made-up examples; spans at equal starts
go by kind as listed; equally likely candidates go by start, then kind, then end; a null doc_id is a document like any
other; repeated rows are treated alike and count once in the sample; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 6_000
#: Made-up entities of each kind, and decoys of each form.
ENTITIES, DECOYS = 60, 40
#: Candidates that are scored at a time.
GATHER = 20_000
PRECISION = 0.95
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the four base patterns, by start, then kind as listed."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # from each @ outwards, which finds what scanning from the left would
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        tail = _DOMAIN.match(text, at) if first < at else None
        if tail:
            end = tail.end()
            out.append((first, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[0], KINDS.index(s[2]), s[1]


_AT = re.compile(r"@|[\s(\[{]at[\s)\]}]", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[{](?:dot|\.)[)\]}]\s?|\s(?:dot|\.)\s)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_RUN = re.compile(r"[0-9]+(?:[\x20\t./()_\u2013-]{1,2}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_WRITTEN_IP = re.compile(r"[0-9]{1,3}(?:(?:\s?[(\[{](?:dot|\.)[)\]}]\s?|\s(?:dot|\.)\s)[0-9]{1,3}){3}", re.I)
#: A phone number, a card number: least and most digits; groups that either has at most.
_PHONE_DIGITS, _CARD_DIGITS, _GROUPS = (7, 15), (13, 19), 6

#: A proposed span, with the digits of its run before and after it.
Candidate = tuple[Span, int, int]


def candidates(text: str) -> Iterator[Candidate]:
    """What the generators propose: many more than are personal data, and some that overlap."""
    for m in _AT.finditer(text):
        first, end = m.start(), m.end()
        first -= first > 0 and text[first - 1].isspace() and not text[first].isspace()
        end += end < len(text) and text[end].isspace() and not text[end - 1].isspace()
        local = first
        while local and first - local < 64 and text[local - 1] in _LOCAL:
            local -= 1
        host = _HOST.match(text, end) if local < first else None
        if host:
            yield (local, host.end(), "email"), 0, 0
    for m in _WRITTEN_IP.finditer(text):
        yield (m.start(), m.end(), "ip"), 0, 0
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= _PHONE_DIGITS[0]:
            yield from _stretches(text, [g.span() for g in _GROUP.finditer(text, m.start(), m.end())])


def _stretches(text: str, groups: list[tuple[int, int]]) -> Iterator[Candidate]:
    """The stretches of a run of digit groups that have enough digits for a kind and not too many."""
    before, total = 0, sum(b - a for a, b in groups)
    for i, (first, end) in enumerate(groups):
        digits = 0
        for a, b in groups[i : i + _GROUPS]:
            digits += b - a
            if digits > _CARD_DIGITS[1]:
                break
            # With the bracket that opens before a bracketed first group.
            start = first - (first > 0 and text[first - 1] == "(" and ")" in text[first:b])
            if _CARD_DIGITS[0] <= digits and luhn(_NOT_DIGIT.sub("", text[first:b])):
                yield (start, b, "card"), before, total - before - digits
            if _PHONE_DIGITS[0] <= digits <= _PHONE_DIGITS[1]:
                yield (start, b, "phone"), before, total - before - digits
        before += end - first


#: Words near a span that hint at a kind, in the languages of the corpus.
_HINTS = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.I),
    "card": re.compile(r"card|visa|karte|carte|tarjeta|credit", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|mobile|fax|anruf|appel|llam", re.I),
}
_YEAR = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
_MARK = re.compile(r"[(\[{](?:at|dot|\.)[)\]}]", re.I)
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9])")


def features(text: str, candidate: Candidate) -> list[float]:
    (a, b, kind), run_before, run_after = candidate
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 40]
    groups = [len(g) for g in _GROUP.findall(s)]
    digits = _NOT_DIGIT.sub("", s)
    near = before + " " + after
    local = re.split(r"@|[\s(\[{]at", s, maxsplit=1, flags=re.I)[0] if kind == "email" else ""
    marks = set(_GROUP.sub("", s)) if kind != "email" else ()
    return [
        *(kind == k for k in KINDS),
        len(s),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        len(set(groups)),
        len(marks),
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count("/"),
        s.count("(") + s.count(")"),
        s.startswith("0"),
        s.startswith("00"),
        len(set(digits)),
        bool(digits) and luhn(digits),
        bool(_YEAR.search(s)),
        bool(_DATE.search(s)),
        run_before,
        run_after,
        kind == "ip" and all(int(g) <= 255 for g in _GROUP.findall(s)),
        sum(c.isalpha() for c in s),
        len(_MARK.findall(s)),
        " dot " in s.lower(),
        " . " in s,
        " at " in s.lower(),
        "@" in s,
        any(not c.isalpha() for c in local),
        bool(before) and before[-1].isalnum(),
        bool(after) and after[0].isalnum(),
        bool(before) and before[-1] in "#+-./:$\u20ac",
        bool(after) and after[0] in "-./:%\u20ac",
        sum(c.isdigit() for c in near),
        sum(c.isalpha() for c in near),
        near.count("|") + near.count("\t"),
        *(bool(_HINTS[k].search(near)) for k in KINDS),
    ]


def _grouped(digits: str, sizes: tuple[int, ...], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return mark.join([*out, digits[at:]] if at < len(digits) else out)


def _mail(address: str, at: str, dot: str) -> str:
    user, host = address.split("@", 1)
    return user + at + host.replace(".", dot)


#: Other forms of an entity (an e-mail address, the digits of a card or a national phone number, an IP address): those of
#: training and those of calibration.
FORMS = {
    "email": (
        (
            lambda e: _mail(e, " at ", " dot "),
            lambda e: _mail(e, "[at]", "[dot]"),
            lambda e: _mail(e, " (at) ", " (dot) "),
            lambda e: _mail(e, " @ ", "."),
            lambda e: _mail(e, "(at)", "."),
            lambda e: _mail(e, " at " if not e.split("@")[0].isalpha() else " [at] ", "."),
        ),
        (
            lambda e: _mail(e, " {at} ", " {dot} "),
            lambda e: _mail(e, " AT ", " DOT "),
            lambda e: _mail(e, "[at]", "."),
            lambda e: _mail(e, " @ ", " . "),
        ),
    ),
    "ip": (
        (lambda e: e.replace(".", "[.]"), lambda e: e.replace(".", " dot "), lambda e: e.replace(".", "(dot)")),
        (lambda e: e.replace(".", " . "), lambda e: e.replace(".", "(.)"), lambda e: e.replace(".", " [dot] ")),
    ),
    "card": (
        (lambda e: _grouped(e, (4, 4, 4), "."), lambda e: _grouped(e, (4, 4, 4), "/"), lambda e: _grouped(e, (4, 6), ".")),
        (lambda e: _grouped(e, (4, 4, 4), "_"), lambda e: _grouped(e, (4, 4, 4), "\u2013"), lambda e: _grouped(e, (4, 4, 4), "  ")),
    ),
    "phone": (
        (
            lambda e: _grouped(e, (3, 3), "-"),
            lambda e: f"({e[:3]}) {_grouped(e[3:], (3,), '-')}",
            lambda e: "0" + _grouped(e, (3, 3), " "),
            lambda e: "0049 " + _grouped(e, (3, 3), " "),
            lambda e: "0" + _grouped(e, (2, 4), " "),
        ),
        (lambda e: _grouped(e, (3, 3), "."), lambda e: "0" + _grouped(e, (3,), "/"), lambda e: "0033 " + _grouped(e, (3, 3), "-"), lambda e: "0" + _grouped(e, (2, 3), " ")),
    ),
}

_SYLLABLES = ("an", "bo", "cla", "dra", "el", "fi", "gor", "ha", "in", "jo", "ka", "lu", "mar", "no", "ol", "pe", "ro", "sa", "ti", "ve")
_SENTENCES = (
    "You can write to {} about it", "Please call {} today", "mail: {}", "Tel. {}", "reach me: {}", "the card {} was used", "server {} is down",
    "Ihre Nummer {} bitte", "mi correo {} gracias", "appelez {} demain", "They said {} again", "{}", "see ({}), thanks", "then {} and so on", "Kontakt: {}.", "my number is {} now",
    "we paid with {} there", "from {} to us",
)


def _word(rng: random.Random) -> str:
    return "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 3)))


def entity(kind: str, rng: random.Random) -> str:
    """A made-up entity."""
    if kind == "email":
        user = rng.choice(("{a}", "{a}.{b}", "{a}_{b}", "{a}{n}", "{a}-{b}", "{a}.{n}")).format(a=_word(rng), b=_word(rng), n=rng.randint(1, 99))
        return f"{user}@{rng.choice(('', 'mail.', 'post.'))}{_word(rng)}.{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io'))}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "phone":
        return str(rng.randint(2, 9)) + "".join(rng.choices("0123456789", k=9))
    digits = rng.choice("3456") + "".join(rng.choices("0123456789", k=14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=n - 1))


def _unlucky(rng: random.Random) -> str:
    """Sixteen digits that are no card number."""
    return next(d for d in iter(lambda: _number(rng, 16), None) if not luhn(d))


def _date(rng: random.Random, form: str) -> str:
    return form.format(y=rng.randint(1950, 2030), m=rng.randint(1, 12), d=rng.randint(1, 28))


#: What is no personal data though the generators propose it: for training and for calibration.
DECOY_FORMS = (
    (
        lambda r: _date(r, "{y}-{m:02}-{d:02} {m:02}.{d:02}"),
        lambda r: _date(r, "{d:02}.{m:02}.{y}") + " " + _date(r, "{d:02}.{m:02}.{y}"),
        lambda r: _date(r, "{d}/{m}/{y}"),
        lambda r: _date(r, "{y}{m:02}{d:02}"),
        lambda r: f"{r.randint(1, 9)}.{r.randint(100, 999)}.{r.randint(100, 999)}.{r.randint(100, 999)}",
        lambda r: f"order {_number(r, 8)}-{_number(r, 4)}",
        lambda r: _unlucky(r),
        lambda r: _grouped(_unlucky(r), (4, 4, 4), r.choice("./ -")),
        lambda r: _number(r, r.randint(7, 19)),
        lambda r: " ".join(str(r.randint(1, 99)) for _ in range(8)),
        lambda r: f"{r.choice(('works', 'look', 'is', 'shop', 'available', 'sold'))} at {_word(r)}.{r.choice(('com', 'net', 'org'))}",
        lambda r: f"arrived at {_word(r)} . {_word(r)} went on",
        lambda r: f"v{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(1000, 99999)}",
        lambda r: f"{r.randint(10, 99)}.{_number(r, 5)} {r.randint(1, 99)}.{_number(r, 5)}",
    ),
    (
        lambda r: _date(r, "{y}/{m:02}/{d:02} - ") + _date(r, "{y}/{m:02}/{d:02}"),
        lambda r: _date(r, "{d}-{m}-{y}"),
        lambda r: f"{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(100, 999)}",
        lambda r: f"ISBN 978-{r.randint(0, 9)}-{_number(r, 2)}-{_number(r, 6)}-{r.randint(0, 9)}",
        lambda r: f"invoice {_date(r, '{y}')}-{_number(r, 6)}",
        lambda r: _grouped(_unlucky(r), (4, 4, 4), r.choice("_/")),
        lambda r: f"meet at {_word(r)}.{_word(r)}",
        lambda r: _number(r, r.randint(7, 19)),
        lambda r: f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}, {r.randint(1900, 1999)}-{r.randint(2000, 2030)}",
        lambda r: f"1.{r.randint(0, 9)}.{r.randint(0, 9)}-{_number(r, 6)}",
    ),
)


def _entity_of(text: str, span: Span) -> tuple[str, str] | None:
    """The entity that a base span of the sample names, as `FORMS` take it."""
    s, kind = text[span[0] : span[1]], span[2]
    digits = _NOT_DIGIT.sub("", s)
    if kind == "phone":
        return ("phone", digits[-10:]) if len(digits) >= 11 else None
    if kind == "card":
        return ("card", digits) if len(digits) == 16 else None
    return kind, s


def _surely_other(text: str, candidate: Candidate) -> bool:
    """Whether a candidate off the base spans cannot be what its kind says: the sample's own personal data must not be taught
    as negatives."""
    (a, b, kind), run_before, run_after = candidate
    s = text[a:b]
    if kind == "email":
        return not (_MARK.search(s) or "@" in s or " dot " in s.lower()) and s.split(maxsplit=1)[0].isalpha()
    if kind == "ip":
        return any(int(g) > 255 for g in _GROUP.findall(s))
    if run_before + run_after > 0:
        return True
    return s.isdigit() or bool(_DATE.search(s))


class Covered:
    """Spans as sorted disjoint ranges, so that an overlap is one search however many there are."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __contains__(self, span: Span) -> bool:
        k = bisect.bisect_right(self.ends, span[0])
        return k < len(self.starts) and self.starts[k] < span[1]

    def add(self, span: Span) -> None:
        """Take in a span that overlaps none."""
        k = bisect.bisect_right(self.ends, span[0])
        self.starts.insert(k, span[0])
        self.ends.insert(k, span[1])


def examples(texts: list[str], fold: int) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the candidates of training (fold 0) or calibration (fold 1), from the sample's texts of the fold."""
    rng, rows, labels = random.Random(fold), [], []

    def take(before: str, made: str, after: str, kind: str | None) -> None:
        text, first, end = before + made + after, len(before), len(before) + len(made)
        for c in candidates(text):
            a, b, of = c[0]
            # Near misses of a planted entity are negatives of its kind; what stands around it teaches nothing.
            if a < end and first < b and kind in (None, of):
                rows.append(features(text, c))
                labels.append(int((a, b, of) == (first, end, kind)))

    places = [t for t in texts if len(t) > 200]
    entities = [(kind, entity(kind, rng)) for kind in KINDS for _ in range(ENTITIES)]
    for text in texts:
        base = base_spans(text)
        covered = Covered(base)
        entities += filter(None, (_entity_of(text, s) for s in base))
        for c in candidates(text):
            if c[0] not in covered and _surely_other(text, c):
                rows.append(features(text, c))
                labels.append(0)

    def around() -> tuple[str, str]:
        if places and rng.random() < 0.5:
            text = rng.choice(places)
            at = text.find(" ", rng.randrange(len(text) - 100)) + 1
            return text[max(0, at - 60) : at], " " + text[at : at + 60]
        before, after = rng.choice(_SENTENCES).split("{}")
        return before, after

    for kind, e in entities:
        for form in FORMS[kind][fold]:
            before, after = around()
            take(before, form(e), after, kind)
    for form in DECOY_FORMS[fold]:
        for _ in range(DECOYS):
            before, after = around()
            take(before, form(rng), after, None)
    return rows, labels


@dataclass
class Boosted:
    """Gradient-boosted trees of one depth for log loss, on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(np.unique(x[:, k]), np.linspace(0, 1, BINS), method="lower"))[:-1] for k in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        flat = b + np.arange(b.shape[1]) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS), np.zeros(2**DEPTH)
            node = np.zeros(len(y), int)
            for depth in range(DEPTH):
                for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                    here = np.flatnonzero(node == k)
                    if len(here) < 8:
                        continue
                    g, h = (np.bincount(flat[here].ravel(), np.repeat(w[here], b.shape[1]), b.shape[1] * BINS).reshape(-1, BINS).cumsum(1) for w in (grad, hess))
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[k], cut[k] = divmod(best, BINS)
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            node -= 2**DEPTH - 1
            g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
            leaf = RATE * g / (h + 1)
            score += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


@dataclass
class Judge:
    trees: Boosted
    slope: float
    shift: float
    thresholds: dict[str, float]

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.scores(x) + self.shift)))

    @classmethod
    def train(cls, texts: list[str]) -> Judge:
        folds = [[t for k, t in enumerate(texts) if (k % 4 == 3) == bool(fold)] for fold in (0, 1)]
        (x, y), (back, t) = ((np.array(rows, float), np.array(labels, float)) for rows, labels in (examples(folds[fold], fold) for fold in (0, 1)))
        trees = Boosted().fit(x, y)
        s, a, b = trees.scores(back), 1.0, 0.0
        for _ in range(25):  # Newton steps of a logistic fit of the labels on their scores
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([(s * (t - p)).sum() - 1e-3 * a, (t - p).sum()])
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(h, g)
            a, b = float(np.clip(a + da, 0.05, 10)), float(np.clip(b + db, -20, 20))
        judge = cls(trees, a, b, {})
        p = judge.chances(back)
        for k, kind in enumerate(KINDS):
            mine = back[:, k] == 1
            order = np.argsort(-p[mine], kind="stable")
            ranked = p[mine][order]
            right = t[mine][order].cumsum() / np.arange(1, len(ranked) + 1)
            good = np.flatnonzero((right >= PRECISION) & np.append(ranked[1:] < ranked[:-1], True))  # equal chances stand or fall together
            judge.thresholds[kind] = max(0.5, float(ranked[good[-1]])) if len(good) else 2.0
        return judge

    def choose(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """The spans to add to each text's base spans; candidates are scored `GATHER` at a time."""
        chosen: list[list[tuple[float, Span]]] = [[] for _ in texts]
        where: list[tuple[int, Span]] = []
        rows: list[list[float]] = []

        def judged() -> None:
            for (k, span), p in zip(where, self.chances(np.array(rows, float)), strict=True):
                if p >= self.thresholds[span[2]]:
                    chosen[k].append((float(p), span))
            where.clear()
            rows.clear()

        for k, text in enumerate(texts):
            covered = Covered(base[k])
            for c in candidates(text):
                if c[0] not in covered:
                    where.append((k, c[0]))
                    rows.append(features(text, c))
                    if len(rows) >= GATHER:
                        judged()
        if rows:
            judged()
        return [added(c, b) for c, b in zip(chosen, base, strict=True)]


def sample_texts(docs: DataFrame) -> list[str]:
    """The sample, in an order by hash; a share of the rows is drawn, equal ones count once, so no task sends more than its
    part."""
    share = SAMPLE_ROWS / max(1, docs.count())
    drawn = docs.where(common.chance(F.lit("pii"), "doc_id", "text") < share).where("text is not null")
    rows = drawn.select(F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("t")).groupBy("h").agg(F.min("t").alias("t"))
    return [r["t"] for r in rows.orderBy("h").limit(2 * SAMPLE_ROWS).collect()]


def added(found: list[tuple[float, Span]], base: list[Span]) -> list[Span]:
    """The chosen candidates that overlap neither a base span nor one that scores better."""
    out, covered = [], Covered(base)
    for _, span in sorted(found, key=lambda f: (-f[0], _order(f[1]))):
        if span not in covered:
            out.append(span)
            covered.add(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=_order))


def find(docs: DataFrame) -> DataFrame:
    """Base and added spans of every whole text."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    judge = spark.sparkContext.broadcast(Judge.train(sample_texts(docs)))  # a fixed number of small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = judge.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = [joined(b + more) for b, more in zip(base, model.choose(texts, base), strict=True)]
            counts = [pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
            sums = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sums, pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
        common.trim()

    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: personal data in every document."""
    return find(common.table(spark, sf_dir, "documents"))
