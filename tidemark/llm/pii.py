"""Personal information inside free text: candidate spans, boosted trees, calibrated thresholds."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Boosted, best_threshold, calibrate, fit_boosted
from tidemark.llm.pii_training import TRAINING_TEXTS, training_texts
from tidemark.llm.pii_words import CLASSES, DIGIT_WORDS, PLACE_ENDS, REPEATS, is_common, vocabulary, word_class

KINDS = ("email", "phone", "id_number", "address", "name")
#: A span missed costs more than one redacted too much; the thresholds maximise F-beta.
BETA = 1.5
#: How far a cue word may stand before or after a span, in words.
REACH = 5

_LETTERS = r"[^\W\d_](?:[^\W\d_]|[ऀ-ःऺ-ॏಂಃ಼-್])*"
_TOKEN = re.compile(rf"{_LETTERS}|\d+")
_EMAIL = re.compile(r"[\w.+-]+\s?(?:@|\(at\)|\[at\]|\{at\})\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+|[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", re.I)
_WORDS = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:(?:{'|'.join(REPEATS)}) )?(?:{_WORDS})(?:[ ,-]+(?:(?:{'|'.join(REPEATS)}) )?(?:{_WORDS})){{5,}}\b", re.I)
_DIGITS = re.compile(r"(?<![\w@])(?:\+\d{1,3}[ -]?)?(?:\(\d{2,5}\)[ -]?)?\d+(?:[ .-]\d+)*(?!\w)")
_ID = re.compile(r"(?<!\w)(?:[A-Z]{5}[ -]?\d{4}[ -]?[A-Z]|[A-Z]{3} ?\d{7}|[A-Z] ?\d{7}|[A-Z]{2}[- ]?\d{2}[- ]?(?:19|20)\d{2}[- ]?\d{7})(?!\w)", re.I)
_HOUSE = re.compile(
    r"(?<![\w.,/+-])(?:#\s?\d+[\w/-]*|(?:h\.? ?no\.?|d\.? ?no\.?|(?:flat|plot|house|door|quarters?|qtr|room|shop|unit|villa|bungalow|survey)(?: ?no\.?| number)?|makaa?n(?: no\.?| number)?|gharkul|no\.?)"
    r"\s*[:#-]?\s*(?:[a-z][ /-]?)?\d+[\w/-]*|(?:[a-z][/-])?\d{1,4}(?:[/-]\d{1,4})*(?:[/-]?[a-z])?)(?![\w%:]|[.]\d)",
    re.I,
)
_BREAK = re.compile(r"[\n;|?!]|\s/\s|[.]\s|\s[-–—]\s")
#: Classes of words no name has.
_NEVER = frozenset("func prep post pron honorific digitword naming".split())
_CUES = {c: frozenset(CLASSES[c].split()) for c in ("phoneword", "idword", "refword", "mailword", "addrword", "comm", "motion", "honorific", "naming", "role", "kin", "firm", "product", "street", "building", "house")}
_PLACE_ENDS = tuple(PLACE_ENDS)


@dataclass(slots=True)
class Span:
    start: int
    end: int
    kind: str
    how: int
    lo: int = 0
    hi: int = 0
    extra: tuple[float, ...] = (0.0, 0.0, 0.0)
    x: list[float] = field(default_factory=list)


class Text:
    """A text with its digits made plain, its words, their classes and where clauses break."""

    __slots__ = ("t", "words", "starts", "ends", "raw", "cls", "broken", "caseless")

    def __init__(self, text: str, det: Detector):
        self.t = t = plain_digits(text)
        found = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(t)]
        self.starts = [a for a, _, _ in found]
        self.ends = [b for _, b, _ in found]
        self.raw = [w for _, _, w in found]
        self.words = [w.lower() for w in self.raw]
        self.cls = [det.class_of(w) for w in self.words]
        self.broken = [False] + [bool(_BREAK.search(t[self.ends[i - 1] : self.starts[i]])) and not (len(self.words[i - 1]) <= 1 or self.cls[i - 1] == "honorific" or self.words[i - 1] == "no") for i in range(1, len(found))]
        letters = [w for w in self.raw if w[0].isascii() and not w[0].isdigit() and len(w) > 1]
        upper = sum(w[0].isupper() for w in letters)
        self.caseless = not upper or all(w.isupper() for w in letters)

    def at(self, i: int, of: int) -> tuple[str, str]:
        """Word and class at ``i`` as seen from the span's edge word ``of``; a mark where a clause ends."""
        if not 0 <= i < len(self.words):
            return "<e>", "<e>"
        a, b = (i, of) if i < of else (of, i)
        for k in range(a + 1, b + 1):
            if self.broken[k]:
                return "<b>", "<b>"
        w = self.words[i]
        return ("0", "number") if w[0].isdigit() else (w, self.cls[i])


def plain_digits(text: str) -> str:
    """Decimal digits of any script as ASCII; every other character stays where it is."""
    if text.isascii():
        return text
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


class Detector:
    """Generators, features, trees and thresholds. Built from training texts, then only read."""

    def __init__(self, words: dict[str, float] | None = None) -> None:
        self.vocabulary = vocabulary() if words is None else words
        self.odds: dict[tuple, float] = {}
        self.endings: dict[str, float] = {}
        self.trees: dict[str, Boosted] = {}
        self.platt: dict[str, tuple[float, float]] = {}
        self.threshold: dict[str, float] = {}
        self._classes: dict[str, str] = {}

    def class_of(self, w: str) -> str:
        found = self._classes.get(w)
        if found is None:
            if len(self._classes) > 200_000:
                self._classes.clear()
            listed = word_class().get(w)
            if w[0].isdigit():
                found = "number"
            elif len(w) == 1:
                found = "letter"
            elif listed:
                found = listed
            elif is_common(w, self.vocabulary):
                found = "common"
            else:
                found = "proper" if w in self.vocabulary else "unknown"
            self._classes[w] = found
        return found

    # candidates

    def candidates(self, x: Text) -> list[Span]:
        """High-recall spans of every kind, which may overlap."""
        t = x.t
        out = [Span(m.start(), m.end(), "email", 0) for m in _EMAIL.finditer(t)]
        out += [Span(m.start(), m.end(), "phone", 1) for m in _SPELLED.finditer(t)]
        for m in _DIGITS.finditer(t):
            for a, b, n in self._numbers(m):
                out.append(Span(a, b, "phone", 2))
                if n == 12:
                    out.append(Span(a, b, "id_number", 3))
        out += [Span(m.start(), m.end(), "id_number", 4) for m in _ID.finditer(t)]
        for m in _HOUSE.finditer(t):
            out += self._addresses(x, m)
        out += self._names(x)
        for s in out:
            s.lo, s.hi = bisect_left(x.starts, s.start), bisect_left(x.starts, s.end)
        return out

    def _numbers(self, m: re.Match) -> list[tuple[int, int, int]]:
        """Every run of the match's groups with 8 to 13 digits."""
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"\d+", m.group())]
        out = []
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 13:
                    break
                if n >= 8:
                    out.append((m.start() if i == 0 else groups[i][0], groups[j][1], n))
        return out

    def _addresses(self, x: Text, m: re.Match) -> list[Span]:
        """An address from the house number ``m`` on may end after each of its streets, sectors,
        buildings, postal codes and comma parts, and with its last word."""
        t, at, seen, ends = x.t, m.end(), 0, []
        keyed = not m.group()[0].isdigit()
        commas = 0
        first = bisect_left(x.starts, m.end())
        marks: list[tuple[int, tuple[float, ...]]] = []
        for n, i in enumerate(range(first, min(first + 18, len(x.words)))):
            a, b, w, c = x.starts[i], x.ends[i], x.words[i], x.cls[i]
            gap = t[at:a]
            if len(gap) > 3 or "\n" in gap or gap.strip(" ,-/#.") or (gap.strip() == "/" and gap != "/"):
                break
            if "." in gap and len(x.words[i - 1]) > 3 and gap != ".":
                break
            if w[0].isdigit():
                if len(w) > 4 and len(w) != 6:
                    break
                place = len(w) == 6 or (i > first and x.cls[i - 1] in ("street", "building"))
            else:
                ahead = x.cls[i + 1 : i + 4]
                leads = bool(ahead) and ahead[0] in ("street", "building") and t[b : x.starts[i + 1]] in (" ", "-")
                named = x.raw[i][0].isupper() and not x.caseless
                beside = "relative_place" in x.cls[max(first, i - 2) : i]
                if w == "a" and (leads or i > first and x.cls[i - 1] in ("street", "building")):
                    c = "letter"
                if w in ("to", "no", "of", "ke") and n and (w != "to" or x.words[i - 1] == "next"):
                    c = "letter"
                if c in ("func", "pron", "digitword", "naming", "prep", "post", "comm", "motion"):
                    break
                if not leads and c in ("honorific", "phoneword", "idword", "mailword", "time", "product", "hinglish") and not (named and c in ("hinglish", "time", "product", "honorific")):
                    break
                if c in ("common", "role", "kin", "refword", "addrword", "firm") and not named and not beside and not {"street", "building"} & set(ahead):
                    break
                place = c in ("street", "building")
            seen += place
            if "," in gap:
                commas += 1
                if n:
                    marks.append((at, (float(seen), float(n), float(commas))))
            at = b
            if place:
                marks.append((at, (float(seen), float(n + 1), float(commas))))
            if w[0].isdigit() and len(w) == 6:
                break
        last = bisect_left(x.starts, at)
        if last > first:
            marks.append((at, (float(seen), float(last - first), float(commas))))
        best = {e: k for e, k in marks if k[0] or (keyed and k[1])}
        ends = sorted(best.items())
        return [Span(m.start(), e, "address", 5 + keyed, extra=k) for e, k in ends]

    def _names(self, x: Text) -> list[Span]:
        """All runs of up to four words that may be a name, with initials."""
        n = len(x.words)
        fits = [self._fits(x, i) for i in range(n)]
        out, i = [], 0
        while i < n:
            if not fits[i]:
                i += 1
                continue
            j = i
            while j + 1 < n and fits[j + 1]:
                gap = x.t[x.ends[j] : x.starts[j + 1]]
                if gap != " " and not (gap in (". ", ".") and len(x.words[j]) <= 2):
                    break
                j += 1
            for a in range(i, j + 1):
                for b in range(a, min(a + 4, j + 1)):
                    if any(len(x.words[k]) > 1 for k in range(a, b + 1)):
                        out.append(Span(x.starts[a], x.ends[b], "name", 7, extra=(float(a > i), float(b < j), float(j - i + 1))))
            i = j + 1
        return out

    def _fits(self, x: Text, i: int) -> bool:
        c, w = x.cls[i], x.raw[i]
        if c == "number" or c in _NEVER or x.t[x.starts[i] - 1 : x.starts[i]] in ("@", "#", "_"):
            return False
        if c == "letter":
            return w.isupper() or x.caseless
        if c in ("unknown", "proper"):
            return True
        if c not in ("common", "hinglish", "time"):
            return False
        if i and x.cls[i - 1] in ("honorific", "naming"):
            return True
        return w[0].isupper() and not x.caseless

    # features

    def context(self, x: Text, s: Span) -> list[tuple]:
        """The keys under which the training texts count what stands around a span."""
        (p1, c1), (p2, c2) = x.at(s.lo - 1, s.lo), x.at(s.lo - 2, s.lo)
        (n1, d1), (n2, d2) = (x.at(s.hi, s.hi - 1), x.at(s.hi + 1, s.hi - 1)) if s.hi > s.lo else (("<e>", "<e>"), ("<e>", "<e>"))
        k = s.kind
        return [(k, "p", p1), (k, "pc", c1), (k, "pp", c2, p1), (k, "ppc", c2, c1), (k, "n", n1), (k, "nc", d1), (k, "nn", n1, d2), (k, "nnc", d1, d2), (k, "pn", c1, d1)]

    def describe(self, x: Text, spans: list[Span]) -> None:
        t = x.t
        holders = sorted((a.start, a.end) for a in spans if a.kind in ("email", "address"))
        reach, most = [], 0
        for _, e in holders:
            most = max(most, e)
            reach.append(most)
        for s in spans:
            body = t[s.start : s.end]
            inner = range(s.lo, s.hi)
            kinds = [x.cls[i] for i in inner]
            groups = [len(x.words[i]) for i in inner if x.cls[i] == "number"]
            digits = "".join(x.words[i] for i in inner if x.cls[i] == "number")
            held = bisect_left(holders, (s.start + 1, 0)) - 1
            before = t[max(0, s.start - 2) : s.start]
            raw = [x.raw[i] for i in inner]
            odds = [self.odds.get(key, 0.0) for key in self.context(x, s)]
            s.x = [
                float(s.how),
                *s.extra,
                len(body),
                len(digits),
                len(groups),
                groups[0] if groups else 0,
                groups[-1] if groups else 0,
                float(body.startswith("+")),
                float(digits[:1] or -1),
                float(digits[:2] or -1),
                float(bool(groups) and set(groups) == {4}),
                sum(c.isalpha() for c in body),
                len(inner),
                float(x.caseless),
                sum(w[0].isupper() for w in raw) / (len(raw) or 1),
                float(not body.isascii()),
                kinds.count("unknown"),
                kinds.count("proper"),
                kinds.count("common") + kinds.count("hinglish") + kinds.count("time"),
                kinds.count("letter"),
                kinds.count("street"),
                kinds.count("building"),
                float("firm" in kinds),
                float(kinds[0] == "firm" or kinds[-1] == "firm") if kinds else 0.0,
                float("@" in body),
                float(bool(before) and before[-1] in "-/#_:" and before[0].isalnum()),
                float(t[s.end : s.end + 1] in ("/", "-", "%", "@") and s.end < len(t)),
                self._near(x, s, "phoneword"),
                self._near(x, s, "idword"),
                self._near(x, s, "refword"),
                self._near(x, s, "addrword"),
                self._near(x, s, "mailword"),
                self._near(x, s, "motion"),
                self._near(x, s, "comm"),
                *[float(x.at(s.lo - 1, s.lo)[1] == c) for c in ("honorific", "kin", "role", "prep", "firm", "<e>", "<b>")],
                *[float(s.hi > s.lo and x.at(s.hi, s.hi - 1)[1] == c) for c in ("firm", "street", "building", "product", "role", "<e>", "<b>")],
                *odds,
                *self._shape(x, s),
                float(s.kind not in ("email", "address") and held >= 0 and reach[held] >= s.end),
            ]

    def _near(self, x: Text, s: Span, cue: str) -> float:
        """How many words before the span the nearest cue stands, negative after it; 9 for none."""
        cues = _CUES[cue]
        for k in range(1, REACH + 1):
            w, c = x.at(s.lo - k, s.lo)
            if c in ("<b>", "<e>"):
                break
            if w in cues:
                return float(k)
        for k in range(REACH - 2):
            if s.hi == s.lo:
                break
            w, c = x.at(s.hi + k, s.hi - 1)
            if c in ("<b>", "<e>"):
                break
            if w in cues:
                return float(-1 - k)
        return 9.0

    def _shape(self, x: Text, s: Span) -> list[float]:
        """For names: how the words end, against those of other unknown words, and as towns do."""
        if s.kind != "name":
            return [0.0, 0.0, 0.0, 0.0]
        words = [x.words[i] for i in range(s.lo, s.hi) if len(x.words[i]) > 1]
        scores = [self.endings.get(w[-3:], 0.0) + self.endings.get(w[-2:], 0.0) + self.endings.get("^" + w[:2], 0.0) for w in words]
        places = sum(w.endswith(_PLACE_ENDS) and len(w) > 4 for w in words)
        return [sum(scores) / len(scores), min(scores), float(places), sum(self.vocabulary.get(w, -3.0) for w in words) / len(words)]

    # training

    def fit(self, labelled: list[tuple[str, list[tuple[int, int, str]]]]) -> Detector:
        """``labelled``: texts with their true spans. A third each gives the odds of contexts, trains
        the trees, and calibrates them and sets the thresholds."""
        third = len(labelled) // 3
        counts: dict[tuple, list[int]] = {}
        ends: dict[str, list[int]] = {}
        sets: dict[str, list[list]] = {k: [[], [], [], []] for k in KINDS}
        for text, true in labelled[:third]:
            x = Text(text, self)
            for s in self.candidates(x):
                y = _is_true(s, true)
                for key in self.context(x, s):
                    counts.setdefault(key, [0, 0])[y] += 1
                if s.kind == "name":
                    for i in range(s.lo, s.hi):
                        w = x.words[i]
                        if len(w) > 2 and w.isascii():
                            for e in (w[-3:], w[-2:], "^" + w[:2]):
                                ends.setdefault(e, [0, 0])[y] += 1
        # Odds are relative to those of the kind, so that a context never seen says nothing.
        share = {}
        for kind in KINDS:
            a, b = (sum(c[y] for key, c in counts.items() if key[:2] == (kind, "pc")) for y in (0, 1))
            share[kind] = (b + 1.0) / (a + b + 2.0)

        def lift(c: list[int], p: float, weight: float) -> float:
            return float(np.clip(np.log((c[1] + weight * p) / (c[0] + weight * (1 - p))) - np.log(p / (1 - p)), -4, 4))

        self.odds = {k: lift(c, share[k[0]], 4.0) for k, c in counts.items() if sum(c) > 2}
        self.endings = {k: lift(c, share["name"], 8.0) for k, c in ends.items()}
        for n, (text, true) in enumerate(labelled[third:]):
            part = 2 * int(n >= third)
            x = Text(text, self)
            spans = self.candidates(x)
            self.describe(x, spans)
            for s in spans:
                sets[s.kind][part].append(s.x)
                sets[s.kind][part + 1].append(_is_true(s, true))
        for kind in KINDS:
            x, y, hx, hy = (np.array(v, dtype=float) for v in sets[kind])
            self.trees[kind] = fit_boosted(x, y, rounds=80, depth=5, rate=0.15)
            score = self.trees[kind].score(hx)
            self.platt[kind] = calibrate(score, hy)
            a, b = self.platt[kind]
            self.threshold[kind] = best_threshold(_probability(a * score + b), hy, BETA)
        return self

    # use

    def find(self, texts: list[str | None]) -> list[list[Span]]:
        """The spans to redact in each text, without overlaps, in order."""
        per: list[list[Span]] = []
        for text in texts:
            if not text or not text.strip():
                per.append([])
                continue
            x = Text(text, self)
            spans = self.candidates(x)
            self.describe(x, spans)
            per.append(spans)
        chance: dict[int, float] = {}
        for kind in KINDS:
            own = [s for spans in per for s in spans if s.kind == kind]
            if own:
                a, b = self.platt[kind]
                p = _probability(a * self.trees[kind].score(np.array([s.x for s in own])) + b)
                chance.update({id(s): float(v) for s, v in zip(own, p, strict=True)})
        out = []
        for spans in per:
            good = [s for s in spans if chance[id(s)] >= self.threshold[s.kind]]
            starts: list[int] = []
            taken: list[Span] = []
            for s in sorted(good, key=lambda s: (s.kind != "email", s.kind != "address", -chance[id(s)], s.start - s.end)):
                k = bisect_left(starts, s.end)
                if not k or taken[k - 1].end <= s.start:
                    k = bisect_left(starts, s.start)
                    starts.insert(k, s.start)
                    taken.insert(k, s)
            out.append(taken)
        return out

    def redact(self, text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for s in spans:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        return "".join(out) + text[at:]


def _probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def _is_true(s: Span, true: list[tuple[int, int, str]]) -> int:
    """A candidate is right if what it shares with a true span of its kind is most of both."""
    for a, b, kind in true:
        both = min(b, s.end) - max(a, s.start)
        if kind == s.kind and both > 0 and both >= 0.75 * (b - a) and both >= 0.75 * (s.end - s.start):
            return 1
    return 0


@lru_cache(maxsize=4)
def train(n: int = TRAINING_TEXTS, seed: int = 5) -> Detector:
    return Detector().fit(training_texts(n, seed))


# Spark ---------------------------------------------------------------------------------------

SCHEMA = "redacted string, kinds array<string>, found array<struct<start:int,end:int,kind:string>>"


def redact_text(df: DataFrame, text_col: str, detector: Detector | None = None) -> DataFrame:
    """``df`` with a column ``pii``: redacted text, the kinds found, and the spans.

    The detector (a few MB, bounded by its training texts and the public vocabulary) is trained on the
    driver and broadcast; Arrow batches of whole texts are searched in Python workers. Null texts give
    a null redacted text and no kinds; blank ones come back unchanged. Placeholders are the kind in
    brackets, such as [PHONE]; everything else stays as it is. Other columns pass; where there is a
    column ``pii`` already, ValueError is raised.
    """
    if "pii" in {c.lower() for c in df.columns}:
        raise ValueError("the input already has a column pii")
    shared = df.sparkSession.sparkContext.broadcast(detector or train())

    @F.pandas_udf(SCHEMA)
    def pii(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        det = shared.value
        for texts in batches:
            values = [None if t is None else str(t) for t in texts]
            found = det.find(values)
            yield pd.DataFrame(
                {
                    "redacted": [None if t is None else det.redact(t, s) for t, s in zip(values, found, strict=True)],
                    "kinds": [sorted({x.kind for x in s}) for s in found],
                    "found": [[{"start": x.start, "end": x.end, "kind": x.kind} for x in s] for s in found],
                }
            )

    return df.withColumn("pii", pii(F.col(f"`{text_col}`")))
