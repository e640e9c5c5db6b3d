"""Finds licences in texts: identifiers in tags, and notices by sparse TF-IDF cosine to templates, with hard tests of versions, telling words and negations.

Weights are inverse document frequencies over the templates, so the verdict on a text is its own: it changes with no other file. A word of no template has a fixed weight.
"""

from __future__ import annotations

import re
from math import sqrt

import numpy as np

from .bytetext import ALNUM, LOWER, hashed_words, span_hashes, words
from .license_texts import MONTHS, NEGATIONS, NO_NEGATIONS, OTHER_IDENTIFIERS, TELLING

#: Weight of a word that no template has; template words weigh 1 to about 6.
OTHER = 2.5
#: Templates of fewer words count only word for word.
WORD_FOR_WORD = 5
#: Within templates of at most so many words a negation counts wherever it stands.
SHORT = 12
#: Words after a notice that may still name its version.
AFTER = 8
#: Bytes before a notice in which its clause is sought.
CLAUSE_BYTES = 4096

TAG = re.compile(rb"spdx-license-identifier:", re.IGNORECASE)
FIELD = re.compile(rb"^[ \t#*/;\"'-]*licen[cs]e(?:-expression)?[\"']?[ \t]*[:=][ \t]*[\"']?([a-z0-9(][a-z0-9.+:() -]*)[\"']?[,;.]?[ \t]*\r?$", re.IGNORECASE | re.MULTILINE)
TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
SUFFIX = re.compile(r"(-only|-or-later|\+)$", re.IGNORECASE)
REFERENCE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+$", re.IGNORECASE)
VERSION = re.compile(rb"(?<![a-z0-9.])v?(\d{1,2}(?:\.\d{1,2})*)(?![a-z0-9])(?!\.\d)(?!\s+(?:%s))" % "|".join(MONTHS).encode())
LICENSE_VERSION = re.compile(rb"licen[cs]e\W+(?:\(\w+\)\W+)?(?:version|v)\W*(\d+(?:\.\d+)*)")
BREAK = re.compile(rb"[.;:!?](?=\s)|\n[^\w\n]*\n|\n\W*(?=[A-Z])|\b(?:but|however|instead|rather)\b")
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def identifier(word: str, known: dict[str, str]) -> str | None:
    """The identifier that a word of a tag stands for, with its -only, -or-later or +; references to own licences as they are."""
    word = word.rstrip(".:")
    suffix = SUFFIX.search(word)
    name = known.get(word.lower()) or (known.get(word[: suffix.start()].lower()) if suffix else None)
    if name is not None:
        return name if word.lower() == name.lower() else name + suffix[0].lower()
    return word if REFERENCE.match(word) else None


def expression(raw: bytes, at: int, known: dict[str, str]) -> tuple[str | None, int]:
    """The longest expression of known identifiers that begins at a place, and its end. One with an unknown identifier after AND, OR or WITH in capitals is none at all."""
    out: list[str] = []
    depth, wanted, lower, found = 0, True, False, (None, at)
    while m := TOKEN.match(raw, at):
        word, at = m[1].decode(), m.end()
        if wanted and word == "(":
            depth += 1
        elif wanted:
            name = word.rstrip(".") if out[-1:] == ["WITH"] else identifier(word, known)
            if name is None:
                return found if out and lower else (None, at)
            word, wanted = name, False
        elif word == ")" and depth:
            depth -= 1
        elif word in ("AND", "OR", "WITH", "and", "or", "with"):
            lower, word, wanted = word.islower(), word.upper(), True
        else:
            break
        out.append(word)
        if not depth and not wanted:
            found = (" ".join(out).replace("( ", "(").replace(" )", ")"), at)
    return found


def tagged(raw: bytes, known: dict[str, str]) -> str | None:
    """The expression of the first tag that gives one: after SPDX-License-Identifier, or alone on a line after "license:" or "license =". known: identifiers by their lower case."""
    for m in TAG.finditer(raw):
        if name := expression(raw, m.end(), known)[0]:
            return name
    for m in FIELD.finditer(raw):
        name, end = expression(m[1], 0, known)
        if name and not m[1][end:].strip(b" .)"):
            return name
    return None


def plain(number: str) -> str:
    """A version without zeros at its end: 2.0 is 2."""
    return re.sub(r"(\.0+)+$", "", number)


def whole_number(raw: bytes, end: int) -> int:
    """Where a version ends of which a word ends at ``end``."""
    return end + re.match(rb"(?:\.\d+)*", raw[end : end + 16]).end()


def versions(lower: bytes) -> set[str]:
    return {plain(m[1].decode()) for m in VERSION.finditer(lower)}


def telling(lower: bytes) -> set[str]:
    line = f" {' '.join(w.decode(errors='replace') for w in WORD.findall(lower))} "
    return {t for t in TELLING if f" {t} " in line}


_negation = re.compile(rb"\b(?:%s)\b" % "|".join(NEGATIONS).encode())
_idioms = re.compile(rb"\b(?:%s)\b" % "|".join(NO_NEGATIONS).replace(" ", r"\s+").encode())


def negations(lower: bytes) -> int:
    return len(_negation.findall(_idioms.sub(b" ", lower)))


class Notices:
    """Templates as unit vectors over the hashes of their words, with what their notices must and must not have."""

    def __init__(self, texts: dict[str, str]):
        pairs = [(name, v.lower().encode()) for name, variants in texts.items() for v in variants.split("|")]
        self.names, self.known = [p[0] for p in pairs], {x.lower(): x for x in (*OTHER_IDENTIFIERS, *texts)}
        terms = [hashed_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), ALNUM)[0] for _, t in pairs]
        self.lengths = [len(t) for t in terms]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
        counts = np.array([np.bincount(np.searchsorted(self.vocabulary, t), minlength=len(self.vocabulary)) for t in terms], float).reshape(len(terms), len(self.vocabulary))
        idf = np.log((len(terms) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1
        self.weights, self.distinct = np.append(idf, OTHER), (counts > 0).sum(axis=1)
        vectors = counts * idf
        self.vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)
        self.squares = (self.vectors**2).T.astype(np.float32)
        self.versions, self.telling, self.negations = [versions(t) for _, t in pairs], [telling(t) for _, t in pairs], [negations(t) for _, t in pairs]
        own = [re.search(r"-(\d+(?:\.\d+)*)", n) for n in self.names]
        self.version = [plain(m[1]) if m else None for m in own]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary; its length for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def possible(self, place: np.ndarray, before: np.ndarray, accept: float) -> list[tuple[int, np.ndarray]]:
        """(row, templates) that could reach ``accept``: a stretch's cosine is at most the length of the template's vector over the words that the text has."""
        out, size = [], len(self.vocabulary)
        for a in range(0, len(before) - 1, 4096):
            b = min(a + 4096, len(before) - 1)
            has = np.zeros((b - a, size + 1), np.float32)
            has[np.repeat(np.arange(b - a), np.diff(before[a : b + 1])), place[before[a] : before[b]]] = 1
            could = has[:, :size] @ self.squares >= accept**2 - 1e-3
            out += [(a + int(r), np.flatnonzero(could[r])) for r in np.flatnonzero(could.any(axis=1))]
        return out

    def fits(self, raw: bytes, k: int, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bool:
        """Whether words a to b of a text are a notice of template k by version, telling words and negations."""
        s, e = int(starts[a]), int(ends[b - 1])
        lower = raw[s:e].lower()
        if not self.versions[k] <= versions(raw[s : whole_number(raw, e)].lower()) or telling(lower) != self.telling[k]:
            return False
        if self.version[k] and not self.versions[k]:
            # A stretch may end some words before the version.
            named = LICENSE_VERSION.search(raw[s : whole_number(raw, int(ends[min(b + AFTER, len(ends)) - 1]))].lower())
            if named and plain(named[1].decode()) != self.version[k]:
                return False
        if negations(lower if self.lengths[k] <= SHORT else raw[s : int(ends[min(a + 3, b) - 1])].lower()) > self.negations[k]:
            return False
        before = raw[max(0, s - CLAUSE_BYTES) : s]
        clause = max((m.end() for m in BREAK.finditer(before)), default=0)
        return not negations(before[clause:].lower())

    def best(self, raw: bytes, k: int, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, accept: float) -> tuple[float, int, int] | None:
        """(score, first word, word after the last) of the best stretch of a text that is a notice of template k and has half of its words: the most similar, then the first."""
        n, total = self.lengths[k], len(place)
        if not n or 2 * total < n:
            return None
        first = np.arange(max(1, total - n + 1))
        last = np.minimum(first + n, total)
        squares = np.concatenate([[0], (self.weights[place] ** 2).cumsum()])
        dots = np.concatenate([[0], np.append(self.vectors[k] * self.weights[:-1], 0.0)[place].cumsum()])
        most = (dots[last] - dots[first]) / np.sqrt(squares[last] - squares[first])
        accept = 1 - 1e-9 if n < WORD_FOR_WORD else accept
        hits = np.flatnonzero(most >= accept - 1e-6)
        found: tuple[float, int, int] | None = None
        # A word that is repeated lowers a stretch's cosine below ``most``, so the search goes on until no stretch left can be better.
        for i in hits[np.lexsort([hits, -np.round(most[hits], 9)])].tolist():
            if found and most[i] < found[0] - 1e-7:
                break
            a, b = int(first[i]), int(last[i])
            at, count = np.unique(place[a:b], return_counts=True)
            inside = at < len(self.vocabulary)
            values = count[inside] * self.weights[at[inside]]
            # Words of no template are told apart by their hashes only where there are several.
            other = self.others(starts[a:b], ends[a:b], raw, place[a:b])
            score = round(float(self.vectors[k, at[inside]] @ values) / sqrt(max(float((values**2).sum()) + other * OTHER**2, 1e-300)), 12)
            shared = 2 * int((self.vectors[k, at[inside]] > 0).sum()) >= self.distinct[k]
            if shared and score >= accept - 1e-12 and (found is None or (-score, a) < (-found[0], found[1])) and self.fits(raw, k, starts, ends, a, b):
                found = (min(score, 1.0), a, b)
        return found

    def others(self, starts: np.ndarray, ends: np.ndarray, raw: bytes, place: np.ndarray) -> float:
        """The sum of squared counts of the words that no template has."""
        away = np.flatnonzero(place == len(self.vocabulary))
        counts: dict[bytes, int] = {}
        for s, e in zip(starts[away].tolist(), ends[away].tolist(), strict=True):
            w = raw[s:e].lower()
            counts[w] = counts.get(w, 0) + 1
        return float(sum(c * c for c in counts.values()))

    def decide(self, data: np.ndarray, at: np.ndarray, accept: float, margin: float) -> list[tuple[str | None, float]]:
        """(licence, score) of each text."""
        raw, n = data.tobytes(), len(at) - 1
        out: list[tuple[str | None, float]] = [(None, 0.0)] * n
        tags = set()
        hints = LOWER[data].tobytes() if n else b""
        for r in range(n):
            a, b = int(at[r]), int(at[r + 1])
            if hints.find(b"licen", a, b) >= 0 and (name := tagged(raw[a:b], self.known)):
                out[r] = (name, 1.0)
                tags.add(r)
        if not len(self.vocabulary):
            return out
        starts, ends, before = words(data, at, ALNUM)
        place = self.places(span_hashes(data, starts, ends))
        for r, templates in self.possible(place, before, accept):
            if r not in tags:
                i, j, s = int(before[r]), int(before[r + 1]), int(at[r])
                out[r] = self.verdict(raw[s : int(at[r + 1])], templates, place[i:j], starts[i:j] - s, ends[i:j] - s, accept, margin)
        return out

    def verdict(self, raw: bytes, templates: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, accept: float, margin: float) -> tuple[str | None, float]:
        """The licence of the best notice, unless another licence's is as good at the same place."""
        by: dict[str, tuple[float, int, str, int]] = {}
        for k in templates.tolist():
            if hit := self.best(raw, k, place, starts, ends, accept):
                name = self.names[k]
                by[name] = min(by.get(name, (1.0, 0, "", 0)), (-hit[0], hit[1], name, hit[2]))
        found = sorted(by.values())
        if not found:
            return None, 0.0
        score, a, name, b = found[0]
        second = max([-x[0] for x in found[1:] if x[1] < b and x[3] > a], default=0.0)
        return (name if -score - second >= margin else None), -score

