"""Toxicity from a lexicon, its misspellings and the words around them.

The lexicon is a trie of whole words and of stems (a stem matches every word
that begins with it). Levenshtein automata of the words are intersected with
that trie (one edit in words of five letters, two in words of ten); the product is
determinised as it is walked, so that a word costs one table look-up per character
and most words leave the table after three or four. Words disguised by digits and
signs for letters, or by signs between letters, are unfolded and looked up, too.

A hit counts with its term's weight, less for a misspelling or disguise, less where
it lies in quotation marks or the words around it report it rather than use it,
more where they address someone. Two sums per document, over exact and over other
hits, go through a logistic model.

Lexicon and model are fitted on labelled rows, at most ``fit_rows`` of them (the
ones with the smallest hashes of their ids); scoring reads every whole text.

Defined cases: a null, empty or wordless text has no hits and gets the model's
base score; a text of any length is read whole; repeated rows are scored alike; of
terms that a word is equally near to the heavier, then the first by letters counts;
a label that two rows give differently counts both ways; without labelled rows of
both classes the lexicon is the built-in one and the model a fixed prior; other
columns pass unchanged except ``score``, which is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"([^\W\d_]+)")
QUOTE_MARKS = "\"'`«»‘’‚“”„‹›"
#: Marks that open a quotation, and those that may close it, within a line.
CLOSES = {'"': '"', "“": "”", "«": "»", "„": "“”"}
MARK = re.compile('["“”«»„\n]')
#: Digits and signs that stand for letters; 1 may be either of two.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: A word with such signs, each run of them before a letter; and four single letters or more with one sign between them.
DISGUISED = re.compile(r"(?<![\w@$!])[^\W\d_]*+(?:[0134578@$!]++[^\W\d_]++)++(?![\w@$])")
#: What any such word holds.
SIGN_THEN_LETTER = re.compile(r"[0134578@$!][^\W\d_]")
#: Words of letters with one sign or more between them.
CUT = re.compile(r"(?<![\w\-*·|~])[^\W\d_]++(?:[-_*·|~][^\W\d_]++)++(?![\w\-*·|~])")
#: What any such text holds.
SEPARATED = re.compile(r"[-_*·|~][^\W\d_]")
#: A letter three times or more.
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
#: What shows nothing between two letters.
INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
HAS_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
SPREAD = re.compile(r"(?<![\w@$!.\-*])[^\W_]([.\-_*·|~ ])[^\W_](?:\1[^\W_]){2,}(?![^\W_])")
REPORTING = frozenset("said says say quote quoted quotes word words term called wrote writes cited example zitat sagte wort dit cité mot dijo palabra cita".split())
ADDRESS = frozenset("you your youre ur du dich dein sie tu toi ton vous votre usted tú".split())
#: Terms that hold where nothing can be learned.
SEED_TERMS = ("idiot", "moron", "stupid", "pathetic", "worthless", "scum")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


class Matches(dict):
    """What words match, remembered up to a bound."""

    def __init__(self, match, most: int = 300_000):
        self.match, self.most = match, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self.match(word)
        if len(word) <= 40:
            self[word] = found
        return found


class Pieces:
    """Which words are terms as they stand, and which may be misspellings, by what edits leave of a term.

    A term has four parts. One edit lies in one of them, and what stands before and
    behind that part is a word's start and end. Two edits lie in one or two of them; a
    part between the two is at most one place from where it was. (Before that is looked
    at, two edits must have left one of three thirds, at most two places from where it
    was.) A word of the right length that shows what is left for some place of the edits
    may be the term, and the automata decide; any other word is not.
    """

    def __init__(self, terms: Iterable[Term], edits):
        self.words: dict[str, Term] = {}
        stems: defaultdict[int, dict[str, Term]] = defaultdict(dict)
        # Word length and edits; (start, end and middle of what is left), the texts there.
        shapes: defaultdict = defaultdict(lambda: defaultdict(set))
        thirds: defaultdict = defaultdict(lambda: defaultdict(set))
        for term in terms:
            t, m, k = term.text, len(term.text), edits(term)
            if term.stem:
                stems[m].setdefault(t, term)
                continue
            if t not in self.words or (term.weight, t) > (self.words[t].weight, t):
                self.words[t] = term
            cut, third = [m * i // 4 for i in range(5)], [0, m // 3, 2 * m // 3, m]
            for length in range(m - k, m + k + 1) if k else ():
                for first in range(4):
                    last = min(3, first + k - 1)
                    shapes[length, k][cut[first], m - cut[last + 1], 0, 0].add(t[: cut[first]] + t[cut[last + 1] :])
                    for far in range(first + 2, 4) if k > 1 else ():  # one edit in each of two parts that are apart
                        for a in (cut[first + 1] - 1, cut[first + 1], cut[first + 1] + 1):
                            size = cut[far] - cut[first + 1]
                            shapes[length, k][cut[first], m - cut[far + 1], a, a + size].add(t[: cut[first]] + t[cut[far + 1] :] + t[cut[first + 1] : cut[far]])
                if k > 1:
                    thirds[length][0, third[1]].add(t[: third[1]])
                    thirds[length][length - (m - third[2]), length].add(t[third[2] :])
                    for a in range(max(0, third[1] - 2), third[1] + 3):
                        thirds[length][a, a + third[2] - third[1]].add(t[third[1] : third[2]])
        self.stems = sorted(stems.items())
        self.shapes = {n: list(by.items()) for n, by in shapes.items()}
        self.thirds = {n: list(by.items()) for n, by in thirds.items()}

    def exact(self, word: str) -> Term | None:
        """The shortest stem that ``word`` starts with, else the word that it is."""
        for size, found in self.stems:
            if (term := found.get(word[:size])) is not None:
                return term
        return self.words.get(word)

    def may(self, word: str) -> bool:
        n = len(word)
        for (start, end, _, _), found in self.shapes.get((n, 1), ()):
            if word[:start] + word[n - end :] in found:
                return True
        for (a, b), found in self.thirds.get(n, ()):
            if word[a:b] in found:
                break
        else:
            return False
        for (start, end, a, b), found in self.shapes[n, 2]:
            if word[:start] + word[n - end :] + word[a:b] in found:
                return True
        return False


class FuzzyTrie:
    """Terms in a trie, walked by all their Levenshtein automata at once.

    A state is the set of (trie node, edits so far) that the word's prefix can
    be in. Words of ``once`` letters and more may be one edit away, of ``twice``
    and more two; stems and shorter words must be exact.
    """

    def __init__(self, terms: Iterable[Term], once: int = 5, twice: int = 10, most_states: int = 50_000):
        terms = list(terms)
        self.most_states = most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: defaultdict[int, list[Term]] = defaultdict(list)  # a stem may be a word, too
        self.least = (once, twice)
        for term in terms:
            node = 0
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node].append(term)
        # The most edits of any word that a node lies on the way to; children have higher numbers.
        self.bend = [max(map(self._edits, self.ends.get(node, ())), default=0) for node in range(len(self.children))]
        for node in range(len(self.children) - 1, -1, -1):
            self.bend[node] = max([self.bend[node], *(self.bend[child] for child in self.children[node].values())])
        self.pieces = Pieces(terms, self._edits)
        self.codes = list(range(4 * len(self.children)))  # a node and its edits, as numbers that all states share
        self._begin()
        self.known = Matches(self.match_repeated)

    def _begin(self) -> None:
        """No states but the first: words are without end, and what they lead to is kept up to a bound."""
        self.states: dict[tuple[int, ...], int] = {}
        self.sets: list[tuple[int, ...]] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[Term, int] | None] = []
        self.stemmed: list[Term | None] = []
        self.start = self._state({0: 0})

    def _edits(self, term: Term) -> int:
        """How many edits away a term may be."""
        return 0 if term.stem else sum(len(term.text) >= n for n in self.least)

    def _state(self, places: dict[int, int]) -> int:
        """The state of the fewest edits by node, with what leaving out letters of the terms reaches."""
        queue = list(places)
        for node in queue:
            for child in self.children[node].values():
                edits = places[node] + 1
                if edits <= self.bend[child] and edits < places.get(child, 99):
                    places[child] = edits
                    queue.append(child)
        key = tuple([self.codes[4 * node + edits] for node, edits in sorted(places.items())])
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(t, e) for n, e in places.items() for t in self.ends.get(n, ()) if e <= self._edits(t)]
            self.found.append(min(ends, key=lambda x: (x[1], -x[0].weight, x[0].text), default=None))
            self.stemmed.append(next((t for t, e in ends if t.stem and not e), None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        """The state after one more letter; -1 if no term can follow."""
        places: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.bend[node] and edits < places.get(node, 99):
                places[node] = edits

        for code in self.sets[state]:
            node, edits = code >> 2, code & 3
            reach(node, edits + 1)  # a letter too many
            for other, child in self.children[node].items():
                reach(child, edits + (other != c))
        after = self._state(places) if places else -1
        if len(self.next[state]) < 4096:  # letters of a text are without bound; the table isn't
            self.next[state][c] = after
        return after

    def match_repeated(self, word: str) -> tuple[Term, int] | None:
        """As ``match``; a word of long runs of a letter may also be a term, one edit away, with one or two in their place."""
        found = self.match(word)
        if found is None and REPEATED.search(word):
            for times in (r"\1", r"\1\1"):
                hit = self.match(REPEATED.sub(times, word))
                if hit and not hit[1]:
                    return hit[0], 1
        return found

    def match(self, word: str) -> tuple[Term, int] | None:
        """The term that ``word`` is, and how many edits away."""
        if (term := self.pieces.exact(word)) is not None:
            return term, 0
        if not self.pieces.may(word):
            return None
        if len(self.sets) > self.most_states:
            self._begin()
        state = self.start
        for c in word:
            after = self.next[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return None
            if self.stemmed[state] is not None:
                return self.stemmed[state], 0
        return self.found[state]


def quotations(low: str) -> list[tuple[int, int]]:
    """Spans of quotations, each within a line, from left to right, in one pass back for the closing marks and one on."""
    marks = [(m.start(), m.group()) for m in MARK.finditer(low)]
    closing: list[int | None] = [None] * len(marks)
    last: dict[str, int] = {}
    for i in range(len(marks) - 1, -1, -1):
        mark = marks[i][1]
        if mark == "\n":
            last.clear()
        else:
            closing[i] = min((last[c] for c in CLOSES.get(mark, "") if c in last), default=None)
            last[mark] = i
    spans, i = [], 0
    while i < len(marks):
        if (end := closing[i]) is not None:
            spans.append((marks[i][0], marks[end][0] + 1))
            i = end
        i += 1
    return spans


def unfolded(word: str) -> list[str]:
    """What a disguised word may stand for."""
    plain = "".join(STANDS_FOR.get(c, c) for c in word if c.isalnum() or c in STANDS_FOR)
    return [plain, "".join("l" if c == "1" else STANDS_FOR.get(c, c) for c in word if c.isalnum() or c in STANDS_FOR)] if "1" in word else [plain]


def disguised(low: str, words: set[str], match, known: Matches | None = None) -> list[tuple[int, int, Term]]:
    """Places of terms (as they are, not misspelled) under digits, signs and separators. ``words``: those of the text; ``known``: what words match, where that is remembered."""
    out = []
    patterns = [DISGUISED] if SIGN_THEN_LETTER.search(low) else []
    if sum(len(w) == 1 for w in words) > 1:  # no term is one letter over and over
        patterns.append(SPREAD)
    for pattern in patterns:
        for m in pattern.finditer(low):
            hit = next((h for h in map(match, unfolded(m.group())) if h and not h[1]), None)
            if hit:
                out.append((m.start(), m.end(), hit[0]))
    for m in CUT.finditer(low) if SEPARATED.search(low) else ():
        parts = TOKEN.findall(m.group())
        if not any(map(match if known is None else known.__getitem__, parts)):  # else a part is counted itself
            hit = match("".join(parts))
            if hit and not hit[1]:
                out.append((m.start(), m.end(), hit[0]))
    return out


def context_factor(text: str, start: int, end: int, before: list[str], after: list[str], quoted: list[tuple[int, int]]) -> float:
    """How much a hit from ``start`` to ``end`` counts for the words on either side of it."""
    near = before + after
    marked = start and text[start - 1] in QUOTE_MARKS and text[end : end + 1] in tuple(QUOTE_MARKS)
    factor = 0.3 if marked or any(a < start and end < b for a, b in quoted) else 0.6 if any(w in REPORTING for w in near) else 1.0
    return factor * (1.25 if any(w in ADDRESS for w in near) else 1.0)


def evidence(text: str | None, trie: FuzzyTrie, window: int = 5, misspelled: float = 0.5) -> tuple[float, float]:
    """Weighted exact and other hits of a text; ``misspelled`` is what each edit leaves of a weight, or a disguise."""
    if not text:
        return 0.0, 0.0
    low = text.lower()
    if not low.isascii() and HAS_INVISIBLE.search(low):
        low = low.translate(INVISIBLE)
    parts = WORDS.split(low)  # what stands between words, and words, in turn
    words, known = parts[1::2], trie.known
    seen = set(words)
    hits = {w: m for w in seen if (m := known[w])}
    hidden = disguised(low, seen, trie.match, known)
    if not hits and not hidden:
        return 0.0, 0.0
    starts = list(accumulate(map(len, parts)))[:-1:2]
    found = [(starts[at], starts[at] + len(w), at, at + 1, *hits[w]) for at, w in enumerate(words) if w in hits]
    found += [(a, b, bisect_left(starts, a), bisect_left(starts, b), term, 1) for a, b, term in hidden]
    quoted = quotations(low)
    opens = [a for a, _ in quoted]
    sums = [0.0, 0.0]
    for start, end, first, last, term, edits in found:
        around = quoted[max(0, bisect_left(opens, start) - 1) :][:1]
        factor = context_factor(low, start, end, words[max(0, first - window) : first], words[last : last + window], around)
        sums[edits > 0] += term.weight * misspelled**edits * factor
    return sums[0], sums[1]


def _counts(max_prefix: int):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        forms: defaultdict = defaultdict(set)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(TOKEN.findall((text or "").lower()))
                seen.update(("w", w, toxic) for w in words)
                stems = {w[:n] for w in words for n in range(4, max_prefix + 1) if len(w) > n}
                seen.update(("s", s, toxic) for s in stems)
                if toxic:
                    for w in words:
                        for n in range(4, min(max_prefix, len(w) - 1) + 1):
                            if len(forms[w[:n]]) < 3:
                                forms[w[:n]].add(w)
        rows = [(k, t, x, n, sorted(forms.get(t, ())) if k == "s" and x else []) for (k, t, x), n in seen.items()]
        yield pd.DataFrame(rows, columns=["kind", "term", "toxic", "n", "forms"])

    return counted


def learn_terms(labelled: DataFrame, *, least_docs: int = 4, precision: float = 0.9, max_prefix: int = 6) -> list[Term]:
    """Words and stems that occur almost only in toxic rows of ``labelled``
    (columns ``text``, ``toxic``), with smoothed log odds as weights.

    Words of any length that a stem covers stay beside it, for their misspellings."""
    counts = labelled.mapInPandas(_counts(max_prefix), "kind string, term string, toxic int, n long, forms array<string>")
    toxic = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    total = F.sum("n")
    found = (
        counts.groupBy("kind", "term").agg(toxic.alias("toxic"), total.alias("total"), F.size(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("n_forms"))
        .where((F.col("toxic") >= least_docs) & (F.col("toxic") >= precision * F.col("total")) & ((F.col("kind") == "w") | (F.col("n_forms") >= 3)))
        .orderBy(F.desc("toxic"), "kind", "term").collect()
    )  # fmt: skip; no more than the labelled rows hold
    stems = sorted((r.term for r in found if r.kind == "s"), key=lambda s: (len(s), s))
    short = [s for i, s in enumerate(stems) if not any(s.startswith(x) for x in stems[:i])]
    support = {r.term: r.toxic for r in found if r.kind == "s"}
    # A stem is taken as long as it can be without losing a document.
    short = [max((x for x in stems if x.startswith(s) and support[x] == support[s]), key=len) for s in short]
    return [
        Term(r.term, r.kind == "s", math.log((r.toxic + 0.5) / (r.total - r.toxic + 0.5)))
        for r in found
        if r.kind == "w" or r.term in short
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) by ridge-penalised Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


_KEPT: dict[tuple, FuzzyTrie] = {}


def kept_trie(terms: tuple[Term, ...]) -> FuzzyTrie:
    """The trie of some terms, with what it remembers: a worker's tasks share it."""
    if terms not in _KEPT:
        _KEPT.clear()
        _KEPT[terms] = FuzzyTrie(terms)
    return _KEPT[terms]


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[Term, ...]
    weights: tuple[float, float, float]  # of exact and misspelled hits, intercept
    window: int = 5

    def column(self, text):
        """The score of a text column."""
        terms, weights, window = self.terms, self.weights, self.window

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = kept_trie(terms)
            for texts in batches:
                sums = [evidence(t, trie, window) for t in texts]
                yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] * math.log1p(a) + weights[1] * math.log1p(b) + weights[2])))) for a, b in sums], dtype="float64")

        return score(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, window: int = 5) -> ToxicityModel:
    """Lexicon and weights from the rows of ``docs`` that ``labels`` (``doc_id``, ``toxic``) marks."""
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # fit_rows ids at most
    sample = sample.select("text", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism).cache()
    terms = learn_terms(sample) or [Term(t, False, 5.0) for t in SEED_TERMS]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = FuzzyTrie(terms)
        for batch in batches:
            found = [evidence(t, trie, window) for t in batch["text"]]
            yield pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found], "y": batch["toxic"].to_numpy()})

    rows = sample.mapInPandas(sums, "a double, b double, y int").toPandas()
    sample.unpersist()
    if rows["y"].nunique() < 2:
        return ToxicityModel(tuple(terms), (2.0, 1.0, -3.0), window)
    weights = fit_logistic(np.log1p(rows[["a", "b"]].to_numpy(float)), rows["y"].to_numpy(float))
    return ToxicityModel(tuple(terms), tuple(float(w) for w in weights), window)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    return docs.withColumn("score", model.column(F.col(text_col)))
