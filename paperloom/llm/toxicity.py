"""Toxicity by noisy-channel deobfuscation.

A token that holds digits, symbols or separators among letters, or letters
repeated three times and more, is a lattice: each character may stand for one
of several letters, or for none. So is a run of single characters between
spaces. Viterbi decoding under a character trigram model of clean words
restores the likeliest word; every other token has one path through its
lattice and is only lower-cased. Restored words are scored by a sparse logistic
regression over words, word beginnings and inner 5-grams.

Both models are fitted on all labelled rows, shard by shard.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import Ftrl
from .shared import Table, bounded_memory, held_out

MOST_PER_CLASS = 2000  # half the rows of a shard that weights are fitted on at once
FRACTION = 1 << 30  # parts of 1 that weights are summed in
MOST_FEATURES = 4096
EPOCHS = 12
MOST_CACHED = 300_000  # tokens whose features a worker remembers
MOST_TOKEN = 64  # characters of the longest token that it remembers
MOST_LISTED = 50_000  # tokens whose features, as strings, are remembered in training
MOST_COUNTED = 200_000  # keys that a worker counts before it sends counts on
ROWS_A_FRAME = 20_000  # rows that training sends on at once
CELLS = 1 << 25  # bits, 4 MB, that tell which ids may be labelled
MOST_STARS = 40  # of a run that are decoded
KEPT_BYTES = 8 << 20  # of scores that the decoding of one token looks up

# Letters that a digit or symbol stands for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SKIP_COST, DROP_COST, LEET_COST, ANY_COST, DOUBLE_COST = 0.7, 6.0, 0.3, 1.5, 0.5

_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_IN_SPACED = re.compile(r" \S \S ")  # every such run has this; it is found sooner
_SYMBOL = re.compile(r"[^\w\s]")
_RUN = re.compile(r"([^\W\d_])\1{2,}", re.I)
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]")
_LOWER = np.array([ord(chr(i).lower()[0]) for i in range(0x1F000)], np.uint32)  # no letter after these has cases
_OPEN, _CLOSE = "\"'([{<¿¡*_#%&.,;:~`^=/\\-", ".,;:?\"')]}>#%&*~`^=/\\_-"
_END = "\0"


class CharModel:
    """Interpolated character trigrams of words, as log probabilities."""

    def __init__(self, words: Counter):
        self._set(gram_weights(words))

    @classmethod
    def of_weights(cls, weights: dict[str, int]) -> CharModel:
        """From the summed weights of all grams of one to three characters."""
        out = cls.__new__(cls)
        out._set(weights)
        return out

    def _set(self, weights: dict[str, int]) -> None:
        one, two, tri = ({g: n for g, n in weights.items() if len(g) == k} for k in (1, 2, 3))
        self.letters = "".join(sorted(c for c in one if c != _END))
        total, context2, context1 = sum(one.values()) or 1, Counter(), Counter()
        for g, n in tri.items():
            context2[g[:2]] += n
        for g, n in two.items():
            context1[g[0]] += n
        self._p1 = {c: n / total for c, n in one.items()}
        self._p2 = {g: n / context1[g[0]] for g, n in two.items()}
        self._p3 = {g: n / context2[g[:2]] for g, n in tri.items()}
        self._ways: _Ways | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ways": None}

    def log(self, state: str, c: str) -> float:
        p = 0.7 * self._p3.get(state + c, 0) + 0.2 * self._p2.get(state[1] + c, 0) + 0.0999 * self._p1.get(c, 0) + 1e-6
        return math.log(p)

    def ways(self) -> _Ways:
        if self._ways is None:
            self._ways = _Ways(self)
        return self._ways


def grams(word: str) -> Iterator[str]:
    """All grams of one to three characters that end at a character of the word,
    or at its end."""
    s = _END * 2 + word + _END
    for i in range(2, len(s)):
        yield s[i]
        yield s[i - 1 : i + 1]
        yield s[i - 2 : i + 1]


def word_weight(n: int) -> int:
    """The weight of a word of n texts: 1 + log n, as a whole number, so that
    sums do not depend on their order."""
    return round((1 + math.log(n)) * (1 << 20))


def gram_weights(words: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        for g in grams(word):
            out[g] += word_weight(n)
    return out


class _Ways:
    """The steps from state to state of a model, as arrays.

    A state is the last two letters; but if the model never saw the two in a
    row, no trigram begins with them, and the future depends on the last letter
    alone. So there is a state for each bigram, and one for each letter beside;
    one more stands for all letters that the model does not know, which behave
    alike. Steps are the trigrams (from a bigram), the bigrams (from whatever
    state ends in a letter, at the best score among those) and the letters (from
    anywhere): as many as the model has grams, not letters to the third.

    A step that overlooks a trigram or bigram the model has is worth less than
    the one that does not, so the best score is that of the full table."""

    def __init__(self, model: CharModel):
        letters = ["", _END, *model.letters]  # "": any letter that is not known
        pairs = sorted((g for g in model._p2 if g[1] != _END), key=lambda g: (g[1], g[0]))
        states = sorted([*((c, "") for c in letters), *((g[1], g[0]) for g in pairs)])
        self.model, self.letters = model, {c: i for i, c in enumerate(letters)}
        self.states = [(before, c) for c, before in states]  # by their last letter; alone, it comes first
        self.index = {s: i for i, s in enumerate(self.states)}
        self.first = np.array([self.index["", c] for c in letters])  # also where a letter's states begin
        last = lambda c: 0.0999 * model._p1.get(c, 0) + 1e-6
        self.floor = np.log(np.array([last(c) for c in letters]))
        self.floor[1] = -np.inf  # the end is no letter
        self.pair_from = np.array([self.letters[g[0]] for g in pairs], np.int64)
        self.pair_to = np.array([self.index[g[0], g[1]] for g in pairs], np.int64)
        self.pair_log = np.array([math.log(0.2 * model._p2[g] + last(g[1])) for g in pairs])
        start = {_END * 2: self.index["", _END]}
        three = sorted((self.index[g[1], g[2]], start.get(g[:2], self.index.get((g[0], g[1]), -1)), g) for g in model._p3 if g[2] != _END)
        self.three_to = np.array([x[0] for x in three], np.int64)
        self.three_from = np.array([x[1] for x in three], np.int64)
        self.three_log = np.array([model.log(x[2][:2], x[2][2]) for x in three])
        # steps into one letter lie together, as states do
        letter_of = np.array([self.letters[c] for _, c in self.states])
        place = np.arange(len(letters) + 1)
        self.pairs_of = np.searchsorted(letter_of[self.pair_to], place) if len(pairs) else np.zeros(len(letters) + 1, np.int64)
        self.threes_of = np.searchsorted(letter_of[self.three_to], place) if three else np.zeros(len(letters) + 1, np.int64)
        self.into: dict[int, list[int]] = {}
        for i, t in enumerate(self.three_to.tolist()):
            self.into.setdefault(t, []).append(i)
        self.pair_at = {int(t): i for i, t in enumerate(self.pair_to)}

    def state_of(self, two: str) -> int:
        """The state after two letters."""
        known = self.index.get((two[0], two[1]))
        return int(self.first[self.letters.get(two[1], 0)]) if known is None else known

    def tops(self, best: np.ndarray) -> np.ndarray:
        """The best score among the states of each last letter."""
        return np.maximum.reduceat(best, self.first)

    def step(self, best: np.ndarray, unit: list[tuple[str, float]]) -> np.ndarray:
        out = np.full(len(best), -np.inf)
        tops = self.tops(best)
        top = tops.max()
        for c, cost in unit:
            if not c:
                np.maximum(out, best - cost, out=out)
                continue
            if c == "?":
                lone, pairs, threes = slice(2, None), slice(None), slice(None)
            else:
                k = self.letters.get(c, 0)
                lone, pairs, threes = slice(k, k + 1), slice(self.pairs_of[k], self.pairs_of[k + 1]), slice(self.threes_of[k], self.threes_of[k + 1])
            at = self.first[lone]
            out[at] = np.maximum(out[at], top + self.floor[lone] - cost)
            to = self.pair_to[pairs]
            out[to] = np.maximum(out[to], tops[self.pair_from[pairs]] + self.pair_log[pairs] - cost)
            np.maximum.at(out, self.three_to[threes], best[self.three_from[threes]] + self.three_log[threes] - cost)
        return out - out.max()

    def end(self, best: np.ndarray) -> int:
        """The state from which a word ends best."""
        found = np.flatnonzero(best > -np.inf)
        scores = [best[i] + self.model.log(self._two(i), _END) for i in found]
        return int(found[int(np.argmax(scores))])

    def _two(self, state: int) -> str:
        before, c = self.states[state]
        return _END * 2 if c == _END else (before or "\1") + (c or "\1")  # \1: in no gram

    def back(self, best: np.ndarray, unit: list[tuple[str, float]], state: int) -> tuple[str, int]:
        """(letter given, state before) of the best way into a state."""
        before, c = self.states[state]
        tops, ways = self.tops(best), []
        segment = lambda k: (self.first[k], self.first[k + 1] if k + 1 < len(self.first) else len(best))
        for given, cost in unit:
            if not given:
                ways.append((best[state] - cost, given, state))
                continue
            if given == "?":
                given = c
            if c == _END or not given or self.letters.get(given, 0) != self.letters[c]:
                continue
            if not before:  # from wherever the score is best
                k = int(tops.argmax())
                ways.append((tops[k] + self.floor[self.letters[c]] - cost, given, ("top", k)))
                continue
            i = self.pair_at[state]
            k = int(self.pair_from[i])
            ways.append((tops[k] + self.pair_log[i] - cost, given, ("top", k)))
            ways += [(best[self.three_from[j]] + self.three_log[j] - cost, given, int(self.three_from[j])) for j in self.into.get(state, ())]
        _, given, source = max(ways, key=lambda w: w[0])
        if isinstance(source, tuple):
            low, high = segment(source[1])
            source = int(low + best[low:high].argmax())
        return given, source


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each unit of a token what it may stand for, with costs; '?' in place
    of letters means any letter. Symbols that can only be skipped cost every path
    the same and are left out, and so is what a run of stars has over MOST_STARS:
    a star that gives a letter costs 0.8 more than one that is skipped, and
    another state gains 27.7 at most (two letters, each with a probability of at
    least 1e-6, that cost 1.6 themselves), so no best path takes more than 36
    letters from a run."""
    out, i, stars = [], 0, 0
    token = "".join(map(str.lower, token))  # a letter may become two characters
    while i < len(token):
        c = token[i]
        if _LETTER.match(c):
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            if j - i >= 3:  # once or twice
                out += [[(c, 0.0)], [("", 0.0), (c, DOUBLE_COST)]]
            else:
                out += [[(c, 0.0)]] * (j - i)
            i, stars = j, 0
            continue
        if c in LEET:
            out.append([(x, LEET_COST) for x in LEET[c]] + [("", DROP_COST)])
            stars = 0
        elif c == "*":
            stars += 1
            if stars <= MOST_STARS:
                out.append([("?", ANY_COST), ("", SKIP_COST)])
        i += 1
    return out


def viterbi(units: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The likeliest word of a lattice; states are the last two letters, ties
    go to the path found first."""
    if any(text == "?" for unit in units for text, _ in unit):
        return _viterbi_of_any(units, model)
    best: dict[str, tuple[float, tuple | None]] = {_END * 2: (0.0, None)}
    for unit in units:
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for c, cost in unit:
                s, now, way = score - cost, state, path
                if c:
                    s, now, way = s + model.log(now, c), now[1] + c, (way, c)
                if now not in after or s > after[now][0]:
                    after[now] = (s, way)
        best = after
    _, path = max(((s + model.log(state, _END), p) for state, (s, p) in best.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def _viterbi_of_any(units: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The same where units may be any letter. A letter that has no other
    reading is copied; after two of them, in a row, the state is known, so what
    comes before and after is decoded apart."""
    units, ways, out = _shared(units), model.ways(), []
    two, i = _END * 2, 0
    forced = [len(u) == 1 and u[0][0] not in ("", "?") for u in units]
    while i < len(units):
        if forced[i]:
            out.append(units[i][0][0])
            two, i = two[1] + out[-1], i + 1
            continue
        j = i
        while j < len(units) and not (j - i >= 2 and forced[j - 1] and forced[j - 2]):
            j += 1
        closed = j - i >= 2 and forced[j - 1] and forced[j - 2]
        begin, two = two, units[j - 2][0][0] + units[j - 1][0][0] if closed else two
        out.append(_decoded(units[i:j], ways, ways.state_of(begin), ways.state_of(two) if closed else None))
        i = j
    return "".join(out)


def _shared(units: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
    """The same units; equal ones are one object."""
    one: dict[tuple, list[tuple[str, float]]] = {}
    return [one.setdefault(tuple(u), u) for u in units]


def _decoded(units: list[list[tuple[str, float]]], ways: _Ways, begin: int, state: int | None) -> str:
    """The best letters of units from a state on, to a state or to the end.
    Scores are kept at the begin of each block of units, and in one block at a
    time on the way back, so memory grows with the root of their number. Scores
    are relative to the best; where a token repeats itself they soon do, and are
    then looked up."""
    best = np.full(len(ways.states), -np.inf)
    best[begin] = 0.0
    known: dict[tuple, np.ndarray] = {}
    keep = max(1, KEPT_BYTES // (8 * len(best)))

    def after(best: np.ndarray, unit: list[tuple[str, float]]) -> np.ndarray:
        key = (best.tobytes(), id(unit))
        found = known.get(key)
        if found is None:
            if len(known) >= keep:
                known.clear()
            found = known[key] = ways.step(best, unit)
        return found

    ends: dict[tuple, tuple] = {}

    def before(best: np.ndarray, unit: list[tuple[str, float]], state: int) -> tuple[str, int]:
        key = (id(best), id(unit), state)
        found = ends.get(key)
        if found is None:
            if len(ends) >= keep:
                ends.clear()
            found = ends[key] = (best, *ways.back(best, unit, state))  # holds the array, so that its id stays its own
        return found[1:]

    block = max(1, math.isqrt(len(units)))
    starts = []
    for i, unit in enumerate(units):
        if i % block == 0:
            starts.append(best)
        best = after(best, unit)
    state = ways.end(best) if state is None else state
    out = []
    for n in range(len(starts) - 1, -1, -1):
        part = units[n * block : (n + 1) * block]
        scores = [starts[n]]
        for unit in part[:-1]:
            scores.append(after(scores[-1], unit))
        for best, unit in zip(reversed(scores), reversed(part)):
            given, state = before(best, unit, state)
            out.append(given)
    return "".join(reversed(out))


def core_of(token: str) -> str:
    """A token without exclamation marks or three and more equal symbols at its
    end, and without other punctuation around it."""
    if token:
        bare = token.rstrip(token[-1])
        if token[-1] == "!" or (len(token) - len(bare) >= 3 and _SYMBOL.match(token[-1])):
            token = bare
    return token.rstrip(_CLOSE).lstrip(_OPEN)


def has_runs(text: str) -> bool:
    """Whether a letter may be repeated three times in a row, in either case."""
    low = _LOWER[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_LOWER) - 1)]
    same = low[1:] == low[:-1]
    return any(_LETTER.match(text, i) for i in np.flatnonzero(same[1:] & same[:-1]).tolist())


def _plain(core: str, runs: bool) -> bool:
    """Letters only, none of them three times in a row."""
    return (core.isalpha() or (core != "" and not _OTHER.search(core))) and not (runs and _RUN.search(core))


def restore(token: str, model: CharModel, runs: bool = True) -> str:
    """The word that a token stands for; empty without letters. runs: false if
    the token is known to have no letter three times in a row."""
    core = token if token.isalpha() else core_of(token)
    if _plain(core, runs):
        return core.lower()
    return viterbi(lattice(core), model) if _LETTER.search(core) else ""


def spaced(text: str) -> Iterator[str]:
    """Words spelt out with spaces between their letters."""
    if _IN_SPACED.search(text):
        for m in _SPACED.finditer(text):
            yield m[0].replace(" ", "")


def word_features(word: str) -> list[str]:
    if not word:
        return []
    out = ["w:" + word]
    out += ["p:" + word[:n] for n in (4, 5, 6) if len(word) > n]
    out += ["g:" + word[i : i + 5] for i in range(len(word) - 4)]
    return out


class Model:
    def __init__(self, chars: CharModel, index: dict[str, int], weights: np.ndarray, bias: float, by_length: float):
        self.chars, self.index, self.weights, self.bias, self.by_length = chars, index, weights, bias, by_length
        self.cache: dict[str, tuple[int, ...]] = {}  # tokens with features
        self.idle: set[str] = set()  # tokens without any
        # by kind, as in word_features: whole words, beginnings, inner 5-grams
        self.words, self.begins, self.inner = ({f[2:]: i for f, i in index.items() if f.startswith(k)} for k in ("w:", "p:", "g:"))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "idle": set()}

    def found(self, word: str) -> tuple[int, ...]:
        """The numbers of the word_features that the model knows, in their order."""
        n, begins, inner = len(word), self.begins, self.inner
        out = [self.words[word]] if word in self.words else []
        if n > 4:
            if word[:4] in begins:
                out.append(begins[word[:4]])
            if n > 5 and word[:5] in begins:
                out.append(begins[word[:5]])
            if n > 6 and word[:6] in begins:
                out.append(begins[word[:6]])
            out += [inner[g] for i in range(n - 4) if (g := word[i : i + 5]) in inner]
        return tuple(out)

    def known(self, token: str, runs: bool = True) -> tuple[int, ...]:
        found = self.cache.get(token)
        if found is None and token not in self.idle:
            if len(self.cache) + len(self.idle) >= MOST_CACHED:
                self.cache.clear()
                self.idle.clear()
            found = self.found(restore(token, self.chars, runs))
            if len(token) <= MOST_TOKEN:
                if found:
                    self.cache[token] = found
                else:
                    self.idle.add(token)
        return found or ()

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """How often each feature is there, in the order of their numbers."""
        tokens = text.split()
        hits: Counter = Counter()
        rest, runs = set(tokens) - self.idle, has_runs(text)
        live = [(t, found) for t in rest if (found := self.known(t, runs))]
        if live:
            times = Counter(tokens) if len(live) > 8 else {t: tokens.count(t) for t, _ in live}
            for t, found in live:
                for i in found:
                    hits[i] += times[t]
        for t in spaced(text):
            hits.update(self.known(t))
        return dict(sorted(hits.items())), len(tokens)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        hits, n = self.counts(text)
        at = np.fromiter(hits, np.int64, len(hits))
        x = np.log1p(np.fromiter(hits.values(), float, len(hits)))
        last = len(self.index)
        return np.append(at, [last, last + 1]), np.append(x, [math.log1p(n) / 3, 1.0])

    def score(self, text: str) -> float:
        hits, n = self.counts(text)
        s = self.bias + self.by_length * math.log1p(n) / 3 + sum(self.weights[i] * math.log1p(c) for i, c in hits.items())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))


def clean_words(text: str) -> set[str]:
    """The tokens of a text that need no decoding, in lower case."""
    runs = has_runs(text)
    return {c.lower() for t in set(text.split()) if _plain(c := t if t.isalpha() else core_of(t), runs)}


def features_of(text: str, chars: CharModel, known: dict[str, list[str]]) -> set[str]:
    found: set[str] = set()
    apart, runs = set(spaced(text)), has_runs(text)
    for token in {*text.split(), *apart}:
        names = known.get(token)
        if names is None:
            names = word_features(restore(token, chars, runs or token in apart))
            if len(token) <= MOST_TOKEN:
                if len(known) >= MOST_LISTED:
                    known.clear()
                known[token] = names
        found.update(names)
    return found


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], features: int) -> np.ndarray:
    """Weights of the features, of the length and of the bias."""
    w = Ftrl(features + 2, 2, alpha=0.3, l1=0.3, l2=1.0).fit(rows, labels, EPOCHS)
    return w[:, 1] - w[:, 0]


def _each(f, kinds: str):
    """A function of one row to rows, for mapInPandas."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [k.split()[0] for k in kinds.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                out += f(row)
                if len(out) >= ROWS_A_FRAME:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return of, kinds


def _counted(add, kinds: str):
    """add(row, counters) counts what a row has by keys; the counts of many rows
    are sent on together, for mapInPandas."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counters = [k.split()[0] for k in kinds.split(", ")], (Counter(), Counter())

        def told() -> Iterator[pd.DataFrame]:
            for kind, counter in enumerate(counters):
                if counter:
                    yield pd.DataFrame({names[0]: list(counter), names[1]: kind, names[2]: list(counter.values())})
                    counter.clear()

        for batch in batches:
            for row in batch.itertuples(index=False):
                add(row, counters)
                if len(counters[0]) + len(counters[1]) >= MOST_COUNTED:
                    yield from told()
        yield from told()

    return of, kinds


def _may_have(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is one of ids (not null), and few others: a bit for
    each of CELLS hashes is set by the ids. What it leaves out, no join has to
    send; 4 MB at most are broadcast, however many ids there are."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)) + 1
    bits = ids.select(F.bitmap_bucket_number(cell).alias("_bucket"), F.bitmap_bit_position(cell).alias("_bit"))
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(cell), "_bit": F.bitmap_bit_position(cell)})
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    return placed.join(F.broadcast(bits), "_bucket").filter(is_set).select(*rows.columns)


def train(rows: DataFrame, marks: DataFrame, most: int = MOST_PER_CLASS) -> Model:
    """rows: (doc_id, text); marks: (doc_id, toxic), toxic 0 or 1.

    Learned from every different (doc_id, toxic, text), whole texts of any
    length; null ids take no part. Grams and features are counted over all of
    them. Weights are fitted on all of them too: rows are dealt by a hash of the
    id into shards of about 2 * most, each is fitted where it lies, and weights
    are averaged by rows. Up to 2 * most rows are one shard. What comes to the
    driver are the weights of the grams, the strongest features and one weight
    for each."""
    ids = marks.filter(F.col("doc_id").isNotNull()).distinct()
    counts = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        bias = 4.0 if counts.get(1) else -4.0
        return Model(CharModel(Counter()), {}, np.zeros(0), bias, 0.0)
    table = Table(_may_have(rows, ids).join(ids, "doc_id").select("doc_id", "toxic", "text").distinct(), "labelled")
    known_rows, context = table.df, rows.sparkSession.sparkContext
    totals = {r["toxic"]: r["n"] for r in known_rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))

    def weigh(r, counters) -> None:
        weight, counter = word_weight(r.n), counters[0]
        for g in grams(r.word):
            counter[g] += weight

    words = known_rows.mapInPandas(*_counted(lambda r, c: c[0].update(clean_words(r.text)), "word string, kind int, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    weights = words.mapInPandas(*_counted(weigh, "gram string, kind int, weight long")).groupBy("gram").agg(F.sum("weight").alias("weight"))
    chars = CharModel.of_weights({r["gram"]: r["weight"] for r in weights.collect()})

    model, known = context.broadcast(chars), {}
    found = known_rows.mapInPandas(*_counted(lambda r, c: c[r.toxic].update(features_of(r.text, model.value, known)), "feature string, toxic int, n long"))
    seen = found.groupBy("feature").agg(F.sum(F.col("toxic") * F.col("n")).alias("a"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("b")).filter("a >= 3")
    a, b = F.col("a") / n1, F.col("b") / n0
    p = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    strong = seen.withColumn("strength", (a - b) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))).filter("strength > 3")
    names = [r["feature"] for r in strong.orderBy(F.desc("strength"), "feature").limit(MOST_FEATURES).collect()]

    size = len(names)
    blank = context.broadcast(Model(chars, {f: i for i, f in enumerate(names)}, np.zeros(size), 0.0, 0.0))
    n_shards = math.ceil(sum(totals.values()) / (2 * most))

    def placed(r) -> list[tuple]:
        at, x = blank.value.vector(r.text)
        return [(r.shard, r.doc_id, int(r.toxic), r.nth, at.tolist(), x.tolist())]

    def fitted(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "toxic", "nth"])
        w = fit([(np.array(at, np.int64), np.array(x)) for at, x in zip(shard["at"], shard["x"])], shard["toxic"].tolist(), size)
        # whole numbers, so that sums do not depend on their order
        return pd.DataFrame({"place": np.arange(size + 2), "sum": np.round(w * FRACTION).astype(np.int64) * len(shard)})

    dealt = known_rows.withColumns({"shard": F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)), "nth": F.xxhash64("text")})
    vectors = dealt.mapInPandas(*_each(placed, "shard long, doc_id long, toxic int, nth long, at array<long>, x array<double>"))
    sums = vectors.groupBy("shard").applyInPandas(fitted, "place int, sum long").groupBy("place").agg(F.sum("sum").alias("sum")).collect()
    table.drop()
    w = np.zeros(size + 2)
    for r in sums:
        w[r["place"]] = r["sum"] / FRACTION / sum(totals.values())
    kept = [i for i in range(size) if w[i] != 0]
    return Model(chars, {names[i]: k for k, i in enumerate(kept)}, w[kept], float(w[-1]), float(w[-2]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_PER_CLASS) -> DataFrame:
    """One row for each row of docs: id_col, held_out, score, predicted.

    Labels are learned from documents that are not held out and whose label is
    0 or 1. Null text counts as empty and is scored like any other. Repeated
    rows get equal scores. Without labels of both classes, every text gets the
    one score that the labels there are suggest. Texts and tokens may be of any
    length; time grows in proportion. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out())
    bounded_memory(docs.sparkSession)
    model = train(rows, marks, most)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights and the trigrams of the labelled texts

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(sent.value.score).astype(float)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = rows.select("doc_id", F.pandas_udf(of, "double")("text").alias("score"))
    return found.select(F.col("doc_id").alias(id_col), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
