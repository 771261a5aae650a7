"""Toxicity by a subsequence string kernel machine with Nyström landmarks, trained on labelled sentences.

The kernel of two terms sums, over triples of letters that both contain in order, decay ** (letters spanned in both),
up to a largest span; it is scaled so that a term's kernel with itself is one. An insult with inserted or dropped
letters still shares most triples with the plain one; characters that are no letters leave no gap at all. A term is
a word or two neighbouring words of a sentence, a sentence is as toxic as its most toxic term, and a document is judged
by its most toxic sentences. Labels are of documents, so which sentence of a toxic document bears the label, and which term of it,
is found by turns with the machine: a linear support vector machine on the Nyström features of the sentences' terms
(features K_mm ** -1/2 k(landmarks, term)). Scores are calibrated on labelled documents that the machine has not seen.
As the kernel is a sum over triples, the machine folds into one weight a triple, and scoring is a table lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_arrow

#: Bounds of the fitting sample: labelled documents, the first so many by hash; sentences of these, likewise, and the
#: most characters of a sentence. Scoring has no such bounds.
SAMPLE_DOCS, SAMPLE_SENTENCES, SAMPLE_CHARS = 4_000, 150_000, 2_000
#: One in so many of the sampled documents is kept for calibration; with fewer documents than FOLDED each is, by turns.
CALIBRATED, FOLDED = 5, 200
#: Greatest log odds of a text without evidence: a score of 0.27.
NO_EVIDENCE = -1.0
LANDMARKS, DECAY, SPAN = 448, 0.6, 6
#: Longest word that is a term; longer ones are scored in overlapping pieces of this length.
PIECE = 24
ROUNDS, C, STEPS = 3, 8.0, 40
#: Random and hardest terms of clean sentences that the machine is fitted to, and hardest pairs of words.
NEGATIVES, HARDEST, HARDEST_PAIRS = 6_000, 2_000, 500
#: Toxic sentences that a pair of words must be in to be a term.
PAIR_LEAST = 10
#: Sentences of a document, the most toxic ones, whose margins its score is calibrated from.
TOP = 3
#: Decision values below it all count alike: the classes lie about 1 and -1.
FLOOR = -0.5
#: Terms whose margins are found at a time, and those whose kernels are.
BATCH, KERNELS = 10_000, 200
#: Where sentences end, as a pattern for the JVM; `parsed` cuts at the same places.
SENTENCE = r"(?<=[.!?])\s+|\n"
_ENDS = ".!?"
#: Symbols of the kernel's alphabet: Latin letters from 1 on, then the mark that begins a word; letters of other scripts
#: share the rest by number. 0 is every other character.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_BEGIN, _NEXT, _LETTERS = "\x02", "\x04", 128
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Letters of other scripts that look like Latin ones. Fixed values.
_LOOKS |= dict(zip("аеорсухіѕјκαοειντυρ", "aeopcyxisjkaoeivtup"))
_TAIL = "\0" * SPAN


def _symbols() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    mark = len(_ALPHABET) + 1
    every = np.array([c for c in range(0x250, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    out[every] = mark + 1 + every % (_LETTERS - mark - 1)
    for i, a in enumerate(_ALPHABET, 1):
        for b in {a, a.upper()} - {"SS"}:
            out[ord(b)] = i
    for a, b in _LOOKS.items():
        out[ord(a)] = out[ord(b)]
    for c in range(26):  # full-width letters
        out[[0xFF21 + c, 0xFF41 + c]] = c + 1
    out[[ord(_BEGIN), ord(_NEXT)]] = mark
    return out


_FOLD = _symbols()
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def fold(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all terms, each word after the mark and before SPAN zeros; and where each term begins.

    Characters that are no letters leave no gap.
    """
    joined = "".join([f"{_BEGIN}{t}{_TAIL}" for t in terms])
    if joined.count(_BEGIN) + joined.count(_NEXT) + joined.count("\0") != len(terms) * (SPAN + 1):
        joined = "".join([_BEGIN + t.translate({0: "?", 2: "?", 4: "?"}) + _TAIL for t in terms])
    codes = np.frombuffer(joined.replace(" ", _TAIL + _NEXT).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _FOLD[codes]
    kept = (letters > 0) | (codes == 0)
    return letters[kept], np.flatnonzero(codes[kept] == ord(_BEGIN))


def triples(letters: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of gaps: the triple's number at every place, 0 if it has no three letters, and its decay."""
    x = letters.astype(np.int32)
    n = len(x)
    for a, b in _GAPS:
        t = np.zeros(n, np.int32)
        m = n - a - b
        if m > 0:
            p, q, r = x[:m], x[a : a + m], x[a + b : a + b + m]
            t[:m] = np.where((p > 0) & (q > 0) & (r > 0), (p * _LETTERS + q) * _LETTERS + r, 0)
        yield t, DECAY ** (a + b + 1)


def features(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (term, triple, value) of length one."""
    letters, begins = fold(terms)
    owner = np.repeat(np.arange(len(terms)), np.diff(np.append(begins, len(letters))))
    keys, values = [], []
    for t, w in triples(letters):
        at = np.nonzero(t)[0]
        keys.append(owner[at] * _LETTERS**3 + t[at])
        values.append(np.full(len(at), w))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(back, np.concatenate(values), len(key))
    row = key // _LETTERS**3
    norm = np.sqrt(np.bincount(row, value**2, len(terms)))
    return row, key % _LETTERS**3, value / norm[row]


class Landmarks:
    """Landmark terms by the triples that occur in any of them."""

    def __init__(self, terms: list[str]):
        row, col, value = features(terms)
        self.n, (self.triples, at) = len(terms), np.unique(col, return_inverse=True)
        self.table = np.zeros((len(self.triples), len(terms)), np.float32)
        self.table[at, row] = value

    def kernel(self, terms: list[str]) -> np.ndarray:
        out = np.zeros((len(terms), self.n), np.float32)
        for i in range(0, len(terms), KERNELS):
            row, col, value = features(terms[i : i + KERNELS])
            at = np.minimum(np.searchsorted(self.triples, col), len(self.triples) - 1)
            known = self.triples[at] == col
            row, at, value = row[known], at[known], value[known]
            some, first = np.unique(row, return_index=True)
            if len(some):
                out[some + i] = np.add.reduceat(value[:, None].astype(np.float32) * self.table[at], first, axis=0)
        return out

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """A weight for each triple that gives the same values as weights of the landmarks."""
        out = np.zeros(_LETTERS**3, np.float32)
        out[self.triples] = self.table @ weights
        return out


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


@dataclass
class Parsed:
    """words: the different ones; word, text: of each occurrence in order, texts ascending; ends: whether a sentence ends there."""

    words: list[str]
    word: np.ndarray
    text: np.ndarray
    ends: np.ndarray

    def spelled_out(self) -> tuple[list[str], np.ndarray]:
        """Runs of four or more single letters of a text, joined; and their texts."""
        single = np.array([len(w.rstrip(".!?,;:")) == 1 for w in self.words] or [False])[self.word] if len(self.word) else np.zeros(0, bool)
        begin = single & ~np.r_[False, single[:-1] & (self.text[1:] == self.text[:-1])][: len(single)]
        stop = single & ~np.r_[single[1:] & (self.text[1:] == self.text[:-1]), False][: len(single)]
        a, z = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        a, z = a[z - a >= 4], z[z - a >= 4]
        return ["".join(self.words[k].rstrip(".!?,;:") for k in self.word[i:j].tolist()) for i, j in zip(a, z)], self.text[a]

    def pairs(self) -> np.ndarray:
        """Occurrences whose next word is of the same sentence."""
        return np.flatnonzero(~self.ends[:-1] & (self.text[1:] == self.text[:-1])) if len(self.word) else np.zeros(0, np.int64)


def parsed(texts: list[str]) -> Parsed:
    low = pc.utf8_lower(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", ". "))
    parts = pc.utf8_split_whitespace(low)
    sizes = np.diff(parts.offsets.to_numpy().astype(np.int64))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    word = coded.indices.to_numpy().astype(np.int64)
    ends = np.array([w[-1:] in _ENDS for w in words] or [False])  # an empty word too
    return Parsed(words, word, np.repeat(np.arange(len(texts)), sizes), ends[word] if len(word) else np.zeros(0, bool))


@dataclass
class Machine:
    """weights: for each triple; bias; scale and shift turn a text's greatest margins into a probability.

    paired: whether pairs of words are terms, which they are if some tell toxic sentences in the fitting sample.
    """

    weights: np.ndarray
    bias: float
    scale: np.ndarray
    shift: float
    paired: bool = False

    def __getstate__(self):
        at = np.flatnonzero(self.weights).astype(np.int32)
        return at, self.weights[at], self.bias, self.scale, self.shift, self.paired

    def __setstate__(self, state):
        at, values, self.bias, self.scale, self.shift, self.paired = state
        self.weights = np.zeros(_LETTERS**3, np.float32)
        self.weights[at] = values

    def sums(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each term the sum of its triples' weights, and the square of a length not above its own."""
        tops, squares = [np.zeros(0)], [np.zeros(0)]
        for i in range(0, len(terms), BATCH):
            letters, begins = fold(terms[i : i + BATCH])
            dot, square = np.zeros(len(letters), np.float32), np.zeros(len(letters), np.float32)
            for t, w in triples(letters):
                dot += np.float32(w) * self.weights[t]
                square += np.where(t > 0, np.float32(w * w), np.float32(0))
            tops.append(np.add.reduceat(dot, begins))
            squares.append(np.add.reduceat(square, begins))
        return np.concatenate(tops), np.concatenate(squares)

    def bound(self, top: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Not below the margin, if that is positive before the bias: the length that ignores equal triples is not above the true one."""
        return np.maximum(top, 0.0) / np.sqrt(np.maximum(square, 1e-9)) + self.bias

    def exact(self, terms: list[str]) -> np.ndarray:
        out = np.full(len(terms), self.bias)
        for i in range(0, len(terms), BATCH):
            row, col, value = features(terms[i : i + BATCH])
            out[i : i + BATCH] += np.bincount(row, value * self.weights[col], len(terms[i : i + BATCH]))
        return np.maximum(out, FLOOR)

    def margins(self, terms: list[str], sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Decision values, FLOOR at least; only terms whose bound is over FLOOR need the true length."""
        out = np.full(len(terms), FLOOR)
        likely = np.flatnonzero(self.bound(*(sums or self.sums(terms))) > FLOOR)
        if len(likely):
            out[likely] = self.exact([terms[i] for i in likely])
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margin, sum, square) of words of any length; a long one has the greatest margin of its pieces."""
        long = [i for i, w in enumerate(words) if len(w) > PIECE]
        short = words
        if long:
            short = list(words)
            for i in long:
                short[i] = ""
        sums = self.sums(short)
        margin = self.margins(short, sums)
        for i in long:
            margin[i] = self.margins(pieces(words[i])).max()
        return margin, *sums

    def pairs(self, p: Parsed, margin: np.ndarray, top: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, margin) of neighbouring words that together may have a greater margin than each of them."""
        at = p.pairs() if self.paired else np.zeros(0, np.int64)
        a, b = p.word[at], p.word[at + 1]
        most = self.bound(top[a] + top[b], square[a] + square[b])
        good = most > np.maximum(np.maximum(margin[a], margin[b]), FLOOR)
        at, a, b = at[good], a[good], b[good]
        key, back = np.unique(a * len(p.words) + b, return_inverse=True)
        own = self.exact([f"{p.words[k // len(p.words)]} {p.words[k % len(p.words)]}" for k in key.tolist()])
        return at, own[back]

    def score(self, margin: np.ndarray) -> np.ndarray:
        """Probabilities of rows of greatest margins."""
        return 1 / (1 + np.exp(-(margin @ self.scale + self.shift)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Finite Newton steps for the squared hinge loss, the bias as a constant feature."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(v @ v / 2 + C * (weight * np.maximum(0.0, 1 - y * (x @ v)) ** 2).sum())

    for _ in range(STEPS):
        slack = 1 - y * (x @ w)
        on = slack > 0
        ws = np.sqrt(2 * C * weight[on])
        xs = x[on] * ws[:, None]
        gradient = w - xs.T @ (ws * y[on] * slack[on])
        step = np.linalg.solve(np.eye(len(w)) + xs.T @ xs, gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic fit of labels to rows of margins by Newton steps, lightly penalised; no margin counts against a label.

    A row without evidence, all at FLOOR, gets at most the log odds NO_EVIDENCE, whatever share of the labels is 1: a
    score of one half or more has to come from margins.
    """
    over, used, free = margin - FLOOR, np.arange(margin.shape[1]), True
    while True:
        x = np.hstack([over[:, used], np.ones((len(y), 1))])
        w = np.append(np.full(len(used), 1.0 / max(len(used), 1)), 0.0 if free else NO_EVIDENCE)
        n = len(w) if free else len(w) - 1  # what may change
        for _ in range(50 if n else 0):
            p = 1 / (1 + np.exp(-(x @ w)))
            g = (x.T @ (p - y) + 0.05 * w)[:n]
            h = (x[:, :n] * (p * (1 - p) + 1e-9)[:, None]).T @ x[:, :n] + 0.05 * np.eye(n)
            step = np.linalg.solve(h, g)
            w[:n] -= step
            if abs(step).max() < 1e-9:
                break
        if free and w[-1] > NO_EVIDENCE:
            used, free = np.arange(margin.shape[1]), False
        elif (w[:-1] >= 0).all():
            scale = np.zeros(margin.shape[1])
            scale[used] = w[:-1]
            return scale, float(w[-1] - FLOOR * scale.sum())
        else:
            used = np.delete(used, int(np.argmin(w[:-1])))


def _constant(bias: float, shift: float) -> Machine:
    return Machine(np.zeros(_LETTERS**3, np.float32), bias, np.zeros(TOP), shift)


def fit(docs: list[list[str]], labels: list[int], seed: int = 7) -> Machine:
    """Documents as their sentences, with labels 1 (toxic) or 0. Without both labels nothing tells them apart: all score low.

    Scores are calibrated on documents that the machine has not seen: on one in CALIBRATED of them, or, where there are fewer
    than FOLDED, on all by turns, each with a machine fitted to the others.
    """
    y = np.array(labels, float)
    both = lambda part: len(set(y[part])) == 2
    if not both(slice(None)):
        return _constant(-1.0, -4.0)
    fold = np.arange(len(y)) % CALIBRATED
    if len(y) < FOLDED:
        machine = _machine(docs, y, np.zeros(len(y), bool), seed)
        folds = [fold == k for k in range(CALIBRATED) if (fold == k).any() and both(fold != k)]
        judged = [(part, _machine(docs, y, part, seed)) for part in folds] or [(fold >= 0, machine)]
    else:
        part = fold == CALIBRATED - 1
        if not (both(part) and both(~part)):
            part[:] = False  # too few of a label to set any aside
        machine = _machine(docs, y, part, seed)
        judged = [(part if part.any() else ~part, machine)]
    best = [greatest_margins(m, ["\n".join(docs[i]) for i in np.flatnonzero(part)]) for part, m in judged]
    machine.scale, machine.shift = _calibrated(np.concatenate(best), np.concatenate([y[part] for part, _ in judged]))
    return machine


def _machine(docs: list[list[str]], y: np.ndarray, unseen: np.ndarray, seed: int) -> Machine:
    """The machine, not yet calibrated, fitted to the documents that aren't to stay unseen."""
    labels = y.astype(int).tolist()
    # A sentence that comes again under the same label, in copies of a document say, is one row.
    rows = {(label, s): i for i, (sentences, label) in reversed([*enumerate(zip(docs, labels))]) for s in reversed(sentences)}
    p, of = parsed([s for _, s in rows]), np.array([*rows.values()])  # of: the first document of each sentence
    fitted = ~unseen[of]
    toxic_sentence = (y[of] == 1) & fitted
    clean_sentence = (y[of] == 0) & fitted
    terms, word, text = list(p.words), p.word, p.text
    more, where = p.spelled_out()
    word, text = _with(terms, word, text, [w[:PIECE] for w in more], where)

    def counted(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """In how many sentences of toxic and of clean fitted documents each term is."""
        key = np.unique(text[fitted[text]] * n + word[fitted[text]])
        return (np.bincount(key % n, y[of[key // n]] == k, n) for k in (1, 0))

    def odds_of(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        return np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))

    n1, n0 = toxic_sentence.sum(), clean_sentence.sum()
    toxic, clean = counted(word, text, len(terms))
    # Pairs of words that bear a label which neither word bears: seen in toxic documents, hardly in clean ones.
    at = p.pairs()
    at = at[(toxic[p.word[at]] >= 3) & (toxic[p.word[at + 1]] >= 3) & fitted[p.text[at]]]
    key, code = np.unique(p.word[at] * len(terms) + p.word[at + 1], return_inverse=True)
    t2, c2 = counted(code, p.text[at], max(len(key), 1))
    alone = np.maximum(*(odds_of(toxic[k], clean[k]) for k in (key // len(terms), key % len(terms)))) if len(key) else np.zeros(0)
    telling = np.flatnonzero((t2[: len(key)] >= PAIR_LEAST) & (odds_of(t2, c2)[: len(key)] > np.maximum(2.5, alone + 1)))
    here = np.isin(code, telling)
    names = [f"{terms[k // len(p.words)]} {terms[k % len(p.words)]}" for k in key.tolist()] if len(telling) else []
    word, text = _with(terms, word, text, [names[k] for k in code[here].tolist()], p.text[at[here]])
    toxic, clean = counted(word, text, len(terms))
    odds = odds_of(toxic, clean)
    # Evidence that a term bears the label: its odds, as often as it was seen.
    short = np.array([len(t) <= PIECE or " " in t for t in terms])
    evidence = np.where((toxic > 0) & short, odds * np.sqrt(toxic), -np.inf)
    ranked = np.argsort(-evidence, kind="stable")
    ranked = ranked[np.isfinite(evidence[ranked])]
    r = np.random.default_rng(seed)
    common = np.flatnonzero((clean > 0) & short)
    others = r.choice(common, min(len(common), LANDMARKS * 4), replace=False)
    first = [terms[k] for k in dict.fromkeys([*ranked[: LANDMARKS * 3 // 4].tolist(), *others.tolist()])]
    with_triples = np.zeros(len(first), bool)
    if first:
        with_triples[np.unique(features(first)[0])] = True
    landmarks = [t for t, ok in zip(first, with_triples) if ok][:LANDMARKS]
    if not landmarks:
        return _constant(-1.0, 0.0)
    base = Landmarks(landmarks)
    value, vector = np.linalg.eigh(base.kernel(landmarks).astype(np.float64))
    half = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    evident = (toxic >= 3) & (odds > 2.5) & short

    def bearers(value: np.ndarray, sentences: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of each group of the chosen sentences the term of greatest value, that of its sentence of greatest value."""
        own = sentences[text]
        t, g = word[own], group[text[own]]
        order = np.lexsort((t, -value[t], g))
        return np.unique(t[order][np.r_[True, np.diff(g[order]) != 0][: len(order)]])

    sentence = np.arange(len(of))
    witness = bearers(evidence, toxic_sentence, of)
    negative = set(r.choice(common, min(len(common), NEGATIVES), replace=False).tolist())
    pairs: set[str] = set()
    machine, margin = _constant(0.0, 0.0), np.zeros(len(terms))
    for _ in range(ROUNDS):
        # A document's label may be wrong: what is seen in a few documents, clean ones too, is no evidence.
        plus = set(np.flatnonzero(evident).tolist()) | set(witness[(odds[witness] > 1) & (toxic[witness] >= min(3, n1)) & short[witness]].tolist())
        plus = sorted(plus or witness[short[witness]].tolist())
        # A term may be a row of either label, with the weight of each: its margin then says how surely it is toxic.
        minus, double = sorted(negative | {k for k in plus if clean[k]}), sorted(pairs)
        rows = [*(terms[k] for k in plus), *(terms[k] for k in minus), *double]
        sign = np.array([1.0] * len(plus) + [-1.0] * (len(minus) + len(double)))
        weight = np.array([*np.minimum(toxic[plus], 50), *np.where(np.isin(minus, plus), np.minimum(clean[minus], 50), 1 + np.minimum(clean[minus], 20) / 4), *[1.0] * len(double)])
        v, bias = _svm(base.kernel(rows) @ half.astype(np.float32), sign, weight)
        machine = Machine(base.folded((half @ v).astype(np.float32)), bias, np.zeros(TOP), 0.0, len(telling) > 0)
        margin, top, square = machine.words(terms)
        witness = bearers(margin, toxic_sentence, of)
        # Each clean sentence is a row by its hardest term, and by its hardest pair of words.
        hard = bearers(margin, clean_sentence, sentence)
        hard = hard[short[hard]]
        negative |= set(hard[np.argsort(-margin[hard], kind="stable")][:HARDEST].tolist())
        at, own = machine.pairs(p, margin[: len(p.words)], top[: len(p.words)], square[: len(p.words)])
        clear = clean_sentence[p.text[at]]
        at, own = at[clear], own[clear]
        for k in at[np.argsort(-own, kind="stable")][:HARDEST_PAIRS].tolist():
            pairs.add(f"{p.words[p.word[k]]} {p.words[p.word[k + 1]]}")
    return machine


def _with(terms: list[str], word: np.ndarray, text: np.ndarray, more: list[str], where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences with more of them; their terms are added to the list if they aren't in it."""
    if not more:
        return word, text
    known = {t: i for i, t in enumerate(terms)}
    ids = []
    for t in more:
        if t not in known:
            known[t] = len(terms)
            terms.append(t)
        ids.append(known[t])
    return np.append(word, ids), np.append(text, where)


def greatest_margins(machine: Machine, texts: list[str]) -> np.ndarray:
    """The margins of each text's TOP most toxic sentences, descending; FLOOR where there are fewer.

    Each different term is scored once. A run of spelled-out letters counts as a sentence.
    """
    best = np.full((len(texts), TOP), FLOOR)
    p = parsed(texts)
    if not len(p.word):
        return best
    margin, top, square = machine.words(p.words)
    begins = np.flatnonzero(np.r_[True, p.ends[:-1] | (p.text[1:] != p.text[:-1])])
    sentence = np.maximum.reduceat(margin[p.word], begins)
    at, own = machine.pairs(p, margin, top, square)
    np.maximum.at(sentence, np.searchsorted(begins, at, side="right") - 1, own)
    spelled, where = p.spelled_out()
    more = [machine.margins(pieces(s)).max() for s in spelled]
    value, text = np.append(sentence, more), np.append(p.text[begins], where).astype(np.int64)
    toxic = np.flatnonzero(value > FLOOR)
    toxic = toxic[np.lexsort((-value[toxic], text[toxic]))]
    value, text = value[toxic], text[toxic]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    few = rank < TOP
    best[text[few], rank[few]] = value[few]
    return best


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """docs with text: the `keep` columns and score (0 to 1).

    Null texts are as empty ones; rows are scored alone, so repeated rows, null ids and ties need no care; a very long text
    is scored whole, other columns are not read, and an empty table gives no rows.
    """
    from . import tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep))
            got = []
            for i, j in tokens.slices(tokens.sizes(texts)):
                got.append(machine.score(greatest_margins(machine, [t or "" for t in texts.slice(i, j - i).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(got) if got else np.zeros(0))], [*keep, "score"])

    rows = docs.select(*keep, F.col("text"))
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema
    return in_arrow(rows, run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, toxic, sentence) in order of doc to one row of the machine's numbers."""
    docs, labels, last = [], [], None
    for b in batches:
        for doc, toxic, sentence in zip(*(b.column(i).to_pylist() for i in range(3))):
            if doc != last:
                docs.append([])
                labels.append(int(toxic > 0))
                last = doc
            docs[-1].append(sentence)
    if not docs:
        return
    at, values, bias, scale, shift, paired = fit(docs, labels).__getstate__()
    yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([values.astype(np.float32).tobytes()]), pa.array([bias]), pa.array([scale.tolist()]), pa.array([shift]), pa.array([paired])], ["triples", "weights", "bias", "scale", "shift", "paired"])


def trained(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, sentences: int = SAMPLE_SENTENCES) -> Machine:
    """Fits the machine to the labelled documents that aren't held out: at most `limit` of them, by hash of their id.

    One task fits it to the sample, whose size is bounded whatever the input's; the driver gets the weights alone.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    # One text an id, so that an id that comes often adds no rows.
    rows = known.join(texts, F.col("doc_id") == F.col("id")).groupBy(F.col("doc_id").alias("doc"), "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("doc", "toxic", F.posexplode(F.split("text", SENTENCE)).alias("place", "sentence"))
    rows = rows.filter(F.char_length("sentence").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("doc", "place"), "doc", "place").limit(sentences)
    rows = rows.repartition(1).sortWithinPartitions("doc", "place").select("doc", F.col("toxic").cast("int").alias("toxic"), "sentence")
    got = in_arrow(rows, _fitted, "triples binary, weights binary, bias double, scale array<double>, shift double, paired boolean").collect()
    if not got:
        return _constant(-1.0, -4.0)
    machine = Machine.__new__(Machine)
    machine.__setstate__((np.frombuffer(got[0]["triples"], np.int32), np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"], np.array(got[0]["scale"]), got[0]["shift"], got[0]["paired"]))
    return machine


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its toxicity score and class."""
    docs = documents(spark, sf_dir)
    machine = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, machine, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
