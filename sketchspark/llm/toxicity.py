"""Toxicity: a support vector machine over a subsequence string kernel, with Nystrom landmarks.

Kernel.  A word is its letters; what stands between letters of a blank-delimited token is
skipped, and runs of one-letter tokens are joined ("i.d.i o t" is "idiot").  Words longer
than 8 letters are seen through every window of 8.  The feature of a letter triple is
decay^(gaps) for each place where it occurs in order within a span of 6 letters, so gapped
and inserted characters cost weight but keep the match; the kernel is the cosine of these.

Landmarks are letter n-grams of the training sentences that are in toxic documents beyond
chance, with as many usual clean words.  Nystrom maps a word to K_mm^(-1/2) k(word, landmarks), and
a linear squared-hinge SVM is fitted there.  A sentence scores as its highest word and a
document as its highest sentence.  Labels are per document, so the fit is multi-instance: the
witness of a toxic document is its highest sentence under the model so far, while every
sentence of a clean document is clean.  A logistic curve on the documents' scores,
weighted to the labels' rate, gives the probability.

In the linear span of the landmarks the decision is one weight per letter triple, so a
word costs a few table look-ups; distinct words are scored once and kept in a bounded cache.

The fit reads a bounded sample of labelled rows: `per_label` toxic documents and
`clean_factor` times as many clean ones, the least hashes of their ids, `sample_chars` characters of each; these go to the driver.

Defined results: null or empty text, or text without words of three letters, has the lowest
score; without labels of both kinds every score is 0; an empty table gives no rows.  Equal
texts, equal scores.  Of rows with one id the fit reads the least text.  `with_score` keeps all
columns but one of the score's name, which it replaces; `score` returns its own columns only.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ROLLING, U64, byte_chunks, byte_view, mix64, word_spans
from .language_id import in_fold

SPAN, DECAY, WINDOW = 6, 0.5, 8
SYMBOLS = 32
CACHE_WORDS = 1 << 19
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
BLANKS = re.compile(r"[\x20\x09-\x0D]+")  # those of `word_spans`
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")


class _Symbols(dict):
    """Translation of lower-case text: letters to their base letter or one of five symbols, the rest to nothing."""

    def __missing__(self, code: int) -> str | None:
        c, out = chr(code), None
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0]
            out = base if "a" <= base <= "z" else chr(123 + code % 5)
        self[code] = out
        return out


_SYMBOLS = _Symbols()


def letters(word: str) -> str:
    """The letters of a token, as symbols a-z and five more."""
    return word.lower().translate(_SYMBOLS)


def words_of(text: str) -> list[str]:
    """Letters of the words; one-letter tokens that follow one another are one word."""
    out, single = [], ""
    for token in BLANKS.split(text):
        word = letters(token)
        if not word:
            continue  # marks between letters
        if len(word) == 1:
            single += word
            continue
        if single:
            out.append(single)
            single = ""
        out.append(word)
    return [*out, single] if single else out


def windows_of(word: str) -> list[str]:
    return [word[i : i + WINDOW] for i in range(max(1, len(word) - WINDOW + 1))] if len(word) > 2 else []


def triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of all letter triples of padded windows; weight 0 where one is padding."""
    index, weight = [], []
    for a, b in GAPS:
        n = rows.shape[1] - a - b
        first, second, third = rows[:, :n], rows[:, a : a + n], rows[:, a + b : a + b + n]
        index.append((first * SYMBOLS + second) * SYMBOLS + third)
        weight.append(np.where(third > 0, DECAY ** (a + b - 2), 0.0))
    return np.concatenate(index, 1), np.concatenate(weight, 1)


def padded(windows: list[str]) -> np.ndarray:
    """Symbol numbers from 1 on; 0 is padding."""
    raw = "".join(w.ljust(WINDOW, "`") for w in windows).encode("ascii")
    return (np.frombuffer(raw, np.uint8) - 96).reshape(-1, WINDOW).astype(np.int64)


def decisions(windows: list[str], table: np.ndarray) -> np.ndarray:
    """table . phi(w) / |phi(w)| of each window."""
    out = np.empty(len(windows))
    for i in range(0, len(windows), 1 << 14):
        index, weight = triples(padded(windows[i : i + (1 << 14)]))
        norm = np.sqrt((weight**2).sum(1))
        out[i : i + len(index)] = (table[index] * weight).sum(1) / np.maximum(norm, 1e-9)
    return out


class StringKernelSVM:
    """The fitted model: one weight for each letter triple, an offset, and the logistic curve."""

    def __init__(self, table: np.ndarray | None = None, offset: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift
        self._empty()

    def __getstate__(self) -> tuple:
        return self.table, self.offset, self.slope, self.shift

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _empty(self) -> None:
        self.keys, self.values = np.zeros(0, U64), np.zeros(0)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The highest window of each word; -1 without one."""
        windows, owner = [], []
        for i, w in enumerate(words):
            found = windows_of(w)
            windows += found
            owner += [i] * len(found)
        out = np.full(len(words), -1.0)
        if windows and self.table is not None:
            np.maximum.at(out, np.array(owner), np.maximum(-1.0, decisions(windows, self.table) + self.offset))
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(score))
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest word score of texts that lie one after another in data."""
        begin, end = word_spans(data, offsets[:-1])
        n, best = len(offsets) - 1, np.full(len(offsets) - 1, -1.0)
        keys = mix64(ROLLING.slices(ROLLING.sums(data), begin, end) + (end - begin).astype(U64))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._empty()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool))
        if len(new):
            view = memoryview(data)
            words = [letters(str(view[begin[i] : end[i]], "utf-8")) for i in first[new]]
            scores = self.word_scores(words)
            scores[[len(w) == 1 for w in words]] = -2.0  # marks a one-letter token
            scores[[not w for w in words]] = -3.0  # and one of marks alone
            named = np.r_[self.keys, distinct[new]]
            order = np.argsort(named)
            self.keys, self.values = named[order], np.r_[self.values, scores][order]
            at = np.searchsorted(self.keys, distinct)
        value = self.values[at][back] if len(distinct) else np.zeros(0)
        doc = np.searchsorted(offsets, begin, "right") - 1
        np.maximum.at(best, doc, np.maximum(value, -1.0))
        lone = np.flatnonzero((value < -1.5) & (value > -2.5))  # runs of three or more one-letter tokens are words, too
        if len(lone) > 2:
            place = np.cumsum(value > -2.5)  # among tokens with letters
            run = np.flatnonzero(np.r_[True, (np.diff(place[lone]) > 1) | (np.diff(doc[lone]) > 0)])
            size = np.diff(np.r_[run, len(lone)])
            view = memoryview(data)
            picked = np.flatnonzero(size > 2)
            joined = ["".join(letters(str(view[begin[i] : end[i]], "utf-8")) for i in lone[run[r] : run[r] + size[r]]) for r in picked]
            np.maximum.at(best, doc[lone[run[picked]]], self.word_scores(joined))
        return best[:n]


# --- fit --------------------------------------------------------------------------------------


def ngrams(words: list[str]) -> set[str]:
    return {w[i : i + n] for w in words for n in (4, 5, 6) for i in range(len(w) - n + 1)}


def choose_landmarks(toxic: list[list[str]], clean: list[list[str]], count: int, least: float = 14.0) -> list[str]:
    """n-grams whose documents are toxic beyond chance (log-likelihood ratio), none holding another."""
    bad = Counter(g for words in toxic for g in ngrams(words))
    bad = {g: n for g, n in bad.items() if n > 2}
    good = Counter(g for words in clean for g in ngrams(words) if g in bad)
    rate = len(toxic) / (len(toxic) + len(clean))

    def worth(g: str) -> float:
        n, m = bad[g], good[g]
        p = n / (n + m)
        return 0.0 if p <= 0.8 else n * np.log(p / rate) + (m * np.log((1 - p) / (1 - rate)) if m else 0.0)

    found = {g: w for g in bad if (w := worth(g)) >= least}
    out: list[str] = []
    for g in sorted(found, key=lambda g: (-found[g] - 0.5 * len(g), g)):
        if len(out) < count and not any(g in o or o in g for o in out):
            out.append(g)
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps of the primal L2-loss SVM."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / cost
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(steps):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(score: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a smoothed logistic fit."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[score, np.ones(len(score))], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-4 * np.eye(2), x.T @ (target - p) - 1e-4 * w)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def fit_texts(texts: list[str], labels: list[int], landmarks: int = 96, cost: float = 1.0, rounds: int = 4, negatives: int = 6000) -> StringKernelSVM:
    """Learn from labelled documents; their sentences are the instances."""
    label = np.array(labels)
    if not (label == 1).any() or not (label == 0).any():
        return StringKernelSVM()
    words = [sorted({w for s in SENTENCE.split(t) for w in words_of(s)}) for t in texts]
    bad = choose_landmarks([d for d, y in zip(words, label, strict=True) if y], [d for d, y in zip(words, label, strict=True) if not y], landmarks)
    number: dict[str, int] = {}
    seen = [np.unique(np.array([number.setdefault(x, len(number)) for w in d for x in windows_of(w)], np.int32)) for d in words]
    every = list(number)
    del words, number
    clean = np.bincount(np.concatenate([d for d, y in zip(seen, label, strict=True) if not y]), minlength=len(every)) if every else np.zeros(0)
    usual = [every[i] for i in np.argsort(-clean, kind="stable")[: int((clean > 0).sum())]]
    if not bad or not usual:
        return StringKernelSVM()
    marks = bad + usual[: max(16, len(bad))]
    index, weight = triples(padded(marks))
    weight = weight / np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-9)
    phi = np.zeros((len(marks), SYMBOLS**3), np.float32)
    np.add.at(phi, (np.arange(len(marks))[:, None], index), weight)
    value, vector = np.linalg.eigh(phi @ phi.T)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T  # K_mm^(-1/2)
    features = lambda w: np.stack([decisions(w, row) for row in phi], 1) @ root
    # every window of a clean sentence is negative: the most usual ones, and in each round the worst of all
    minus = usual[:negatives]
    x_minus = features(minus)
    toxic = [d for d, y in zip(seen, label, strict=True) if y and len(d)]
    model = None
    for _ in range(rounds):
        if model is None:  # at first, windows that hold a landmark
            held = np.array([any(g in w for g in bad) for w in every])
            witness = [every[i] for d in toxic for i in d if held[i]]
        else:
            scored = decisions(every, model.table) + model.offset
            witness = [every[d[int(scored[d].argmax())]] for d in toxic if scored[d].max() > -0.5]
            wrong = decisions(usual, model.table) + model.offset
            known = set(minus)
            more = [usual[i] for i in np.argsort(-wrong, kind="stable")[:negatives] if wrong[i] > -1 and usual[i] not in known]
            if more:
                minus = minus + more
                x_minus = np.r_[x_minus, features(more)]
        if not witness:
            return StringKernelSVM()
        counts = Counter(witness)
        plus = list(counts)
        share = np.array([counts[p] for p in plus], float)
        x = np.r_[features(plus), x_minus]
        y = np.r_[np.ones(len(plus)), -np.ones(len(minus))]
        w, b = squared_hinge(x, y, np.r_[share / share.sum() * len(minus) * 0.2, np.ones(len(minus))], cost)
        model = StringKernelSVM((root @ w) @ phi, b)
    scored = decisions(every, model.table) + model.offset
    best = np.array([max(-1.0, float(scored[d].max())) if len(d) else -1.0 for d in seen])
    slope, shift = logistic(best, label.astype(float))
    return StringKernelSVM(model.table.astype(np.float32), model.offset, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1000, clean_factor: int = 2, sample_chars: int = 4000) -> StringKernelSVM:
    """Learn from the labelled rows of docs; ids that are labelled both ways are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    picked = {}
    for y, most in ((1, per_label), (0, per_label * clean_factor)):  # the least hashes: a top-k in every task
        picked |= {r[0]: y for r in known.where(F.col("y") == y).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(most).collect()}
    text = F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, sample_chars)
    # one text of each id, should ids repeat, so the sample's bound is one of rows, too
    rows = docs.where(F.col(id_col).isin(list(picked))).groupBy(id_col).agg(F.min(text).alias("t")).collect() if picked else []
    rows = sorted((r[0], r["t"] or "") for r in rows)
    return fit_texts([t for _, t in rows], [picked[i] for i, _ in rows])


def _score_stage(model: StringKernelSVM):
    """The last column's texts become scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(batch.num_columns - 1))
            best = np.full(batch.num_rows, -1.0)
            for i, j in byte_chunks(offsets, 4 << 20):
                best[i:j] = model.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.probability(best))], [*batch.schema.names[:-1], "score"])

    return run


def score(df: DataFrame, model: StringKernelSVM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), from the text alone."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), in_fold(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score_stage(model), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_score(df: DataFrame, model: StringKernelSVM, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """df with one more column, the score (which replaces a column of that name)."""
    others = [c for c in df.columns if c != score_col]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score_stage(model), StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in others), F.col("score").alias(score_col))
