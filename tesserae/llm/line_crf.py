"""Document quality from a linear-chain conditional random field over lines.

Every line of a text (null: one empty line) is a node with two states, good and bad. Its features are binned measures of the line
(length, symbols, capitals, repetition, ...), the same measures of the lines before and after it, and whether it is the first or last;
a 2 x 2 table scores neighbouring states. Forward-backward gives each line's marginal of being good; weighted by line length
they aggregate into the document's, and a logistic function calibrated on the training documents makes the score.

Fitted by maximum likelihood (Adam, L2) on at most ``rows`` labelled documents, half of each class where there are enough, chosen
by a hash of doc_id among the rows that ``train`` admits; a training line takes its document's label. Every text is scored whole.

Defined cases: null and empty texts are one empty line; repeated rows get equal scores; rows without doc_id are scored like any other, never
learned from and not held out; an empty table gives no rows; extra
columns are passed through by ``score_documents`` and ``keep_good``. Without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SAMPLE_ROWS, crc_mod, labelled_sample, table
from .scoring import judged, logistic, sigmoid, with_score

BINS = 8
SYMBOLS, UPPERS, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
LETTERS, HIGH, STOPS = bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(128, 256)), b".,;:?"


def measures(text: str) -> list[tuple]:
    """For each line of the text its measures, the first being its weight."""
    out, before = [], None
    for line in text.encode().split(b"\n"):
        words = line.split()
        n, k = len(line), len(words)
        m, v = max(1, n), max(1, k)
        distinct = len(set(words))
        letters = n - len(line.translate(None, LETTERS))
        out.append((
            n + 1, n, k, (n - len(line.translate(None, SYMBOLS))) / m, line.count(b"!") / v, line.count(b"|") / v, (n - len(line.translate(None, UPPERS))) / max(1, letters), (n - len(line.translate(None, DIGITS))) / m,
            (n - len(line.translate(None, HIGH))) / m, distinct / v, sum(map(bytes.__eq__, words, words[1:])) / v, n / v, (n - len(line.translate(None, STOPS))) / v,
            float(line[-1:] in (b".", b"!", b"?")), float(line[:1].isupper()), float(line == before), sum(len(w) <= 3 for w in words) / v,
        ))
        before = line
    return out


def _chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling length, and the row where each begins."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def marginals(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward over many chains at once, a step for each place in a chain.

    unary: score of state 1 (good) against state 0 for each line. Returns each line's marginal of state 1, the sum of the
    chains' log partition functions, and the expected counts of neighbouring states."""
    order, begin = _chains(sizes)
    sizes, begin = sizes[order], begin[order]
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    alpha[begin, 1] = unary[begin]
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(1, longest):
        rows = begin[: active[t]] + t
        step = np.logaddexp(alpha[rows - 1, 0, None] + trans[0], alpha[rows - 1, 1, None] + trans[1])
        step[:, 1] += unary[rows]
        alpha[rows] = step
    for t in range(longest - 2, -1, -1):
        rows = begin[: active[t + 1]] + t
        ahead = beta[rows + 1].copy()
        ahead[:, 1] += unary[rows + 1]
        beta[rows] = np.logaddexp(ahead[:, 0, None] + trans[:, 0], ahead[:, 1, None] + trans[:, 1])
    total = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - total)
    first = np.zeros(len(unary), dtype=bool)
    first[begin] = True
    rows = np.flatnonzero(~first)
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = np.exp(alpha[rows - 1, a] + trans[a, b] + b * unary[rows] + beta[rows, b] - total[rows]).sum()
    return good, float(total[begin].sum()), pair


class Model:
    def __init__(self):
        self.edges = self.weights = self.trans = self.scale = None

    def _columns(self, lines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each line the places of its ones in the binary feature vector."""
        k = lines.shape[1] - 1
        own = np.empty((len(lines), k), dtype=np.int64)
        for j in range(k):
            own[:, j] = np.searchsorted(self.edges[j], lines[:, j + 1], side="right") + j * BINS
        first = np.zeros(len(lines), dtype=bool)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        first[begin] = True
        last = np.roll(first, -1)
        none = np.arange(k) * BINS + BINS - 1  # the bin beyond the last edge serves as "no such line"
        before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        before[first], after[last] = none, none
        width = k * BINS
        ends = np.stack([3 * width + first.astype(np.int64), 3 * width + 2 + last.astype(np.int64)], axis=1)
        return np.hstack([own, before + width, after + 2 * width, ends])

    def fit(self, rows: list[tuple], rounds: int = 120, rate: float = 0.08, l2: float = 3e-3) -> Model:
        y = np.array([r[2] for r in rows], dtype=float)
        if len(set(y)) < 2:
            return self
        per_doc = [measures(t) for _, t, _ in rows]
        sizes = np.array([len(m) for m in per_doc])
        lines = np.array([x for m in per_doc for x in m], dtype=float)
        self.edges = [np.unique(np.quantile(lines[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(1, lines.shape[1])]
        cols = self._columns(lines, sizes)
        state = np.repeat(y, sizes)
        # every document weighs the same, as does every class
        share = np.repeat(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), sizes)
        first = np.zeros(len(lines), dtype=bool)
        first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[np.flatnonzero(~first) - 1].astype(int), state[~first].astype(int)), 1)
        width = int(3 * BINS * (lines.shape[1] - 1) + 4)
        w, trans = np.zeros(width), np.zeros((2, 2))
        m, v, mt, vt = np.zeros(width), np.zeros(width), np.zeros((2, 2)), np.zeros((2, 2))
        for k in range(1, rounds + 1):
            good, _, pair = marginals(w[cols].sum(axis=1), sizes, trans)
            gap = np.repeat(((state - good) * share)[:, None], cols.shape[1], axis=1)
            grad = np.bincount(cols.ravel(), gap.ravel(), minlength=width) / len(lines) - l2 * w
            grad_t = (seen - pair) / len(lines) - 0.05 * trans
            m, v, mt, vt = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mt + 0.1 * grad_t, 0.99 * vt + 0.01 * grad_t**2
            w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            trans = trans + rate * (mt / (1 - 0.9**k)) / (np.sqrt(vt / (1 - 0.99**k)) + 1e-8)
        self.weights, self.trans = w, trans
        x = self._good(lines, sizes)
        self.scale = logistic(x[:, None], y, l2=0.1, weight=np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
        return self

    def _good(self, lines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log odds of each document's length-weighted mean marginal."""
        good, _, _ = marginals(self.weights[self._columns(lines, sizes)].sum(axis=1), sizes, self.trans)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        mean = np.add.reduceat(good * lines[:, 0], begin) / np.add.reduceat(lines[:, 0], begin)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str], lines_at_once: int = 20_000) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        out, held, sizes = [], [], []

        def flush():
            if sizes:
                out.append(self._good(np.array(held, dtype=float), np.array(sizes)))
                held.clear()
                sizes.clear()

        for t in texts:
            got = measures(t)
            held.extend(got)
            sizes.append(len(got))
            if len(held) >= lines_at_once:
                flush()
        flush()
        return sigmoid(np.concatenate(out) * self.scale[0] + self.scale[1]) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, train=None, rows: int = SAMPLE_ROWS) -> Model:
    return Model().fit(labelled_sample(docs, labels, "quality", train, rows))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    return with_score(docs, lambda: model.score, column)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least ``least``, with all their columns."""
    name = "_quality"
    while name in map(str.lower, docs.columns):
        name += "_"
    return score_documents(docs, model, name).where(F.col(name) >= least).drop(name)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return judged(score_documents(docs.select("doc_id", "text"), model), 3, 1)
