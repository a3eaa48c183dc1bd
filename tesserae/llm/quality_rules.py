"""Quality rules with an isolation forest on the rule statistics.

Every whole text gets exact rule counts (words, symbols, repeated lines, words in repeated 5-word windows). Two hard rules
reject a text by themselves (``base_failed``). The rest is judged by an isolation forest: trees of random splits grown on
the statistics of labelled rows of quality 1 with one in fifty of quality 0 (so that a measure which all good rows share
can be split too), where a text that is isolated after few splits is anomalous. The score is
2 ** (-mean path length / expected path length); the threshold is calibrated on all labelled rows, where the gap between
rejected bad and rejected good rows is largest while at most ``good_loss`` of the good ones go.

Statistics, threshold and verdicts come from every labelled row and every text, long ones included; a tree is grown on ``SUBSAMPLE`` rows,
which is what isolates, drawn from all labelled rows by a hash of doc_id.

Defined cases: a null text has no words; an empty text has no words, so it fails the base rules; very long texts are counted whole; repeated rows get equal
results; rows without doc_id are judged like any other and never learned from;
an empty table gives no rows; extra columns are not read. Without labelled rows of both classes only the base rules reject.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, cut, drop, table

TREES, SUBSAMPLE, STEPS = 100, 256, 100_000
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
WINDOW = 5

COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])
MEASURED = T.StructType([*COUNTS.fields[:6], T.StructField("ratios", T.ArrayType(T.DoubleType())), T.StructField("base_failed", T.BooleanType()), T.StructField("text_hash", T.BinaryType())])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words found twice or more in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = ids[:n].copy()
        for j in range(1, window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The rule counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the ratios that the forest sees."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    chars = len(text) - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n))
    v = max(1, n)
    ratios = [symbols / v, chars / v, len(set(words)) / v, raw.count(b"!") / v]
    return [n, chars, symbols, dup, repeat], ratios


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


class Forest:
    """Isolation trees in arrays; a leaf adds the expected path of the rows it still holds."""

    def __init__(self, seed: int = 11):
        self.seed, self.threshold, self.trees, self.norm = seed, None, [], 1.0

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(self, x: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        size = min(SUBSAMPLE, len(x))
        most = int(np.ceil(np.log2(max(2, size))))
        self.norm = max(1e-9, self.expected(size))
        for _ in range(TREES):
            feature, cut, left, path = [], [], [], []

            def node(rows: np.ndarray, depth: int) -> int:
                at = len(feature)
                feature.append(0)
                cut.append(np.inf)  # a leaf sends every row to itself
                left.append(at)
                path.append(depth + self.expected(len(rows)))
                spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
                if depth < most and len(spread):
                    j = int(rng.choice(spread))
                    feature[at], cut[at] = j, rng.uniform(rows[:, j].min(), rows[:, j].max())
                    below = rows[:, j] < cut[at]
                    first = node(rows[below], depth + 1)
                    left[at] = (first, node(rows[~below], depth + 1))
                return at

            node(x[rng.choice(len(x), size, replace=False)], 0)
            sides = np.array([s if isinstance(s, tuple) else (s, s) for s in left])
            self.trees.append((np.array(feature), np.array(cut), sides[:, 0], sides[:, 1], np.array(path), most))
        return self

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, path, most in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(most):
                at = np.where(x[rows, feature[at]] < cut[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-(total / max(1, len(self.trees))) / self.norm)

    def fit(self, rows: list[tuple], good_loss: float = 0.01, mixed_in: float = 0.02) -> Forest:
        """The forest of rows (doc_id, text, label) that are at hand; ``fit`` takes a table of any size."""
        hashes = WordHashes()
        got = [(*statistics(t, hashes), y) for _, t, y in rows]
        got = [(r, y) for c, r, y in got if not base_failed(c[0], c[4])]
        x, y = np.array([r for r, _ in got]), np.array([y for _, y in got])
        if len(set(y.tolist())) < 2:
            return self
        self.grow(np.vstack([x[y == 1], x[y == 0][: max(1, int(mixed_in * (y == 1).sum()))]]))
        steps = self.steps(x)
        return self.calibrate(Counter(steps[y == 1].tolist()), Counter(steps[y == 0].tolist()), good_loss)

    def steps(self, x: np.ndarray) -> np.ndarray:
        """The anomaly in whole steps of 1 / STEPS, rounded up."""
        return np.ceil(self.anomaly(x) * STEPS).astype(np.int64)

    def calibrate(self, good: dict[int, int], bad: dict[int, int], good_loss: float = 0.01) -> Forest:
        """The threshold from how many good and bad rows lie at each step: the gap between rejected bad and rejected good rows is largest
        there while at most ``good_loss`` of the good ones go; of equal gaps the largest threshold."""
        n, m, best, lost, caught = sum(good.values()), sum(bad.values()), (-1.0, np.inf), 0, 0
        for t in sorted({*good, *bad}, reverse=True):
            if lost <= good_loss * n and t in good:
                best = max(best, (caught / m - lost / n, t / STEPS))
            lost, caught = lost + good.get(t, 0), caught + bad.get(t, 0)
        self.threshold = best[1]
        return self


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the rule counts, the forest's ratios, base_failed and a hash of the text for every row."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text")
            out = []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                c, r = statistics(text, hashes)
                out.append((*c, r, base_failed(c[0], c[4]), xxhash.xxh3_128_digest(text.encode())))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [pa.int64()] * 5 + [pa.list_(pa.float64()), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=MEASURED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURED)


def labelled_ratios(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and ratios of every labelled document that the base rules pass, from measured rows. Of rows that share a doc_id the text of the
    smallest hash is taken; of several labels of a doc_id the largest counts; null labels and labels other than 0 and 1 are not used."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    one = F.min_by(F.struct("base_failed", "ratios"), "text_hash").alias("_one")
    return rows.join(known, "doc_id").groupBy("doc_id", "label").agg(one).where("not _one.base_failed").select("doc_id", "label", "_one.ratios")


def _drawn(rows: DataFrame, count: int, n: int) -> list:
    """The ratios of n of count rows, by hashes of doc_id: one leaves about 1.5 n rows, so that this is what all tasks together send."""
    near = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < F.lit(int(min(1.0, (1.5 * n + 20) / count) * (1 << 30)))
    return [r[0] for r in rows.where(near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("ratios").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    return fit_measured(measured(docs), labels)


def fit_measured(measured_rows: DataFrame, labels: DataFrame, mixed_in: float = 0.02) -> Forest:
    """Each tree draws its own subsample, as isolation trees do, here from all labelled rows: of each class the TREES * SUBSAMPLE rows of the smallest
    hashes are dealt to the trees. The threshold is calibrated on all labelled rows, counted by step of the anomaly."""
    rows = cut(labelled_ratios(measured_rows, labels), "labelled-ratios")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(count) < 2:
        return Forest()
    mixed = min(count[0], max(1, int(mixed_in * count[1])))  # so many rows of label 0 are among those that trees are grown on
    size = TREES * SUBSAMPLE
    wanted = {1: min(count[1], size), 0: min(mixed, max(1, round(mixed / (mixed + count[1]) * size)))}
    drawn = {k: np.array(_drawn(rows.where(F.col("label") == k), count[k], n)) for k, n in wanted.items()}
    forest = Forest().grow(np.vstack([drawn[1], drawn[0]]))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("ratios").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(forest.steps(x))], names=["label", "step"])

    at = rows.mapInArrow(run, "label int, step long").groupBy("label", "step").count().collect()
    drop(rows)
    return forest.calibrate(*({r["step"]: r["count"] for r in at if r["label"] == k} for k in (1, 0)))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the rule counts, base_failed, anomaly and kept for every row."""
    return judge_measured(measured(docs), forest)


def judge_measured(measured_rows: DataFrame, forest: Forest) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            failed = np.array(batch.column("base_failed").to_pylist())
            score = forest.anomaly(np.array(batch.column("ratios").to_pylist())) if forest.trees else np.zeros(len(failed))
            kept = ~failed & ((score <= forest.threshold) if forest.threshold is not None else True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COUNTS.names[:-2]), pa.array(score), pa.array(kept)], names=COUNTS.names)

    return measured_rows.select(*COUNTS.names[:-2], "ratios").mapInArrow(run, COUNTS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are measured once; model and verdicts read what was measured."""
    rows = cut(measured(table(spark, sf_dir, "documents")), "measured")
    return judge_measured(rows, fit_measured(rows, table(spark, sf_dir, "labels")))
