"""Toxicity by compression distance with two zstandard dictionaries, trained on toxic and on ordinary text.

A text is lower-cased (A-Z) and written as a stream of fixed-width codes, one for each word and one for each of several lengths of the word's
opening bytes, as families of words share openings of different lengths; so what the compressor matches is whole words and word families, not
chance runs of letters. The stream is cut into
windows of ``window`` words. Each window is compressed twice: with the ordinary dictionary, and with the toxic dictionary laid in front
of the ordinary one, so that words that both know cost the same. The bytes that the second saves are the window's margin. A
document's score is a logistic function of how many windows reach the calibrated margin, their share, and the largest margin.

Both dictionaries are trained by zstandard. Most windows of a toxic document are ordinary, so the toxic one is trained in ``turns``
turns: first on all windows of the toxic sample, then on those windows from which a dictionary trained on the *other* half of the toxic documents
saves at least ``saved`` bytes. What only one document has so never confirms itself. The margin that counts, the size of the toxic dictionary (one of
``toxic_bytes``) and the logistic weights are calibrated on margins that dictionaries of one half of the sample leave on the other half.

Fitted on at most ``rows`` labelled documents (half toxic where there are enough), chosen by a hash of doc_id among the rows
that ``train`` admits (see ``common.labelled_sample`` for the bounds). Every text is scored whole.

Defined cases: null and empty texts have no window and get the score of zero margins; very long texts are scored window by window; repeated
rows get equal scores; rows without doc_id are scored like any other, never learned from and not held out; an
empty table gives no rows; extra columns are passed through by ``score_documents``. Without labelled rows of both
classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, table
from .scoring import judged, logistic, sigmoid, with_score

ROWS = 6000  # bound of the labelled sample; with SAMPLE_TEXT_BYTES at most 393 MB reach the driver
TRIM = b".,!?;:#*$%&|<>\"'()[]"
LEVEL = 5  # the first level whose search looks at every place of a dictionary


class Units(dict):
    """word -> its codes: of the word, and of its opening bytes of each length that it is longer than."""

    def __init__(self, opening: int | tuple[int, ...], bound: int = 1 << 18):
        super().__init__()
        self.openings, self.bound = opening if isinstance(opening, tuple) else (opening,), bound

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        bare = word.strip(TRIM) or word
        got = xxhash.xxh3_64_digest(bare)
        for k in self.openings:
            if len(bare) > k:
                got += xxhash.xxh3_64_digest(b"^" + bare[:k])
        self[word] = got
        return got


def _compressor(dictionary: bytes):
    import zstandard as zs

    if not dictionary:
        return zs.ZstdCompressor(level=LEVEL, write_content_size=False)
    raw = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
    return zs.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary of segments of two codes; too few samples to train on are the dictionary themselves."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, k=16, d=8).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def saved_bytes(ordinary: bytes, toxic: bytes, cut: list[list[bytes]]) -> list[np.ndarray]:
    """For each window of each text, the bytes that the toxic dictionary saves."""
    plain, both = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress
    return [np.array([len(plain(w)) - len(both(w)) for w in ws], dtype=np.int64) for ws in cut]


def dictionaries(cut: list[list[bytes]], y: np.ndarray, half: np.ndarray, ordinary_bytes: int, toxic_bytes: int, turns: int, saved: int) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of texts cut into windows."""
    ordinary = _train(ordinary_bytes, [w for ws, k in zip(cut, y, strict=True) if k == 0 for w in ws])
    toxic = [ws for ws, k in zip(cut, y, strict=True) if k == 1]
    halves = [np.flatnonzero(half[y == 1] == h).tolist() for h in (0, 1)]
    telling = toxic
    for _ in range(turns):
        found: list = [[] for _ in toxic]
        for mine, others in (halves, halves[::-1]):
            other = _train(toxic_bytes, [w for i in others for w in telling[i]])
            for i, gains in zip(mine, saved_bytes(ordinary, other, [toxic[i] for i in mine]), strict=True):
                found[i] = [w for w, n in zip(toxic[i], gains, strict=True) if n >= saved]
        telling = found if any(found) else toxic
    return ordinary, _train(toxic_bytes, [w for ws in telling for w in ws])


class Model:
    """The two dictionaries, the margin that counts and the logistic weights; ``margins`` does the compressing."""

    def __init__(self, window: int = 16, opening: int | tuple[int, ...] = (4, 5, 6)):
        self.window, self.opening = window, opening
        self.toxic = self.ordinary = b""
        self.least, self.weights = 3, None

    def windows(self, text: str, units: Units) -> list[bytes]:
        codes = list(map(units.__getitem__, text.encode().lower().split()))
        return [b"".join(codes[i : i + self.window]) for i in range(0, len(codes), self.window)]

    def margins(self, texts: list[str]) -> list[np.ndarray]:
        units = Units(self.opening)
        return saved_bytes(self.ordinary, self.toxic, [self.windows(t, units) for t in texts])

    def features(self, margins: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(margins), 4))
        for i, m in enumerate(margins):
            if len(m):
                hits = m[m >= self.least]
                out[i] = np.log1p(len(hits)), 10 * len(hits) / len(m), min(24, m.max()) / 10, np.log1p(hits.sum() / len(m))
        return out

    def fit(self, rows: list[tuple], ordinary_bytes: int = 1 << 15, toxic_bytes: tuple[int, ...] = (1536, 2048), turns: int = 2, saved: int = 4) -> Model:
        y = np.array([float(r[2]) for r in rows])
        if not (y == 1).any() or not (y == 0).any():
            return self
        units = Units(self.opening)
        cut = [self.windows(t, units) for _, t, _ in rows]
        bits = np.array([xxhash.xxh3_64_intdigest(f"half {r[0]}".encode()) & 3 for r in rows])
        best = (-1.0, 0, 0, None)
        for size in toxic_bytes:
            margins: list = [None] * len(rows)
            for h in (0, 1):
                there, here = np.flatnonzero(bits >> 1 != h), np.flatnonzero(bits >> 1 == h)
                pair = dictionaries([cut[i] for i in there], y[there], bits[there] & 1, ordinary_bytes, size, turns, saved)
                for i, m in zip(here, saved_bytes(*pair, [cut[i] for i in here]), strict=True):
                    margins[i] = m
            for least in range(1, 25):
                hit = np.array([bool((m >= least).any()) for m in margins])
                best = max(best, (hit[y == 1].mean() - hit[y == 0].mean(), -least, size, margins), key=lambda t: t[:3])
        _, least, size, margins = best
        self.least = -least
        self.ordinary, self.toxic = dictionaries(cut, y, bits & 1, ordinary_bytes, size, turns, saved)
        # classes weigh the same, so 0.5 is where they are equally likely
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        self.weights = logistic(self.features(margins), y, l2=0.5, weight=weight)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = self.features(self.margins(texts))
        return sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, train=None, rows: int = ROWS) -> Model:
    return Model().fit(labelled_sample(docs, labels, "toxic", train, rows))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    return with_score(docs, lambda: model.score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return judged(score_documents(docs.select("doc_id", "text"), model), 5, 0)
