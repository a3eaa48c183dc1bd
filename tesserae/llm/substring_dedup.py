"""Substring deduplication with a count-min prefilter and an exact second pass.

A window is ``WINDOW`` consecutive words. A word goes if a window that covers it also starts in a document of smaller doc_id.

Documents are dealt into batches of about ``batch_bytes`` by a hash; one shuffle of the texts serves all three steps.
1. Each batch makes the count-min sketch of its windows: two hash rows of cells, kept as sorted cell lists cut into slices, so that
   a sketch costs space for its windows and not for its width. A slice's task merges the counts of all batches and
   answers each batch with a bit for each of its cells: counted twice or more. The width grows with the corpus; no task holds more
   than a slice of it and nothing is broadcast. A count is never too low, so no repeated window is lost.
2. Windows with both bits set go, once for each batch with the smallest doc_id there, to the bucket of their hash, where they are
   grouped exactly (by 96 bits of hash of the words). A batch gets back those of its windows that start in a smaller doc_id
   in another batch. A window common to all documents is one entry for each batch, not for each document.
3. The batch applies these and its own repetitions to its texts.

Defined cases: null and empty texts have no words; texts of fewer than ``WINDOW`` words lose none; rows that repeat a doc_id do
not remove from each other; a null doc_id neither removes nor loses; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, table

WINDOW = 13
ROWS = 2  # of the sketch
ODD = np.random.default_rng(13).integers(0, 1 << 62, (2, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPIN = np.uint64(0xC2B2AE3D27D4EB4F)
CELLS_A_SLICE, BUCKET_WINDOWS = 1 << 22, 1 << 20
_HASHES: list = []


class Batch:
    """The windows of one batch of documents, in an order that does not depend on how its rows arrive."""

    def __init__(self, rows: pa.Table):
        if not _HASHES:
            _HASHES.append(WordHashes(3))
        docs = sorted(zip(rows.column("doc_id").to_pylist(), ((t or "").encode() for t in rows.column("text").to_pylist()), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.doc_ids = [d for d, _ in docs]
        self.words = [t.split() for _, t in docs]
        sizes = [max(0, len(w) - WINDOW + 1) if d is not None else 0 for d, w in zip(self.doc_ids, self.words, strict=True)]
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.h = np.empty(int(self.begins[-1]), dtype=np.uint64)
        self.ids = [np.fromiter(map(_HASHES[0].__getitem__, w), dtype=np.uint64, count=len(w)) if n else None for w, n in zip(self.words, sizes, strict=True)]
        for i, n in enumerate(sizes):
            if n:
                self.h[self.begins[i] : self.begins[i + 1]] = self._windows(self.ids[i], n, ODD[0])
        # distinct windows in hash order; documents stand in doc_id order, so the first place is the smallest doc_id
        order = np.argsort(self.h, kind="stable")
        s = self.h[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        self.distinct, self.first = s[new], order[new]
        self.counts = np.diff(np.append(np.flatnonzero(new), len(s)))
        self.which = np.empty(len(s), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1

    @staticmethod
    def _windows(ids: np.ndarray, n: int, odd: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            w = ids[:n] * odd[0]
            for j in range(1, WINDOW):
                w += ids[j : j + n] * odd[j]
            w ^= w >> np.uint64(31)
            w *= SPIN
        return w

    def second(self, places: np.ndarray) -> np.ndarray:
        """An independent hash of the windows at some places: other multipliers on remixed words."""
        doc = np.searchsorted(self.begins, places, side="right") - 1
        out = np.empty(len(places), dtype=np.uint64)
        order = np.argsort(doc, kind="stable")
        edge = np.searchsorted(doc[order], np.arange(len(self.words) + 1))
        for i in np.flatnonzero(np.diff(edge)).tolist():
            rows = order[edge[i] : edge[i + 1]]
            with np.errstate(over="ignore"):
                ids = (self.ids[i] ^ (self.ids[i] >> np.uint64(29))) * SPIN
            out[rows] = self._windows(ids, len(ids) - WINDOW + 1, ODD[1])[places[rows] - self.begins[i]]
        return out

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        ids = np.array([d if d is not None else -(1 << 62) for d in self.doc_ids], dtype=np.int64)
        return ids[np.searchsorted(self.begins, places, side="right") - 1]

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted cells of the distinct windows, those found twice here standing twice; and whose each is."""
        who = np.repeat(np.arange(len(self.distinct)), np.minimum(self.counts, 2))
        h = self.distinct[who]
        if row:
            with np.errstate(over="ignore"):
                h = (h ^ (h >> np.uint64(32))) * SPIN
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
        return h >> np.uint64(64 - bits), who


def _packed(cells: np.ndarray) -> bytes:
    gaps = np.diff(cells, prepend=np.uint64(0))
    return b"\2" + gaps.astype("<u2").tobytes() if not len(gaps) or gaps.max() < 65536 else b"\4" + gaps.astype("<u4").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, dtype="<u2" if blob[0] == 2 else "<u4", offset=1), dtype=np.int64)


def _table(columns: dict) -> pa.Table:
    return pa.table({k: pa.array(v, type=t) for k, (v, t) in columns.items()})


def substring_dedup(docs: DataFrame, batch_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of docs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    bits = max(12, int(size // 3).bit_length())  # about two cells for each window in either row
    cut_bits = min(bits, CELLS_A_SLICE.bit_length() - 1)
    slices = 1 << (bits - cut_bits)
    buckets = max(1, size // 6 // BUCKET_WINDOWS)

    def sketch(rows: pa.Table) -> pa.Table:
        name, b = rows.column("batch")[0].as_py(), Batch(rows)
        out: tuple[list, list] = ([], [])
        for row in range(ROWS):
            cells, _ = b.cells(row, bits)
            edge = np.searchsorted(cells, np.arange(slices + 1, dtype=np.uint64) << np.uint64(cut_bits))
            for s in np.flatnonzero(np.diff(edge)).tolist():
                out[0].append(row * slices + s)
                out[1].append(_packed(cells[edge[s] : edge[s + 1]] - np.uint64(s << cut_bits)))
        return _table({"slice": (out[0], pa.int64()), "batch": ([name] * len(out[0]), pa.int64()), "blob": (out[1], pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        counts = np.zeros(1 << cut_bits, dtype=np.uint8)
        blobs = rows.column("blob").to_pylist()
        for blob in blobs:
            cells = _unpacked(blob)
            again = cells[1:][cells[1:] == cells[:-1]]
            counts[cells] = np.minimum(counts[cells] + 1, 2)
            counts[again] = 2
        bits_ = [np.packbits(counts[_unpacked(blob)] >= 2).tobytes() for blob in blobs]
        return _table({"batch": (rows.column("batch"), pa.int64()), "slice": (rows.column("slice"), pa.int64()), "bits": (bits_, pa.binary())})

    def ask(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _table({"bucket": ([], pa.int64()), "batch": ([], pa.int64()), "blob": ([], pa.binary())})
        name, b = rows.column("batch")[0].as_py(), Batch(rows)
        got = dict(zip(answers.column("slice").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        likely = np.ones(len(b.distinct), dtype=bool)
        for row in range(ROWS):
            cells, who = b.cells(row, bits)
            edge = np.searchsorted(cells, np.arange(slices + 1, dtype=np.uint64) << np.uint64(cut_bits))
            seen = np.zeros(len(cells), dtype=bool)
            for s in np.flatnonzero(np.diff(edge)).tolist():
                seen[edge[s] : edge[s + 1]] = np.unpackbits(np.frombuffer(got[row * slices + s], dtype=np.uint8), count=int(edge[s + 1] - edge[s]))
            here = np.zeros(len(b.distinct), dtype=bool)
            here[who[seen]] = True
            likely &= here
        pick = np.flatnonzero(likely)
        h1, h2, doc = b.distinct[pick], b.second(b.first[pick]) >> np.uint64(32), b.doc_of(b.first[pick])
        where = (h1 % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[order], np.arange(buckets + 1))
        out: tuple[list, list] = ([], [])
        for k in np.flatnonzero(np.diff(edge)).tolist():
            o = order[edge[k] : edge[k + 1]]
            out[0].append(k)
            out[1].append(h1[o].astype("<u8").tobytes() + doc[o].astype("<i8").tobytes() + h2[o].astype("<u4").tobytes() + pick[o].astype("<u4").tobytes())
        return _table({"bucket": (out[0], pa.int64()), "batch": ([name] * len(out[0]), pa.int64()), "blob": (out[1], pa.binary())})

    def group(rows: pa.Table) -> pa.Table:
        blobs, names = rows.column("blob").to_pylist(), rows.column("batch").to_pylist()
        sizes = [len(x) // 24 for x in blobs]
        at = lambda kind, skip, width: np.concatenate([np.frombuffer(x, dtype=kind, count=n, offset=skip * n) for x, n in zip(blobs, sizes, strict=True)])
        h1, doc, h2, place = at("<u8", 0, 8), at("<i8", 8, 8), at("<u4", 16, 4), at("<u4", 20, 4)
        order = np.lexsort((h2, h1))
        a, c = h1[order], h2[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], begin)
        gone = np.empty(len(order), dtype=bool)
        gone[order] = least[np.cumsum(new) - 1] < doc[order]
        out: tuple[list, list] = ([], [])
        end = 0
        for name, n in zip(names, sizes, strict=True):
            hit = place[end : end + n][gone[end : end + n]]
            end += n
            if len(hit):
                out[0].append(name)
                out[1].append(hit.astype("<u4").tobytes())
        return _table({"batch": (out[0], pa.int64()), "places": (out[1], pa.binary())})

    def remove(rows: pa.Table, found: pa.Table) -> pa.Table:
        b = Batch(rows) if rows.num_rows else None
        if b is None:
            return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])]).empty_table()
        elsewhere = np.zeros(len(b.distinct), dtype=bool)
        for blob in found.column("places").to_pylist():
            elsewhere[np.frombuffer(blob, dtype="<u4")] = True
        place = np.arange(len(b.h))
        gone = elsewhere[b.which] | (b.doc_of(place) > b.doc_of(b.first[b.which])) if len(place) else np.zeros(0, dtype=bool)
        removed, shas, texts = [], [], []
        for i, words in enumerate(b.words):
            hits = np.flatnonzero(gone[b.begins[i] : b.begins[i + 1]])
            if len(hits):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[hits] += 1
                np.add.at(edge, hits + WINDOW, -1)
                stay = np.cumsum(edge)[:-1] == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            kept = b" ".join(words)
            removed.append(len(b.words[i]) - len(words))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        out = {"doc_id": (b.doc_ids, pa.int64()), "n_words": ([len(w) for w in b.words], pa.int64()), "n_removed": (removed, pa.int64()), "kept_sha256": (shas, pa.string())}
        return _table(out | ({"kept_text": (texts, pa.string())} if with_text else {}))

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("long").alias("batch"))
    lists = rows.groupBy("batch").applyInArrow(sketch, "slice long, batch long, blob binary")
    answers = lists.groupBy("slice").applyInArrow(merge, "batch long, slice long, bits binary")
    asked = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(ask, "bucket long, batch long, blob binary")
    found = asked.groupBy("bucket").applyInArrow(group, "batch long, places binary")
    return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS t(i) WHERE len(ws) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT p.doc_id, list(p.i) AS starts FROM p JOIN f USING (g) WHERE p.doc_id > f.first GROUP BY p.doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS g FROM hit),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(g, i)), lambda i: ws[i]) END AS kept
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
