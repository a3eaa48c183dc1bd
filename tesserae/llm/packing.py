"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A document (null text: empty) is its ids by a tokenizers file plus an end id. Whole windows of ``length`` ids are cut off it and
are sequences as they stand; what remains is cut into pieces of at most ``piece`` ids. The pieces of a few hundred documents at
a time are dealt to windows by multiway differencing: every piece starts as a partial partition with one used window; the two
partial partitions of the largest imbalance are merged, the fullest windows of one with the emptiest of the other, until one
partition is left. If a window of it exceeds the capacity the number of windows rises and the deal starts anew.

Documents stay in the task that reads them: no shuffle, no state beyond one group, ids from the position in the input.
A sequence is padded to ``length`` unless its length is a power of two.

Defined cases: null and empty texts are one id (the end id); repeated rows, and rows without doc_id, are packed each by itself (the pieces
of the latter carry a null); a text of any length
is cut into as many windows as it needs; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import WordBpe, runs, table, token_cache

END = 1
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window of each item, and the fullest window's load.

    A partial partition is its loads from the fullest down and, for each, the root of a binary tree over items (-1: none)."""
    n = len(sizes)
    left, right = np.full(2 * n * 2, -1, dtype=np.int64), np.full(2 * n * 2, -1, dtype=np.int64)
    used = n  # nodes below n are the items
    heap: list[tuple] = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        # the unused windows of either side are zeros at its end; so are its rising loads' beginnings
        k = min(windows, len(a) + len(b))
        loads, roots = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        loads[: len(a)], roots[: len(a)] = a, ra
        loads[k - len(b) :] += b[::-1]
        other = np.full(k, -1, dtype=np.int64)
        other[k - len(b) :] = rb[::-1]
        both = np.flatnonzero((roots >= 0) & (other >= 0))
        if len(both):
            if used + len(both) > len(left):
                left, right = np.concatenate([left, np.full(len(left), -1)]), np.concatenate([right, np.full(len(right), -1)])
            new = np.arange(used, used + len(both))
            left[new], right[new] = roots[both], other[both]
            used += len(both)
            roots = np.where(roots >= 0, roots, other)
            roots[both] = new
        else:
            roots = np.where(roots >= 0, roots, other)
        order = np.argsort(-loads, kind="stable")
        loads, roots = loads[order], roots[order]
        gap = int(loads[0] - loads[-1]) if k == windows else int(loads[0])
        heapq.heappush(heap, (-gap, tick, loads, roots))
        tick += 1
    _, _, loads, roots = heap[0]
    where = np.zeros(n, dtype=np.int64)
    for w, root in enumerate(roots):
        stack = [int(root)] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                where[x] = w
            else:
                stack += [int(left[x]), int(right[x])]
    return where, int(loads[0])


def deal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item. The count of windows starts where 98.5 in 100 places are filled and rises until all fit."""
    windows = max(1, -(-int(sizes.sum()) * 1000 // (capacity * 985)))
    while True:
        where, most = difference(sizes, windows)
        if most <= capacity:
            return where
        windows += max(1, windows // 100)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, piece: int = 512, group: int = 256, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its ids if asked for: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = T.StructType([f for f in PIECES.fields if with_ids or f.name != "ids"])

    def run(batches):
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        codes, end = token_cache(WordBpe, tokenizer), np.array([END], dtype="<u4").tobytes()
        sequence = 0
        rests: list[tuple] = []
        docs_held = 0
        out: list[tuple] = []

        def put(doc, start, raw, total, seq, offset):
            out.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, task + seq, offset, *([np.frombuffer(raw, dtype="<u4").tolist()] if with_ids else [])))

        def flush():
            nonlocal sequence, docs_held
            if rests:
                where = deal(np.array([len(r[2]) // 4 for r in rests]), length)
                fill: dict[int, int] = {}
                names: dict[int, int] = {}
                for r, w in zip(rests, where.tolist(), strict=True):
                    if w not in names:
                        names[w] = sequence
                        sequence += 1
                    at = fill.get(w, 0)
                    put(*r, names[w], at)
                    fill[w] = at + len(r[2]) // 4
                rests.clear()
            docs_held = 0

        def batch_out():
            got = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), ARROW, strict=False)], names=schema.names)
            out.clear()
            return got

        def take(doc, raw):
            nonlocal sequence, docs_held
            total = len(raw) // 4
            whole = total - total % length
            for s in range(0, whole, length):
                put(doc, s, raw[4 * s : 4 * (s + length)], total, sequence, 0)
                sequence += 1
            parts = -(-(total - whole) // piece)
            for i in range(parts):  # equal parts rather than a stub at the end
                a, b = whole + (total - whole) * i // parts, whole + (total - whole) * (i + 1) // parts
                rests.append((doc, a, raw[4 * a : 4 * b], total))
            docs_held += 1
            if docs_held >= group:
                flush()

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in runs(texts):
                for doc, raw in zip(names[a:b], codes.many(texts[a:b]), strict=True):
                    take(doc, raw + end)
                if len(out) >= 10_000:
                    yield batch_out()
        flush()
        if out:
            yield batch_out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


ARROW = [pa.int64()] * 7 + [pa.list_(pa.int32())]


def sequences(docs: DataFrame, tokenizer: str, length: int = 2048, **options) -> DataFrame:
    """sequence_id, ids (padded with 0 unless the length is a power of two), n_tokens, doc_ids."""
    from pyspark.sql import functions as F

    pieces = pack(docs, tokenizer, length, with_ids=True, **options)
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_p"))
    ids = F.flatten(F.transform("_p", lambda p: p["ids"]))
    n = F.size(ids)
    power = F.bitwise_not(n - 1).bitwiseAND(n) == n
    padded = F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - n))))
    return whole.select("sequence_id", padded.alias("ids"), n.alias("n_tokens"), F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
