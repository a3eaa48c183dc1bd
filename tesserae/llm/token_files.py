"""Token-id output: documents encoded, written to files in ascending doc_id order, and read back.

One range shuffle puts documents in doc_id order; each task then encodes its range, gathers whole documents into segments
of about ``segment`` ids and writes one row for each segment: the coded payload (see id_codec) and an index of the documents
in it. The files are written by Spark's own committer, so a lost executor leaves no half-written file, and they go where only Spark can
write. Reading decodes each segment by itself, checks every block's checksum, and looks up the documents in the index.

Ids above id_codec.MAX_ID (262142) are refused with an error: larger vocabularies need wider classes.

Defined cases: a null text counts as empty; an empty text is one id (the end id); rows that repeat a doc_id stand one after the
other; null doc_ids come first; a document is never split between segments, whatever its length; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import id_codec
from .common import ByteBpe, broadcast_if_small, runs, scratch_dir, table, token_cache

END = 2
SEGMENTS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])
DOCS = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "segment", "nth", "doc_id", "start_in_part", "n_tokens", "ids_crc32")] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode_documents(docs: DataFrame, tokenizer: str, segment: int = id_codec.BLOCK * id_codec.LANES) -> DataFrame:
    """The rows of the files, in ascending doc_id order over the partitions."""

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        codes, end = token_cache(ByteBpe, tokenizer), np.array([END], dtype="<u4").tobytes()
        names: list = []
        raws: list[bytes] = []
        held = first = nth = 0

        def flush():
            nonlocal held, first, nth
            sizes = [len(r) // 4 for r in raws]
            payload = id_codec.encode(np.frombuffer(b"".join(raws), dtype="<u4"))
            got = pa.RecordBatch.from_arrays(
                [pa.array([task]), pa.array([nth]), pa.array([first]), pa.array([sum(sizes)]), pa.array([names], type=pa.list_(pa.int64())), pa.array([sizes], type=pa.list_(pa.int64())), pa.array([payload], type=pa.binary())],
                names=SEGMENTS.names,
            )
            first, nth, held = first + sum(sizes), nth + 1, 0
            names.clear()
            raws.clear()
            return got

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in runs(texts):
                for doc, raw in zip(ids[a:b], codes.many(texts[a:b]), strict=True):
                    raw += end
                    if raws and held + len(raw) // 4 > segment:
                        yield flush()
                    names.append(doc)
                    raws.append(raw)
                    held += len(raw) // 4
        if raws:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, SEGMENTS)


def write_files(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes the files of docs to a folder. The payloads are dense already, so Parquet compresses nothing again."""
    encode_documents(docs, tokenizer).write.option("compression", "uncompressed").parquet(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) the ids of each document in the files of a folder."""
    return digests(spark.read.schema(SEGMENTS).parquet(path), with_ids)


def decode_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document in the files, with its ids if asked for."""
    schema = T.StructType([f for f in DOCS.fields if with_ids or f.name != "ids"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = id_codec.decode(row["payload"]).tobytes()
                sizes = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                pieces = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(sizes)
                cols = [pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["segment"])), pa.array(np.arange(n)), pa.array(row["doc_ids"], type=pa.int64()), pa.array(begins + row["first_id"]), pa.array(sizes), pa.array([zlib.crc32(p) for p in pieces], type=pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, dtype="<i4") for p in pieces], type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return files.mapInArrow(run, schema)


def digests(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document of files that have been written, and its ids if asked for."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # one row for each partition written
    before = sizes.select(F.col("part").alias("_part"), (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("_n")).alias("_before"))
    docs = decode_documents(files, with_ids)
    joined = docs.join(broadcast_if_small(before, 100_000), F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_files(spark, path, with_ids=False)
