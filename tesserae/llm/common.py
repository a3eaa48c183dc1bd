"""Shared pieces of the training-data operators: scratch tables, ranks, word and token caches.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir``, which the
driver and all executors share. Where that is unset, a local session (tests, a laptop) gets a temporary folder; any other
session stops with an error.
"""

from __future__ import annotations

import os
import re
import string
import tempfile
import uuid
from array import array
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one only where the session has none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set, and the executors of {master} share no temporary folder")
        base = f"file://{tempfile.mkdtemp(prefix='scratch')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        spark, path = df.sparkSession, df.scratch_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, null counting as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def high_bits(h: Column, bits: int = 12) -> Column:
    """The order-preserving top bits of a signed 64-bit hash."""
    return (F.shiftright(h, 64 - bits) + F.lit(1 << (bits - 1))).cast("int")


def global_rank(df: DataFrame, h: str, order: Iterable[str], out: str, bits: int = 12) -> DataFrame:
    """Gapless ranks from 0 by (hash h, order), in two levels: rows within a bucket of the hash's top bits, buckets
    before it by a prefix sum over 2**bits counts. No task sees more than a bucket, and the broadcast counts are
    at most 2**bits rows whatever the input."""
    rows = df.withColumn("_bucket", high_bits(F.col(h), bits))
    counts = rows.groupBy("_bucket").count()
    before = counts.select("_bucket", (F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("count")).alias("_before"))
    ranked = rows.withColumn("_row", F.row_number().over(W.partitionBy("_bucket").orderBy(h, *order)) - 1)
    return ranked.join(F.broadcast(before), "_bucket").withColumn(out, F.col("_before") + F.col("_row")).drop("_bucket", "_before", "_row")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only when the table is known to have at most max_rows rows; else the planner decides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 3000, 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column | None, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES) -> list:
    """At most ``rows`` labelled documents (doc_id, text, label), chosen by a hash of doc_id, for fitting a model on the driver. Half of
    the places go to each class where there are enough. Texts of over ``text_bytes`` are passed over for fitting only, so the driver
    gets rows * text_bytes at most (197 MB by default). Of rows that share a doc_id one text is taken, that of the smallest hash; of
    several labels of a doc_id the largest counts; null labels and labels other than 0 and 1 are not used."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if train is not None:
        known = known.where(train)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    picked = None
    for k in (0, 1):
        part = known.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= text_bytes)
    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")))
    return sorted(((r[0], r[2], r[1]) for r in chosen.collect()), key=lambda r: r[0])


class WordHashes(dict):
    """word bytes -> 64-bit hash; filled as words are met, emptied when it reaches its bound."""

    def __init__(self, seed: int = 0, bound: int = 1 << 19):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return got


class Pieces(dict):
    """piece -> ids; a piece that is met for the first time comes from the generation before or is encoded."""

    def __init__(self, cache: TokenCache):
        super().__init__()
        self.cache = cache

    def __missing__(self, piece: str) -> bytes:
        got = self.cache.old.get(piece)
        if got is None:
            got = self.cache.one(piece)
        self[piece] = got
        return got


class TokenCache:
    """Ids of texts by a tokenizers file, as little-endian unsigned 32-bit bytes. A text is split where the pre-tokenizer cuts
    anyway, so the ids of its pieces in a row are the ids of the whole text; each distinct piece is encoded once and
    remembered. Two generations of about ``bound`` pieces are held. Texts with unusual white space or with the text of a special
    token are encoded whole."""

    def __init__(self, path: str, bound: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are taken by other tasks
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.tokenize = self.tokenizer.model.tokenize
        self.young, self.old = Pieces(self), {}

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def word(self, piece: str) -> str | None:
        """What the tokenizer's model gets for a piece that is neither normalized nor cut; None for other pieces."""
        raise NotImplementedError

    def encoded(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def one(self, piece: str) -> bytes:
        stem = piece.rstrip(MARKS)
        if len(stem) < len(piece) and stem[-1:].isalpha() and latin(stem[-1]):  # marks after a letter that stays one when lower-cased are always cut off together
            return self.young[stem] + self.young[piece[len(stem) :]]
        word = self.word(piece)
        return array("I", self.encoded([piece])[0] if word is None else [t.id for t in self.tokenize(word)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.young) > self.bound:
                self.old, self.young = self.young, Pieces(self)
            out.append(self.whole(text) if odd_space(text) else b"".join(map(self.young.__getitem__, self.split(text))))
        return out

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


# a search for one character is so much faster than a pattern that all of them take a tenth of its time
ODD_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["<|"]


def odd_space(text: str) -> bool:
    return any(map(text.__contains__, ODD_SPACE))


class WordBpe(TokenCache):
    """For a lower-casing tokenizer that drops white space and never joins words across it."""

    def split(self, text: str) -> list[str]:
        return (text.lower() if latin(text) else text).split()

    def word(self, piece: str) -> str | None:
        """Small Latin-1 letters only."""
        if piece.isascii():
            return piece.lower() if piece.isalpha() else None
        return byte_letters(piece) if piece.isalpha() and latin(piece) and piece == piece.lower() else None


def latin(text: str) -> bool:
    """Latin-1 characters only, which lower-case one by one and are normalized as they stand."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


MARKS = string.punctuation
# what byte-level models write for the bytes that have no visible character of their own
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def byte_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTES)


class ByteBpe(TokenCache):
    """For byte-level pre-tokenization, where the last white space before a word belongs to that word."""

    PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

    def split(self, text: str) -> list[str]:
        return self.PIECES.findall(text)

    def word(self, piece: str) -> str | None:
        """Latin-1 letters only, after a space or none."""
        letters = piece[1:] if piece[0] == " " else piece
        return byte_letters(piece) if letters.isalpha() and latin(letters) else None


_CACHES: dict = {}


def token_cache(kind: type, path: str) -> TokenCache:
    """The worker's cache, which outlives a task."""
    if (kind, path) not in _CACHES:
        _CACHES[kind, path] = kind(path)
    return _CACHES[kind, path]


def runs(texts: list[str], most: int = 1 << 20):
    """Slices of a batch of about ``most`` characters, so that what is held beside the batch stays small."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
