import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import id_codec, packing, token_files
from tesserae.llm.common import ByteBpe, WordBpe, cut

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a\t b", "  x  y\n\n z ", "don't 's it's", "<|endoftext|> a<|endoftext|>", "\x1cx y", "é .", "", " ", "\n\n", "A.B. c., D,. 1. #. .,a", "x\r\ny", "  x", "İstanbul ΣΑΣ. ", "!!! ... ,"]


@functools.cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def plain(path, text, end):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize(("kind", "path"), [(WordBpe, WORDS), (ByteBpe, BYTES)])
def test_cached_ids_are_the_tokenizers_ids(kind, path, rows):
    texts = [r[1] or "" for r in rows] + ODD
    whole = Tokenizer.from_file(path)
    cache = kind(path, bound=50)  # small enough to lose its pieces all the time
    for got, text in zip(cache.many(texts), texts, strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def check_pieces(got, rows, length):
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(plain(WORDS, r[1], 1))
    seqs, ids, parts = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length))
        ids[r.doc_id].append((r.start, r.ids))
    for p in seqs.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= length
    for d, texts in want.items():
        flat = sorted(x for t in texts for x in t)
        assert sorted(x for _, p in ids[d] for x in p) == flat
        if len(texts) == 1:
            assert [x for _, p in sorted(ids[d]) for x in p] == texts[0]
    return [sum(n for _, n in p) for p in seqs.values()]


def test_packing(docs, rows, empty):
    for length in (64, 2048):
        check_pieces(packing.pack(docs, WORDS, length, piece=length // 4, group=20, with_ids=True).collect(), rows, length)
    assert packing.pack(empty, WORDS).count() == 0
    got = packing.sequences(docs, WORDS, 256).collect()
    assert all(len(r.ids) == 256 or r.n_tokens & (r.n_tokens - 1) == 0 for r in got)


def test_packing_leaves_little_padding(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 1500)))) for i in range(400)]
    loads = check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORDS, with_ids=True).collect(), rows, 2048)
    assert sum(loads) / (2048 * len(loads)) > 0.95


@given(st.lists(st.integers(1, 500), min_size=1, max_size=60), st.integers(500, 900))
@settings(max_examples=60, deadline=None)
def test_deal_fits_and_loses_nothing(sizes, capacity):
    where = packing.deal(np.array(sizes), capacity)
    assert len(where) == len(sizes) and np.bincount(where, weights=sizes).max() <= capacity


def test_differencing_balances_better_than_dealing_in_turn():
    sizes = np.random.default_rng(2).integers(1, 500, 120)
    where, most = packing.difference(sizes, 10)
    assert most == np.bincount(where, weights=sizes).max() and most <= sizes.sum() / 10 * 1.01 + 1


@given(st.lists(st.integers(0, id_codec.MAX_ID), max_size=300) | st.lists(st.integers(0, 5), max_size=600), st.sampled_from([1, 7, 100, 2048]))
@settings(max_examples=40, deadline=None)
def test_codec_round_trip(ids, block):
    payload = id_codec.encode(np.array(ids, dtype=np.uint32), block)
    assert id_codec.decode(payload).tolist() == ids
    if len(ids) > block:
        assert id_codec.decode(payload, only=1).tolist() == ids[block : 2 * block]


def test_codec_more_blocks_than_lanes_and_damage(monkeypatch):
    monkeypatch.setattr(id_codec, "LANES", 3)
    ids = np.random.default_rng(0).zipf(1.3, 5000).clip(0, 50_000).astype(np.uint32)
    payload = id_codec.encode(ids, 256)
    assert (id_codec.decode(payload) == ids).all() and len(payload) < 4 * len(ids)
    bad = bytearray(payload)
    bad[len(bad) // 2] ^= 0x55
    with pytest.raises(ValueError):
        id_codec.decode(bytes(bad))
    with pytest.raises(ValueError):
        id_codec.encode(np.array([id_codec.MAX_ID + 1]))


def test_token_files(docs, rows, empty):
    want, start = [], 0
    from collections import Counter

    order = sorted(rows, key=lambda r: r[0])
    got = sorted(token_files.digests(cut(token_files.encode_documents(docs, BYTES, segment=3000), "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    for r in order:
        ids = plain(BYTES, r[1], 2)
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    files = token_files.encode_documents(docs, BYTES)
    back = {r.doc_id: r.ids for r in token_files.decode_documents(files, with_ids=True).collect()}
    assert back[0] == plain(BYTES, next(r[1] for r in rows if r[0] == 0), 2)
    assert token_files.digests(cut(token_files.encode_documents(empty, BYTES), "t")).count() == 0


def test_files_of_a_folder_round_trip(spark, docs, rows, tmp_path):
    """Whole ids of every document, in ascending doc_id order, from files written and read by path."""
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_files(docs, name, f"{tmp_path}/files")
    got = token_files.read_files(spark, f"{tmp_path}/files").orderBy("start").collect()
    tok = Tokenizer.from_file(name)
    want = sorted((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want and [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens


def test_words_of_small_letters_go_to_the_model(monkeypatch):
    """Ids are those of the whole text; a text's capitals and marks cost no encoding of their own, and only words of other scripts are normalized."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tesserae.llm.common import WordBpe

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = ["Straße ÉTÉ été, Añoran. THERE there, Ünder ñandú", "éclair Éclair. éclair, ÿÿ µm ª½"]
    other = ["ΣΑΣ İx it's IT'S x² naïve,", "e\u0301a A\u030a Åb", "a\x85b\xa0c\u3000d", "x <|endoftext|> y", "Ab###,. C'est", "", None]
    codes, whole = WordBpe(path), Tokenizer.from_file(path)
    sent, encoded = [], WordBpe.__mro__[1].encoded
    monkeypatch.setattr(WordBpe.__mro__[1], "encoded", lambda self, stems: sent.extend(stems) or encoded(self, stems))
    texts = [t or "" for t in plain + other]
    got = codes.many(texts[:2])
    assert not {w for w in sent if w.isalpha() and w != "½"} and len(codes.young) <= 20
    assert [*got, *codes.many(texts[2:])] == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize(("kind", "path"), [(WordBpe, WORDS), (ByteBpe, BYTES)])
def test_words_before_marks_go_to_the_model(kind, path, monkeypatch):
    """Ids are those of the whole text; a word with marks behind it is its letters and the marks, and costs no encoding of its own."""
    texts = ["wort*** wort!! wort, (wort) a'b' éa### ñ&&&", "It's. it'S' Straße%%%. x²*** 7** á## e#̸ ª!! '' .'s ǆ!! ΣΑΣ!!", "ab''s can't.. D'... İ*** aİ,"]
    base, whole = kind.__mro__[1], Tokenizer.from_file(path)
    sent, encoded = [], base.encoded
    monkeypatch.setattr(base, "encoded", lambda self, pieces: sent.extend(pieces) or encoded(self, pieces))
    codes = kind(path)
    got = codes.many(texts)
    assert not {w for w in sent if w[-1] in "*!#&%," and w.strip(" *!#&%,").isalpha() and w.strip()[0].isalpha() and max(w) < "\u0100"}
    assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
