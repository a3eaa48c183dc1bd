import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import line_crf, quality_rules, toxicity
from tesserae.llm.common import WordHashes
from tesserae.llm.scoring import judged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled(seed, n=240):
    """(doc_id, text, quality, toxic): bad texts carry symbols, toxic ones a few words of their own."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 20))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        bad, mean = i % 3 == 0, i % 4 == 0
        if mean:
            lines[0] += " " + " ".join(rng.choice(["vilewordone", "vilewordtwo", "nastythree"]) for _ in range(2))
        if bad:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        out.append((i, "\n".join(lines), 0 if bad else 1, int(mean)))
    return out


@pytest.fixture(scope="module")
def models():
    rows = labelled(1)
    return line_crf.Model().fit([(d, t, q) for d, t, q, _ in rows]), toxicity.Model().fit([(d, t, x) for d, t, _, x in rows]), quality_rules.Forest().fit([(d, t, q) for d, t, q, _ in rows])


def test_held_out_accuracy(models):
    crf, tox, forest = models
    rows = labelled(2)
    texts = [r[1] for r in rows]
    assert ((crf.score(texts) >= 0.5) == [r[2] == 1 for r in rows]).mean() > 0.97
    assert ((tox.score(texts) >= 0.5) == [r[3] == 1 for r in rows]).mean() > 0.97
    anomaly = forest.anomaly(np.array([quality_rules.statistics(t, WordHashes())[1] for t in texts]))
    kept = anomaly <= forest.threshold
    good = np.array([r[2] == 1 for r in rows])
    assert kept[good].mean() > 0.9 and kept[~good].mean() < 0.1


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    sizes, trans = np.array([3, 1, 4, 2]), rng.normal(size=(2, 2))
    unary = rng.normal(size=int(sizes.sum()))
    good, log_z, pair = line_crf.marginals(unary, sizes, trans)
    want, total, pairs, at = [], 0.0, np.zeros((2, 2)), 0
    for n in sizes:
        weights = {s: np.exp(sum(unary[at + i] * s[i] for i in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        want += [sum(w for s, w in weights.items() if s[i]) / z for i in range(n)]
        total += np.log(z)
        for s, w in weights.items():
            for a, b in itertools.pairwise(s):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(good, want) and np.isclose(log_z, total) and np.allclose(pair, pairs)


def test_scores_for_every_row(spark, docs, rows, empty, models):
    crf, tox, _ = models
    for module, model, mod, held in ((line_crf, crf, 3, 1), (toxicity, tox, 5, 0)):
        got = judged(module.score_documents(docs, model), mod, held).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        import zlib

        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in got)
        assert module.score_documents(empty, model).count() == 0
        assert "text" in module.score_documents(docs, model).columns
    kept = line_crf.keep_good(docs, crf)
    assert kept.columns == docs.columns


def test_no_labels_no_verdict(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(line_crf.fit(docs, labels).score(["a", ""])) == {0.5}
    assert set(toxicity.fit(docs, labels).score(["a", ""])) == {0.0}
    forest = quality_rules.fit(docs, labels)
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(docs, forest).collect())


def test_labels_with_nulls_and_repeats(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    assert line_crf.fit(docs, labels).weights is not None
    assert quality_rules.judge(docs, quality_rules.fit(docs, labels)).count() == docs.count()


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_rule_counts(docs, rows, empty, models):
    forest = models[2]
    got = quality_rules.judge(docs, forest).collect()
    want = Counter((r[0], *brute_rules(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty, forest).count() == 0


def test_toxic_margins_are_those_of_compressed_windows(models):
    """Every window compressed anew, with each dictionary by itself in the compressor."""
    import zstandard as zs

    tox = models[1]
    assert tox.toxic and tox.ordinary and tox.toxic not in tox.ordinary
    plain, both = (zs.ZstdCompressor(level=toxicity.LEVEL, write_content_size=False, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT)) for d in (tox.ordinary, tox.toxic + tox.ordinary))
    texts = [r[1] for r in labelled(7, 60)] + ["", "one", "vilewordone " * 500]
    for t, got in zip(texts, tox.margins(texts), strict=True):
        words, units = t.encode().lower().split(), toxicity.Units(tox.opening)
        want = []
        for i in range(0, len(words), tox.window):
            w = b"".join(units[x] for x in words[i : i + tox.window])
            want.append(len(plain.compress(w)) - len(both.compress(w)))
        assert got.tolist() == want


def test_toxic_families_of_short_and_long_openings():
    """Toxic words share an opening of four, five or six bytes and little else; no ending comes often enough to be learned by itself."""
    rng = random.Random(6)
    parts = ["er", "an", "tion", "ou", "sch", "ica", "el", "ado", "ung", "eau", "st", "or", "mi", "ga"]
    word = lambda k: "".join(rng.choice(parts) for _ in range(k))
    rows = []
    for i in range(2400):
        words = [word(rng.randint(1, 4)) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(rng.randint(2, 3)):
                words[rng.randrange(len(words))] = rng.choice(["vequ", "lowei", "lostra"]) + word(rng.randint(1, 3))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    scores = toxicity.Model().fit(rows[:800]).score([t for _, t, _ in rows[800:]])
    y = np.array([k for _, _, k in rows[800:]])
    assert (scores[y == 1] >= 0.5).mean() >= 0.85 and (scores[y == 0] < 0.5).mean() >= 0.95


def test_toxic_dictionaries_are_trained_on_their_own_windows(monkeypatch):
    seen, train = [], toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda size, samples: seen.append((size, len(samples))) or train(size, samples))
    rows = [(i, " ".join(["plain", "words"] * 5000), 0) for i in range(21)] + [(100 + i, " ".join(f"vile{j}" for j in range(600)), 1) for i in range(6)]
    toxicity.Model(window=1, opening=12).fit(rows, toxic_bytes=(8192,), turns=1)
    *halves, ordinary, one, two, last = seen  # two halves for calibration, then the whole sample
    assert len(halves) == 8 and halves[0][1] + halves[4][1] == 21 * 10_000
    assert ordinary == (1 << 15, 21 * 10_000) and one[1] + two[1] == 6 * 600 and last == (8192, 6 * 600)


def test_forest_counts_every_labelled_row(spark, monkeypatch):
    """More labelled rows than any sample held, and texts longer than a sample took: all are in the counts that give the threshold."""
    plain = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{plain} w{i}" + (" ###" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(4000)] + [(5000, " ".join(f"word{j}" for j in range(12_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0 if d % 4 == 0 and d < 4000 else 1) for d, _ in rows], "doc_id long, quality int")
    seen, calibrate = [], quality_rules.Forest.calibrate
    monkeypatch.setattr(quality_rules.Forest, "calibrate", lambda self, good, bad, *a: seen.append((sum(good.values()), sum(bad.values()))) or calibrate(self, good, bad, *a))
    forest = quality_rules.fit(docs, labels)
    assert seen == [(3001, 1000)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, forest).collect()}
    assert sum(kept[d] for d in range(4000) if d % 4 == 0) < 100 and sum(kept[d] for d in range(4000) if d % 4) >= 2970
