import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import near_dedup, ngram_join, overlap
from tests.llm.test_dedup_and_sharding import WORD, fold


def brute(rows, width, share):
    """n_shingles and component_id of each (doc_id, text), texts of one doc_id judged text by text."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(fold(t))
        sets[d, t] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    keys = sorted((k for k in sets if sets[k] and k[0] is not None), key=str)
    comp = {k: k for k in keys}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    least = {}
    for d, t in keys:
        c = find((d, t))
        least[c] = min(d, least.get(c, d))
    return sorted(((d, len(sets[d, t]), least[find((d, t))] if (d, t) in comp else d) for d, t in rows), key=str)


def joined(df, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_groups(df, **how).collect()), key=str)


def test_ngram_join(spark, docs, rows, empty):
    assert joined(docs) == brute([r[:2] for r in rows], 4, 85)
    assert joined(docs, width=2, share=60) == brute([r[:2] for r in rows], 2, 60)
    assert ngram_join.join_groups(empty).count() == 0


def test_ngram_join_groups(spark):
    """Chains whose ends are not alike, a large group of near copies, texts that share a passage, nulls, repeated ids and clashing names."""
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 - k, " ".join(base[k * 4 :] + [f"c{k}{i}" for i in range(k * 4)])) for k in range(8)]
    rows += [(2000 + k, " ".join([*(f"g{i}" for i in range(90)), *(f"own{k}x{i}" for i in range(k % 12))])) for k in range(150)]
    rows += [(3000 + k, " ".join([*(f"p{i}" for i in range(60)), *(f"q{k}x{i}" for i in range(60))])) for k in range(60)]
    rows += [(None, rows[0][1]), (None, None), (5, None), (6, ""), (7, " \n"), (1000, "other words of one id"), (1000, "other words of one id"), (8, "one"), (9, "ONE"), (10, "a b c"), (11, "a b c d e")]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, node int, value int, th string, comp int").repartition(5)
    assert joined(df) == brute(rows, 4, 85)


def copies(seed, n, stock):
    """Copies of one text with changes, most of them from a small stock, so that copies that are not alike share changes."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"w{i}" for i in range(120)]
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
            at = rng.randrange(0, 120, 3)
            w[at] = f"x{at}" if rng.random() < stock else f"own{k}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("stock", [0.2, 0.8])
def test_ngram_join_frequent_changes(spark, stock, monkeypatch):
    monkeypatch.setattr(overlap, "LONG", 8)
    monkeypatch.setattr(overlap, "CHUNK", 32)
    rows = copies(3, 220, stock)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    assert joined(df) == want and 3 < len({c for *_, c in want}) < 210


def test_ngram_join_chance_meetings(spark, monkeypatch):
    """Texts of few words share many shingles by chance; only what can have a partner is searched for, and no link is lost."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghijkl") for _ in range(60))) for k in range(300)]
    for k in range(300, 310):
        w = rows[k - 300][1].split()
        rows.append((k, " ".join([*w[: rng.randint(1, 3)], "new", *w[4:]])))
    searched = []
    monkeypatch.setattr(ngram_join, "t_occurrence", lambda lists, *how: (searched.append(lists.select("node").distinct().count()), overlap.t_occurrence(lists, *how))[1])
    want = brute(rows, 4, 85)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == want and len({c for *_, c in want}) < 305
    assert sum(searched) <= 30


def template(seed, n, phrases=8):
    """Pages of one template: 300 common words with ten slots, each filled with one of so many phrases."""
    rng = random.Random(seed)
    stock = [[" ".join(f"s{j}p{p}w{i}" for i in range(5)) for p in range(phrases)] for j in range(10)]
    return [(k, " ".join(" ".join(f"t{j}x{i}" for i in range(30)) + " " + rng.choice(stock[j]) for j in range(10))) for k in range(n)]


def test_template_pages_make_candidates_in_proportion(spark, monkeypatch):
    """Pairs that reach the full comparison grow with the rows, not with their square, and the components are right."""
    made = []
    kept = overlap.similar
    monkeypatch.setattr(overlap, "similar", lambda pairs, *how: (made.append(pairs.count()), kept(pairs, *how))[1])
    total = {}
    for n in (120, 240, 480):
        rows = template(1, n)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        made.clear()
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect()), key=str)
        total[n] = sum(made)
        if n < 480:
            assert got == brute(rows, 5, 75)
    assert total[480] <= 2.5 * total[240] and total[480] < 18 * 480, total


def test_rare_lists_lose_no_link(spark):
    """Every linked pair comes out of the search over rare shingles with no star round before it."""
    rows = copies(9, 120, 0.6) + [(500 + k, t) for k, t in template(4, 60)]
    texts = spark.createDataFrame(rows, "node long, text string")
    comps = spark.createDataFrame([], "node long, comp long")
    pairs = {(r.a, r.b) for r in overlap.t_occurrence(overlap.atoms(overlap.rare_shingles(texts, 5, 75)), comps, 75).collect()}
    sets = {d: frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in rows}
    ids = sorted(sets)
    linked = {(a, b) for a in ids for b in ids if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= pairs and len(pairs) < 3 * len(linked) + 200


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sets(st.integers(0, 30), min_size=1, max_size=20), st.integers(1, 4)), min_size=1, max_size=8), st.integers(1, 12))
def test_merge_skip(lists, want):
    count = {}
    for ids, w in lists:
        for x in ids:
            count[x] = count.get(x, 0) + w
    got = overlap.merge_skip([(sorted(ids), w) for ids, w in lists], want)
    assert sorted(got) == sorted((x, c) for x, c in count.items() if c >= want)


def test_copies_with_too_many_changes_are_no_candidates(spark, monkeypatch):
    """Of copies of one text with one to four new words most pairs aren't linked: what the search gives grows with the rows, not with their pairs."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 300):
        new = list(words)
        for j in rng.sample(range(150), 1 + i % 4):
            new[j] = f"c{i}_{j}"
        rows.append((i, " ".join(new)))
    counted = []
    monkeypatch.setattr(ngram_join, "settle", lambda pairs, *a: counted.append(pairs.count()) or overlap.settle(pairs, *a))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 4, 85)
    assert counted and counted[0] <= len(rows)
