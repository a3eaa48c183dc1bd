import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from tesserae.llm import exact_dedup, mixing, near_dedup, sharding, substring_dedup
from tesserae.llm.common import LOWER, UPPER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(UPPER, LOWER)


def fold(text):
    return (text or "").translate(FOLD)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        for i, d in enumerate(sorted(ids)):
            last = i == len(ids) - 1
            want[d, max(ids), len(ids), last, hashlib.sha256(t.encode()).hexdigest()] += 1
    for size in (64, 2048):
        got = exact_dedup.exact_dedup(docs, size).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert Counter(map(tuple, got)) == want
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted(fold(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_unique(empty).count() == 0


def test_exact_dedup_names_of_blocks_and_lengths(spark):
    texts = ["x" * 64, "x" * 65, "x" * 128, "x" * 192, "x" * 193, "X" * 128, "x" * 63 + "y" + "x" * 64, "x" * 64 + "x" * 63 + "y"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(d, 64).collect()}
    assert got == {i: (5, 2) if i in (2, 5) else (i, 1) for i in range(8)}


def test_exact_dedup_null_doc_id(spark):
    d = spark.createDataFrame([(None, "a"), (1, "A"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(d).collect()}
    assert sorted(got.values(), key=str) == sorted([(1, False), (1, True), (None, True)], key=str)


def check_shards(got, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(docs, rows, empty):
    for shards in (3, 7, 40):
        check_shards(sharding.shard(docs, shards).collect(), rows, shards)
    assert sharding.shard(empty).count() == 0


def test_sharding_moves_linked_documents_together(spark):
    rows = [(i, f"text {i // 3}" if i < 300 else f"alone {i}") for i in range(600)]
    rows += [(1000 + i, "hot") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(d, 10).collect()
    check_shards(got, rows, 10)
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    apart = sum(len(where[f"text {k}"]) > 1 for k in range(100))
    assert apart <= 5  # by chance about 99 of the 100 triples would be apart


def test_sharding_without_free_documents(spark):
    rows = [(i, f"t{i // 2}") for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check_shards(got, rows, 4)
    where = defaultdict(set)
    for r in got:
        where[r.doc_id // 2].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 40  # by chance 75


def test_sharding_keeps_groups_whole(spark):
    """Groups of 0.6 to 1 shard stay whole, one of 2.5 shards takes 3, a full table of pairs is cut nowhere."""
    cases = [
        ([30, 24, 24, 24, 18], [1] * 120, 8, {}),
        ([75, 30, 20], [1] * 115, 8, {0: 3}),
        ([2] * 100, [], 4, {}),
        ([5] * 12, [1] * 20, 20, {k: 2 for k in range(12)}),
    ]
    for groups, alone, shards, over in cases:
        texts = [f"g{k}" for k, n in enumerate(groups) for _ in range(n)] + [f"a{k}" for k in range(len(alone))]
        rows = list(enumerate(texts))
        d = spark.createDataFrame(rows, "doc_id long, text string")
        out = sharding.shard(d, shards)
        got = out.collect()
        check_shards(got, rows, shards)
        where = defaultdict(set)
        for r in got:
            where[texts[r.doc_id]].add(r.shard)
        assert [len(where[f"g{k}"]) for k in range(len(groups))] == [over.get(k, 1) for k in range(len(groups))], groups
        r = sharding.kept_whole(d, out).first()
        cap = -(-len(rows) // shards)
        assert (r.n_groups, r.n_fitting, r.n_whole) == (len(groups), sum(n <= cap for n in groups), len(groups) - len(over))


def brute_groups(rows):
    sets = {}
    for d, t in sorted({(r[0], r[1]) for r in rows}, key=str):
        w = WORD.findall(fold(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_dedup(docs, rows, empty):
    want = brute_groups(rows)
    got = near_dedup.near_groups(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, w in want.items() if w[2])
    assert near_dedup.near_groups(empty).count() == 0


def test_near_dedup_chains_and_big_groups(spark):
    """A chain whose ends are not alike, a large group around one text, and texts that share a long passage only."""
    base = [f"w{i}" for i in range(100)]
    rows = [(1000 - k, " ".join(base[k * 6 :] + [f"c{k}{i}" for i in range(k * 6)])) for k in range(8)]
    rows += [(2000 + k, " ".join([*(f"g{i}" for i in range(90)), f"own{k}"])) for k in range(150)]
    rows += [(3000 + k, " ".join([*(f"p{i}" for i in range(60)), *(f"q{k}x{i}" for i in range(60))])) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_near_dedup_rows_without_doc_id(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(d).collect()), key=str)
    assert got == [(4, 4, True), (7, 4, False), (None, None, True)]
    assert near_dedup.keep_one(d).count() == 2


def brute_substrings(rows):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(d, first.get(g, d))
    out = Counter()
    for d, w in words:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup(docs, rows, empty):
    want = brute_substrings(rows)
    assert any(k[2] for k in want)
    for batch in (2000, 1 << 22):
        assert Counter(map(tuple, substring_dedup.substring_dedup(docs, batch).collect())) == want
    assert substring_dedup.substring_dedup(empty).count() == 0
    text = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(docs, with_text=True).collect()}
    assert hashlib.sha256(text[0].encode()).hexdigest() in {k[3] for k in want if k[0] == 0}


def test_substring_dedup_many_slices(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELLS_A_SLICE", 1 << 8)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 500)
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs, 3000).collect())) == brute_substrings(rows)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, epochs=20.0)
    assert got.columns == [c for c in docs.columns if c != "n_copies"] + ["n_copies", "copy_no", "place"]
    got = got.collect()
    assert [r.place for r in got] == sorted(r.place for r in got)
    n = Counter(r.source for r in got)
    assert set(n) == {"s0", "s1"}
    assert 0.65 < n["s0"] / len(got) < 0.85 and 0.8 < len(got) / (20 * len(rows)) < 1.2
    copies = defaultdict(list)
    for r in got:
        copies[r.doc_id, r.text].append(r.copy_no)
    times = Counter((r[0], r[1]) for r in rows)
    for k, c in copies.items():  # every row counts its copies from 1, and there are at most as many rows as in the input
        n = Counter(c)
        assert n[1] <= times[k] and all(n[i] >= n[i + 1] for i in range(1, max(c))), k
    again = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, epochs=20.0).collect()
    assert Counter((r.doc_id, r.copy_no) for r in again) == Counter((r.doc_id, r.copy_no) for r in got)
    assert mixing.mix(empty).count() == 0
    assert {r.source for r in mixing.mix(docs, epochs=10.0).collect()} == {"s0", "s1", "s2", None}


def test_near_dedup_one_doc_id_with_several_texts(spark):
    """Every text is judged by itself: none is lost with the doc_id that it shares, and repeated rows leave one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "p"), (1, b, "q"), (3, b, "r"), (2, c, "s"), (2, a + " z", "t"), (1, a, "u"), (7, None, "v"), (7, "", "w"), (None, a, "x"), (None, a, "y"), (-5, b + " y", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _doc string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(d).collect())
    want = [(1, 36, 1, True), (1, 36, -5, False), (3, 36, -5, False), (2, 36, 2, True), (2, 37, 1, False), (1, 36, 1, True), (7, 0, 7, True), (7, 0, 7, True), (None, 36, None, True), (None, 36, None, True), (-5, 37, -5, True)]
    assert got == Counter(want)
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == Counter([(1, a), (2, c), (-5, b + " y"), (7, None), (7, ""), (None, a), (None, a)])


def test_near_dedup_many_rows_without_doc_id(spark):
    d = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "concat('one two three four five ', id) as text")
    assert near_dedup.keep_one(d.unionByName(spark.createDataFrame([(1, "one two three four five 1")], "doc_id long, text string"))).count() == 10_001


def test_near_dedup_frequent_changes(spark):
    """Copies of one text with changes from a small stock, so that changes are shared by copies that are not alike."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(220):
        w = list(base)
        for _ in range(rng.choice((1, 2, 5, 8, 12))):
            at = rng.randrange(0, 120, 3)
            w[at] = f"x{at}" if rng.random() < 0.7 else f"own{k}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows)
    assert got == want and 10 < len({w[1] for w in want.values()}) < 210


def test_mixing_rows_without_doc_id_and_repeats_draw_each_for_itself(spark):
    """2000 rows without id and 2000 equal rows at a rate of 1: about as many come out, each at a place of its own, the same ones each time."""
    rows = [(None, f"text {k % 50}", "a", k % 7) for k in range(2000)] + [(3, "same", "a", 1)] * 2000
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _tag int").repartition(6)
    out = mixing.mix(d)
    got = out.collect()
    for some in (True, False):
        n = [r.n_copies for r in got if (r.doc_id is None) == some and r.copy_no == 1]
        assert 1800 < sum(n) < 2200 and 1150 < len(n) < 1380  # 1 - 1/e of the rows come out
    assert Counter((r.doc_id, r.text, r.place) for r in got) == Counter((r.doc_id, r.text, r.place) for r in mixing.mix(d.repartition(3)).collect())
    assert len({r.place for r in got}) == len(got)
