import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import conversation_repair as repair
from tesserae.llm import manifest

SPACE = " \t\n\x0b\x0c\r"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, paths):
    """The top of nodes; paths[k] gets the siblings of leaf k, with their side."""
    at = {k: k for k in paths}
    while len(nodes) > 1:
        for k in paths:
            beside = at[k] ^ 1
            paths[k].append(("" if beside >= len(nodes) else nodes[beside], at[k] % 2))
            at[k] //= 2
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0]


def brute_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        leaf = lambda n: h("".join(map(enc, (doc_id, source, lang, n, text))))  # noqa: B023, E731
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        by_lang[lang].append((doc_id, leaf(n_chars), leaf(n_chars + 1) if chosen else leaf(n_chars)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops, ways = [], {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        paths = {k: [] for k in range(len(by_lang[lang]))}
        tops.append(tree([r[1] for r in by_lang[lang]], paths))
        ways[lang] = paths
    upper = {k: [] for k in range(len(langs))}
    root = tree(tops, upper)
    out = Counter()
    for j, lang in enumerate(langs):
        for k, (doc_id, leaf, shown) in enumerate(by_lang[lang]):
            way, x = ways[lang][k] + upper[j], shown
            for sib, odd in way:
                x = h(sib + x if odd else x + sib)
            out[doc_id, leaf, tops[j], root, h("".join(s for s, _ in way)), x, x == root] += 1
    return out


@pytest.mark.parametrize(("bits", "top"), [(12, 8192), (3, 12), (1, 1)])
def test_manifest(spark, rows, bits, top):
    langs = ["en", None, "é", "", "z", "en"]
    rows = [(*r[:2], langs[i % 6] if i % 2 else "en", *r[3:]) for i, r in enumerate(rows)] + [(None, "x", "en", "s", 4, 0, 0, ""), (None, None, None, None, None, 0, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, place int, tree int, node string").repartition(3)
    got = manifest.manifest(docs, bits, top).collect()
    want = brute_manifest(rows)
    assert Counter(map(tuple, got)) == want
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_many_langs(spark):
    """More trees than the driver takes: the tree over them is reduced on executors, too."""
    rows = [(i, f"t{i}", f"l{i % 23:02}" if i % 23 else None, None, i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, manifest.manifest(docs, 2, 4).collect())) == brute_manifest(rows)
    proofs = manifest.manifest(docs, 2, 4, with_proof=True).collect()
    assert all(manifest.fold(r.leaf, r.proof) == r.root for r in proofs)


def test_manifest_of_one_row_and_of_none(spark, empty):
    docs = spark.createDataFrame([(3, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, manifest.manifest(docs).collect())) == brute_manifest([(3, "x", "en", "s", 1)])
    assert manifest.manifest(empty).count() == 0


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # noqa: B018  a conversation whose rows are all dropped stays
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_repair(conv, rows):
    """Dynamic programming over all states, with whole audits and texts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {r[0] for r in rows} - {None}
    count, seen, faults = Counter(), set(), []
    for _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        count[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in NEXT:
                        new = (cost + 5, audit + "I", [*lines, name + ":"])
                        if new[:2] < best.get(NEXT[state, r], (1 << 60,))[:2]:
                            best[NEXT[state, r]] = new
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            moves = [(state, cost + 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (state, role[:1]) in NEXT:
                    moves.append((NEXT[state, role[:1]], cost + more, "K", [f"{role}:{text}"]))
                moves += [(NEXT[state, r], cost + 1 + more, "R", [f"{name}:{text}"]) for r, name in (("u", "user"), ("a", "assistant")) if (state, r) in NEXT]
            for to, c, letter, line in moves:
                if (c, audit + letter) < after.get(to, (1 << 60,))[:2]:
                    after[to] = (c, audit + letter, lines + line)
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in (0, 3))
    return conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, h("\n".join(lines))


def talk(seed, n, convs):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"], ["Yes.", "No", "", None, " \t", "Why?\n", "é!", "a. b", "x" * 40 + "."]
    rows = []
    for k in range(n):
        rows.append((rng.choice([*range(convs), None]), rng.choice([k, k, k, rng.randrange(30), None]), rng.choice(roles), rng.choice([*texts, f"own {k}.", f"own {k}"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = talk(1, 600, 40) + [(900, t, "user" if t % 2 else "assistant", f"row {t}{'.' if t % 5 else ''}") for t in range(300)]
    want = Counter(brute_repair(c, r) for c, r in damage(rows).items())
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", alive int, first_turn string").repartition(5)
    for block in (1, 7, 1024):
        assert Counter(map(tuple, repair.repair(repair.damaged(table), block).collect())) == want
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert Counter(con.execute(repair.OP13_SQL).fetchall()) == want


def test_repair_of_dropped_and_empty(spark):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    table = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in gone], SCHEMA)
    assert {tuple(r) for r in repair.repair(repair.damaged(table)).collect()} == {(c, 0, 0, 0, 0, 0, 0, "", h("")) for c, _ in gone}
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.sampled_from("suat "), st.sampled_from(["", "blank", "truncated"])), max_size=14), st.integers(1, 6))
def test_search_in_blocks_is_the_whole_search(steps, block):
    rows = [(k, r, {"": f"{k}.", "blank": " ", "truncated": f"{k}"}[f]) for k, (r, f) in enumerate(steps)]
    now = repair.Conversation(7, block)
    for turn, role, text in rows:
        now.add(turn, role, text, None)
    assert now.result() == brute_repair(7, rows)
