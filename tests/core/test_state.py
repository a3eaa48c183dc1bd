import datetime
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserae.operators import catalog, context, lexical, lifecycle, projections, search, tools
from tesserae.sources import chunk_store

# --- chunks and versions -------------------------------------------------------------------------------------------------------


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "document_id long, version_number long, ordinal long, content string")


def test_rewriting_a_version_leaves_no_surplus(spark):
    old = chunk_rows(spark, [(1, 1, i, f"old {i}") for i in range(5)] + [(1, 2, 0, "other")])
    got = lifecycle.rewrite_versions(old, chunk_rows(spark, [(1, 1, 0, "new")])).collect()
    assert sorted((r.version_number, r.content) for r in got) == [(1, "new"), (2, "other")]


def test_zip_needs_a_vector_for_each_draft(spark):
    drafts = chunk_rows(spark, [(1, 1, 0, "a"), (1, 1, 1, "b")])
    vectors = spark.createDataFrame([(1, 1, 1, [2.0]), (1, 1, 0, [1.0])], "document_id long, version_number long, ordinal long, embedding array<double>")
    assert {r.content: r.embedding for r in lifecycle.zip_vectors(drafts, vectors).collect()} == {"a": [1.0], "b": [2.0]}
    for d, v in ((drafts, vectors.where("ordinal = 0")), (drafts.where("ordinal = 0"), vectors)):
        with pytest.raises(PySparkException, match="drafts and vectors differ"):
            lifecycle.zip_vectors(d, v).collect()


def test_failing_a_version_leaves_the_active_one(spark):
    v = spark.createDataFrame([(1, 1, "ACTIVE"), (1, 2, "PROCESSING"), (2, 1, "PROCESSING")], "document_id long, version_number long, status string")
    f = spark.createDataFrame([(1, 1, "x"), (1, 2, "y" * 3000)], "document_id long, version_number long, message string")
    got = {(r.document_id, r.version_number): (r.status, len(r.error or "")) for r in lifecycle.mark_failed(v, f).collect()}
    assert got == {(1, 1): ("ACTIVE", 0), (1, 2): ("FAILED", 2000), (2, 1): ("PROCESSING", 0)}


def test_uploads(spark):
    docs = spark.createDataFrame([(1, 7, None, "menu", False), (2, 7, 5, "menu", False), (3, 7, None, "gone", True)], "document_id long, organization_id long, location_id long, slug string, is_deleted boolean")
    v = spark.createDataFrame([(1, 1), (1, 4), (2, 1)], "document_id long, version_number long")
    files = spark.createDataFrame([(7, None, "menu", 10, "a"), (7, None, "menu", 11, "b"), (7, 5, "menu", 12, "c"), (7, None, "gone", 13, "d"), (8, None, "menu", 14, "e")], "organization_id long, location_id long, slug string, file_id long, content string")
    new, versions = lifecycle.uploads(docs, v, files)
    assert {r.file_id: (r.document_id, r.version_number, r.new_document) for r in versions.collect()} == {10: (1, 5, None), 11: (1, 6, None), 12: (2, 2, None), 13: (None, 1, 13), 14: (None, 1, 14)}
    assert sorted(r.new_document for r in new.collect()) == [13, 14]


def test_appends_refuse_taken_keys(spark):
    old = spark.createDataFrame([(1, "a")], "id long, name string")
    assert lifecycle.refuse_duplicates(old, spark.createDataFrame([(2, "b")], old.schema), ["id"]).count() == 2
    for new in ([(1, "b")], [(3, "b"), (3, "c")]):
        with pytest.raises(PySparkException, match="taken"):
            lifecycle.refuse_duplicates(old, spark.createDataFrame(new, old.schema), ["id"]).collect()


def test_spaces(spark):
    s = spark.createDataFrame([(1, "m", 64, True), (2, "m", 64, True)], "organization_id long, model string, dimension int, is_current boolean")
    got = lifecycle.ensure_spaces(s, spark.createDataFrame([(1, "n", 32)], "organization_id long, model string, dimension int")).collect()
    assert sorted((r.organization_id, r.model, r.is_current) for r in got) == [(1, "m", False), (1, "n", True), (2, "m", True)]
    again = lifecycle.ensure_spaces(s, spark.createDataFrame([(1, "m", 64)], "organization_id long, model string, dimension int")).collect()
    assert sorted((r.organization_id, r.model, r.is_current) for r in again) == [(1, "m", True), (2, "m", True)]


# --- jobs --------------------------------------------------------------------------------------------------------------------------


def test_job_lifecycle(spark):
    rows = [
        (1, 1, "create", None, None, None), (1, 2, "start", "PARSING", None, {"a": "1", "b": "1"}), (1, 3, "stage", "CHUNKING", None, {"a": "2"}), (1, 4, "fail", None, "broke", None),
        (1, 5, "start", "PARSING", None, None), (1, 6, "stage", "OCR", None, None), (2, 1, "create", None, None, None), (3, 1, "start", "PARSING", None, None), (3, 2, "complete", None, None, None),
        (4, 1, "start", "OCR", None, None), (4, 2, "fail", None, "z" * 2500, None),
    ]
    ev = spark.createDataFrame(rows, "job_id long, seq long, kind string, stage string, message string, state map<string,string>")
    got = {r.job_id: r for r in lifecycle.job_states(ev).collect()}
    assert (got[1].attempts, got[1].status, got[1].stage, got[1].error, got[1].state) == (2, "RUNNING", "OCR", None, {"a": "2", "b": "1"})
    assert (got[2].attempts, got[2].status, got[2].stage) == (0, "QUEUED", None) and (got[3].status, got[3].stage) == ("COMPLETED", "COMPLETED")
    assert (got[4].status, got[4].stage, len(got[4].error)) == ("FAILED", "OCR", 2000)


def test_resume(spark):
    j = spark.createDataFrame([(1, "EMBEDDING"), (2, "EMBEDDING"), (3, "OCR")], "document_id long, stage string")
    got = {r.document_id: r.resume_stage for r in lifecycle.resume_from(j, j.where("document_id <> 2").select("document_id")).collect()}
    assert got == {1: "EMBEDDING", 2: "PARSING", 3: "PARSING"}


# --- look-ups ------------------------------------------------------------------------------------------------------------------------


def test_lookups(spark):
    rows = spark.createDataFrame([(1, 7, "k", 2, True), (2, 7, "k", 1, True), (3, 7, "k", 3, False), (4, 8, "k", 4, True)], "chunk_id long, organization_id long, section_key string, ordinal long, is_active boolean").withColumn("document_id", F.lit(9))
    assert catalog.require(rows, 7, chunk_id=1).count() == 1
    for org, key in ((8, 1), (7, 99), (None, 1)):
        with pytest.raises(catalog.NotFound):
            catalog.require(rows, org, chunk_id=key)
    assert [r.chunk_id for r in catalog.section(rows, 7, 9, "k").collect()] == [2, 1]
    assert [r.chunk_id for r in catalog.section(rows, 7, 9, "k", active_only=False).collect()] == [2, 1, 3]
    assert catalog.chunks_by_ids(rows, 7, rows.select("chunk_id")).count() == 3 and catalog.chunks_by_ids(rows, 7, rows.limit(0)).count() == 0
    assert catalog.narrowed(5, None) == 5 and catalog.narrowed(None, 4) == 4
    with pytest.raises(PermissionError):
        catalog.narrowed(5, 4)
    assert catalog.visible_organizations(rows).count() == 0 and catalog.visible_organizations(rows, platform=True).count() == 4


def test_hit_projection_of_sparse_rows(spark):
    rows = spark.createDataFrame([(1, None, 0.12345678, None)], "chunk_id long, location_id long, vector_score double, keyword_score double")
    r = projections.api_hits(projections.hits(rows)).first()
    assert (r.scope, r.matched, r.section_path, r.score, r.vector_score, r.token_count) == ("ORGANIZATION", ["vector"], [], 0.0, 0.123457, 0)


# --- searches --------------------------------------------------------------------------------------------------------------------------


def test_documents_join(spark):
    c = spark.createDataFrame([(i, 1, None, i, 1, True, "en") for i in (1, 2, 3)], "chunk_id long, organization_id long, location_id long, document_id long, version_number long, is_active boolean, language string")
    docs = spark.createDataFrame([(1, False, "guide"), (2, True, "guide"), (3, False, "legal")], "document_id long, is_deleted boolean, document_type string")
    ids = lambda f, d=docs: sorted(r.chunk_id for r in search.scoped(c, f, d).collect())
    assert ids(search.Filters(1, include_inactive=True)) == [1, 3] and ids(search.Filters(1, document_types=("legal",))) == [3]
    with pytest.raises(ValueError):
        ids(search.Filters(1, document_types=("legal",)), None)
    assert search.Filters(1, 5).for_scope(None).scope == "ORG_ONLY" and search.Filters(1).for_scope(5) == search.Filters(1, 5, "LOCATION_ONLY")
    assert search.candidate_k(8) == 50 and search.candidate_k(20) == 80


def test_vector_batch_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(90, 6))
    m[7] = m[3]
    m[11] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, None), (91, [1.0])], "row_id long, embedding array<double>")
    asked = rows.where("row_id % 20 = 3 or row_id = 11 or row_id = 90").select(F.col("row_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.place): r.row_id for r in search.vector_batch(rows, asked, 5, block=16, width=2).collect()}
    u = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    want = {}
    for q in range(3, 90, 20):
        s = np.round(u @ u[q], 12)
        order = [i for i in np.lexsort((np.arange(90), -s)) if i != 11][:5]
        want |= {(q, k): int(i) for k, i in enumerate(order, 1)}
    assert got == want


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"s{i}" for i in range(80)]
    sets = [sorted(set(base[: rng.integers(40, 80)]) | {f"x{rng.integers(0, 4)}" for _ in range(rng.integers(0, 3))}) for _ in range(60)] + [["only"], [], ["only"]]
    rows = [(i % 2, i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "organization_id long, chunk_id long, shingles array<string>")
    reps = {}
    for o, i, s in rows:
        if s:
            reps.setdefault((o, tuple(s)), i)
    want = {(min(i, j), max(i, j)) for (o, s), i in reps.items() for (p, t), j in reps.items() if i < j and o == p and len(set(s) & set(t)) >= 0.97 * min(len(s), len(t))}
    assert {(r.a, r.b) for r in context.near_pairs(df).collect()} == want and want
    assert {r.chunk_id: r.class_id for r in context.set_classes(df).collect()} == {i: reps[o, tuple(s)] for o, i, s in rows if s}


def test_sets_are_made_once(spark):
    """Each row's set is made of its text once, however often the search reads it."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(1, i, [f"s{j}" for j in range(i % 5, 40)]) for i in range(30)]
    schema = "organization_id long, chunk_id long, shingles array<string>"
    for search in (context.near_pairs, context.set_classes):
        made.value = 0
        assert search(spark.createDataFrame(rows, schema).mapInArrow(run, schema)).count() == (10 if search is context.near_pairs else 30)
        assert made.value == 30


def test_near_pairs_of_sets_made_again_and_in_rounds(spark, monkeypatch):
    """The same pairs, whether shingles are written or made again, and however many rounds; the sets are made again for chunks of likely pairs only."""
    rng = np.random.default_rng(8)
    base = [[f"w{b} {j}" for j in range(70)] for b in range(8)]
    sets = [sorted(set(base[i % 8][: rng.integers(30, 70)]) | {f"x{i} {j}" for j in range(rng.integers(0, 3))}) for i in range(80)] + [[f"alone {i} {j}" for j in range(9)] for i in range(40)]
    rows = [(i % 2, i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "organization_id long, chunk_id long, shingles array<string>")
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i < j and i % 2 == j % 2 and s != t and len(set(s) & set(t)) >= 0.97 * min(len(s), len(t))}
    reps = {(o, tuple(s)): i for o, i, s in reversed(rows)}
    want = {(i, j) for i, j in want if {i, j} <= set(reps.values())}
    asked = []

    def again(ids):
        asked.extend(r.chunk_id for r in ids.collect())
        return df.join(ids, "chunk_id", "left_semi")

    for bits in (context.BITS, 256):
        monkeypatch.setattr(context, "BITS", bits)
        asked.clear()
        assert {(r.a, r.b) for r in context.near_pairs(df, again=again).collect()} == want and want
        assert {r for pair in want for r in pair} <= set(asked) and max(asked) < 80
        assert {(r.a, r.b) for r in context.near_pairs(df).collect()} == want


def test_near_pairs_leave_few_shingles_behind(spark):
    """What stays written is a small part of the sets (all of them twice before)."""
    df = spark.range(3000).selectExpr("id % 4 as organization_id", "id as chunk_id", "transform(sequence(1, 60), j -> concat(sha2(concat(id, ' ', j), 512), ' of a text')) as shingles")
    folder = chunk_store.shared_folder(spark).removeprefix("file://")
    old = set(os.listdir(folder))
    context.near_pairs(df, again=lambda ids: df.join(ids, "chunk_id", "left_semi")).collect()
    size = sum(os.path.getsize(os.path.join(base, f)) for name in set(os.listdir(folder)) - old for base, _, files in os.walk(f"{folder}/{name}") for f in files)
    assert size < 3000 * 60 * 8


def test_stems():
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "glass": "glass", "hoping": "hop", "hopping": "hop", "conflated": "conflate", "falling": "fall", "happy": "happi", "sky": "sky", "sing": "sing", "policies": "polici", "policy": "polici"}.items():
        assert lexical.stem(word) == want, word
    assert lexical.tokens("The cats are IN the hall") == [("cat", 2), ("hall", 6)]


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "Pool", "The pool is open late and towels are given out.", "en"), (2, "Bar", "Late at the bar, far from any water, one may ask whether the pool is open.", "en"), (3, None, "open pool", "en"),
        (4, "Pets", "No pets near the pool", "en"), (5, "Piscine", "la piscine est ouverte", "fr"), (6, None, None, "en"),
    ]
    return lexical.postings(spark.createDataFrame(rows, "chunk_id long, heading string, content string, language string")).cache()


def found(index, text, **how):
    return [r.chunk_id for r in lexical.search(index, lexical.parse(text, **how), 10).collect()]


def test_lexical_queries(index):
    assert set(found(index, "pools opened", relax=False)) == {1, 2, 3}
    assert set(found(index, "pools opened")) == {1, 2, 3, 4}
    assert set(found(index, '"pool is open"')) == {1, 2} and found(index, '"open pool"') == [3]
    assert set(found(index, "pool -pets")) == {1, 2, 3} and set(found(index, "bar OR pets")) == {2, 4}
    assert found(index, "est ouverte", english=False) == [5] and found(index, "the") == [] and found(index, "-pool") == []
    assert found(index, "pool late", relax=False)[0] == 1  # both stand close together, and in the heading
    assert lexical.query_language(("fr",)) == "fr" and lexical.query_language(("fr", "de")) == "en"


def leaf(*words):
    return ("leaf", tuple((w, i) for i, w in enumerate(words)))


def test_cover_density_by_hand():
    places = [(1, "a", 1.0), (2, "b", 1.0), (9, "a", 0.4)]
    # covers 1-2 (no gap) and 2-9 (six words between)
    both, either = ("and", (leaf("a"), leaf("b"))), ("or", (leaf("a"), leaf("b")))
    assert lexical.cover_density(places, both) == pytest.approx(2 / 2 + (2 / (1 / 1.0 + 1 / 0.4)) / 7)
    assert lexical.cover_density(places, ("and", (leaf("a"), leaf("c")))) == 0.0 and lexical.cover_density([(4, "a", 0.4)], leaf("a")) == pytest.approx(0.4)
    assert lexical.cover_density(places, either) == pytest.approx(2.4)  # every match is a cover of its own
    assert lexical.cover_density([(1, "a", 0.4), (40, "b", 0.4)], either) == pytest.approx(0.8)
    assert lexical.cover_density([(1, "a", 1.0), (2, "b", 1.0), (3, "b", 1.0), (4, "c", 0.4)], ("or", (both, leaf("c")))) == pytest.approx(1.4)
    assert lexical.cover_density([(1, "a", 1.0), (3, "b", 1.0), (4, "a", 0.4), (5, "b", 0.4)], leaf("a", "b")) == pytest.approx(0.4)


def test_query_trees():
    tree = lambda q, **how: lexical.parse(q, english=False, **how).tree
    a, b, c = map(leaf, "abc")
    assert tree("a b or c", relax=False) == ("or", (("and", (a, b)), c)) == tree("a b OR c", relax=False)
    assert tree("a b or c") == ("or", (a, b, c)) and tree("a b") == ("or", (a, b)) and tree("or a or") == a
    assert tree('a "b c"', relax=False) == ("and", (a, leaf("b", "c"))) and tree('"or" a', relax=False) == ("and", (leaf("or"), a))
    assert tree("a b -c") == ("and", (a, b, ("not", c))) and tree("") is None
    assert lexical.stem("agreed") == "agree" and lexical.stem("need") == "need"


def test_both_words_beat_one_in_relaxed_queries(spark):
    far = " ".join(["pool", *["x"] * 38, "bar"])
    rows = [(1, None, far, "fr"), (2, None, "pool", "fr"), (3, "bar", "none", "fr"), (4, None, "pool pool -", "fr")]
    got = lexical.search(lexical.postings(spark.createDataFrame(rows, "chunk_id long, heading string, content string, language string")), lexical.parse("pool bar", english=False), 10).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [(3, 0.5), (1, round(0.8 / 1.8, 6)), (4, round(0.8 / 1.8, 6)), (2, round(0.4 / 1.4, 6))]


def test_stored_positions(spark, tmp_path):
    rows = [(1, "Pool", "the pool bar", "fr", 1, True), (2, None, "bar", "fr", 2, True), (3, None, None, None, 1, False)]
    chunks = spark.createDataFrame(rows, "chunk_id long, heading string, content string, language string, organization_id long, is_active boolean")
    lexical.write(chunks, f"file://{tmp_path}/p", buckets=8)
    query = lexical.parse("pool bar", english=False)
    at = lexical.read(spark, f"file://{tmp_path}/p", query, buckets=8)
    assert lexical.search(at, query, 5).collect() == lexical.search(lexical.postings(chunks), query, 5).collect()
    assert [r.chunk_id for r in lexical.search(search.scoped(at, search.Filters(1, scope="ALL_LOCATIONS")), query, 5).collect()] == [1]
    assert len({r.bucket for r in at.select("bucket").distinct().collect()}) <= 2


def test_positions_carry_the_chunk_s_columns_without_a_join(spark):
    rows = [(1, "Pool", "the pool", "en", 1, None), (2, None, "a bar", "fr", 2, 7)]
    chunks = spark.createDataFrame(rows, "chunk_id long, heading string, content string, language string, organization_id long, location_id long")
    got = lexical.postings(chunks, ("organization_id", "location_id", "absent"))
    assert sorted(tuple(r) for r in got.select("chunk_id", "organization_id", "term", "weight", "positions").collect()) == [(1, 1, "pool", "A", [1]), (1, 1, "pool", "B", [3]), (2, 2, "a", "B", [1]), (2, 2, "bar", "B", [2])]
    assert {(r.chunk_id, r.location_id) for r in got.collect()} == {(1, None), (2, 7)}
    assert not any(w in got._jdf.queryExecution().executedPlan().toString() for w in ("Join", "Exchange"))


# --- tools -----------------------------------------------------------------------------------------------------------------------------


def test_tools(spark):
    d = spark.createDataFrame([("2024-03-01",), ("2023-12-30",), ("x",), ("2026-01-01",), ("2023-12-31",)], "t string")
    assert [r[0] for r in d.select(tools.stay_error(F.col("t"), F.to_date(F.lit("2024-01-01")))).collect()] == [None, "past", "not_a_date", "too_far", None]
    stays = spark.createDataFrame([(1, 5, "suite", datetime.date(2024, 1, 5), 3), (2, 5, "suite", datetime.date(2024, 1, 5), 0)], "stay_id long, location_id long, room_type string, check_in date, n_nights int")
    nights = tools.house(tools.nights(stays)).collect()
    assert len(nights) == 3 and all(0 <= r.available <= 6 and r.rate % 100 == 0 and r.rate >= 72000 for r in nights)
    assert nights == tools.house(tools.nights(stays)).collect()
    t = spark.createDataFrame([("Guide > Pool\n\nThe pool opens early every single morning until dusk comes", ), ("a bc def",), ("",)], "content string")
    assert [r[0] for r in t.select(tools.probe_text(F.col("content"))).collect()] == ["pool opens early every single morning", None, None]
    a = spark.createDataFrame([("[S1] [S2, s3].",), ("see [S1]",), ("",)], "t string")
    assert [r[0] for r in a.select(tools.only_citations(F.col("t"))).collect()] == [True, False, False]
    m = spark.createDataFrame([(10.0, "eur", " JPY ", ), (1.0, "eur", "xxx")], "amount double, from_currency string, to_currency string")
    r = spark.createDataFrame([("EUR", 1.0), ("JPY", 160.0)], "currency string, per_base double")
    assert sorted((x.converted for x in tools.convert(m, r).collect()), key=str) == [1600.0, None]


def test_retained_feed_keeps_the_newest_of_live_jobs(spark):
    rows = spark.createDataFrame([(1, i, f"2024-01-01 10:00:0{i}") for i in range(5)] + [(2, 9, "2024-01-01 08:00:00"), (None, 7, "2024-01-01 10:00:00"), (3, 8, None)], "job_id long, seq long, t string").withColumn("at", F.to_timestamp("t"))
    got = lifecycle.retained_feed(rows, F.to_timestamp(F.lit("2024-01-01 10:30:00")), maxlen=2).collect()
    assert sorted((r.job_id or 0, r.seq) for r in got) == [(0, 7), (1, 3), (1, 4)]
    assert [r.seq for r in lifecycle.trimmed_queue(rows, 2).collect()] == [9, 8]


def test_mark_failed_keeps_other_errors(spark):
    v = spark.createDataFrame([(1, 1, "FAILED", "old message"), (1, 2, "PROCESSING", None), (2, 1, "ACTIVE", "was"), (3, 1, "FAILED", "before")], "document_id long, version_number long, status string, error string")
    f = spark.createDataFrame([(1, 2, "new"), (2, 1, "no"), (3, 1, "again")], "document_id long, version_number long, message string")
    got = {(r.document_id, r.version_number): (r.status, r.error) for r in lifecycle.mark_failed(v, f).collect()}
    assert got == {(1, 1): ("FAILED", "old message"), (1, 2): ("FAILED", "new"), (2, 1): ("ACTIVE", "was"), (3, 1): ("FAILED", "again")}
    assert {r.error for r in lifecycle.mark_failed(v.drop("error"), f).collect()} == {None, "new", "again"}


def test_ensure_spaces_two_models_wanted(spark):
    schema = "organization_id long, model string, dimension int"
    spaces = spark.createDataFrame([(1, "a", 4, True), (1, "b", 4, False)], schema + ", is_current boolean")
    wanted = spark.createDataFrame([(1, "b", 4), (1, "a", 4), (2, "z", 4), (2, "y", 8), (2, "y", 8)], schema)
    got = sorted(tuple(r) for r in lifecycle.ensure_spaces(spaces, wanted).collect())
    assert got == [(1, "a", 4, True), (1, "b", 4, False), (2, "y", 8, True)]
