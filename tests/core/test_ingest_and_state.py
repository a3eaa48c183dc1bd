import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.operators import catalog, ocr_gate, routing, structure, versions
from tesserae.settings import Chunking, Ocr
from tesserae.sources import chunk_store, readers, snapshots
from tesserae.streaming import jobs

GOOD = "The pool is open from nine until dusk and towels are handed out at the desk near the door. " * 3


def decision(spark, pages, s=Ocr(), area=0.0):
    df = spark.createDataFrame([(1, i + 1, t, area, True) for i, t in enumerate(pages)], "document_id long, page_number long, text string, image_area_ratio double, has_fonts boolean")
    r = ocr_gate.decide(ocr_gate.with_repeats(ocr_gate.page_stats(df)), s).first()
    return r.mode, r.ocr_pages


def test_ocr_gate(spark):
    good = [f"{GOOD} page {i}" for i in range(10)]
    assert decision(spark, good[:5]) == ("NATIVE", [])
    assert decision(spark, [""] * 6) == ("OCR", [1, 2, 3, 4, 5, 6])
    assert decision(spark, ["Figure 1."] * 6, area=0.95)[0] == "OCR"
    assert decision(spark, [" ".join(f"(cid:{i})" for i in range(120))] * 5)[0] == "OCR"
    assert decision(spark, ["�" * 400] * 4)[0] == "OCR"
    assert decision(spark, ["CONFIDENTIAL draft copy, do not pass on " * 4] * 8)[0] == "OCR"
    assert decision(spark, good[:7] + [""] * 3) == ("HYBRID", [8, 9, 10])
    assert len(decision(spark, [""] * 40, Ocr(max_ocr_pages=5))[1]) == 5


def test_ocr_gate_of_the_reference_cases(spark):
    """Sixty characters on an image are no scan; control characters are broken text; a document without pages is native."""
    good = [f"{GOOD} page {i}" for i in range(4)]
    assert decision(spark, ["x" * 60 + f" {i}" for i in range(4)], area=0.95)[0] == "OCR"  # for want of usable text
    assert decision(spark, good, area=0.95)[0] == "NATIVE"
    assert decision(spark, [t + "\x01" * 60 for t in good])[0] == "OCR"
    none = spark.createDataFrame([], "document_id long, page_number long, text string, image_area_ratio double, has_fonts boolean")
    r = ocr_gate.decide(ocr_gate.with_repeats(ocr_gate.page_stats(none)), documents=spark.createDataFrame([(7,)], "document_id long")).first()
    assert (r.document_id, r["mode"], r.coverage, r.n_pages, r.ocr_pages, r.reasons) == (7, "NATIVE", 0.0, 0, [], ["empty_document"])
    d = ocr_gate.event_detail(ocr_gate.decide(ocr_gate.with_repeats(ocr_gate.page_stats(spark.createDataFrame([(1, i, "", 0.0, True) for i in range(1, 71)], none.schema))))).first()
    assert (len(d.ocr_pages), d.n_ocr_pages, d.reasons) == (50, 70, "insufficient_text")


def test_ocr_overlay(spark):
    pages = spark.createDataFrame([(1, 1, "own"), (1, 2, "own")], "document_id long, page_number long, text string")
    ocr = spark.createDataFrame([(1, 1, "seen"), (1, 2, " ")], "document_id long, page_number long, ocr_text string")
    assert sorted((r.page_number, r.text) for r in ocr_gate.overlay(pages, ocr).collect()) == [(1, "seen"), (2, "own")]


def chunked(spark, text, s=Chunking()):
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    return structure.chunk_text(docs, s).orderBy("ordinal").collect()


def test_texts_are_cut_into_lines_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "document_id long, text string"
    rows = [(i, f"# Part {i}\n{GOOD}\n## More\n{GOOD}") for i in range(5)]
    got = structure.chunk_text(spark.createDataFrame(rows, schema).mapInArrow(run, schema))
    assert {r.document_id for r in got.collect()} == {0, 1, 2, 3, 4}
    assert made.value == 5
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_made_without_another_shuffle(spark):
    """Lines are shuffled once, before they are written by document: statistics, windows, joins, paragraphs and sections take what lies together."""
    docs = spark.createDataFrame([(i, f"# Part {i}\n{GOOD}\n## More\n{GOOD}") for i in range(20)], "document_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = structure.chunk_text(docs)
        assert got.count() == 40 and got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sections_without_text_or_heading(spark):
    rows = [("before any heading", 10.0, 1, 300.0), ("Empty", 18.0, 1, 50.0), ("Full", 18.0, 2, 50.0), ("its text", 10.0, 2, 300.0), ("and more of it", 10.0, 3, 300.0)]
    secs = structure.section_rows(structure.outline(scored_lines(spark, rows))).orderBy("section").collect()
    assert [(r.section, r.level, r.path, r.heading_page, [(b.text, b.page_from, b.page_to) for b in r.blocks]) for r in secs] == [
        (0, 0, [], None, [("before any heading", 1, 1)]),
        (2, 1, ["Full"], 2, [("its text and more of it", 2, 3)]),
    ]


def test_sections_stay_apart_and_carry_their_path(spark):
    long = "This sentence is about one thing and is long enough to matter to a reader. " * 8
    got = chunked(spark, f"# Guide\n{long}\n## Breakfast Hours\n{long}\n## Parking\n{long}")
    assert [r.heading for r in got] == ["Guide", "Breakfast Hours", "Parking"]
    assert got[1].content.startswith("Guide > Breakfast Hours\n\n") and got[1].topic_key == "breakfast" and [r.ordinal for r in got] == [0, 1, 2]


def test_small_sections_fold_unless_a_hard_boundary_lies_between(spark):
    long = "This sentence is about one thing and is long enough to matter to a reader. " * 8
    got = chunked(spark, f"# A\n## One\n{long}\n### Tiny\nShort.\n## Two\nShort too.")
    assert [r.heading for r in got] == ["One", "Two"] and "Tiny" in got[0].content


def test_windows_respect_the_cap_and_overlap(spark):
    text = "# T\n" + "\n".join(f"Sentence number {i} says something of its own and goes on for a while." for i in range(200))
    s = Chunking(target_tokens=100, max_tokens=150, min_tokens=20, overlap_tokens=30)
    got = chunked(spark, text, s)
    assert len(got) > 5 and all(r.token_count <= 150 + 30 for r in got)
    first, second = got[0].content.split("\n\n", 1)[1], got[1].content.split("\n\n", 1)[1]
    assert second.split("\n\n")[0] in first
    whole = " ".join(r.content for r in got)
    assert all(f"Sentence number {i} " in whole for i in range(200))
    with pytest.raises(ValueError):
        Chunking(target_tokens=10, overlap_tokens=10)


def test_split_ladder():
    assert structure.split_text("a b", 10) == ["a b"]
    assert structure.split_text("aaaa bbbb.\n\ncccc dddd.", 4) == ["aaaa bbbb.", "cccc dddd."]
    parts = structure.split_text("w" * 5 + " " + " ".join("w" * 5 for _ in range(40)), 10)
    assert len(parts) > 3 and " ".join(parts).split() == ["wwwww"] * 41
    assert structure.closing("One is here. Two is here. Three is here.", 9) == "Two is here. Three is here." and structure.closing("A sentence far over the budget.", 1) != ""


def scored_lines(spark, rows):
    """rows: (text, font, page, x1)"""
    lines = spark.createDataFrame([(1, p, i, t, 0.0, x1, i * 14.0, i * 14.0 + 10, f, 0.0, 4.0) for i, (t, f, p, x1) in enumerate(rows)], structure.LINES)
    return structure.heading_scores(lines, structure.layout_stats(lines), structure.repeating_lines(lines))


def test_font_levels_and_numbers(spark):
    """Levels come from all large lines, not from headings alone; sizes within 0.4 are one level; numbers win over fonts."""
    body = [("ordinary text that goes on and on, as text does, and on", 10.0, 1, 300.0)] * 6
    rows = [("Large but a sentence, with a comma,", 24.0, 1, 150.0), ("First", 18.0, 1, 50.0), *body, ("Second", 17.9997, 1, 50.0), ("Deep", 14.0, 1, 50.0), ("2.1.3 Numbered", 18.0, 1, 50.0)]
    scored = scored_lines(spark, rows)
    levels = structure.font_levels(scored).first().levels
    assert levels == pytest.approx([24.0, 18.0, 14.0])
    got = {r.text: r.level for r in structure.outline(scored).where("is_heading").collect()}
    assert got == {"Large but a sentence, with a comma,": 1, "First": 2, "Second": 2, "Deep": 3, "2.1.3 Numbered": 3} or got == {"First": 2, "Second": 2, "Deep": 3, "2.1.3 Numbered": 3}


def test_paths_paragraphs_and_pages(spark):
    rows = [("Guide", 18.0, 1, 50.0), ("one two three", 10.0, 1, 300.0), ("goes on to the next page.", 10.0, 2, 300.0), ("Part", 14.0, 2, 50.0), ("text of the part", 10.0, 2, 300.0), ("Other", 18.0, 3, 50.0), ("last", 10.0, 3, 300.0)]
    secs = structure.section_rows(structure.outline(scored_lines(spark, rows))).orderBy("section").collect()
    assert [(r.path, [(b.text, b.page_from, b.page_to) for b in r.blocks]) for r in secs] == [
        (["Guide"], [("one two three goes on to the next page.", 1, 2)]),
        (["Guide", "Part"], [("text of the part", 2, 2)]),
        (["Other"], [("last", 3, 3)]),
    ]
    spans = structure.page_spans(structure.section_rows(structure.outline(scored_lines(spark, rows)))).collect()
    assert sorted((r.path, r.page_from, r.page_to) for r in spans) == [(["Guide"], 1, 2), (["Guide", "Part"], 2, 2), (["Other"], 3, 3)]


def test_running_headers(spark):
    rows = [(1, p, s, "Acme handbook" if s == 0 else f"line {p} {s} of text that is ordinary.") for p in range(1, 7) for s in range(3)]
    lines = spark.createDataFrame([(d, p, s, t, 0.0, 100.0, s * 14.0, s * 14.0 + 10, 10.0, 0.0, 4.0) for d, p, s, t in rows], structure.LINES)
    repeats = structure.repeating_lines(lines)
    assert [r.key for r in repeats.collect()] == ["acme handbook"]
    scored = structure.heading_scores(lines, structure.layout_stats(lines), repeats)
    assert scored.where("is_repeating").count() == 6 and scored.where("is_repeating and heading_score >= 3").count() == 0


V = "document_id long, version_number long, status string"
C = "chunk_id long, document_id long, version_number long, is_active boolean"


@pytest.fixture
def state(spark):
    v = spark.createDataFrame([(1, 1, "INACTIVE"), (1, 2, "ACTIVE"), (1, 3, "FAILED"), (2, 1, "ACTIVE"), (2, 2, "PROCESSING")], V)
    c = spark.createDataFrame([(10, 1, 1, False), (11, 1, 2, True), (12, 1, 3, False), (20, 2, 1, True), (21, 2, 2, False)], C)
    return v, c


def test_activation_and_rollback(state):
    v, c = versions.activate(*state, 1, 1)
    assert {(r.document_id, r.version_number): r.status for r in v.collect()} == {(1, 1): "ACTIVE", (1, 2): "INACTIVE", (1, 3): "FAILED", (2, 1): "ACTIVE", (2, 2): "PROCESSING"}
    assert sorted(r.chunk_id for r in c.where("is_active").collect()) == [10, 20]
    v, c = versions.activate(v, c, 1, 2)
    assert sorted(r.chunk_id for r in c.where("is_active").collect()) == [11, 20]
    again = versions.activate(v, c, 1, 2)
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, c.collect()))
    with pytest.raises(versions.Conflict):
        versions.activate(*state, 1, 3)
    with pytest.raises(KeyError):
        versions.activate(*state, 9, 1)


def test_next_versions_and_gates(spark, state):
    assert {r.document_id: r.next_version for r in versions.next_version(state[0]).collect()} == {1: 4, 2: 3}
    checks = spark.createDataFrame([(1, "content", True), (1, "chunk_count", True), (2, "lexical_index", False), (2, "content", False), (2, "chunk_count", True)], "document_id long, gate string, passed boolean")
    assert {r.document_id: (r.passed, r.failed_gate) for r in versions.first_failure(checks).collect()} == {1: (True, None), 2: (False, "content")}


def test_archive_and_restore(spark, state):
    docs = spark.createDataFrame([(1, 7, None, "a", False), (2, 7, None, "b", False)], "document_id long, organization_id long, location_id long, slug string, is_deleted boolean")
    d, v, c = versions.archive(docs, *state, docs.where("document_id = 1"))
    row = d.where("document_id = 1").first()
    assert row.is_deleted and row.slug.startswith("a:archived:") and c.where("is_active and document_id = 1").count() == 0
    assert v.where("status = 'ACTIVE'").count() == 1
    back = versions.restore(d, 1).where("document_id = 1").first()
    assert (back.slug, back.is_deleted) == ("a", False)
    clash = d.unionByName(spark.createDataFrame([(3, 7, None, "a", False)], docs.schema))
    with pytest.raises(versions.Conflict):
        versions.restore(clash, 1)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 0, "x", True), (1, 1, "y", True)], "v long, ordinal long, content string, is_active boolean")
    new = spark.createDataFrame([(1, 1, "z", False), (1, 2, "w", False)], old.schema)
    once = versions.upsert(old, new, ("v", "ordinal"), ("content",))
    assert sorted(map(tuple, once.collect())) == [(1, 0, "x", True), (1, 1, "z", True), (1, 2, "w", False)]
    assert sorted(map(tuple, versions.upsert(once, new, ("v", "ordinal"), ("content",)).collect())) == sorted(map(tuple, once.collect()))


def test_tenancy(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "organization_id long, x string")
    assert catalog.tenant(df, None).count() == 0 and catalog.tenant(df, 2).count() == 1
    with pytest.raises(Exception, match="another tenant"):
        catalog.write_check(df, 1).collect()


def test_users_and_pages(spark):
    users = spark.createDataFrame([(1, 1, "a_b@x", "Ann", "admin", True), (2, 1, "c@x", "Axb", "admin", True), (3, 1, "d@x", "Dan", "member", True), (4, 2, "e@x", "Eve", "admin", True)], "user_id long, organization_id long, email string, name string, role string, is_active boolean")
    assert [r.user_id for r in catalog.search_users(users, "A_B").collect()] == [1]
    ask = lambda *ids: sorted(r.user_id for r in catalog.guarded_admins(users, spark.createDataFrame([(i,) for i in ids], "user_id long")).collect())
    assert ask(1, 3) == [1, 3] and ask(1, 2) == [] and ask(4) == []
    got = catalog.page(users.select("user_id"), [F.col("user_id")], 3, 0).collect()
    assert [(r.user_id, r.total, r.has_more) for r in got] == [(1, 4, True), (2, 4, True), (3, 4, True)]
    assert catalog.partial_update(users, F.col("user_id") == 1, {"name": None}, ("name",)).where("name is null").count() == 1
    with pytest.raises(ValueError):
        catalog.partial_update(users, F.lit(True), {"role": "x"}, ("name",))


MODELS = [("p", "small-local", "fast", "local", 8000, True, False, 0.0, 0.0), ("p", "mid-local", "balanced", "local", 32000, True, True, 0.0, 0.0), ("q", "cheap-cloud", "fast", "cloud", 128000, True, True, 0.5, 1.5), ("q", "big-cloud", "quality", "cloud", 200000, True, True, 3.0, 15.0)]


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame([(i, *m, True, True) for i, m in enumerate(MODELS)], "position int, provider string, name string, tier string, privacy string, context_window long, supports_tools boolean, supports_json boolean, cost_in double, cost_out double, supports_streaming boolean, is_available boolean")
    return df.cache()


@pytest.mark.parametrize(
    ("request_", "want"),
    [
        (routing.Request("answer"), ("mid-local", "default_balanced")),
        (routing.Request("title"), ("small-local", "cheap_task")),
        (routing.Request("answer", needs_tools=True), ("small-local", "tool_capable")),
        (routing.Request("answer", document_types=("legal",)), ("big-cloud", "high_stakes")),
        (routing.Request("answer", require_local=True, document_types=("legal",)), ("mid-local", "high_stakes")),
        (routing.Request("answer", prompt_tokens=100_000), ("big-cloud", "default_any")),
        (routing.Request("answer", pins={"*": "q/cheap-cloud"}, prefer_model="big-cloud"), ("cheap-cloud", "org_pin")),
        (routing.Request("answer", prefer_model="big-cloud"), ("big-cloud", "caller_preference")),
        (routing.Request("answer", prefer_model="big-cloud", allowed_providers=("p",)), ("mid-local", "default_balanced")),
        (routing.Request("title", needs_json=True, require_local=True), ("mid-local", "cheap_task")),
    ],
)
def test_routing(models, request_, want):
    r = routing.route(models, request_).first()
    assert (r["name"], r["rule"]) == want and not r["compaction_required"]


def test_routing_relaxes_the_window_and_may_find_nothing(models):
    r = routing.route(models, routing.Request("answer", prompt_tokens=10_000_000)).first()
    assert r["compaction_required"]
    assert routing.route(models, routing.Request("answer", allowed_providers=("none",))).count() == 0


def test_routing_prefers_local_at_equal_cost_and_names_fallbacks(spark):
    rows = [(i, p, n, t, v, 32_000, True, True, True, True, 1.0, 1.0) for i, (p, n, t, v) in enumerate([("c", "far", "fast", "cloud"), ("l", "near", "fast", "local"), ("c", "big", "quality", "cloud"), ("l", "big2", "quality", "local"), ("c", "x", "fast", "cloud")])]
    m = spark.createDataFrame(rows, "position long, provider string, name string, tier string, privacy string, context_window long, is_available boolean, supports_tools boolean, supports_json boolean, supports_streaming boolean, cost_in double, cost_out double")
    one = lambda r: tuple(routing.route(m, r).select("name", "rule", "fallbacks").first())
    assert one(routing.Request("title")) == ("near", "cheap_task", ["c/far", "c/big", "l/big2"])
    assert one(routing.Request("answer", document_types=("legal",))) == ("big2", "high_stakes", ["c/far", "l/near", "c/big"])
    assert one(routing.Request("answer"))[:2] == ("big", "default_any")
    assert one(routing.Request("answer", pins={"answer": "nowhere/x"}, prefer_model="x"))[:2] == ("x", "caller_preference")


def test_small_routing_rules(spark):
    e = spark.createDataFrame([(1, datetime.fromisoformat("2024-01-01 00:00:10")), (1, datetime.fromisoformat("2024-01-01 00:00:50")), (1, datetime.fromisoformat("2024-01-01 00:01:00"))], "user_id long, ts timestamp")
    assert sorted((r.n_requests, r.n_rejected) for r in routing.rate_windows(e, 1).collect()) == [(1, 0), (2, 1)]
    assert all(r.n_rejected == 0 for r in routing.rate_windows(e, 0).collect())
    df = spark.createDataFrame([([1.0, 2.0, 9.0],)], "r array<double>")
    assert df.select(routing.calibrate(F.col("r"))).first()[0] == pytest.approx(1.3)
    tools = spark.createDataFrame([("a", True, ["x"]), ("b", True, []), ("c", False, [])], "name string, enabled boolean, scopes array<string>")
    assert [r.name for r in routing.visible_tools(tools, []).collect()] == ["b"]
    plan = spark.createDataFrame([([" a", "a", "", "b", "c", "d"], "raw"), (["  "], "raw")], "q array<string>, raw string")
    assert [r[0] for r in plan.select(routing.plan(F.col("q"), F.col("raw"))).collect()] == [["a", "b", "c"], ["raw"]]


def test_job_stream_retries_and_dead_letters(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    msg = lambda job, fail=False, terminal=False: json.dumps({"job_id": job, "organization_id": 1, "document_id": 1, "attempt": 1, "fail": fail, "terminal": terminal})
    for i, lines in enumerate([[msg("a"), msg("b", True), "not json", msg("t", True, True)], [msg("b", True), msg("a", True)], [msg("b", True)], [msg("b")]]):
        (src / f"{i}.json").write_text("\n".join(lines))
        done = []
        jobs.run_jobs(jobs.messages(spark, str(src)), str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, done=done: done.extend(r.job_id for r in df.collect())).awaitTermination()
    got = {r.job_id: (r.attempts, r.outcome) for r in jobs.read_jobs(spark, str(tmp_path / "state"), 3).collect()}
    assert got == {"a": (1, "done"), "b": (3, "dead"), "t": (1, "dead")}


def stream(spark, tmp_path, schema, batches):
    src = tmp_path / "s"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{i}.json", (10**9 + i, 10**9 + i))  # files are read in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def drain(df, tmp_path, mode):
    """Runs until the input is used up. Processing-time timeouts would ask for empty batches for ever."""
    out = []
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", mode == "append")
    df.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_stage_machine(spark, tmp_path):
    ev = lambda job, seq, kind, stage=None: {"job_id": job, "seq": seq, "kind": kind, "stage": stage}
    files = [
        [ev(1, 1, "start", "PARSING"), ev(1, 2, "stage", "CHUNKING"), ev(1, 3, "stage", "OCR"), ev(2, 1, "stage", "OCR")],
        [ev(1, 4, "fail"), ev(1, 5, "stage", "INDEXING"), ev(2, 2, "start", "PARSING"), ev(2, 3, "complete")],
        [ev(1, 6, "start", "PARSING"), ev(2, 3, "complete")],
    ]
    got = drain(jobs.stage_machine(stream(spark, tmp_path, "job_id long, seq long, kind string, stage string", files)), tmp_path, "update")
    of = lambda job: [(r.attempts, r.stage, r.progress, r.status) for r in got if r.job_id == job]
    assert of(1) == [(1, "CHUNKING", 0.55, "RUNNING"), (1, "CHUNKING", 1.0, "FAILED"), (2, "PARSING", 0.2, "RUNNING")]
    assert of(2) == [(0, None, 0.0, "QUEUED"), (1, "COMPLETED", 1.0, "COMPLETED"), (1, "COMPLETED", 1.0, "COMPLETED")]
    v = spark.createDataFrame([(1, 1, "FAILED"), (1, 2, "FAILED"), (2, 1, "ACTIVE")], "document_id long, version_number long, status string")
    again = {(r.document_id, r.version_number): r.status for r in jobs.requeue_versions(v, v.where("version_number = 1")).collect()}
    assert again == {(1, 1): "PROCESSING", (1, 2): "FAILED", (2, 1): "ACTIVE"}


def test_breaker(spark, tmp_path):
    call = lambda at, ok: {"provider": "p", "at": at, "ok": ok}
    calls = [call(float(i), False) for i in range(5)] + [call(6.0, True), call(25.0, False), call(30.0, True), call(46.0, True), call(47.0, True)]
    got = drain(jobs.breaker(stream(spark, tmp_path, "provider string, at double, ok boolean", [calls])), tmp_path, "append")
    assert [(r.at, r.passed, r.state) for r in sorted(got, key=lambda r: r.at)][4:] == [(4.0, True, "OPEN"), (6.0, False, "OPEN"), (25.0, True, "OPEN"), (30.0, False, "OPEN"), (46.0, True, "CLOSED"), (47.0, True, "CLOSED")]


def test_memory_keeps_the_last_turns(spark, tmp_path):
    turns = [[{"conv_id": 1, "turn": t, "text": "x"} for t in range(5)], [{"conv_id": 1, "turn": t, "text": "x"} for t in range(3, 9)]]
    got = drain(jobs.memory(stream(spark, tmp_path, "conv_id long, turn long, text string", turns), keep=3), tmp_path, "update")
    assert (got[-1].n_turns, got[-1].last_turn) == (6, 8)


def test_rate_stream(spark, tmp_path):
    ev = [[{"user_id": 1, "ts": f"2024-01-01T00:0{m}:{s:02d}Z"} for m, s in ((0, 1), (0, 59), (1, 5), (5, 0))], [{"user_id": 2, "ts": "2024-01-01T00:09:00Z"}]]
    got = drain(jobs.rate_stream(stream(spark, tmp_path, "user_id long, ts timestamp", ev)), tmp_path, "append")
    assert sorted(r.n_requests for r in got) == [1, 1, 2]


def test_queue_helpers(spark):
    d = spark.createDataFrame([(1, False, 400_000, False), (2, True, 900_000, False), (3, False, 5, True)], "job_id long, acked boolean, idle_ms long, dead boolean")
    assert [r.job_id for r in jobs.stale(d).collect()] == [1]
    assert tuple(jobs.queue_stats(d).first()) == (3, 2, 400_000, 1)
    ev = spark.createDataFrame([(1, "EMBEDDING"), (1, "PARSING"), (1, "nonsense")], "job_id long, stage string")
    assert tuple(jobs.progress(ev).first()) == (1, "EMBEDDING", 0.8, 2)
    rows = spark.createDataFrame([(1, 3, "FAILED"), (2, 2, "DONE"), (3, 1, "FAILED")], "job_id long, attempts int, status string")
    got = {r.job_id: (r.attempts, r.status) for r in jobs.requeue(rows, rows.where("job_id < 3")).collect()}
    assert got == {1: (0, "QUEUED"), 2: (2, "DONE"), 3: (1, "FAILED")}
    frame = jobs.ordered_frames(spark.createDataFrame([(1, 5, "stage", "x")], "job_id long, seq long, kind string, payload string")).first().frame
    assert frame.startswith("id: 1\nevent: stage\ndata: {") and frame.endswith("\n\n")


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody\n")
    (tmp_path / "b.png").write_bytes(b"\x89PNG....")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00\x80")
    raw = readers.files(spark, str(tmp_path))
    assert {r.path[-5:]: r.verdict for r in readers.upload_checks(raw).collect()} == {"/a.md": "ok", "b.png": "ok", "c.bin": "not_text"}
    p = readers.pages(raw.where("path not like '%bin'"))
    assert sorted((r.image_area_ratio, r.text) for r in p.collect()) == [(0.0, "# T\nbody\n"), (1.0, "")]
    want = p.where("image_area_ratio = 1").select("path", "page_number")
    assert readers.recognise(raw, want).first().ocr_text == ""
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(Exception, match="no parser"):
        readers.pages(readers.files(spark, str(tmp_path / "d.pdf"))).collect()


def test_snapshots(spark, tmp_path, state):
    root = f"file://{tmp_path}/snap"
    assert snapshots.current(spark, root) is None
    first = snapshots.publish(root, versions=state[0], chunks=state[1])
    assert snapshots.current(spark, root) == first
    v, c = versions.activate(snapshots.read(spark, root, "versions"), snapshots.read(spark, root, "chunks"), 1, 1)
    second = snapshots.publish(root, versions=v, chunks=c)
    assert snapshots.current(spark, root) == second != first and snapshots.read(spark, root, "chunks").where("is_active").count() == 2


def test_whole_jobs_are_registered(spark, tmp_path):
    """No delivery, key or replayed row is left out: counted against the tables themselves."""
    from tesserae import queries

    events = [(i, i % 3, "error" if i % 2 else "purchase") for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i + 1, "s") for i in (1, 250, 900)], "doc_id long, n_chars long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(900, 1), (900, 2), (5000, 1)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sum(r.attempts for r in run("settle_all_deliveries")) == 40
    assert sorted((r.id, r.size, r.source) for r in run("keyed_upsert_all")) == [(1, 2, "s"), (250, 251, "s"), (900, 2, "s"), (5000, 1, None)]
    assert sorted(r.event_id for r in run("progress_replay")) == list(range(40))


def test_gates_of_versions_without_chunks_or_not_found(spark):
    schema = "chunk_id long, is_active boolean, organization_id long, location_id long, document_id long, version_number long, ordinal long, content string, terms array<string>, embedding array<double>"
    rows = [(1, False, 1, None, 1, 1, 1, "Quiet rooms", ["quiet", "rooms"], [1.0]), (2, False, 1, None, 2, 1, 1, "Pool hours", ["stale", "index"], [1.0]), (4, False, 1, None, 4, 1, 1, "a b", ["a", "b"], [1.0])]
    chunks = spark.createDataFrame(rows, schema)
    every = spark.createDataFrame([(k, 1, 1, None) for k in (1, 2, 3, 4)], "document_id long, version_number long, organization_id long, location_id long")
    smoke = versions.smoke_hits(every, chunks, chunk_store.postings_of(chunks))
    checks = versions.gate_checks(versions.validation_stats(chunks), versions.foreign_rows(chunks, every), versions.scope_mismatch(chunks, every), every, smoke)
    assert {r.document_id: (r.passed, r.failed_gate) for r in versions.first_failure(checks).collect()} == {1: (True, None), 2: (False, "smoke_retrieval"), 3: (False, "chunk_count"), 4: (False, "smoke_retrieval")}
    elsewhere = every.withColumn("location_id", F.lit(5).cast("long"))  # the search by a version's own scope doesn't see its chunks
    assert not any(r.found for r in versions.smoke_hits(elsewhere, chunks, chunk_store.postings_of(chunks)).collect())
    assert not any(r.found for r in versions.smoke_hits(every.withColumn("organization_id", F.lit(2).cast("long")), chunks, chunk_store.postings_of(chunks)).collect())


def test_gates_shuffle_no_text(spark):
    """Vectors beside the chunks give the same statistics as vectors in them, and no exchange carries content, terms or a vector."""
    schema = "chunk_id long, doc_id long, organization_id long, location_id long, document_id long, version_number long, ordinal long, is_active boolean, content string, terms array<string>"
    rows = [(k, k % 3, 1, None, k % 3, 1, k, True, " " if k == 4 else f"Quiet rooms {k // 6}", [] if k == 5 else ["quiet", "rooms"]) for k in range(12)]
    chunks, vectors = spark.createDataFrame(rows, schema), spark.createDataFrame([(0, [1.0]), (1, None)], "doc_id long, embedding array<double>")
    apart = versions.validation_stats(chunks, vectors)
    assert sorted(apart.collect()) == sorted(versions.validation_stats(chunks.join(vectors, "doc_id", "left")).collect())
    assert {(r.document_id, r.n_chunks, r.n_empty, r.n_unembedded, r.n_unindexed, r.n_contents, r.n_ordinals) for r in apart.collect()} == {(0, 4, 0, 0, 0, 2, 4), (1, 4, 1, 4, 0, 3, 4), (2, 4, 0, 4, 1, 2, 4)}
    every = chunks.select("document_id", "version_number", "organization_id", "location_id").distinct()
    found = lambda postings: sorted(versions.smoke_hits(every, chunks, postings).collect())
    assert found(None) == found(chunk_store.postings_of(chunks))
