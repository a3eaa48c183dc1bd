"""Queries of ingestion state, look-ups, searches over many queries, and tools, with their SQL. Whole tables throughout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.operators import catalog, lexical, lifecycle, projections, search, tools
from tesserae.plans import tenant_tables as tt
from tesserae.queries import STAGE_SQL, USERS, V, _stage, _users, query
from tesserae.settings import STAGES
from tesserae.sources import chunk_store, segments, vector_index
from tesserae.streaming import jobs

CHUNKS = tt.CHUNKS_SQL
TYPES = "docs AS (SELECT document_id, document_id % 7 = 0 AS is_deleted, CASE document_id % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'legal' ELSE 'guide' END AS document_type FROM versions GROUP BY document_id)"


def _typed(spark, d):
    k = F.col("document_id")
    kind = F.when(k % 3 == 0, "policy").when(k % 3 == 1, "legal").otherwise("guide")
    return tt.versions(spark, d).select("document_id").distinct().select("document_id", (k % 7 == 0).alias("is_deleted"), kind.alias("document_type"))


# --- searches --------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {CHUNKS}, {TYPES} SELECT document_id, document_type, count(*) AS n_chunks FROM chunks JOIN docs USING (document_id)
WHERE organization_id = 1 AND is_active AND NOT is_deleted AND document_type IN ('policy', 'legal') GROUP BY ALL""")
def search_document_types(spark, d):
    seen = search.scoped(tt.index(spark, d).chunks, search.Filters(1, scope="ALL_LOCATIONS", document_types=("policy", "legal")), _typed(spark, d))
    return seen.groupBy("document_id", "document_type").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"""WITH {CHUNKS}, {TYPES} SELECT document_id, count(*) AS n_chunks FROM chunks JOIN docs USING (document_id) WHERE organization_id = 1 AND NOT is_deleted GROUP BY ALL""")
def search_excludes_archived(spark, d):
    """Inactive versions may answer when asked for; archived documents never do."""
    seen = search.scoped(tt.index(spark, d).chunks, search.Filters(1, scope="ALL_LOCATIONS", include_inactive=True), _typed(spark, d))
    return seen.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))


BATCH_SQL = """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, u.vec_id AS row_id, round(list_dot_product(q.v, u.v) / (q.n * u.n), 12) AS score FROM u q JOIN u ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM s)
SELECT query_id, row_id, round(score, 6) AS score, place FROM r WHERE place <= 10"""


@query(BATCH_SQL)
def search_batch(spark, d):
    """Every vector whose id is divisible by 20 is a query against all vectors."""
    rows = tt.read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    asked = rows.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "embedding")
    return search.vector_batch(rows, asked, 10).withColumn("score", F.round("score", 6))


def _vector_queries(spark, d):
    return tt.read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def vector_index_batch(spark, d):
    """search_batch over the cells of the index: each query reads the cells nearest to it, as many as the index was calibrated to. No SQL, as it may
    miss rows: a test holds its recall to at least 0.95."""
    return vector_index.search(tt.vector_cells(spark, d), _vector_queries(spark, d), 10).withColumn("score", F.round("score", 6))


@query(BATCH_SQL)
def vector_index_exact(spark, d):
    """search_batch by the index, exactly: cells and rows are left out only where their bounds prove that they cannot answer."""
    return vector_index.search(tt.vector_cells(spark, d), _vector_queries(spark, d), 10, exact=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {CHUNKS}, q AS (SELECT doc_id AS query_id, list_distinct(flatten(list(terms))) AS qt FROM chunks WHERE doc_id % 20 = 0 AND ordinal <= 2 GROUP BY 1),
p AS (SELECT chunk_id, unnest(terms) AS term FROM chunks), n AS (SELECT term, chunk_id, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT query_id, chunk_id, sum(n) * 0.4::DOUBLE AS r FROM (SELECT query_id, unnest(qt) AS term FROM q) JOIN n USING (term) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, r / (r + 1) AS score FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, place FROM k WHERE place <= 10""")
def keyword_batch(spark, d):
    """The title and first line of every document whose id is divisible by 20 are a query against all chunks."""
    at = tt.index(spark, d)
    asked = at.chunks.where("doc_id % 20 = 0 and ordinal <= 2").groupBy(F.col("doc_id").alias("query_id")).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return search.keyword_bounded(at.chunks, asked, 10).withColumn("score", F.round("score", 6))


UNSTEMMED = search.Filters(1, scope="ALL_LOCATIONS", languages=("de", "es", "fr"))
WORDS_SQL = f"""{CHUNKS}, split AS (SELECT chunk_id, terms[1:3] AS hw, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS cw
  FROM chunks WHERE organization_id = 1 AND is_active AND language IN ('de', 'es', 'fr')),
e AS (SELECT chunk_id, unnest(hw) AS word, generate_subscripts(hw, 1) AS pos, 1.0::DOUBLE AS w FROM split UNION ALL SELECT chunk_id, unnest(cw), len(hw) + generate_subscripts(cw, 1), 0.4::DOUBLE FROM split)"""
BEST_SQL = "SELECT chunk_id, round(s, 6) AS score FROM (SELECT chunk_id, round(r / (r + 1), 12) AS s FROM ranks ORDER BY s DESC, chunk_id LIMIT 50)"


def _lexical(spark, d, text, **how):
    """The stored positions of the query's words, in the tenant's chunks of languages that are not stemmed."""
    query_ = lexical.parse(text, english=False, **how)
    at = lexical.read(spark, tt.positions(spark, d), query_)
    return lexical.search(search.scoped(at, UNSTEMMED), query_, 50).withColumn("score", F.round("score", 6))


@query(f"""WITH {WORDS_SQL}, ranks AS (SELECT chunk_id, sum(2 / (1 / a.w + 1 / b.w)) AS r FROM e a JOIN e b USING (chunk_id) WHERE a.word = 'de' AND b.word = 'la' AND b.pos = a.pos + 1 GROUP BY 1) {BEST_SQL}""")
def lexical_phrase(spark, d):
    return _lexical(spark, d, '"de la"')


@query(f"""WITH {WORDS_SQL}, m AS (SELECT *, lag(word) OVER p AS word0, lag(pos) OVER p AS pos0, lag(w) OVER p AS w0 FROM e WHERE word IN ('de', 'que') AND chunk_id NOT IN (SELECT chunk_id FROM e WHERE word = 'der') WINDOW p AS (PARTITION BY chunk_id ORDER BY pos)),
ranks AS (SELECT chunk_id, sum(2 / (1 / w + 1 / w0) / (pos - pos0)) AS r FROM m WHERE word <> word0 GROUP BY 1) {BEST_SQL}""")
def lexical_all_terms_cd(spark, d):
    return _lexical(spark, d, "de que -der", relax=False)


@query(f"""WITH {WORDS_SQL}, ranks AS (SELECT chunk_id, sum(w) AS r FROM e WHERE word IN ('de', 'la') GROUP BY 1) {BEST_SQL}""")
def lexical_heading_weight(spark, d):
    """Relaxed: any of the words; every match counts its weight."""
    return _lexical(spark, d, "de la")


@query(f"""WITH {CHUNKS} SELECT chunk_id, document_id, version_number, organization_id, location_id, sha256(content) AS content_sha, CASE WHEN location_id IS NULL THEN 'ORGANIZATION' ELSE 'LOCATION' END AS scope,
  CASE WHEN len(terms) > 9 THEN 'vector,keyword' ELSE 'vector' END AS matched, language, round(1::DOUBLE / (1 + chunk_id % 97), 6) AS score, 'Guide > ' || ordinal AS breadcrumb FROM chunks""")
def hit_projection(spark, d):
    score = F.lit(1.0) / (1 + F.col("chunk_id") % 97)
    rows = tt.chunks(spark, d).withColumns({"score": score, "vector_score": score, "keyword_score": F.when(F.size("terms") > 9, score), "section_path": F.array(F.lit("Guide"), F.col("ordinal").cast("string"))})
    got = projections.api_hits(projections.hits(rows))
    return got.select("chunk_id", "document_id", "version_number", "organization_id", "location_id", F.sha2("content", 256).alias("content_sha"), "scope", F.array_join("matched", ",").alias("matched"), "language", "score", "breadcrumb")


@query(f"""WITH {CHUNKS} SELECT document_id AS query_id, chunk_id, 'S' || ordinal AS ref, CASE WHEN ordinal % 2 = 0 THEN 'pp.' || ordinal || '-' || (ordinal + 1) ELSE 'p.' || ordinal END AS locator, round(1::DOUBLE / (1 + chunk_id % 97), 4) AS score,
  sha256(substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 240)) AS snippet_sha FROM chunks""")
def citation_rows(spark, d):
    rows = tt.chunks(spark, d).select(
        F.col("document_id").alias("query_id"), "chunk_id", "document_id", "version_number", "location_id", "content", F.concat(F.lit("S"), F.col("ordinal").cast("string")).alias("ref"),
        F.lit("doc.md").alias("source_name"), F.col("ordinal").alias("page_from"), F.when(F.col("ordinal") % 2 == 0, F.col("ordinal") + 1).alias("page_to"), F.lit("h").alias("heading"), F.array(F.lit("h")).alias("section_path"), (F.lit(1.0) / (1 + F.col("chunk_id") % 97)).alias("score"),
    )
    c = projections.citations(rows)
    return c.select("query_id", "citation.chunk_id", "citation.ref", "citation.locator", "citation.score", F.sha2("citation.snippet", 256).alias("snippet_sha"))


@query(f"""WITH {CHUNKS}, k AS (SELECT DISTINCT document_id FROM chunks WHERE version_number = 2 AND document_id % 3 = 0),
now AS (SELECT c.* FROM chunks c LEFT JOIN k ON c.document_id = k.document_id WHERE CASE WHEN k.document_id IS NOT NULL THEN version_number = 2 ELSE version_number = 1 AND c.document_id % 7 <> 0 END)
SELECT document_id, version_number, count(*) AS n_chunks, count(*) FILTER (WHERE is_active AND document_id % 5 <> 0) AS n_active FROM now GROUP BY ALL""")
def segment_store(spark, d):
    """First versions in one commit; second versions of every third document put in and every seventh document deleted by the next; every fifth switched off
    by a third, which writes no row."""
    c = tt.chunks(spark, d).select("document_id", "version_number", "ordinal", "content", "is_active")
    table = segments.Segments(spark, f"{chunk_store.shared_folder(spark)}/segments-{uuid.uuid4().hex}", "document_id", c.schema, "is_active")
    first = table.commit(0, c.where("version_number = 1"))
    ids = tt.versions(spark, d).select("document_id").distinct()
    second = table.commit(first, c.where("version_number = 2 and document_id % 3 = 0"), delete=ids.where("document_id % 7 = 0"))
    table.commit(second, flags=ids.where("document_id % 5 = 0").withColumn("is_active", F.lit(False)))
    return table.read().groupBy("document_id", "version_number").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_active").alias("n_active"))


# --- look-ups ----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT chunk_id, document_id FROM chunks WHERE organization_id = 2 AND chunk_id % 3 = 0")
def chunk_multi_get(spark, d):
    """A third of all chunks is asked for; the tenant gets its own."""
    c = tt.chunks(spark, d)
    return catalog.chunks_by_ids(c, 2, c.where("chunk_id % 3 = 0").select("chunk_id")).select("chunk_id", "document_id")


@query(f"WITH {V}, o AS (SELECT document_id, organization_id, location_id FROM versions WHERE version_number = 1) SELECT document_id FROM o WHERE document_id % 5 <> 0 AND document_id % 2 = 0 AND location_id IS NOT DISTINCT FROM (CASE WHEN document_id % 4 = 0 THEN location_id END)")
def find_by_slug(spark, d):
    """Every other document is asked for by its slug, half of them as if they belonged to the organisation as a whole."""
    k = F.col("document_id")
    docs = tt.versions(spark, d).where("version_number = 1").select("document_id", "organization_id", "location_id", F.concat(F.lit("doc-"), k.cast("string")).alias("slug"), (k % 5 == 0).alias("is_deleted"))
    asked = docs.where(k % 2 == 0).withColumn("location_id", F.when(k % 4 == 0, F.col("location_id")))
    return catalog.by_slug(docs, asked).select("document_id")


def _jobs(spark, d):
    e = tt.read(spark, d, "events")
    return e.select(F.col("event_id").alias("job_id"), (F.col("user_id") % 4).alias("organization_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"))


@query("SELECT event_id AS job_id, user_id AS document_id FROM events WHERE user_id % 4 = 1 AND event_type = 'error'")
def job_list(spark, d):
    return catalog.jobs(_jobs(spark, d), 1, "FAILED").select("job_id", "document_id")


@query("SELECT n_nationkey AS location_id FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 <> 0")
def location_list(spark, d):
    n = tt.read(spark, d, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_regionkey").alias("organization_id"), "n_name", (F.col("n_nationkey") % 3 != 0).alias("is_active"))
    return catalog.locations(n, 1).select("location_id")


@query("SELECT event_id FROM events WHERE user_id % 4 = 2 AND event_type = 'signup'")
def audit_by_action(spark, d):
    e = tt.read(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("organization_id"), F.col("event_type").alias("action"))
    return catalog.audit(e, 2, "signup").select("event_id")


@query(f"WITH {USERS} SELECT user_id FROM users WHERE is_active AND user_id % 3 = 0")
def login_lookup(spark, d):
    u = _users(spark, d)
    asked = u.where("user_id % 3 = 0").select(F.concat(F.lit(" "), F.upper("email")).alias("email"))
    return catalog_login(u, asked).select("user_id")


def catalog_login(users, asked):
    return lifecycle.login(users.select("email", "organization_id"), users, asked)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n_pins, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_allowed FROM events""")
def organization_settings(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit('{"model_pins": '), F.when(e % 3 == 0, '{"answer": "p/m"}').otherwise('"none"'), F.lit(', "allowed_providers": '), F.when(e % 2 == 0, '["a", "b"]').otherwise("7"), F.lit("}"))
    rows = catalog.settings(tt.read(spark, d, "events").select("event_id", text.alias("settings")))
    return rows.select("event_id", F.size("model_pins").cast("long").alias("n_pins"), F.size("allowed_providers").cast("long").alias("n_allowed"))


# --- ingestion state -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT document_id, version_number, count(*) AS n_chunks FROM chunks WHERE NOT (version_number = 1 AND document_id % 3 = 0) GROUP BY ALL")
def delete_versions(spark, d):
    gone = tt.versions(spark, d).where("version_number = 1 and document_id % 3 = 0")
    return lifecycle.delete_versions(tt.chunks(spark, d), gone).groupBy("document_id", "version_number").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"WITH {CHUNKS} SELECT document_id, version_number, count(*) AS n_chunks, count(e.vec_id) AS n_embedded FROM chunks LEFT JOIN embeddings e ON e.vec_id = doc_id GROUP BY ALL")
def version_counts(spark, d):
    return lifecycle.version_counts(tt.chunks(spark, d).join(tt.vectors(spark, d), "doc_id", "left"))


@query("SELECT vec_id // 4 AS document_id, vec_id % 2 + 1 AS version_number, vec_id % 4 // 2 + 1 AS ordinal, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def zip_vectors(spark, d):
    e, k = tt.read(spark, d, "embeddings"), F.col("vec_id")
    rows = e.select(F.floor(k / 4).alias("document_id"), (k % 2 + 1).alias("version_number"), (F.floor(k % 4 / 2) + 1).alias("ordinal"), "embedding")
    got = lifecycle.zip_vectors(rows.drop("embedding").withColumn("content", F.lit("x")), rows)
    return got.select("document_id", "version_number", "ordinal", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


EVENTS = f"""ev AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'stage' END AS kind, {STAGE_SQL} AS stage FROM events)"""


def _job_events(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "click", "start").when(t == "purchase", "complete").when(t == "error", "fail").otherwise("stage")
    return tt.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), _stage().alias("stage"), F.concat(F.lit("no "), F.col("event_id").cast("string")).alias("message"), F.create_map(F.lit("last"), F.col("event_id").cast("string"), F.col("event_type"), F.lit("1")).alias("state"))


RANK_SQL = "list_position([" + ", ".join(f"'{s}'" for s in STAGES) + "], stage)"


@query(f"""WITH {EVENTS}, t AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY job_id ORDER BY seq) AS try FROM ev), n AS (SELECT *, max(try) OVER (PARTITION BY job_id) AS tries FROM t),
g AS (SELECT job_id, max(tries)::BIGINT AS attempts, arg_max(kind, seq) AS last, arg_max(stage, {RANK_SQL}) FILTER (WHERE try = tries AND stage IS NOT NULL) AS furthest, 'no ' || max(seq) FILTER (WHERE try = tries AND kind = 'fail') AS error, max(seq)::VARCHAR AS last_state, count(DISTINCT event_type) + 1 AS n_state
  FROM (SELECT n.*, event_type FROM n JOIN events ON event_id = seq) GROUP BY 1)
SELECT job_id, attempts, CASE last WHEN 'complete' THEN 'COMPLETED' WHEN 'fail' THEN 'FAILED' ELSE 'RUNNING' END AS status, CASE WHEN last = 'complete' THEN 'COMPLETED' ELSE furthest END AS stage, error, last_state, n_state FROM g""")
def job_lifecycle(spark, d):
    got = lifecycle.job_states(_job_events(spark, d))
    return got.select("job_id", "attempts", "status", "stage", "error", F.col("state")["last"].alias("last_state"), F.size("state").cast("long").alias("n_state"))


@query(f"WITH {EVENTS}, b AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM ev WHERE stage IS NOT NULL) SELECT job_id, seq, stage FROM b WHERE before IS NULL OR before <> stage")
def job_event_appends(spark, d):
    return lifecycle.stage_events(_job_events(spark, d).where("stage is not null")).select("job_id", "seq", "stage")


@query(f"""WITH {EVENTS}, s AS (SELECT job_id, arg_max(stage, {RANK_SQL}) AS stage FROM ev WHERE stage IS NOT NULL GROUP BY 1)
SELECT job_id, CASE WHEN {RANK_SQL} >= 5 AND job_id % 2 = 0 THEN stage ELSE 'PARSING' END AS resume_stage FROM s""")
def resume_stages(spark, d):
    now = jobs.progress(_job_events(spark, d)).withColumn("document_id", F.col("job_id"))
    return lifecycle.resume_from(now, now.where("job_id % 2 = 0").select("document_id")).select("job_id", "resume_stage")


@query(f"WITH {V} SELECT doc_id, CASE WHEN version_number = 1 AND status <> 'ACTIVE' THEN 'FAILED' ELSE status END AS status, CASE WHEN version_number = 1 AND status <> 'ACTIVE' THEN 2000 WHEN status = 'FAILED' THEN length('old ' || doc_id) END AS n_error FROM versions")
def mark_failed(spark, d):
    """Versions that failed before keep their errors."""
    v = tt.versions(spark, d).withColumn("error", F.when(F.col("status") == "FAILED", F.concat(F.lit("old "), F.col("doc_id").cast("string"))))
    got = lifecycle.mark_failed(v, v.where("version_number = 1").select("document_id", "version_number", F.repeat(F.lit("e"), 3000).alias("message")))
    return got.select("doc_id", "status", F.length("error").cast("long").alias("n_error"))


@query(f"""WITH {V}, files AS (SELECT s_suppkey AS file_id, 0 AS organization_id, 'doc-' || (s_suppkey * 2) AS slug FROM supplier UNION ALL SELECT s_suppkey + 1000000000, 0, 'doc-' || (s_suppkey * 2) FROM supplier),
o AS (SELECT document_id, 'doc-' || document_id AS slug FROM versions WHERE version_number = 1 AND organization_id = 0 AND location_id IS NULL), t AS (SELECT document_id, max(version_number) AS top FROM versions GROUP BY 1)
SELECT file_id, document_id, coalesce(top, 0) + row_number() OVER (PARTITION BY slug ORDER BY file_id) AS version_number, CASE WHEN document_id IS NULL THEN min(file_id) OVER (PARTITION BY slug) END AS new_document FROM files LEFT JOIN o USING (slug) LEFT JOIN t USING (document_id)""")
def upload_versions(spark, d):
    """Two files for each slug: known slugs get their document's next two versions, others a new document with versions 1 and 2."""
    docs = tt.versions(spark, d).where("version_number = 1").select("document_id", "organization_id", "location_id", F.concat(F.lit("doc-"), F.col("document_id").cast("string")).alias("slug"), F.lit(False).alias("is_deleted"))
    s = tt.read(spark, d, "supplier").select(F.explode(F.array("s_suppkey", F.col("s_suppkey") + 1000000000)).alias("file_id"), F.lit(0).cast("long").alias("organization_id"), F.lit(None).cast("long").alias("location_id"), F.concat(F.lit("doc-"), (F.col("s_suppkey") * 2).cast("string")).alias("slug"), F.col("s_name").alias("content"))
    return lifecycle.uploads(docs, tt.versions(spark, d), s)[1].select("file_id", "document_id", "version_number", "new_document")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 'no_space' WHEN vec_id % 4 = 2 THEN 'other_model' WHEN vec_id % 4 = 1 OR len(embedding) <> 64 THEN 'other_dimension' END AS refused FROM embeddings")
def embedding_space_guard(spark, d):
    spaces = spark.createDataFrame([(0, "m", 64, True), (1, "m", 32, True), (2, "n", 64, True), (3, "m", 64, False)], "organization_id long, model string, dimension int, is_current boolean")
    e = tt.read(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("organization_id"), "embedding")
    return lifecycle.space_guard(e, spaces, "m", 64).select("vec_id", "refused")


@query("""WITH s AS (SELECT s_nationkey AS organization_id, 'm' || s_suppkey % 3 AS model, 64 AS dimension, bool_or(s_suppkey % 2 = 0) AS is_current FROM supplier GROUP BY ALL), w AS (SELECT n_nationkey AS organization_id, CASE WHEN n_nationkey % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, 64 AS dimension FROM nation WHERE n_regionkey < 3)
SELECT coalesce(s.organization_id, w.organization_id) AS organization_id, coalesce(s.model, w.model) AS model, CASE WHEN w.model IS NOT NULL THEN true WHEN s.organization_id IN (SELECT organization_id FROM w) THEN false ELSE is_current END AS is_current FROM s FULL JOIN w ON s.organization_id = w.organization_id AND s.model = w.model""")
def ensure_spaces(spark, d):
    model = F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string"))
    s = tt.read(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("organization_id"), model.alias("model"), F.lit(64).alias("dimension")).agg(F.bool_or(F.col("s_suppkey") % 2 == 0).alias("is_current"))
    models = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("m1"), F.lit("m0"))).otherwise(F.array(F.lit("m1"), F.lit("m1")))  # two are wanted: the first by name is taken
    w = tt.read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("organization_id"), F.explode(models).alias("model"), F.lit(64).alias("dimension"))
    return lifecycle.ensure_spaces(s, w).select("organization_id", "model", "is_current")


@query(f"""WITH u AS (SELECT c_nationkey AS location_id, count(*) FILTER (WHERE c_acctbal > 9000) AS n FROM customer GROUP BY 1)
SELECT n_nationkey AS location_id, coalesce(n, 0) AS n_pinned, n_nationkey % 2 = 0 AND coalesce(n, 0) > 0 AS refused, NOT (n_nationkey % 2 = 0 AND coalesce(n, 0) = 0) AS is_active FROM nation LEFT JOIN u ON u.location_id = n_nationkey""")
def deactivate_locations(spark, d):
    places = tt.read(spark, d, "nation").select(F.col("n_nationkey").alias("location_id"), F.lit(True).alias("is_active"))
    users = tt.read(spark, d, "customer").select(F.col("c_nationkey").alias("location_id"), (F.col("c_acctbal") > 9000).alias("is_active"))
    return lifecycle.deactivate_locations(places, users, places.where("location_id % 2 = 0")).select("location_id", "n_pinned", "refused", "is_active")


@query("""WITH f AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n = 1)
SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'kept' ELSE substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) END AS title FROM f""")
def conversation_titles(spark, d):
    m = tt.read(spark, d, "conversations")
    known = m.where("conv_id % 5 = 0").select("conv_id", F.lit("kept").alias("title")).distinct()
    return lifecycle.conversations(m, known)


SETTLED = "settled AS (SELECT event_id AS job_id, event_id % 5 AS attempts, CASE event_id % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'retry' ELSE 'done' END AS outcome, event_type || repeat('x', 600) AS reason, ts AS ended, event_id % 9 = 0 AS reclaimed FROM events)"


def _settled(spark, d):
    e = F.col("event_id")
    return tt.read(spark, d, "events").select(e.alias("job_id"), (e % 5).alias("attempts"), F.when(e % 5 == 0, "dead").when(e % 5 == 1, "retry").otherwise("done").alias("outcome"), F.concat("event_type", F.repeat(F.lit("x"), 600)).alias("reason"), F.col("ts").alias("at"), (e % 9 == 0).alias("reclaimed"))


@query(f"WITH {SETTLED} SELECT job_id, substr(reason, 1, 500) AS reason, attempts AS delivery_count, ended::TIMESTAMP AS failed_at FROM settled WHERE outcome = 'dead'")
def dead_letters(spark, d):
    return lifecycle.dead_letters(_settled(spark, d))


@query(f"WITH {SETTLED} SELECT count(*) FILTER (WHERE outcome = 'done') AS processed, count(*) FILTER (WHERE outcome = 'retry') AS failed, count(*) FILTER (WHERE outcome = 'dead') AS dead, count(*) FILTER (WHERE reclaimed) AS reclaimed FROM settled")
def worker_counters(spark, d):
    return lifecycle.worker_counters(_settled(spark, d))


# --- tools -----------------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%A, %d %B %Y, %H:%M') AS said FROM events")
def current_datetime(spark, d):
    return tt.read(spark, d, "events").select("event_id", tools.local_time(F.col("ts").cast("timestamp"), F.lit("Asia/Tokyo")).alias("said"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'soon' ELSE strftime(ts::DATE, '%Y-%m-%d') END AS day FROM events)
SELECT event_id, CASE WHEN day = 'soon' THEN 'not_a_date' WHEN day::DATE < DATE '2024-01-09' THEN 'past' WHEN day::DATE > DATE '2025-01-09' THEN 'too_far' END AS error FROM s""")
def stay_errors(spark, d):
    day = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return tt.read(spark, d, "events").select("event_id", tools.stay_error(day, F.to_date(F.lit("2024-01-10"))).alias("error"))


@query("""WITH n AS (SELECT event_id AS stay_id, unnest(range(0, 1 + user_id % 4)) AS k, ts::DATE AS check_in FROM events), v AS (SELECT stay_id, check_in + k::INT AS night, (stay_id + k) % 7 AS available, 1000 + (stay_id * k) % 500 AS rate FROM n)
SELECT stay_id, min(available) AS available, sum(rate)::BIGINT AS total, min(night) FILTER (WHERE available = 0)::VARCHAR AS sold_out FROM v GROUP BY 1""")
def stay_availability(spark, d):
    stays = tt.read(spark, d, "events").select(F.col("event_id").alias("stay_id"), F.to_date("ts").alias("check_in"), (1 + F.col("user_id") % 4).cast("int").alias("n_nights"))
    each = tools.nights(stays).withColumn("k", F.datediff("night", "check_in"))
    each = each.withColumns({"available": ((F.col("stay_id") + F.col("k")) % 7).cast("long"), "rate": (1000 + (F.col("stay_id") * F.col("k")) % 500).cast("long")})
    return tools.availability(each).withColumn("sold_out", F.col("sold_out").cast("string"))


@query()
def simulated_house(spark, d):
    stays = tt.read(spark, d, "events").select(F.col("event_id").alias("stay_id"), (F.col("user_id") % 5).alias("location_id"), F.element_at(F.array(*(F.lit(r) for r in tools.ROOMS)), (F.col("user_id") % 3 + 1).cast("int")).alias("room_type"), F.to_date("ts").alias("check_in"), F.lit(2).alias("n_nights"))
    return tools.availability(tools.house(tools.nights(stays)))


@query("""WITH r AS (SELECT n_name AS c, 1.0371::DOUBLE + n_nationkey * 1.0137::DOUBLE AS p FROM nation) SELECT o_orderkey, round(o_totalprice / a.p * b.p, 4) AS converted FROM (SELECT *, o_orderkey % 25 AS f, o_custkey % 25 AS t FROM orders) o
LEFT JOIN (SELECT n_nationkey, p FROM r JOIN nation ON n_name = c) a ON a.n_nationkey = f LEFT JOIN (SELECT n_nationkey, p FROM r JOIN nation ON n_name = c) b ON b.n_nationkey = t""")
def currency_conversion(spark, d):
    n = tt.read(spark, d, "nation").select("n_nationkey", "n_name")
    names = [n.select(F.col("n_nationkey").alias(f"_{c}"), F.lower("n_name").alias(f"{c}_currency")) for c in ("f", "t")]
    o = tt.read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 25).alias("_f"), (F.col("o_custkey") % 25).alias("_t"))
    amounts = o.join(names[0], "_f").join(names[1], "_t").withColumnsRenamed({"f_currency": "from_currency", "t_currency": "to_currency"})
    rates = n.select(F.col("n_name").alias("currency"), (F.lit(1.0371) + F.col("n_nationkey") * F.lit(1.0137)).alias("per_base"))
    return tools.convert(amounts, rates).select("o_orderkey", F.round("converted", 4).alias("converted"))


@query("SELECT user_id AS trace_id, round(coalesce(sum(value) FILTER (WHERE event_id % 3 = 0), 0), 4) AS total_ms, count(*) AS n_spans FROM events GROUP BY 1")
def trace_totals(spark, d):
    e = tt.read(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("parent_id"), F.col("value").alias("duration_ms"))
    return tools.trace_totals(e).withColumn("total_ms", F.round("total_ms", 4))


@query("SELECT conv_id, sum(CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.5::DOUBLE)::BIGINT + 1 END + 4)::BIGINT AS tokens FROM conversations GROUP BY 1")
def message_tokens(spark, d):
    return tools.message_tokens(tt.read(spark, d, "conversations"))


@query(f"""WITH {CHUNKS}, b AS (SELECT document_id, version_number, arg_max(content, [(CASE WHEN length(content) = 0 THEN 0 ELSE floor(length(content) / 3.5::DOUBLE) + 1 END)::BIGINT, -ordinal]) AS c FROM chunks WHERE content <> '' GROUP BY ALL),
w AS (SELECT *, list_filter(string_split_regex(c, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 3)[1:6] AS ws FROM b) SELECT document_id, version_number, CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') END AS probe FROM w""")
def smoke_probes(spark, d):
    return tools.longest_chunks(tt.chunks(spark, d))


@query("SELECT conv_id, turn, conv_id % 3 = 0 AS only_refs FROM conversations")
def citation_only_answers(spark, d):
    t = F.when(F.col("conv_id") % 3 == 0, "[S1], [s2, S3].").otherwise(F.concat("text", F.lit(" so [S1]")))
    return tt.read(spark, d, "conversations").select("conv_id", "turn", tools.only_citations(t).alias("only_refs"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS tools, least(8, 0.5 * pow(2, event_id % 7))::DOUBLE AS cap FROM events")
def planned_tools(spark, d):
    return tt.read(spark, d, "events").select("event_id", F.array_join(tools.planned_tools(F.array("event_type", "event_type"), ["view", "click"]), ",").alias("tools"), tools.backoff_cap(F.col("event_id") % 7).alias("cap"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id AS job_id, event_id AS seq FROM n JOIN l USING (user_id) WHERE n <= 20 AND last >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS""")
def progress_retention(spark, d):
    events = tt.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    now = events.agg(F.max("at").alias("now"))  # one row
    rows = events.join(F.broadcast(now))
    return lifecycle.retained_feed(rows, F.col("now"), 20, 86400).select("job_id", "seq")


@query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def queue_trim(spark, d):
    return lifecycle.trimmed_queue(tt.read(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 1000)
