"""What ingestion writes: chunks of a version, jobs and their events, versions, uploads, embedding spaces, conversations, dead letters.

Every operator is a function from tables to tables; the caller writes the result to a new snapshot (sources.snapshots). Batches of
many documents or jobs go through one plan. Keys that are null match nothing and are never merged; rows equal in all columns that
order them are ordered by what is left, so results don't depend on the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.operators.versions import upsert
from tesserae.settings import STAGES

VERSION = ["document_id", "version_number"]


def _stop(cond: Column, message: Column, value: Column) -> Column:
    """value, unless cond holds: then the job stops with the message."""
    return F.when(cond, F.raise_error(message).cast("string").isNull().cast("long")).otherwise(value)


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STAGES)), stage)


# --- chunks ------------------------------------------------------------------------------------------------------------------


def delete_versions(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks left when those of the versions in gone (document_id, version_number) are deleted."""
    return chunks.join(gone.select(*VERSION).distinct(), VERSION, "left_anti")


def version_counts(chunks: DataFrame) -> DataFrame:
    """n_chunks of each version, and how many of them have a vector."""
    return chunks.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("n_chunks"), F.count("embedding").alias("n_embedded"))


def zip_vectors(drafts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Drafts with their vectors, by version and ordinal. A draft without a vector, or a vector without a draft, stops the job."""
    key = [*VERSION, "ordinal"]
    d, v = drafts.withColumn("_d", F.lit(1)), vectors.select(*key, "embedding").withColumn("_v", F.lit(1))
    both = d.join(v, key, "full")
    missing = F.col("_d").isNull() | F.col("_v").isNull()
    say = F.concat(F.lit("drafts and vectors differ in version "), F.concat_ws("/", *(F.col(k).cast("string") for k in key)))
    return both.withColumn("ordinal", _stop(missing, say, F.col("ordinal"))).drop("_d", "_v")


def rewrite_versions(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks after some versions are written again: all their old chunks go, so no surplus stays."""
    return delete_versions(chunks, new).unionByName(new.select(*chunks.columns))


# --- jobs --------------------------------------------------------------------------------------------------------------------

def job_states(events: DataFrame) -> DataFrame:
    """A job's row from its events (job_id, seq, kind, stage, message, state): kinds are create, start, stage, complete, fail.

    attempts counts the starts; stage is the furthest since the last start; status is QUEUED, RUNNING, COMPLETED or FAILED after the
    last event; error is the last failure's message, cut at 2000 characters, null once the job has started again. state is the union of
    the maps in order, later values winning."""
    by = W.partitionBy("job_id").orderBy("seq", "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("_try", F.sum((F.col("kind") == "start").cast("long")).over(by))
    last_try = F.max("_try").over(W.partitionBy("job_id"))
    rows = rows.withColumn("_now", F.col("_try") == last_try)
    status = F.create_map(*(F.lit(x) for x in ("create", "QUEUED", "start", "RUNNING", "stage", "RUNNING", "complete", "COMPLETED", "fail", "FAILED")))
    order = F.struct("seq", "kind")
    furthest = F.max(F.when(F.col("_now") & (stage_rank(F.col("stage")) > 0), F.struct(stage_rank(F.col("stage")).alias("r"), "stage")))
    error = F.max_by(F.substring("message", 1, 2000), F.when(F.col("_now") & (F.col("kind") == "fail"), order))
    out = rows.groupBy("job_id").agg(F.max("_try").alias("attempts"), F.max_by(status[F.col("kind")], order).alias("status"), furthest.alias("_f"), error.alias("error"), merged_state("state", order).alias("state"))
    return out.withColumn("stage", F.when(F.col("status") == "COMPLETED", "COMPLETED").otherwise(F.col("_f.stage"))).drop("_f")


def merged_state(state: str, order: Column) -> Column:
    """The union of a group's maps in order, later values winning."""
    entries = F.array_sort(F.collect_list(F.when(F.col(state).isNotNull(), F.struct(order.alias("o"), F.map_entries(state).alias("e")))))
    flat = F.flatten(F.transform(entries, lambda x: x["e"]))
    keys = F.array_distinct(F.transform(flat, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(flat, lambda e: e["key"] == k), -1)))


def stage_events(events: DataFrame) -> DataFrame:
    """The rows to append to the event log: one for each change of a job's stage (job_id, seq, stage, progress)."""
    before = F.lag("stage").over(W.partitionBy("job_id").orderBy("seq"))
    done = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    changed = events.withColumn("_b", before).where("_b is null or _b <> stage")
    return changed.select("job_id", "seq", "stage", F.try_element_at(done, F.col("stage")).alias("progress"))


def resume_from(jobs: DataFrame, kept_text: DataFrame) -> DataFrame:
    """Where a job goes on after a crash: at its own stage if it had reached CHUNKING and its text is kept, else at PARSING."""
    texts = kept_text.select("document_id", F.lit(True).alias("_kept")).distinct()
    resumed = (stage_rank(F.col("stage")) >= stage_rank(F.lit("CHUNKING"))) & F.col("_kept")
    return jobs.join(texts, "document_id", "left").withColumn("resume_stage", F.when(resumed, F.col("stage")).otherwise("PARSING")).drop("_kept")


def dead_letters(failed: DataFrame) -> DataFrame:
    """The dead-letter rows of settled deliveries (job_id, attempts, outcome, reason, at): reason cut at 500 characters."""
    return failed.where("outcome = 'dead'").select("job_id", F.substring(F.coalesce("reason", F.lit("")), 1, 500).alias("reason"), F.col("attempts").alias("delivery_count"), F.col("at").alias("failed_at"))


def retained_feed(events: DataFrame, now: Column, maxlen: int = 500, ttl_seconds: int = 3600) -> DataFrame:
    """Of progress events (job_id, seq, at): each job's newest maxlen, unless its last one is older than the time to live, when all of its feed is gone.
    The cut comes first, within each task already, so that no job sends more than maxlen rows on."""
    job = W.partitionBy("job_id")
    newest = events.withColumn("_n", F.row_number().over(job.orderBy(F.desc("at"), F.desc("seq")))).where(F.col("_n") <= maxlen)
    last = newest.withColumn("_last", F.max("at").over(job))
    return last.where(F.col("_last") >= now - F.expr(f"interval {int(ttl_seconds)} seconds")).drop("_n", "_last")


def trimmed_queue(messages: DataFrame, maxlen: int = 100_000) -> DataFrame:
    """The newest maxlen messages (seq, ...) of a queue."""
    return messages.orderBy(F.desc("seq")).limit(maxlen)


def worker_counters(settled: DataFrame) -> DataFrame:
    """processed, failed and dead over settled deliveries, and how many were reclaimed from another worker."""
    return settled.agg(F.count_if(F.col("outcome") == "done").alias("processed"), F.count_if(F.col("outcome") == "retry").alias("failed"), F.count_if(F.col("outcome") == "dead").alias("dead"), F.count_if("reclaimed").alias("reclaimed"))


# --- versions and uploads ------------------------------------------------------------------------------------------------------


def mark_failed(versions: DataFrame, failures: DataFrame) -> DataFrame:
    """Versions in failures (document_id, version_number, message) are FAILED with the message cut at 2000; an ACTIVE version never is. The errors of
    all others stay as they are."""
    why = failures.groupBy(*VERSION).agg(F.min(F.substring("message", 1, 2000)).alias("_why"))
    hit = F.col("_why").isNotNull() & (F.col("status") != "ACTIVE")
    return versions.join(why, VERSION, "left").withColumns({"status": F.when(hit, "FAILED").otherwise(F.col("status")), "error": F.when(hit, F.col("_why")).otherwise(F.col("error") if "error" in versions.columns else F.lit(None))}).drop("_why")


def uploads(documents: DataFrame, versions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents and new versions for uploaded files (organization_id, location_id, slug, file_id, content).

    A file whose slug names a live document of the same owner becomes its next version; other slugs become documents of one new row each.
    Files of one slug are numbered by file_id. New documents are identified by the smallest file_id. Versions carry the file's SHA-256."""
    owner = ["organization_id", "location_id", "slug"]
    live = documents.where("not is_deleted").select(*(F.col(c).alias(f"_{c}") for c in owner), "document_id")
    same = (F.col("slug") == F.col("_slug")) & (F.col("organization_id") == F.col("_organization_id")) & F.col("location_id").eqNullSafe(F.col("_location_id"))
    found = files.join(live, same, "left").drop("_organization_id", "_location_id", "_slug")
    top = versions.groupBy("document_id").agg(F.max("version_number").alias("_top"))
    by = W.partitionBy(*owner).orderBy("file_id")
    rows = found.join(top, "document_id", "left").withColumn("_n", F.row_number().over(by))
    new_version = rows.select(*owner, "document_id", "file_id", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long").alias("version_number"), F.lit("PROCESSING").alias("status"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    first = F.min("file_id").over(W.partitionBy(*owner))
    new_version = new_version.withColumn("new_document", F.when(F.col("document_id").isNull(), first))
    return new_version.where("new_document = file_id").select(*owner, "new_document"), new_version


def refuse_duplicates(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with new rows appended. A key that is there already, or twice among the new rows, stops the job."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    held = old.select(*keys, F.lit(1).alias("_held")).distinct()
    rows = new.withColumn("_n", n).join(held, keys, "left")
    say = F.concat(F.lit("taken: "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    clash = (F.col("_n") > 1) | F.col("_held").isNotNull()
    rows = rows.where(F.when(clash, F.raise_error(say).isNull()).otherwise(F.lit(True)))
    return old.unionByName(rows.select(*old.columns))


# --- embedding spaces ------------------------------------------------------------------------------------------------------------


def ensure_spaces(spaces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Spaces (organization_id, model, dimension, is_current) after each organisation in wanted has its space: it is found or made, and is the
    only current one; the others of that organisation are demoted. Of several wanted for one organisation the smallest (model, dimension) is taken."""
    one = wanted.groupBy("organization_id").agg(F.min(F.struct("model", "dimension")).alias("_w")).select("organization_id", "_w.*")
    ask = one.select("organization_id", F.col("model").alias("_m"), F.col("dimension").alias("_d"))
    demoted = spaces.join(ask, "organization_id", "left").withColumn("is_current", F.when(F.col("_m").isNull(), F.col("is_current")).otherwise((F.col("model") == F.col("_m")) & (F.col("dimension") == F.col("_d")))).drop("_m", "_d")
    return upsert(demoted.select("organization_id", "model", "dimension", "is_current"), one.withColumn("is_current", F.lit(True)), ("organization_id", "model", "dimension"), ("is_current",))


def space_guard(vectors: DataFrame, spaces: DataFrame, model: str, column_dimension: int) -> DataFrame:
    """Why a vector may not be written, for each (organization_id, vec_id, embedding): no_space, other_model, other_dimension (the
    space's, the column's and the vector's must be one), or null where it may."""
    current = spaces.where("is_current").select("organization_id", F.col("model").alias("_m"), F.col("dimension").alias("_d"))
    n = F.size("embedding")
    why = F.when(F.col("_m").isNull(), "no_space").when(F.col("_m") != model, "other_model").when((F.col("_d") != column_dimension) | (n != column_dimension), "other_dimension")
    return vectors.join(current, "organization_id", "left").withColumn("refused", why).drop("_m", "_d")


# --- people, places, conversations -------------------------------------------------------------------------------------------------


def deactivate_locations(locations: DataFrame, users: DataFrame, ids: DataFrame) -> DataFrame:
    """Locations after those in ids are switched off, and refused where active users are pinned to them (n_pinned says how many)."""
    pinned = users.where("is_active and location_id is not null").groupBy("location_id").agg(F.count(F.lit(1)).alias("n_pinned"))
    asked = ids.select("location_id", F.lit(True).alias("_ask")).distinct()
    rows = locations.join(asked, "location_id", "left").join(pinned, "location_id", "left")
    n, ask = F.coalesce("n_pinned", F.lit(0)), F.coalesce("_ask", F.lit(False))
    return rows.withColumns({"n_pinned": n, "is_active": F.when(ask & (n == 0), F.lit(False)).otherwise(F.col("is_active")), "refused": ask & (n > 0)}).drop("_ask")


def conversations(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """conv_id and title of the conversations that messages (conv_id, turn, role, text) begin: the first message, white space single, cut at 300
    characters. Those in known stay as they are."""
    title = F.substring(F.trim(F.regexp_replace(F.coalesce("_t", F.lit("")), r"\s+", " ")), 1, 300)
    first = messages.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "role", "text")).alias("_t")).select("conv_id", title.alias("title"))
    return first if known is None else known.select("conv_id", "title").unionByName(first.join(known, "conv_id", "left_anti"))


def login(directory: DataFrame, users: DataFrame, asked: DataFrame) -> DataFrame:
    """The active users that log in by the asked emails: the directory names the organisation, the user is looked up within it."""
    who = asked.select(F.lower(F.trim("email")).alias("email")).distinct().join(directory.select("email", "organization_id"), "email")
    return users.where("is_active").join(who, ["organization_id", "email"], "left_semi")
