"""Listings, counts, look-ups and appends over the tenant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tenant(df: DataFrame, organization_id) -> DataFrame:
    """Default deny: no tenant, no rows."""
    return df.limit(0) if organization_id is None else df.where(F.col("organization_id") == organization_id)


def write_check(df: DataFrame, organization_id) -> DataFrame:
    """Rows of another tenant stop the write."""
    ok = F.col("organization_id").eqNullSafe(F.lit(organization_id))
    return df.withColumn("organization_id", F.when(ok, F.col("organization_id")).otherwise(F.raise_error(F.lit("row of another tenant")).cast("long")))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the total and whether more follow: a count and a TakeOrdered, no window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    got = df.orderBy(*order).offset(offset).limit(limit)
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))  # of a page
    return got.join(F.broadcast(total)).withColumn("has_more", F.lit(offset) + n < F.col("total"))


def documents(versions: DataFrame, location_id=None, language: str | None = None, include_deleted: bool = False) -> DataFrame:
    out = versions
    if "is_deleted" in versions.columns and not include_deleted:
        out = out.where(~F.col("is_deleted"))
    if location_id is not None:
        out = out.where(F.col("location_id").isNull() | (F.col("location_id") == location_id))
    return out.where(F.col("language") == language) if language else out


def with_versions(versions: DataFrame) -> DataFrame:
    """A row a document: its versions from the newest, and the active one's number."""
    v = F.array_sort(F.collect_list(F.struct("version_number", "status")), lambda a, b: (b["version_number"] - a["version_number"]).cast("int"))
    return versions.groupBy("document_id").agg(v.alias("versions"), F.max(F.when(F.col("status") == "ACTIVE", F.col("version_number"))).alias("active_version"))


def search_users(users: DataFrame, q: str | None = None, role: str | None = None, active: bool | None = None) -> DataFrame:
    out = users
    if q:
        like = "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        out = out.where(F.col("email").ilike(like) | F.col("name").ilike(like))
    if role:
        out = out.where(F.col("role") == role)
    return out if active is None else out.where(F.col("is_active") == active)


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, oldest first by turn_no."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return messages.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def guarded_admins(users: DataFrame, disable: DataFrame) -> DataFrame:
    """Of the users to be disabled, those who may be: not the last active admins of their organisation."""
    left = users.join(disable, "user_id", "left_anti").where("role = 'admin' and is_active").select("organization_id").distinct()
    asked = users.join(disable, "user_id", "left_semi")
    return asked.where("role <> 'admin'").unionByName(asked.where("role = 'admin'").join(left, "organization_id", "left_semi"))


def existing(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def partial_update(df: DataFrame, cond: Column, changes: dict, allowed: tuple) -> DataFrame:
    """Only listed fields; a field that is present with None is set to null, an absent one stays."""
    if unknown := set(changes) - set(allowed):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.when(cond, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in changes.items()})


def history_then_live(history: DataFrame, live: DataFrame, cursor: int) -> DataFrame:
    """A replay up to the cursor and what came after it: nothing twice, nothing lost."""
    return history.where(F.col("seq") <= cursor).unionByName(live.where(F.col("seq") > cursor))


def trimmed_audit(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"user_agent": F.substring("user_agent", 1, 256), "message": F.substring("message", 1, 1000)})


class NotFound(KeyError):
    """No such row, or one of another tenant: a caller can't tell which."""


def require(df: DataFrame, organization_id, **key) -> DataFrame:
    """The rows of one key within the tenant; NotFound if there are none. A row of another tenant counts as none."""
    rows = tenant(df, organization_id)
    for name, value in key.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    if rows.isEmpty():
        raise NotFound(tuple(key.values()))
    return rows


def chunks_by_ids(chunks: DataFrame, organization_id, ids: DataFrame) -> DataFrame:
    """The chunks of ids (chunk_id) that belong to the tenant; no ids, no rows."""
    return tenant(chunks, organization_id).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def section(chunks: DataFrame, organization_id, document_id, section_key, active_only: bool = True) -> DataFrame:
    """A section's chunks in order."""
    rows = tenant(chunks, organization_id).where((F.col("document_id") == document_id) & (F.col("section_key") == section_key))
    return (rows.where("is_active") if active_only else rows).orderBy("ordinal")


def by_slug(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Live documents of asked (organization_id, location_id, slug); a null location is a value of its own."""
    d, a = documents.where("not is_deleted").alias("d"), asked.select("organization_id", "location_id", "slug").distinct().alias("a")
    same = (F.col("d.organization_id") == F.col("a.organization_id")) & (F.col("d.slug") == F.col("a.slug")) & F.col("d.location_id").eqNullSafe(F.col("a.location_id"))
    return d.join(a, same, "left_semi")


def active_version(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'ACTIVE'")


def jobs(rows: DataFrame, organization_id, status: str | None = None, document_id=None) -> DataFrame:
    """A tenant's jobs, of one status and one document where asked."""
    out = tenant(rows, organization_id)
    out = out if status is None else out.where(F.col("status") == status)
    return out if document_id is None else out.where(F.col("document_id") == document_id)


def locations(rows: DataFrame, organization_id, pinned=None) -> DataFrame:
    """Active locations by name; a caller who is pinned to one sees that alone."""
    out = tenant(rows, organization_id).where("is_active")
    return out if pinned is None else out.where(F.col("location_id") == pinned)


def public_organizations(rows: DataFrame) -> DataFrame:
    """What anyone may read of organisations: three columns of those active and public."""
    return rows.where("is_active and is_public").select("organization_id", "name", "slug")


def visible_organizations(rows: DataFrame, organization_id=None, platform: bool = False) -> DataFrame:
    """A platform operator sees all organisations, anyone else their own, and nobody's caller none."""
    return rows if platform else tenant(rows, organization_id)


def audit(rows: DataFrame, organization_id, action: str | None = None) -> DataFrame:
    out = tenant(rows, organization_id)
    return out if action is None else out.where(F.col("action") == action)


def narrowed(pinned, asked):
    """The location a caller works in: one pinned to a location can't move, others go where they ask."""
    if pinned is not None and asked is not None and asked != pinned:
        raise PermissionError("the caller is pinned to another location")
    return pinned if pinned is not None else asked


def settings(rows: DataFrame, column: str = "settings") -> DataFrame:
    """Pins (map) and allowed providers (array) of organisations' JSON settings; what isn't of the right type counts as absent."""
    text = lambda path: F.get_json_object(column, path)
    pins = F.when(F.substring(F.trim(text("$.model_pins")), 1, 1) == "{", F.from_json(text("$.model_pins"), "map<string,string>"))
    allowed = F.when(F.substring(F.trim(text("$.allowed_providers")), 1, 1) == "[", F.from_json(text("$.allowed_providers"), "array<string>"))
    return rows.withColumns({"model_pins": F.coalesce(pins, F.create_map().cast("map<string,string>")), "allowed_providers": F.coalesce(allowed, F.array().cast("array<string>"))})
