"""Model choice, cost, planning and admission: filters and an argmin by compound keys over a small catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.functions import text as tx
from tesserae.settings import CHEAP_TASKS, HIGH_STAKES, TIERS, Context


@dataclass(frozen=True)
class Request:
    task: str = "answer"
    prompt_tokens: int = 0
    needs_tools: bool = False
    needs_json: bool = False
    needs_streaming: bool = False
    require_local: bool = False
    document_types: tuple = ()
    allowed_providers: tuple = ()
    prefer_model: str | None = None
    pins: dict = field(default_factory=dict)


def blended_cost() -> Column:
    return (3 * F.col("cost_in") + F.col("cost_out")) / 4


def tier_rank() -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))


def named(want: str | None) -> Column:
    """Whether a model is the one that is asked for, as provider/name or as name alone."""
    if not want:
        return F.lit(False)
    return F.concat_ws("/", "provider", "name") == want if "/" in want else F.col("name") == want


def candidates(catalog: DataFrame, r: Request, utilization: float = Context().utilization) -> DataFrame:
    """Models that can serve the request, with _fits: whether their window holds the prompt."""
    ok = F.col("is_available")
    if r.allowed_providers:
        ok &= F.col("provider").isin(*r.allowed_providers)
    for need, cond in ((r.require_local, F.col("privacy") == "local"), (r.needs_tools, F.col("supports_tools")), (r.needs_json, F.col("supports_json")), (r.needs_streaming, F.col("supports_streaming"))):
        if need:
            ok &= cond
    return catalog.where(ok).withColumn("_fits", F.lit(r.prompt_tokens) <= F.col("context_window") * utilization)


def route(catalog: DataFrame, r: Request, utilization: float = Context().utilization) -> DataFrame:
    """One row: provider, name, rule, fallbacks, compaction_required; none if no model can serve the request. If no model has the window,
    the window is not asked for. Rules, first match wins: the organisation's pin, the caller's wish, the smallest model for tools, the
    fast tier for cheap tasks, the quality tier for high stakes, the balanced tier, any. Within a tier the cheapest, at equal cost a local one.
    Fallbacks: the first three other candidates in catalogue order. All of it is one plan: no job runs while it is built."""
    tier, cost, remote = tier_rank(), blended_cost(), (F.col("privacy") != "local").cast("int")
    marks = {"pin": named(r.pins.get(r.task) or r.pins.get("*")), "wish": named(r.prefer_model), **{t: F.col("tier") == t for t in TIERS}}
    rows = candidates(catalog, r, utilization).withColumns({f"_{k}": F.coalesce(m, F.lit(False)) for k, m in marks.items()})
    # one row: whether any model fits, and which marks the models have that then count
    any_fits = F.coalesce(F.bool_or("_fits"), F.lit(False))
    has = rows.agg(any_fits.alias("_any"), *(F.coalesce(F.when(any_fits, F.bool_or(F.col(f"_{k}") & F.col("_fits"))).otherwise(F.bool_or(f"_{k}")), F.lit(False)).alias(f"_has_{k}") for k in marks))
    pool = rows.join(F.broadcast(has)).where(F.col("_fits") | ~F.col("_any"))
    preferred = "fast" if r.task in CHEAP_TASKS else "quality" if r.task == "answer" and set(r.document_types) & set(HIGH_STAKES) else "balanced"
    default = F.lit({"fast": "cheap_task", "quality": "high_stakes"}.get(preferred)) if preferred != "balanced" else F.when(F.col("_has_balanced"), "default_balanced").otherwise("default_any")
    rule = F.when(F.col("_has_pin"), "org_pin").when(F.col("_has_wish"), "caller_preference").otherwise(F.lit("tool_capable") if r.needs_tools else default)
    # three keys to be minimised
    if r.needs_tools:
        keys = [tier, cost, F.lit(0)]
    else:
        there, want = F.col(f"_has_{preferred}"), F.col("tier") == preferred
        other = [cost, tier] if preferred == "fast" else [-tier, cost]
        keys = [(there & ~want).cast("int"), F.when(there, cost).otherwise(other[0]), F.when(there, remote).otherwise(other[1])]
    asked = F.when(F.col("_has_pin"), ~F.col("_pin")).when(F.col("_has_wish"), ~F.col("_wish")).otherwise(F.lit(False))
    free = ~F.col("_has_pin") & ~F.col("_has_wish")
    best = pool.orderBy(asked, *(F.when(free, k.cast("double")) for k in keys), "position").limit(1)
    key = F.concat_ws("/", "provider", "name")
    first = pool.orderBy("position").limit(4).agg(F.sort_array(F.collect_list(F.struct("position", key.alias("key")))).alias("_first"))
    others = F.slice(F.filter(F.transform("_first", lambda x: x["key"]), lambda k: k != key), 1, 3)
    return best.join(F.broadcast(first)).select("provider", "name", rule.alias("rule"), others.alias("fallbacks"), (F.lit(r.prompt_tokens) > F.col("context_window") * utilization).alias("compaction_required"))


def usage_cost(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    joined = usage.join(catalog.select("provider", "name", "cost_in", "cost_out"), ["provider", "name"], "left")
    cost = (F.col("tokens_in") * F.coalesce("cost_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("cost_out", F.lit(0.0))) / 1e6
    return joined.groupBy("provider", "name").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cost).alias("cost"))


def calibrate(ratios: Column, alpha: float = 0.3) -> Column:
    """Exponential mean of an ordered array of measured ratios, starting at 1; those outside 0.25 to 4 don't count."""
    good = F.filter(ratios, lambda r: (r >= 0.25) & (r <= 4.0))
    return F.aggregate(good, F.lit(1.0), lambda s, r: s * (1 - alpha) + r * alpha)


def calibrated(measured: DataFrame, key: str, order: list[str], alpha: float = 0.3) -> DataFrame:
    """The same over rows (key, order..., ratio): a weighted sum with a ratio's weight falling with its place from the end. The rows of a
    key are summed, not gathered; a key without usable ratios keeps 1."""
    good = F.col("ratio").between(0.25, 4.0)
    back = F.row_number().over(W.partitionBy(key, good).orderBy(*(F.desc(c) for c in order)))
    rows = measured.withColumns({"_back": back, "_good": F.coalesce(good, F.lit(False))})
    part = F.when(F.col("_good"), F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("_back") - 1) * F.col("ratio"))
    return rows.groupBy(key).agg((F.coalesce(F.sum(part), F.lit(0.0)) + F.pow(F.lit(1 - alpha), F.count_if("_good"))).alias("ratio"))


def context_budget(window: Column, prompt: Column, c: Context = Context()) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(c.budget_tokens), F.floor(window * c.utilization) - prompt - c.reserve_tokens)).cast("long")


def admit(queries: DataFrame, max_chars: int = 4000) -> DataFrame:
    """verdict (ok, empty, too_long), the flagged patterns, and the query without them."""
    q = F.trim(F.coalesce("query", F.lit("")))
    verdict = F.when(q == "", "empty").when(F.length(q) > max_chars, "too_long").otherwise("ok")
    return queries.withColumns({"verdict": verdict, "flags": tx.injection_flags(q), "clean": tx.screened(q)})


def rate_windows(requests: DataFrame, limit: int) -> DataFrame:
    """Requests by caller and minute, and how many of them a limit turns away; a limit of 0 or less turns none away."""
    n = requests.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n_requests"))
    return n.withColumn("n_rejected", F.greatest(F.lit(0), F.col("n_requests") - limit) if limit > 0 else F.lit(0)).withColumn("n_rejected", F.col("n_rejected").cast("long"))


def visible_tools(tools: DataFrame, scopes: list[str]) -> DataFrame:
    return tools.where(F.col("enabled") & (F.size(F.array_except("scopes", F.array(*(F.lit(s) for s in scopes)).cast("array<string>"))) == 0))


def plan(queries: Column, raw: Column, most: int = 3) -> Column:
    """At most three distinct non-empty rewrites; the raw query if there is none."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q != "")), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(raw))
