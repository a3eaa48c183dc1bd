"""Small tools over tables: dates, stays, currencies, traces, probes and messages."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as tx

# Rooms of each type in a simulated house, their base rates, and how far ahead a stay may begin.
ROOMS = {"standard": (40, 24000), "deluxe": (16, 38000), "suite": (6, 72000)}
HORIZON_DAYS = 365


def local_time(at: Column, zone: Column) -> Column:
    """A UTC time as a guest reads it there: Monday, 01 January 2024, 09:30."""
    return F.date_format(F.from_utc_timestamp(at, zone), "EEEE, dd MMMM yyyy, HH:mm")


def stay_error(check_in: Column, today: Column) -> Column:
    """Why a stay can't begin on that day (yyyy-MM-dd): not_a_date, past, too_far; null if it can. Yesterday still counts, for other time zones."""
    day = F.try_to_date(F.trim(check_in), "yyyy-MM-dd")
    return F.when(day.isNull(), "not_a_date").when(day < F.date_sub(today, 1), "past").when(day > F.date_add(today, HORIZON_DAYS), "too_far")


def nights(stays: DataFrame) -> DataFrame:
    """A row for each night of stays (stay_id, location_id, room_type, check_in date, n_nights)."""
    days = F.sequence(F.col("check_in"), F.date_add("check_in", F.col("n_nights") - 1))
    return stays.where("n_nights > 0").withColumn("night", F.explode(days))


def house_bytes(location: pd.Series, night: pd.Series, room: pd.Series) -> pd.Series:
    """The two bytes that stand for a house's occupancy and rate on a night."""
    keys = zip(location, night, room, strict=True)
    return pd.Series([list(hashlib.blake2b(f"{a}:{b}:{c}".encode(), digest_size=8).digest()[:2]) for a, b, c in keys])


def house(each: DataFrame) -> DataFrame:
    """Nights with available rooms and rate of a simulated house, the same for the same place, night and room type."""
    draw = F.pandas_udf(house_bytes, "array<int>")(F.col("location_id").cast("string"), F.col("night").cast("string"), F.col("room_type"))
    value = lambda i: F.create_map(*(F.lit(x) for k, v in ROOMS.items() for x in (k, v[i])))[F.col("room_type")]
    late = F.weekday("night") >= 4
    full = 0.45 + F.col("_b")[0] / 255 * 0.5
    occupancy = F.when(late, F.least(F.lit(0.98), full + 0.18)).otherwise(full)
    rate = F.floor(value(1) * F.when(late, 1.25).otherwise(1.0) * (1 + F.col("_b")[1] / 255 * 0.15))
    rows = each.withColumn("_b", draw)
    return rows.withColumns({"available": F.greatest(F.lit(0), F.floor(value(0) * (1 - occupancy))).cast("long"), "rate": (rate - rate % 100).cast("long")}).drop("_b")


def availability(each: DataFrame) -> DataFrame:
    """A row for each stay over its nights (stay_id, night, available, rate): the rooms free all nights, the price, the first night sold out."""
    return each.groupBy("stay_id").agg(F.min("available").alias("available"), F.sum("rate").alias("total"), F.min(F.when(F.col("available") == 0, F.col("night"))).alias("sold_out"))


def convert(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts (amount, from_currency, to_currency) with converted, by rates (currency, per_base) to a common base; null for unknown currencies."""
    a, b = (rates.select(F.upper("currency").alias(f"{c}_currency"), F.col("per_base").alias(f"_{c}")) for c in ("from", "to"))
    rows = amounts.withColumns({c: F.upper(F.trim(c)) for c in ("from_currency", "to_currency")})
    return rows.join(a, "from_currency", "left").join(b, "to_currency", "left").withColumn("converted", F.col("amount") / F.nullif(F.col("_from"), F.lit(0.0)) * F.col("_to")).drop("_from", "_to")


def trace_totals(spans: DataFrame) -> DataFrame:
    """trace_id, total_ms over root spans (those without a parent), n_spans."""
    return spans.groupBy("trace_id").agg(F.coalesce(F.sum(F.when(F.col("parent_id").isNull(), F.col("duration_ms"))), F.lit(0.0)).alias("total_ms"), F.count(F.lit(1)).alias("n_spans"))


def probe_text(content: Column, words: int = 6) -> Column:
    """The first words of over three letters of a chunk's body, without the path that stands before it; null if there are none."""
    body = F.element_at(F.split(content, "\n\n", 2), -1)
    kept = F.slice(F.filter(tx.words(body), lambda w: F.length(w) > 3), 1, words)
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def longest_chunks(chunks: DataFrame) -> DataFrame:
    """Of each version the chunk of most tokens, of equal ones the first, that isn't empty: its probe text."""
    t = tx.token_estimate(F.col("content"))
    best = chunks.where("content <> ''").groupBy("document_id", "version_number").agg(F.max_by("content", F.struct(t, -F.col("ordinal"))).alias("content"))
    return best.select("document_id", "version_number", probe_text(F.col("content")).alias("probe"))


def message_tokens(messages: DataFrame) -> DataFrame:
    """Tokens of each conversation's messages: 4 for each message beside its text."""
    return messages.groupBy("conv_id").agg(F.sum(tx.token_estimate(F.col("text")) + 4).alias("tokens"))


def only_citations(answer: Column) -> Column:
    """Whether an answer is nothing but source references."""
    rest = F.regexp_replace(answer, r"(?i)\[\s*S\d+(?:\s*,\s*S\d+)*\s*\]", "")
    return (F.regexp_replace(rest, r"[\s.,;]+", "") == "") & (F.trim(answer) != "")


def planned_tools(planned: Column, known: list[str]) -> Column:
    """The planned tools that exist, once each, in the order of the plan."""
    return F.array_intersect(planned, F.array(*(F.lit(k) for k in known)))


def backoff_cap(attempt: Column, base: float = 0.5, cap: float = 8.0) -> Column:
    """The longest wait before a retry; the wait itself is drawn evenly from 0 to it."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
