"""Keyed state as folds over events: last write wins, field-wise merge, deletion, and what callbacks mean as events.

An event has ``research_id``, ``seq`` (its order), ``op`` (``upsert`` or
``delete``), ``at`` (its time as text), ``is_sync`` and the fields it carries;
a field that is not carried is null. State is a partial aggregation by key:
no key's history has to be in one place before it is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.scalars import clamp_progress, status_label
from triagelake.functions.semantics import truthy


def last_write(events: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, seq).alias(value))


def _last(value: Column, counts: Column) -> Column:
    """The value of the last event for which ``counts`` holds, else null."""
    return F.max_by(value, F.when(counts, F.col("seq")))


def live(events: DataFrame, key: str = "research_id", seq: str = "seq") -> DataFrame:
    """Upserts behind their key's last deletion."""
    ends = events.where("op = 'delete'").groupBy(key).agg(F.max(seq).alias("_end"))
    return events.where("op = 'upsert'").join(ends, key, "left").where(F.col("_end").isNull() | (F.col(seq) > F.col("_end"))).drop("_end")


def merged(events: DataFrame) -> DataFrame:
    """The registered state of each key.

    ``status`` and ``statusLabel`` are taken over if they are not empty,
    ``projectId`` and ``sheetUpdatedAt`` whenever an event carries them, empty
    or not, ``progress`` whenever it is neither null nor empty, ``syncedAt``
    from syncs. A label is made from the status of the event that first had
    none to keep, and stays until an event brings another.
    """
    rows = live(events)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    given = lambda c: F.col(c).isNotNull()
    counts = {"filled": filled, "given": given, "synced": lambda c: F.col("is_sync"), "any": lambda c: F.lit(True)}
    folded = rows.groupBy("research_id").agg(
        *[_last(F.col(source).cast("string"), counts[rule](source)).alias(name) for name, (source, rule) in REGISTERED_RULES.items()], F.min_by(F.col("status"), "seq").alias("first_status")
    )
    return shown(folded)


#: What a registered record keeps: each field's source and when an event's value of it counts (the last that counts is kept).
REGISTERED_RULES = {
    "status": ("status", "filled"), "statusLabel": ("statusLabel", "filled"), "progress": ("progress", "filled"), "projectId": ("projectId", "given"),
    "sheetUpdatedAt": ("sheetUpdatedAt", "given"), "syncedAt": ("at", "synced"), "updatedAt": ("at", "any"),
}


def shown(folded: DataFrame) -> DataFrame:
    """The registered state from its folded fields and the status of the first event that counts (``first_status``)."""
    return folded.select(
        "research_id", F.lit(True).alias("registered"), F.coalesce("projectId", F.lit("")).alias("projectId"), truthy("status", default="REVIEW").alias("status"),
        truthy("statusLabel", default=status_label(truthy("first_status", default="REVIEW"))).alias("statusLabel"), F.when(F.col("progress").isNotNull(), clamp_progress("progress")).alias("progress"),
        F.coalesce("sheetUpdatedAt", F.lit("")).alias("sheetUpdatedAt"), F.coalesce("syncedAt", F.lit("")).alias("syncedAt"), "updatedAt",
    )


EVENT_FIELDS = ("research_id", "seq", "op", "at", "is_sync", "status", "statusLabel", "progress", "projectId", "sheetUpdatedAt")


def registration_events(params: DataFrame) -> DataFrame:
    """Events of registration callbacks (a registeredResearchId): they carry a status and a project id."""
    return params.where(truthy("registeredResearchId") != "").select(
        F.col("registeredResearchId").alias("research_id"), "seq", F.lit("upsert").alias("op"), "at", F.lit(False).alias("is_sync"), truthy("status", default="REVIEW").alias("status"),
        F.lit(None).cast("string").alias("statusLabel"), F.lit(None).cast("string").alias("progress"), F.coalesce("projectId", F.lit("")).alias("projectId"), F.lit(None).cast("string").alias("sheetUpdatedAt"),
    )


def sync_events(params: DataFrame) -> DataFrame:
    """Events of sync callbacks (syncResult=1): a found project is merged, one that is not found is deleted."""
    found = F.col("syncFound").eqNullSafe(F.lit("1"))
    carried = lambda c: F.when(found, F.coalesce(F.col(c), F.lit(""))).alias(c)
    return params.where((F.col("syncResult") == "1") & (truthy("researchId") != "")).select(
        F.col("researchId").alias("research_id"), "seq", F.when(found, F.lit("upsert")).otherwise("delete").alias("op"), "at", found.alias("is_sync"),
        F.when(found, truthy("status", default="REVIEW")).alias("status"), carried("statusLabel"), F.when(found, F.col("progress")).alias("progress"), carried("projectId"), F.when(found, F.coalesce("updatedAt", F.lit(""))).alias("sheetUpdatedAt"),
    )


def running(events: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """Each event with its key's value as of then."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("current", F.last(value, ignorenulls=True).over(w))
