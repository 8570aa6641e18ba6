"""The four whole pipelines: base views, the priority board, the date normaliser's run, and register-and-sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.extract import normalize_notices
from triagelake.functions.scalars import capture_button, form_query, last_updated_text
from triagelake.functions.semantics import or_empty
from triagelake.operators import lookup, resolvers, state, summary, views
from triagelake.sources import readers, schemas, sinks

# The board's categories.
CATEGORIES = ("mural_sculpture", "exhibition_content", "arts_content_support", "other")
FILES = {
    "opportunities": ("b2g_opportunities.json", schemas.OPPORTUNITIES), "agencies": ("target_agencies.json", schemas.AGENCIES), "art": ("art_commissions.json", schemas.ART),
    "local": ("local_projects.json", schemas.LOCAL), "priority": ("priority_projects.json", schemas.PRIORITY), "targets": ("art_commission_source_targets.json", schemas.TARGETS),
}


def base_views(spark: SparkSession, base: str, reviews: DataFrame, as_of, facets: dict[str, views.Facets] | None = None) -> dict[str, DataFrame]:
    """All base views with their summary line joined by compacted title, the counts over unfiltered opportunities, and the banner."""
    t, ask = readers.load_many(spark, base, FILES), facets or {}
    get = lambda name: ask.get(name, views.Facets())
    out = {
        "opportunities": views.opportunities(t["opportunities"], reviews, as_of, get("opportunities")), "agencies": views.agencies(t["agencies"], reviews, get("agencies")),
        "art": views.art(t["art"], reviews, as_of, get("art")), "local": views.local_projects(t["local"], reviews, as_of, get("local")), "grades": summary.grade_counts(t["opportunities"]),
    }
    named = t["opportunities"].withColumns(resolvers.overlay())
    out["opportunities"] = lookup.lookup_first(
        out["opportunities"], named, F.col("title"), lookup.title_key("bidNtceNm", "title"), {"publish_period": "publish_period", "deadline_date": "deadline_date"}
    )
    meta = readers.load_object(spark, f"{base}/dashboard_meta.json", schemas.META)
    out["banner"] = meta.select(last_updated_text("lastUpdatedAt", "timezone").alias("banner"))
    return out


def board(priority: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each category's panel, and all counts in one pass."""
    rows = views.priority_rows(priority)
    counts = summary.category_counts(rows, F.col("board_category"), F.col("isExcludedFromPriority"), list(CATEGORIES))
    return {c: views.priority_board(priority, c) for c in CATEGORIES}, counts


def normalize_file(spark: SparkSession, path: str, as_of, wrapper: str | None = None) -> DataFrame:
    """Reads a notice file (an unknown shape is an error), normalises its dates, replaces the file, and returns the run's summary."""
    done = normalize_notices(readers.load_records(spark, path, schemas.ART, strict=True), as_of)
    return sinks.batch_summary(sinks.publish(done, path, wrapper))


REGISTERED_PARAMS = ["registeredResearchId", "projectId", "status"]
SYNC_PARAMS = ["syncResult", "syncFound", "researchId", "projectId", "status", "statusLabel", "progress", "updatedAt"]


def callback_events(urls: DataFrame, stream: bool = False) -> DataFrame:
    """Events of callback URLs (url, seq, at). A URL that registers and syncs does so in that order, and registering takes its
    project and status out of it. The same delivery (url, seq) counts once, whatever the number of times it comes; in a stream the fold itself sees to that."""
    names = sorted({*REGISTERED_PARAMS, *SYNC_PARAMS})
    params = readers.callback_params(urls if stream else urls.dropDuplicates(["url", "seq"]), names)
    taken = lambda c: F.when(or_empty("registeredResearchId") == "", F.col(c)).alias(c)
    rest = params.select(*[taken(c) if c in ("projectId", "status") else F.col(c) for c in params.columns])
    first = state.registration_events(params).withColumn("seq", F.col("seq") * 2)
    return first.unionByName(state.sync_events(rest).withColumn("seq", F.col("seq") * 2 + 1))


def registered_state(urls: DataFrame) -> DataFrame:
    """The registered state after all callback URLs (url, seq, at), in the order of ``seq``."""
    return state.merged(callback_events(urls))


def capture_links(projects: DataFrame, registered: DataFrame, kind: str, app_url: str) -> DataFrame:
    """Each project's add and sync links and its button text."""
    rows = projects.select("_ord", *[c.alias(n) for n, c in resolvers.capture(kind).items()])
    joined = lookup.with_registered(rows, registered, F.col("research_id"))
    add = form_query([
        ("mode", F.lit("add")), ("researchId", F.col("research_id")), ("title", or_empty("title")), ("institution", or_empty("agency")), ("deadline", or_empty("deadline")),
        ("priority", F.col("priority")), ("nextAction", F.col("next_action")), ("sourceUrl", or_empty("source_url")),
    ])
    sync = form_query([
        ("mode", F.lit("sync")), ("researchId", F.col("research_id")), ("projectId", F.nullif(F.col("registered.projectId"), F.lit(""))), ("title", or_empty("title")), ("deadline", or_empty("deadline")),
    ])
    r = "registered."
    return joined.select(
        "_ord", "research_id", F.concat(F.lit(app_url + "?"), add).alias("add_url"), F.concat(F.lit(app_url + "?"), sync).alias("sync_url"),
        capture_button(F.col(r + "registered"), F.col(r + "status"), F.col(r + "statusLabel"), F.col(r + "progress")).alias("button"),
    )
