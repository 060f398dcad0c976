"""Review log: snapshots, diffs, stale-write checks, invalidation rules, lineage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.operators.order import next_in_chain, number_in_order
from gridfold.session import cut


def snapshot(events: DataFrame, revision: int | None, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """State of every feature as of a revision (None: the latest): the newest ``after`` wins, NULL means deleted.

    ``events`` has ``keys, revision, after``; ``base`` (``keys, after``) is revision 0.  A
    grouped maximum, so map-side combining shrinks a hot feature's history before the shuffle.
    """
    log = (events if revision is None else events.where(F.col("revision") <= revision)).select(*keys, "revision", "after")
    if base is not None:
        log = log.unionByName(base.select(*keys, F.lit(0).cast(log.schema["revision"].dataType).alias("revision"), "after"))
    return (log.groupBy(*keys).agg(F.max_by("after", "revision").alias("after"), F.max("revision").alias("revision"))
            .where("after is not null"))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changed features between two maps; equal states give no row (no change, no revision)."""
    a, b = before.select(*keys, F.col("after").alias("was")), after.select(*keys, F.col("after").alias("now"))
    both = a.join(b, keys, "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.withColumn("change", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed"))


def accept_writes(events: DataFrame, keys: list[str], arrival: str, expected: str, block: Column) -> DataFrame:
    """Optimistic revision check: in arrival order a write is accepted iff its expected revision
    is the current one, and each accepted write adds one.  Output: ``keys, arrival, accepted``.

    The accepted writes form a chain: the first write expecting 0, then the first later write
    expecting 1, and so on.  ``next_in_chain`` finds each write's possible successor and pointer
    doubling marks the chain, so one huge site is still processed in parallel.
    """
    ids = [*keys, arrival]
    jump = cut(next_in_chain(events, keys, expected, arrival, block).where("next is not null").select(*ids, F.col("next")))
    reached = cut(events.where(F.col(expected) == 0).groupBy(*keys).agg(F.min(arrival).alias(arrival)))
    while True:
        found = cut(reached.join(jump, ids).select(*keys, F.col("next").alias(arrival)).join(reached, ids, "left_anti"))
        if found.isEmpty():
            break
        reached = cut(reached.unionByName(found))
        far = jump.select(*keys, F.col(arrival).alias("next"), F.col("next").alias("_far"))
        jump = cut(jump.join(far, [*keys, "next"]).select(*ids, F.col("_far").alias("next")))
    marks = reached.withColumn("accepted", F.lit(True))
    return events.join(marks, ids, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def lineage_sources(edges: DataFrame) -> DataFrame:
    """Provenance closure: every feature with its source features (ancestors without parents).

    ``edges`` has ``child, parent``; paths double in length each round, so depth d costs
    log d rounds.  Features that only lead into a cycle of parents have no source
    (``lineage_faults`` lists them).
    """
    step = cut(edges.select("child", "parent").distinct())
    heads = cut(step.select(F.col("parent").alias("node")).join(step.select(F.col("child").alias("node")), "node", "left_anti").distinct())
    roots = heads.select(F.col("node").alias("parent"))
    done = cut(step.join(roots, "parent", "left_semi").select("child", F.col("parent").alias("source")))
    while True:
        # sources of anything reachable by the current step, then doubled steps
        more = cut(step.join(done.select(F.col("child").alias("parent"), "source"), "parent").select("child", "source").distinct()
                   .join(done, ["child", "source"], "left_anti"))
        if more.isEmpty():  # a shortest path beyond this length would have had an end of this length
            return done
        nxt = step.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        step = cut(step.join(nxt, "parent").select("child", F.col("far").alias("parent")).distinct())
        done = cut(done.unionByName(more))


def lineage_faults(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Features that lead to no source, as ``child``: they hang on a cycle of parents."""
    return edges.select("child").distinct().join(sources.select("child"), "child", "left_anti")


def review_queue(features: DataFrame, flags: str, fid: str, keys: list[str]) -> DataFrame:
    """Suggested features by number of non-empty flags (descending), then id, with their place."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(flags), F.lit("")), ","), lambda f: F.trim(f) != ""))
    todo = features.where("review_status = 'suggested'").withColumn("n_flags", n)
    block = -F.col("n_flags").cast("long") * (1 << 40) + F.floor(F.col(fid) / 65536)
    return number_in_order(todo, keys, [F.desc("n_flags"), fid], "place", block)


def history_page(events: DataFrame, keys: list[str], limit: int, offset: int) -> DataFrame:
    """One page of the log, newest first; revisions are dense, so a page is a range of them."""
    top = events.groupBy(*keys).agg(F.max("revision").alias("_top"))
    return (events.join(top, keys).where((F.col("revision") <= F.col("_top") - offset) & (F.col("revision") > F.col("_top") - offset - limit))
            .withColumnRenamed("_top", "total"))


def status_after_edits(events: DataFrame, keys: list[str]) -> DataFrame:
    """Review status with invalidation: an edit resets it, a later decision sets it again; a
    recorded use survives only without a later edit."""
    def last(cond):
        return F.max(F.when(cond, F.col("revision")))
    op = F.col("operation")
    agg = events.groupBy(*keys).agg(
        last(op == "edit").alias("edited"), last(op.isin("accept", "reject", "draw")).alias("decided"),
        F.max_by(F.when(op.isin("accept", "reject", "draw"), op), F.when(op.isin("accept", "reject", "draw"), F.col("revision"))).alias("decision"),
        last(op == "label").alias("labelled"))
    zero = F.lit(0)
    fresh = F.coalesce("decided", zero) > F.coalesce("edited", zero)
    status = F.when(fresh, F.create_map(*[F.lit(v) for kv in {"accept": "accepted", "reject": "rejected", "draw": "accepted"}.items() for v in kv])[F.col("decision")]).otherwise("suggested")
    use = F.when(F.col("labelled").isNull(), "none").when(F.coalesce("edited", zero) > F.col("labelled"), "needs_review").otherwise("current")
    return agg.select(*keys, status.alias("status"), use.alias("use_review"))


def bound_checks(events: DataFrame, keys: list[str], check: Column, geometry: Column, payload: str) -> DataFrame:
    """Last check of each feature against its geometry: the check is bound to the hash of the
    geometry current when it was recorded and is stale once the geometry hash differs."""
    last = events.where(check).groupBy(*keys).agg(F.max("revision").alias("checked"), F.max_by(payload, "revision").alias("check_value"))
    shapes = events.where(geometry).select(*keys, "revision", F.sha2(F.col(payload).cast("string"), 256).alias("sha"))
    both = last.join(shapes, keys, "left")
    at = F.when(F.col("revision") < F.col("checked"), F.col("revision"))
    out = both.groupBy(*keys, "checked", "check_value").agg(
        F.max_by("sha", at).alias("bound_sha"), F.max_by("sha", "revision").alias("current_sha"), F.max("revision").alias("changed"))
    state = (F.when(F.col("bound_sha").isNull(), "unbound").when(F.col("bound_sha").eqNullSafe(F.col("current_sha")), "current").otherwise("stale"))
    return out.select(*keys, "checked", "check_value", state.alias("state"))


def workflow_state(layers: DataFrame, workspace: DataFrame, sites: DataFrame) -> DataFrame:
    """State of each site from its counts: accepted features, any features, layers, imagery."""
    both = sites.join(workspace, "site_id", "left").join(layers, "site_id", "left")
    state = (F.when(F.coalesce("accepted", F.lit(0)) > 0, "EXPORT_READY").when(F.coalesce("features", F.lit(0)) > 0, "REVIEWING")
             .when(F.coalesce("layers", F.lit(0)) > 0, "LAYERS_AVAILABLE").otherwise("IMAGERY_READY"))
    return both.select("site_id", state.alias("state"))


def history_hash(events: DataFrame, keys: list[str], line: Column, per_block: int = 1024) -> DataFrame:
    """Digest of a log: digests of blocks of revisions, then a digest of those, so no task
    holds a whole log (a second level of blocks would follow the same rule)."""
    lines = events.select(*keys, F.floor((F.col("revision") - 1) / per_block).alias("block"), "revision", line.alias("line"))
    blocks = lines.groupBy(*keys, "block").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("revision", "line"))), lambda e: e.line), "\n"), 256).alias("h"))
    return blocks.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "h"))), lambda e: e.h), "\n"), 256).alias("history_sha256"))


def clean_refs(refs: Column) -> Column:
    """Trimmed references, each once, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(refs, lambda r: F.trim(r)), lambda r: r != ""))


def clean_use(label: Column) -> Column:
    """Trimmed label; any case of unknown becomes unknown; blank is NULL."""
    t = F.trim(label)
    return F.when(F.lower(t) == "unknown", "unknown").when(t != "", t)


def use_errors(label: Column, refs: Column, feature_type: Column) -> Column:
    """Error codes of a use label: blank, wrong feature type, known label without references."""
    use = clean_use(label)
    return F.array_compact(F.array(
        F.when(use.isNull(), F.lit("label_required")),
        F.when(feature_type != "building_footprint", F.lit("use_feature_type")),
        F.when((use != "unknown") & (F.size(clean_refs(refs)) == 0), F.lit("use_evidence_required"))))


def evidence_errors(source: Column, datum: Column, kind: Column, parcel_id: Column, accuracy: Column) -> Column:
    """Error codes of a parcel evidence row."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(source), F.lit("")) == "", F.lit("source_required")),
        F.when(F.coalesce(F.trim(datum), F.lit("")) == "", F.lit("datum_required")),
        F.when((kind == "survey_observation") & parcel_id.isNull(), F.lit("parcel_required")),
        F.when((accuracy <= 0) | (accuracy > 100), F.lit("accuracy_range"))))
