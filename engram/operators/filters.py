"""Filters and decisions (FL) and governance joins (JN11, JN12). The ACL rules differ by layer on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classification levels in order, with the roles that may read each and lease lifetimes in hours. Fixed values.
LEVELS = ("public", "internal", "confidential", "restricted")
LEASE_HOURS = {"public": 168, "internal": 168, "confidential": 48, "restricted": 24}


def level_rank(level: Column) -> Column:
    out = None
    for i, name in enumerate(LEVELS):
        out = (F if out is None else out).when(level == name, i)
    return out


def in_project(project: Column, current: str | None, extra: tuple[str, ...] = (), cross_project: bool = False) -> Column:
    return F.lit(True) if cross_project or current is None else project.isNull() | project.isin(current, *extra)


def in_room(room: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else room.isNull() | (F.btrim(room) == wanted.strip())


def not_ambient(kind: Column) -> Column:
    return ~kind.eqNullSafe(F.lit("ambient_trace"))


def valid_at(valid_from: Column, valid_until: Column, t: Column) -> Column:
    """A missing bound is open."""
    return F.coalesce(valid_from <= t, F.lit(True)) & F.coalesce(valid_until >= t, F.lit(True))


def acl_closed(acl: Column, ids: list[str]) -> Column:
    """Missing or empty: denied."""
    return F.coalesce(F.arrays_overlap(acl, F.array(*[F.lit(i) for i in ids])), F.lit(False))


def acl_open(acl: Column, ids: list[str] | None) -> Column:
    """Missing: allowed; no principal: no filter."""
    return F.lit(True) if ids is None else acl.isNull() | F.coalesce(F.arrays_overlap(acl, F.array(*[F.lit(i) for i in ids])), F.lit(False))


def acl_graph(acl: Column, ids: list[str]) -> Column:
    """Missing: allowed; empty: denied."""
    return acl.isNull() | F.arrays_overlap(acl, F.array(*[F.lit(i) for i in ids]))


def parse_acl(raw: Column) -> Column:
    """A JSON list, or one name, as an array."""
    return F.when(raw.isNotNull(), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw)))


def admission(level: Column, ceiling: str, acl: Column, ids: list[str]) -> Column:
    within = level_rank(level) <= LEVELS.index(ceiling)
    return F.when(~acl_closed(acl, ids), "acl_denied").when(F.coalesce(~within, F.lit(True)), "ceiling_exceeded").otherwise("admitted")


def export_decisions(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """requests (level, format, token) against matrix (level, formats, needs_approval, watermark): approval is judged before format."""
    both = requests.join(F.broadcast(matrix), "level", "left")  # four rows
    reason = F.when(F.col("formats").isNull(), "unknown_level").when(F.col("needs_approval") & F.col("token").isNull(), "approval_required").when(~F.array_contains("formats", F.col("format")), "format_denied").otherwise("allowed")
    return both.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed").withColumn("watermark", F.coalesce(F.col("watermark") & F.col("allowed"), F.lit(False)))


def export_matrix(spark: SparkSession) -> DataFrame:
    rows = [("public", ["json", "csv", "md"], False, False), ("internal", ["json", "csv", "md"], False, False), ("confidential", ["json", "csv"], True, True), ("restricted", ["json"], True, True)]
    return spark.createDataFrame(rows, "level string, formats array<string>, needs_approval boolean, watermark boolean")


def access_decisions(requests: DataFrame, capabilities: DataFrame, class_roles: DataFrame) -> DataFrame:
    """requests (id, principal, role, class_role, capability, acl, level): the capability must be held, the principal in the ACL or an
    override held, and the class role allowed at the level; anything unknown denies. Two separate role vocabularies."""
    held = requests.join(capabilities.groupBy("role").agg(F.collect_set("capability").alias("_caps")), "role", "left")
    both = held.join(class_roles.groupBy("level").agg(F.collect_set("class_role").alias("_roles")), "level", "left")
    caps = F.coalesce("_caps", F.array().cast("array<string>"))
    has = F.array_contains(caps, F.col("capability"))
    listed = F.coalesce(F.array_contains("acl", F.col("principal")), F.lit(False)) | F.arrays_overlap(caps, F.array(F.lit("read_all"), F.lit("write_all")))
    ranked = F.coalesce(F.array_contains("_roles", F.col("class_role")), F.lit(False))
    reason = F.when(~has, "no_capability").when(~listed, "not_in_acl").when(~ranked, "class_denied").otherwise("allowed")
    return both.withColumn("reason", reason).drop("_caps", "_roles")


def all_of(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce(tags, F.array().cast("array<string>")))) == 0


def lease_expiry(level: Column, issued: Column) -> Column:
    out = None
    for name, hours in LEASE_HOURS.items():
        out = (F if out is None else out).when(level == name, F.expr(f"INTERVAL '{hours}' HOUR"))
    return issued + out


def is_secret_path(path: Column) -> Column:
    """Paths in secret-bearing folders or with secret-bearing names; a missing path counts as one."""
    return F.coalesce(path.rlike(r"(?i)(^|/)(\.ssh|\.aws|\.gnupg|secrets)/|(^|/)(\.env(\..*)?|id_rsa.*|.*\.pem|.*\.key|credentials.*)$"), F.lit(True))


def project_scope(groups: Column, explicit: Column) -> Column:
    """Projects of groups named project:x, with those given; null (unrestricted) if there is none."""
    named = F.transform(F.filter(groups, lambda g: g.startswith("project:")), lambda g: F.substring(g, 9, 1000))
    all_ = F.array_union(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(explicit, F.array().cast("array<string>")))
    return F.when(F.size(all_) > 0, F.array_sort(all_))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `reject`: the name of the first rule that fails or is unknown, null for good rows."""
    out = None
    for name, ok in rules.items():
        out = (F if out is None else out).when(~F.coalesce(ok, F.lit(False)), name)
    return rows.withColumn("reject", out)


def delta_pull(records: DataFrame, changelog: DataFrame, since: Column, principal: str) -> DataFrame:
    """Records changed after `since` and visible to the principal, with the position of their last change."""
    last = changelog.where(F.col("changed_at") > since).groupBy("record_id").agg(F.max("id").alias("change_id"))
    return records.join(last, "record_id").where(F.coalesce(F.array_contains("acl_allow", principal), F.lit(False)))


def delta_push(incoming: DataFrame, server: DataFrame, principal: str) -> DataFrame:
    """incoming with the reason it is rejected for, or `accepted`."""
    s = server.select("record_id", F.col("acl_allow").alias("_acl"), F.col("classification").alias("_level"))
    both = incoming.join(s, "record_id", "left")
    widened = F.size(F.array_except("acl_allow", F.coalesce("_acl", "acl_allow"))) > 0
    loosened = level_rank(F.col("classification")) < level_rank(F.coalesce("_level", "classification"))
    reason = (
        F.when(~F.coalesce(F.array_contains("acl_allow", principal), F.lit(False)), "not_in_acl")
        .when(level_rank(F.col("classification")).isNull(), "unknown_class")
        .when(widened, "acl_widened")
        .when(loosened, "class_loosened")
        .otherwise("accepted")
    )
    return both.withColumn("reason", reason).drop("_acl", "_level")


def session_events(rows: DataFrame, mode: str | None, first: Column | None, last: Column | None, offset: int, limit: int) -> DataFrame:
    """A page of recall events (mode, timestamp, event_id) with `total`: of one mode, between two times (rows without a time pass), oldest first."""
    kept = rows if mode is None else rows.where(F.col("mode") == mode)
    for bound, inside in ((first, lambda t: t >= first), (last, lambda t: t <= last)):
        if bound is not None:
            kept = kept.where(F.coalesce(inside(F.col("timestamp")), F.lit(True)))
    total = kept.agg(F.count("*").alias("total"))
    return kept.orderBy(F.asc_nulls_first("timestamp"), "event_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def discovery_page(records: DataFrame, ids: list[str] | None = None, first: str | None = None, last: str | None = None, project: str | None = None, agent: str | None = None, tags: tuple[str, ...] = (), offset: int = 0, limit: int = 100, order: str = "id") -> DataFrame:
    """records (id, date, project, agent, tags, acl) that a principal may see and that match all that is given, in order, one page: with total (of all matches) and next_offset (null on
    the last page). Undated records pass date bounds; ids None: no ACL filter; a missing or empty ACL is seen by no principal."""
    rows = records
    if ids is not None:
        rows = rows.where(acl_closed(F.col("acl"), ids))
    for bound, ok in ((first, lambda d, x: d >= x), (last, lambda d, x: d <= x)):
        if bound is not None:
            rows = rows.where(F.col("date").isNull() | ok(F.col("date"), F.lit(bound).cast("date")))
    for column, value in (("project", project), ("agent", agent)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if tags:
        rows = rows.where(all_of(F.col("tags"), list(tags)))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
    return page.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))
