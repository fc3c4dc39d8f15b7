"""Tickets: payloads from job outcomes, overrides, dispatch, status sync, checks and searches.

An outcome row is ``job_id, severity, summary, metrics map<string,bigint>, recommended_actions
array<string>, categories (array<string> or string), category, tags array<string>``; any may be null.
"""

from __future__ import annotations

from collections.abc import Callable

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsieve.settings import (
    JIRA_PRIORITY,
    SERVICENOW_PRIORITY,
    SERVICENOW_STATES,
    JiraDefaults,
    ServiceNowDefaults,
    TicketToggles,
)

# ---- payloads -------------------------------------------------------------------------------


def _filled(value: Column) -> Column:
    """Null where a text is empty."""
    return F.nullif(value, F.lit(""))


def _lookup(mapping: dict[str, str], key: Column, otherwise: Column) -> Column:
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), otherwise)


def ticket_severity() -> Column:
    """The severity given, else the one the metrics call for, else low."""

    def metric(name: str) -> Column:
        return F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0)) != 0

    derived = F.when(metric("critical"), "critical").when(metric("errors"), "high").when(metric("warnings"), "moderate")
    return F.coalesce(_filled(F.col("severity")), derived, F.lit("low"))


def _summary() -> Column:
    standing = F.concat(F.lit("RCA outcome for job "), F.col("job_id").cast("string"))
    return F.coalesce(_filled(F.col("summary")), standing)


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def _metric_lines() -> Column:
    lines = F.transform(
        F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))
    )
    return F.when(F.size(lines) > 0, _bullets(lines))


def servicenow_payload(outcomes: DataFrame, defaults: ServiceNowDefaults = ServiceNowDefaults()) -> DataFrame:
    """Adds the incident ``payload``; routing fields stay as empty texts when unset."""
    summary, severity, actions = _summary(), ticket_severity(), F.col("recommended_actions")
    listed = F.size(F.coalesce(actions, F.array().cast("array<string>"))) > 0
    # Wording of the description.
    description = F.concat_ws(
        "\n",
        F.concat(F.lit("Job ID: "), F.col("job_id").cast("string")),
        F.concat(F.lit("Severity: "), severity),
        F.lit(""),
        F.concat(F.lit("Summary: "), summary),
        F.lit(""),
        F.lit("Key Metrics:"),
        _metric_lines(),
        F.lit(""),
        F.lit("Recommended Actions:"),
        F.when(listed, _bullets(actions)).otherwise("No immediate actions recorded."),
    )
    # End of fixed values.
    kind = outcomes.schema["categories"].dataType
    if isinstance(kind, T.ArrayType):
        has = F.size(F.coalesce("categories", F.array().cast("array<string>"))) > 0
        category = F.when(has, F.col("categories")[0]).otherwise(F.col("category"))
    else:
        category = F.coalesce(_filled(F.col("categories")), F.col("category"))
    payload = F.struct(
        F.substring(summary, 1, 160).alias("short_description"),
        description.alias("description"),
        F.coalesce(_filled(category), F.lit(defaults.category)).alias("category"),
        F.lit(defaults.subcategory).cast("string").alias("subcategory"),
        _lookup(SERVICENOW_PRIORITY, severity, F.lit(defaults.priority or "3")).alias("priority"),
        F.lit(defaults.state or "1").alias("state"),
        F.lit(defaults.assignment_group or "").alias("assignment_group"),
        F.lit(defaults.configuration_item or "").alias("configuration_item"),
        F.lit(defaults.assigned_to or "").alias("assigned_to"),
    )
    return outcomes.withColumn("payload", payload)


def jira_payload(outcomes: DataFrame, defaults: JiraDefaults = JiraDefaults()) -> DataFrame:
    """Adds the issue ``payload``; labels are the sorted union of tags and default labels."""
    summary, severity, actions = _summary(), ticket_severity(), F.col("recommended_actions")
    listed = F.size(F.coalesce(actions, F.array().cast("array<string>"))) > 0
    # Wording of the description.
    description = F.concat_ws(
        "\n",
        F.concat(F.lit("h2. Root Cause Analysis Summary for Job "), F.col("job_id").cast("string")),
        F.lit(""),
        F.concat(F.lit("*Severity:* "), severity),
        F.lit(""),
        F.lit("*Summary:*"),
        summary,
        F.lit(""),
        F.lit("*Key Metrics:*"),
        _metric_lines(),
        F.when(listed, F.concat(F.lit("\n*Recommended Actions:*\n"), _bullets(actions))),
    )
    # End of fixed values.
    own = F.coalesce("tags", F.array().cast("array<string>"))
    standing = F.array(*[F.lit(x) for x in defaults.labels]).cast("array<string>")
    payload = F.struct(
        F.lit(defaults.project_key).cast("string").alias("project_key"),
        F.lit(defaults.issue_type).alias("issue_type"),
        F.substring(summary, 1, 255).alias("summary"),
        description.alias("description"),
        F.array_sort(F.array_distinct(F.concat(own, standing))).alias("labels"),
        _lookup(JIRA_PRIORITY, severity, F.lit(defaults.priority).cast("string")).alias("priority"),
        F.lit(defaults.assignee).cast("string").alias("assignee"),
    )
    return outcomes.withColumn("payload", payload)


def merge_structs(base: Column, base_type: T.StructType, over: Column, over_type: T.StructType) -> Column:
    """Overrides laid over defaults, field by field and nested structs within.

    A null override leaves the default, an empty text replaces it, and a field only one side has is
    kept. Fields that end up null vanish when the struct is written as JSON.
    """
    fields = []
    for name in dict.fromkeys([*base_type.names, *over_type.names]):
        if name not in over_type.names:
            fields.append(base[name].alias(name))
        elif name not in base_type.names:
            fields.append(over[name].alias(name))
        else:
            left, right = base_type[name].dataType, over_type[name].dataType
            if isinstance(left, T.StructType) and isinstance(right, T.StructType):
                inner = merge_structs(base[name], left, over[name], right)
                neither = base[name].isNull() & over[name].isNull()
                fields.append(F.when(~neither, inner).alias(name))
            else:
                fields.append(F.coalesce(over[name], base[name]).alias(name))
    return F.struct(*fields)


def apply_overrides(rows: DataFrame, payload: str = "payload", overrides: str = "overrides") -> DataFrame:
    """Merges the struct column ``overrides`` (null for none) over ``payload`` and drops it."""
    merged = merge_structs(
        F.col(payload), rows.schema[payload].dataType, F.col(overrides), rows.schema[overrides].dataType
    )
    return rows.withColumn(payload, merged).drop(overrides)


def apply_profile(rows: DataFrame, profiles: DataFrame, schema: T.StructType | str, platform: str) -> DataFrame:
    """Merges the JSON defaults of the named profile of this platform over ``payload``.

    ``profiles``: ``name, platform, defaults``, unique by name. Whether the table is small enough to
    broadcast is left to the planner, which knows its size.
    """
    chosen = profiles.where(F.col("platform") == platform).select(
        F.col("name").alias("profile_name"), F.from_json("defaults", schema).alias("overrides")
    )
    return apply_overrides(rows.join(chosen, "profile_name", "left"))


# ---- creation -------------------------------------------------------------------------------


def made_up_id(platform: Column, as_of: str) -> Column:
    """``<platform>-<8 hex>``, the same on every retry of one run."""
    digest = F.sha2(F.concat_ws("|", F.col("job_id").cast("string"), platform, F.lit(as_of)), 256)
    return F.concat(platform, F.lit("-"), F.substring(digest, 1, 8))


def _ticket(
    platform: Column, answered: Column, answer: Callable[[str], Column], toggles: TicketToggles, as_of: str, dry_run: bool
) -> dict[str, Column]:
    """Columns of a ticket from what the platform answered; a preview, a disabled platform and a failed call give a dry run."""
    enabled = platform.isin(toggles.active_platforms) if toggles.active_platforms else F.lit(False)
    attempted = enabled & F.lit(not dry_run)
    # Wording of errors and reasons.
    unconfigured = F.concat(
        platform, F.lit(" integration is not configured. Provide credentials to enable creation.")
    )
    preview, disabled = "preview", "feature-toggle-disabled"
    # End of fixed values.
    error = F.when(attempted, F.when(~answered, unconfigured).otherwise(answer("error")))
    created = attempted & error.isNull()
    return {
        "ticket_id": F.when(created, answer("remote_id")).otherwise(made_up_id(platform, as_of)),
        "url": F.when(created, answer("remote_url")),
        "status": F.when(created, F.coalesce(answer("remote_status"), F.lit("created"))).otherwise("dry-run"),
        "dry_run": ~created,
        "dry_run_reason": F.when(~attempted, F.lit(preview if dry_run else disabled)),
        "error": error,
    }


def create_tickets(
    prepared: DataFrame, outcomes: DataFrame, toggles: TicketToggles, as_of: str, dry_run: bool = False
) -> DataFrame:
    """Ticket rows from prepared payloads and what the platforms answered.

    ``prepared``: ``job_id, platform, payload`` (JSON) and ``profile_name``. ``outcomes``: ``job_id,
    platform, remote_id, remote_url, remote_status, error``, one row per call made; a missing row means
    the platform is not configured. A preview, a disabled platform and a failed call all give a dry run.
    """
    columns = _ticket(F.col("platform"), F.col("_answered").isNotNull(), F.col, toggles, as_of, dry_run)
    return prepared.join(outcomes.withColumn("_answered", F.lit(True)), ["job_id", "platform"], "left").select(
        "job_id", "platform", "profile_name", "payload", *[c.alias(n) for n, c in columns.items()]
    )


def dispatch(
    outcomes_of_jobs: DataFrame,
    answers: DataFrame,
    toggles: TicketToggles,
    as_of: str,
    dry_run: bool = False,
    servicenow: ServiceNowDefaults = ServiceNowDefaults(),
    jira: JiraDefaults = JiraDefaults(),
) -> DataFrame:
    """One ticket per job and enabled platform, ServiceNow first (``dispatch_order``).

    ``outcomes_of_jobs`` may hold ``servicenow_overrides`` and ``jira_overrides`` structs. With dual
    tracking, a real incident is named in the description of the job's Jira issue: the link replaces
    the generated description, or follows an overriding one. The answers of a job, one per platform, are put in one row
    and joined once; both payloads and the link are worked out there before a job unfolds into its tickets.
    """
    platforms = toggles.active_platforms
    if not platforms:
        raise ValueError("no platform is enabled")
    ready = outcomes_of_jobs
    if "profile_name" not in ready.columns:
        ready = ready.withColumn("profile_name", F.lit(None).cast("string"))
    told = F.struct("remote_id", "remote_url", "remote_status", "error")
    called = answers.groupBy("job_id").agg(
        *[F.first(F.when(F.col("platform") == p, told), ignorenulls=True).alias(f"_answer_{p}") for p in platforms])
    ready = ready.join(called, "job_id", "left")
    linked = {c: F.lit(None).cast("string") for c in ("linked_ticket_id", "linked_url")}
    for order, platform in enumerate(platforms, 1):
        ready = servicenow_payload(ready, servicenow) if platform == "servicenow" else jira_payload(ready, jira)
        overrides = f"{platform}_overrides"
        given = overrides in ready.columns
        if platform == "jira" and toggles.dual_tracking:
            real = ~F.col("_servicenow.dry_run")
            linked = {"linked_ticket_id": F.when(real, F.col("_servicenow.ticket_id")), "linked_url": F.when(real, F.col("_servicenow.url"))}
            ready = _link(ready.withColumns(linked), overrides, given)
            linked, given = {c: F.col(c) for c in linked}, True
        if given:
            ready = apply_overrides(ready, "payload", overrides)
        answer = F.col(f"_answer_{platform}")
        columns = {"platform": F.lit(platform), "profile_name": F.col("profile_name"), "payload": F.to_json("payload")}
        columns |= _ticket(F.lit(platform), answer.isNotNull(), answer.getField, toggles, as_of, dry_run)
        columns |= linked | {"dispatch_order": F.lit(order)}
        ready = ready.withColumn(f"_{platform}", F.struct(*[c.alias(n) for n, c in columns.items()])).drop("payload")
    return ready.select("job_id", F.explode(F.array(*[f"_{p}" for p in platforms])).alias("_ticket")).select("job_id", "_ticket.*")


def _link(ready: DataFrame, overrides: str, given: bool) -> DataFrame:
    # Wording of the link.
    link = F.concat(F.lit("Linked ServiceNow Incident: "), F.col("linked_ticket_id"))
    # End of fixed values.
    if not given:
        return ready.withColumn(overrides, F.struct(link.alias("description")))
    names = ready.schema[overrides].dataType.names
    own = _filled(F.col(f"{overrides}.description")) if "description" in names else F.lit(None).cast("string")
    described = F.when(F.col("linked_ticket_id").isNull(), own).otherwise(
        F.concat_ws("\n\n", own, link)
    )
    others = [F.col(f"{overrides}.{n}").alias(n) for n in names if n != "description"]
    return ready.withColumn(overrides, F.struct(described.alias("description"), *others))


def created_ticket_events(tickets: DataFrame) -> DataFrame:
    fields = F.struct("ticket_id", "platform", "status", "dry_run")
    return tickets.select("job_id", F.lit("ticket-created").alias("event_type"), F.to_json(fields).alias("data"))


def incident_url(base_url: str, sys_id: Column) -> Column:
    return F.concat(F.lit(f"{base_url.rstrip('/')}/nav_to.do?uri=incident.do?sys_id="), sys_id)


def issue_url(base_url: str, key: Column) -> Column:
    return F.concat(F.lit(f"{base_url.rstrip('/')}/browse/"), key)


def servicenow_request(payload: Column, names: list[str], defaults: ServiceNowDefaults = ServiceNowDefaults()) -> Column:
    """Incident body: defaults only for fields the payload does not have at all."""
    standing = {
        "assignment_group": defaults.assignment_group, "configuration_item": defaults.configuration_item,
        "category": defaults.category, "subcategory": defaults.subcategory, "priority": defaults.priority or "3",
        "state": defaults.state or "1", "assigned_to": defaults.assigned_to,
    }
    own = [payload[n].alias(n) for n in names]
    return F.struct(*own, *[F.lit(v).cast("string").alias(n) for n, v in standing.items() if n not in names])


def jira_request(issues: DataFrame, defaults: JiraDefaults = JiraDefaults()) -> DataFrame:
    """Adds the issue ``body`` (JSON) or ``reject_reason`` when no project is known.

    ``issues``: ``project_key, issue_type, summary, description, labels, priority, assignee`` and
    optionally ``components``, ``custom_fields`` (struct) and ``issue_links`` (array of structs).
    Assignee and priority may be texts or structs; custom fields become fields of their own.
    """

    def named(column: str, otherwise: str | None) -> Column:
        if isinstance(issues.schema[column].dataType, T.StructType):
            return F.col(column)
        name = F.coalesce(_filled(F.col(column)), F.lit(otherwise).cast("string"))
        return F.when(name.isNotNull(), F.struct(name.alias("name")))

    project = F.coalesce(_filled(F.col("project_key")), F.lit(defaults.project_key).cast("string"))
    standing = F.array(*[F.lit(x) for x in defaults.labels]).cast("array<string>")
    labels = F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0, F.col("labels")).otherwise(
        standing
    )
    fields = {
        "project": F.struct(project.alias("key")),
        "issuetype": F.struct(
            F.coalesce(_filled(F.col("issue_type")), F.lit(defaults.issue_type)).alias("name")
        ),
        "summary": F.coalesce(_filled(F.col("summary")), F.lit("RCA Ticket")),
        "description": _filled(F.col("description")),
        "assignee": named("assignee", defaults.assignee),
        "labels": F.when(F.size(labels) > 0, labels),
        "priority": named("priority", defaults.priority),
    }
    if "custom_fields" in issues.columns:
        for name in issues.schema["custom_fields"].dataType.names:
            own = F.col(f"custom_fields.{name}")
            fields[name] = F.coalesce(own, fields[name]) if name in fields else own
    if "components" in issues.columns:
        fields["components"] = F.when(F.size("components") > 0, F.col("components"))
    parts = [F.struct(*[c.alias(n) for n, c in fields.items()]).alias("fields")]
    if "issue_links" in issues.columns:
        added = F.transform("issue_links", lambda link: F.struct(link.alias("add")))
        parts.append(F.when(F.size("issue_links") > 0, F.struct(added.alias("issuelinks"))).alias("update"))
    return issues.withColumns({
        "reject_reason": F.when(project.isNull(), "Jira project key is required to create an issue"),
        "body": F.when(project.isNotNull(), F.to_json(F.struct(*parts))),
    })


# ---- sync and reading -----------------------------------------------------------------------


def sync_status(tickets: DataFrame, snapshots: DataFrame, states: dict[str, str] = SERVICENOW_STATES) -> DataFrame:
    """Tickets with the status of their latest remote snapshot.

    ``snapshots``: ``platform, ticket_id, raw`` (JSON), ``seen_at``. Dry runs are not synced; a state
    code without a name is kept as it is; a snapshot without status leaves the old one.
    """
    latest = snapshots.groupBy("platform", "ticket_id").agg(F.max(F.struct("seen_at", "raw")).alias("_seen"))
    return with_remote_status(tickets.join(latest, ["platform", "ticket_id"], "left"), states)


def with_remote_status(seen: DataFrame, states: dict[str, str] = SERVICENOW_STATES) -> DataFrame:
    """Status, raw answer and time from ``_seen`` (``seen_at, raw``), the latest snapshot of a ticket or null."""
    raw = F.when(~F.col("dry_run"), F.col("_seen.raw"))
    state = _filled(F.get_json_object(raw, "$.state"))
    code = F.coalesce(state, F.get_json_object(raw, "$.incident_state"))
    remote = F.when(F.col("platform") == "servicenow", _lookup(states, code, state)).otherwise(
        F.get_json_object(raw, "$.fields.status.name")
    )
    return seen.withColumns({
        "status": F.coalesce(_filled(remote), F.col("status")),
        "sync_raw": raw,
        "refreshed_at": F.when(raw.isNotNull(), F.col("_seen.seen_at")),
    }).drop("_seen")


def job_tickets(tickets: DataFrame, job_id=None) -> DataFrame:
    chosen = tickets if job_id is None else tickets.where(F.col("job_id") == job_id)
    return chosen.orderBy("job_id", "created_at", "ticket_id")


def filter_tickets(tickets: DataFrame, platform: str = "all", status: str = "all", query: str = "") -> DataFrame:
    """Platform and status as given, and the query anywhere in id, status or platform."""
    out = tickets
    if platform != "all":
        out = out.where(F.col("platform") == platform)
    if status != "all":
        out = out.where(F.col("status") == status)
    return _search(out, query, ["ticket_id", "status", "platform"]) if query else out


def search_tickets(tickets: DataFrame, query: str) -> DataFrame:
    """The query anywhere in id, status, platform, payload or metadata (JSON texts)."""
    if not query.strip():
        return tickets
    return _search(tickets, query, ["ticket_id", "status", "platform", "payload", "metadata"])


def _search(tickets: DataFrame, query: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for column in columns:
        text = F.coalesce(F.col(column), F.lit("{}")) if column in ("payload", "metadata") else F.col(column)
        hit = hit | F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))
    return tickets.where(hit)


def status_counters(tickets: DataFrame, keys: list[str] = ["job_id"]) -> DataFrame:
    """Tickets per state; a failed dry run counts only where no state before it did."""
    failed = F.col("dry_run") & (F.coalesce(F.get_json_object("metadata", "$.error"), F.lit("")) != "")
    group = (
        F.when(F.col("status") == "New", "new")
        .when(F.col("status") == "In Progress", "in_progress")
        .when(F.col("status").isin("Resolved", "Closed"), "resolved")
        .when(failed, "failed")
    )
    return tickets.withColumn("_group", group).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("_group") == g).alias(g) for g in ("new", "in_progress", "resolved", "failed")],
    )


# Fragments that decide the class of a status, in this order.
STATUS_CLASSES = {
    "progress": ["progress", "working"],
    "resolved": ["resolve", "closed", "done"],
    "failed": ["fail", "error"],
    "dry": ["dry"],
}
# End of fixed values.


def status_class(status: Column) -> Column:
    out = F.lit("other")
    for name, fragments in reversed(STATUS_CLASSES.items()):
        out = F.when(F.lower(status).rlike("|".join(fragments)), name).otherwise(out)
    return out


def tickets_by_platform(tickets: DataFrame) -> DataFrame:
    """Tickets per status class and platform, one column per platform."""
    return (
        tickets.withColumn("status_class", status_class(F.col("status")))
        .groupBy("status_class")
        .pivot("platform", ["servicenow", "jira"])
        .count()
        .na.fill(0)
    )


# ---- templates and field rules --------------------------------------------------------------

# Ticket templates and field rules.
TEMPLATES = {
    ("servicenow", "rca_incident"): {
        "short_description": "RCA Required: {job_name}",
        "description": "An automated RCA job has identified an issue requiring investigation.\n\n"
        "Job ID: {job_id}\nTimestamp: {timestamp}\nSeverity: {severity}\n\nDetails:\n{details}",
        "category": "Software",
        "subcategory": "Application Error",
        "priority": "3",
    },
    ("servicenow", "critical_alert"): {
        "short_description": "Critical Alert: {alert_name}",
        "description": "Critical alert triggered.\n\nAlert: {alert_name}\nTriggered: {timestamp}\n"
        "Severity: Critical\n\n{alert_details}",
        "priority": "1",
        "urgency": "1",
        "impact": "1",
    },
    ("jira", "rca_issue"): {
        "summary": "RCA: {job_name}",
        "description": "h2. Root Cause Analysis Required\\n\\nAn automated RCA job has identified an issue."
        "\\n\\n*Job ID:* {job_id}\\n*Timestamp:* {timestamp}\\n*Severity:* {severity}\\n\\nh3. Details\\n{details}",
        "issue_type": "Incident",
        "priority": "Medium",
        "labels": ["rca", "automated", "investigation"],
    },
    ("jira", "production_incident"): {
        "summary": "Production Incident: {service_name}",
        "description": "h2. Production Service Impacted\\n\\n*Service:* {service_name}\\n*Impact Start:* {start_time}"
        "\\n*Severity:* {severity}\\n\\nh3. Symptoms\\n{symptoms}\\n\\nh3. Next Steps\\n{action_items}",
        "issue_type": "Incident",
        "priority": "Highest",
        "labels": ["production", "incident", "urgent"],
    },
}
FIELD_RULES = {
    "servicenow": {
        "short_description": {"required": True, "max_length": 160},
        "description": {"max_length": 4000},
        "category": {"values": ["Inquiry / Help", "Software", "Hardware", "Network", "Database"]},
        "priority": {"values": ["1", "2", "3", "4", "5"]},
        "state": {"values": ["1", "2", "3", "6", "7", "8"]},
        "impact": {"values": ["1", "2", "3"]},
        "urgency": {"values": ["1", "2", "3"]},
    },
    "jira": {
        "project_key": {"required": True, "pattern": "^[A-Z][A-Z0-9]+$"},
        "summary": {"required": True, "max_length": 255},
        "issue_type": {"values": ["Incident", "Bug", "Task", "Story", "Epic", "Subtask"]},
        "priority": {"values": ["Highest", "High", "Medium", "Low", "Lowest"]},
    },
}
# End of fixed values.


def render(template: str, known: list[str]) -> Column:
    """The template with ``{name}`` replaced by the column of that name; unknown names stay."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for position, piece in enumerate(pieces):
        if position % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in known:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
        else:
            parts.append(F.lit("{" + piece + "}"))
    return F.concat(*parts)


def render_template(rows: DataFrame, platform: str, name: str) -> DataFrame:
    """Adds a ``payload`` struct filled from the row's columns."""
    fields = []
    for field, value in TEMPLATES[platform, name].items():
        if isinstance(value, list):
            fields.append(F.array(*[F.lit(v) for v in value]).alias(field))
        else:
            fields.append(render(value, rows.columns).alias(field))
    return rows.withColumn("payload", F.struct(*fields))


def field_violations(
    rows: DataFrame, platform: str, payload: str = "payload", disabled: frozenset[str] = frozenset()
) -> DataFrame:
    """Adds ``violations`` of the platform's field rules; ``disabled`` fields are not checked.

    Only required fields must be there; other rules look at values that are.
    """
    names = rows.schema[payload].dataType.names
    found = []
    for field, rule in FIELD_RULES[platform].items():
        if field in disabled:
            continue
        value = F.col(f"{payload}.{field}") if field in names else F.lit(None).cast("string")
        if rule.get("required"):
            found.append(F.when(_filled(value).isNull(), F.lit(f"{field}: required")))
        if "max_length" in rule:
            found.append(F.when(F.length(value) > rule["max_length"], F.lit(f"{field}: too long")))
        if "values" in rule:
            found.append(F.when(~_filled(value).isin(rule["values"]), F.lit(f"{field}: not allowed")))
        if "pattern" in rule:
            found.append(F.when(~_filled(value).rlike(rule["pattern"]), F.lit(f"{field}: bad format")))
    return rows.withColumn("violations", F.array_compact(F.array(*found)))
