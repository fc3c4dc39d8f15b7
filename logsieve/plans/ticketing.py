"""Queries over tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.ordering import numbered, time_bucket
from logsieve.operators import rollup, tickets
from logsieve.plans.registry import query
from logsieve.plans.views import table, view, with_views
from logsieve.settings import JiraDefaults, ServiceNowDefaults, TicketToggles

_AS_OF = "2024-02-01T00:00:00+00:00"
_JIRA = JiraDefaults(project_key="OPS", labels=("rca", "automated"))
_BOTH = TicketToggles(True, True, True)


def outcome_rows(spark, sf_dir):
    """Findings per file and day as ticket input, with gaps of every kind."""
    rated = rollup.add_severity(view(spark, sf_dir, "outcomes"))
    return rated.select(
        "job_id", "file_id",
        F.when(F.col("file_id") % 2 == 0, F.col("severity")).alias("severity"),
        F.when(F.col("file_id") % 3 != 0, F.concat(F.lit("Findings of "), "job_id", F.lit(": "), F.repeat(F.lit("check "), F.lit(50)))).alias("summary"),
        F.create_map(
            F.lit("lines"), F.col("lines"), F.lit("errors"), F.col("errors"), F.lit("warnings"), F.col("warnings"),
            F.lit("critical"), F.col("critical"),
        ).alias("metrics"),
        F.when(F.col("errors") > 0, F.array(F.lit("Escalate"), F.lit("Inspect the handler"))).alias("recommended_actions"),
        F.when(F.col("file_id") % 5 != 0, rollup.categories(F.lit("log_analysis"))).alias("categories"),
        F.when(F.col("file_id") % 10 == 0, "Network").alias("category"),
        F.when(F.col("file_id") % 4 != 0, F.array(F.lit("incident"), F.concat(F.lit("file-"), "file_id"))).alias("tags"),
    )


_OUT = """
    , o AS (SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN errors > 0 THEN 'high' WHEN warnings > 0 THEN 'moderate'
              ELSE 'low' END AS severity, CASE WHEN file_id % 3 <> 0 THEN 'Findings of ' || job_id || ': ' || repeat('check ', 50)
              ELSE 'RCA outcome for job ' || job_id END AS summary FROM outcomes),
      t AS (SELECT *, '- lines: ' || lines || chr(10) || '- errors: ' || errors || chr(10) || '- warnings: ' || warnings || chr(10)
              || '- critical: ' || critical AS metric_lines,
            CASE WHEN errors > 0 THEN '- Escalate' || chr(10) || '- Inspect the handler' END AS bullets,
            CASE WHEN file_id % 5 <> 0 THEN CASE WHEN errors > 0 THEN 'error-detected' ELSE 'log_analysis' END
                 WHEN file_id % 10 = 0 THEN 'Network' END AS cat FROM o),
      sn AS (SELECT job_id, file_id, severity, substr(summary, 1, 160) AS short_description,
              concat_ws(chr(10), 'Job ID: ' || job_id, 'Severity: ' || severity, '', 'Summary: ' || summary, '', 'Key Metrics:',
                metric_lines, '', 'Recommended Actions:', coalesce(bullets, 'No immediate actions recorded.')) AS description,
              coalesce(cat, 'Software') AS category, CASE severity WHEN 'critical' THEN '1' WHEN 'high' THEN '2' WHEN 'moderate'
                THEN '3' ELSE '4' END AS priority, '1' AS state, '' AS assignment_group FROM t),
      jr AS (SELECT job_id, file_id, 'OPS' AS project_key, 'Incident' AS issue_type, substr(summary, 1, 255) AS summary,
              concat_ws(chr(10), 'h2. Root Cause Analysis Summary for Job ' || job_id, '', '*Severity:* ' || severity, '', '*Summary:*',
                summary, '', '*Key Metrics:*', metric_lines, CASE WHEN bullets IS NOT NULL THEN chr(10) || '*Recommended Actions:*'
                || chr(10) || bullets END) AS description,
              array_to_string(list_sort(CASE WHEN file_id % 4 <> 0 THEN ['incident', 'file-' || file_id, 'rca', 'automated']
                ELSE ['rca', 'automated'] END), ',') AS labels,
              CASE severity WHEN 'critical' THEN 'Highest' WHEN 'high' THEN 'High' WHEN 'moderate' THEN 'Medium' ELSE 'Low' END AS priority
             FROM t)"""
_SN = ServiceNowDefaults(category="Software")


@query("ticket_severity", "O-TKT-01", with_views("outcomes", f"{_OUT} SELECT job_id, severity FROM o"))
def ticket_severity(spark, sf_dir):
    return outcome_rows(spark, sf_dir).select("job_id", tickets.ticket_severity().alias("severity"))


@query("ticket_servicenow", "O-TKT-02", with_views("outcomes", f"""{_OUT}
    SELECT job_id, short_description, description, category, priority, state, assignment_group FROM sn"""))
def ticket_servicenow(spark, sf_dir):
    made = tickets.servicenow_payload(outcome_rows(spark, sf_dir), _SN)
    return made.select("job_id", *[
        f"payload.{c}" for c in ("short_description", "description", "category", "priority", "state", "assignment_group")
    ])


@query("ticket_jira", "O-TKT-03", with_views("outcomes", f"""{_OUT}
    SELECT job_id, project_key, issue_type, summary, description, labels, priority FROM jr"""))
def ticket_jira(spark, sf_dir):
    made = tickets.jira_payload(outcome_rows(spark, sf_dir), _JIRA)
    return made.select(
        "job_id", *[f"payload.{c}" for c in ("project_key", "issue_type", "summary", "description", "priority")],
        F.array_join("payload.labels", ",").alias("labels"),
    )


@query("ticket_overrides", "O-TKT-04", with_views("outcomes", f"""{_OUT}
    SELECT job_id, CASE WHEN file_id % 2 = 0 THEN 'P' || file_id ELSE priority END AS priority,
           CASE WHEN file_id % 7 = 0 THEN '' ELSE category END AS category,
           CASE WHEN file_id % 2 = 0 THEN 'vip' END AS caller, state FROM sn"""))
def ticket_overrides(spark, sf_dir):
    """Overrides that are absent, null, empty or new."""
    text = F.expr("""CASE WHEN file_id % 14 = 0 THEN concat('{"priority":"P', file_id, '","category":"","caller":"vip"}')
        WHEN file_id % 2 = 0 THEN concat('{"priority":"P', file_id, '","category":null,"caller":"vip"}')
        WHEN file_id % 7 = 0 THEN '{"category":""}' END""")
    made = tickets.servicenow_payload(outcome_rows(spark, sf_dir), _SN).withColumn(
        "overrides", F.from_json(text, "priority string, category string, caller string")
    )
    return tickets.apply_overrides(made).select(
        "job_id", *[f"payload.{c}" for c in ("priority", "category", "caller", "state")]
    )


def _answers(spark, sf_dir):
    """What the platforms answered: most calls succeed, some fail, some were never made."""
    asked = view(spark, sf_dir, "outcomes").select("job_id", "file_id").withColumn(
        "platform", F.explode(F.array(F.lit("servicenow"), F.lit("jira")))
    ).where("file_id % 11 <> 0")
    ok = F.col("file_id") % 5 != 0
    incident = F.col("platform") == "servicenow"
    return asked.select(
        "job_id", "platform",
        F.when(ok, F.concat(F.when(incident, "INC-").otherwise("OPS-"), "job_id")).alias("remote_id"),
        F.when(ok & incident, tickets.incident_url("https://itsm.example.com/", F.col("job_id")))
        .when(ok, tickets.issue_url("https://issues.example.com", F.concat(F.lit("OPS-"), "job_id"))).alias("remote_url"),
        F.when(ok & incident, "New").alias("remote_status"),
        F.when(~ok, "503: unavailable").alias("error"),
    )


_TICKETED = f"""{_OUT},
      a AS (SELECT o.job_id, file_id, platform, nr, file_id % 11 <> 0 AND file_id % 5 <> 0 AS real FROM o,
            (VALUES ('servicenow', 1), ('jira', 2)) AS p(platform, nr)),
      tk AS (SELECT job_id, file_id, platform, nr AS dispatch_order, NOT real AS dry_run,
        CASE WHEN real AND nr = 1 THEN 'INC-' || job_id WHEN real THEN 'OPS-' || job_id
             ELSE platform || '-' || substr(sha256(job_id || '|' || platform || '|{_AS_OF}'), 1, 8) END AS ticket_id,
        CASE WHEN real AND nr = 1 THEN 'https://itsm.example.com/nav_to.do?uri=incident.do?sys_id=' || job_id
             WHEN real THEN 'https://issues.example.com/browse/OPS-' || job_id END AS url,
        CASE WHEN NOT real THEN 'dry-run' WHEN nr = 1 THEN 'New' ELSE 'created' END AS status,
        CASE WHEN file_id % 11 = 0 THEN platform || ' integration is not configured. Provide credentials to enable creation.'
             WHEN file_id % 5 = 0 THEN '503: unavailable' END AS error,
        CASE WHEN real AND nr = 2 THEN 'INC-' || job_id END AS linked_ticket_id FROM a)"""


@query("ticket_dispatch", "O-TKT-06 O-TKT-07", with_views("outcomes", f"""{_TICKETED}
    SELECT job_id, platform, dispatch_order, dry_run, ticket_id, url, status, error FROM tk"""))
def ticket_dispatch(spark, sf_dir):
    made = tickets.dispatch(
        outcome_rows(spark, sf_dir), _answers(spark, sf_dir), _BOTH, _AS_OF, servicenow=_SN, jira=_JIRA
    )
    return made.select("job_id", "platform", "dispatch_order", "dry_run", "ticket_id", "url", "status", "error")


@query("ticket_dispatch_preview", "O-TKT-06", with_views("outcomes", f"""{_OUT}
    SELECT job_id, 'jira' AS platform, true AS dry_run, 'dry-run' AS status, 'preview' AS dry_run_reason FROM o
    UNION ALL SELECT job_id, 'servicenow', true, 'dry-run', 'feature-toggle-disabled' FROM o"""))
def ticket_dispatch_preview(spark, sf_dir):
    """A preview on the enabled platform, and a real call on the one that is switched off."""
    rows, answers = outcome_rows(spark, sf_dir), _answers(spark, sf_dir)
    only_jira = TicketToggles(jira_enabled=True)
    previews = tickets.dispatch(rows, answers, only_jira, _AS_OF, dry_run=True, jira=_JIRA)
    ready = tickets.servicenow_payload(rows, _SN).select(
        "job_id", F.lit("servicenow").alias("platform"), F.to_json("payload").alias("payload"),
        F.lit(None).cast("string").alias("profile_name"),
    )
    disabled = tickets.create_tickets(ready, answers, only_jira, _AS_OF)
    shown = ["job_id", "platform", "dry_run", "status", "dry_run_reason"]
    return previews.select(shown).unionByName(disabled.select(shown))


@query("ticket_dual_link", "O-TKT-08", with_views("outcomes", f"""{_TICKETED}
    SELECT tk.job_id, linked_ticket_id, CASE WHEN linked_ticket_id IS NULL AND tk.file_id % 2 = 0 THEN 'Own text'
        WHEN linked_ticket_id IS NULL THEN jr.description
        WHEN tk.file_id % 2 = 0 THEN 'Own text' || chr(10) || chr(10) || 'Linked ServiceNow Incident: ' || linked_ticket_id
        ELSE 'Linked ServiceNow Incident: ' || linked_ticket_id END AS description
    FROM tk JOIN jr USING (job_id) WHERE platform = 'jira'"""))
def ticket_dual_link(spark, sf_dir):
    own = F.struct(F.when(F.col("file_id") % 2 == 0, "Own text").alias("description"))
    made = tickets.dispatch(
        outcome_rows(spark, sf_dir).withColumn("jira_overrides", own), _answers(spark, sf_dir), _BOTH, _AS_OF,
        servicenow=_SN, jira=_JIRA,
    )
    return made.where("platform = 'jira'").select(
        "job_id", "linked_ticket_id", F.get_json_object("payload", "$.description").alias("description")
    )


@query("ticket_created_events", "O-TKT-11", with_views("outcomes", f"""{_TICKETED}
    SELECT job_id, 'ticket-created' AS event_type, '{{"ticket_id":"' || ticket_id || '","platform":"' || platform
           || '","status":"' || status || '","dry_run":' || dry_run || '}}' AS data FROM tk"""))
def ticket_created_events(spark, sf_dir):
    return tickets.created_ticket_events(tickets.dispatch(
        outcome_rows(spark, sf_dir), _answers(spark, sf_dir), _BOTH, _AS_OF, servicenow=_SN, jira=_JIRA
    ))


SYNC_SQL = with_views("tickets", """
    , s AS (SELECT l_orderkey AS k, max_by(CAST(l_quantity AS INT) % 9, (l_shipdate, l_linenumber, l_partkey, l_extendedprice)) AS code FROM lineitem GROUP BY 1),
      m AS (SELECT t.*, s.code FROM tickets t LEFT JOIN s ON regexp_replace(ticket_id, '[A-Z-]+', '') = CAST(k AS VARCHAR))
    SELECT ticket_id, CASE WHEN dry_run OR code IS NULL THEN status WHEN platform = 'jira' THEN CASE WHEN code = 0 THEN status
             ELSE 'Jira ' || code END
           WHEN code = 0 THEN status WHEN code = 1 THEN 'New' WHEN code = 2 THEN 'In Progress' WHEN code = 3 THEN 'On Hold'
           WHEN code = 4 THEN 'Resolved' WHEN code = 6 THEN 'Cancelled' WHEN code = 7 THEN 'Closed'
           WHEN code = 5 THEN '5' ELSE '8' END AS status,
           NOT dry_run AND code IS NOT NULL AS synced FROM m""")


def remote_snapshots(spark, sf_dir):
    """Line items as snapshots of the ticket of their order; ``version`` tells those of one day apart."""
    rows = table(spark, sf_dir, "lineitem").withColumn("code", F.col("l_quantity").cast("int") % 9)
    incident = F.col("l_orderkey") % 2 == 0
    raw = F.expr("""CASE WHEN code = 0 THEN '{"number":"x"}'
        WHEN l_orderkey % 2 = 0 THEN concat('{"state":"', code, '"}')
        ELSE concat('{"fields":{"status":{"name":"Jira ', code, '"}}}') END""")
    return rows.select(
        F.when(incident, "servicenow").otherwise("jira").alias("platform"),
        F.concat(F.when(incident, "INC").otherwise("OPS-"), F.col("l_orderkey")).alias("ticket_id"),
        raw.alias("raw"), F.col("l_shipdate").alias("seen_at"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("version"),
    )


@query("ticket_sync", "O-TKT-09", SYNC_SQL)
def ticket_sync(spark, sf_dir):
    """Line items as snapshots of the ticket of their order; the last shipped is the latest."""
    seen = remote_snapshots(spark, sf_dir).withColumn("seen_at", F.struct("seen_at", "version"))
    synced = tickets.sync_status(view(spark, sf_dir, "tickets"), seen)
    return synced.select("ticket_id", "status", F.col("sync_raw").isNotNull().alias("synced"))


@query("ticket_list", "O-TKT-10", with_views("tickets", """
    SELECT job_id, ticket_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, ticket_id) AS nth FROM tickets"""))
def ticket_list(spark, sf_dir):
    """Tickets of every job, oldest first; the place is worked out without one task per job."""
    listed = tickets.job_tickets(view(spark, sf_dir, "tickets"))
    return numbered(listed, ["job_id"], ["created_at", "ticket_id"], time_bucket("created_at", "month"), "nth").select(
        "job_id", "ticket_id", "nth"
    )


@query("ticket_template", "O-TKT-12", with_views("outcomes", """
    SELECT job_id, 'RCA Required: nightly-' || file_id AS short_description, 'An automated RCA job has identified an issue requiring investigation.'
           || chr(10) || chr(10) || 'Job ID: ' || job_id || chr(10) || 'Timestamp: ' || day || chr(10) || 'Severity: {severity}'
           || chr(10) || chr(10) || 'Details:' || chr(10) || errors || ' errors' AS description,
           'RCA: nightly-' || file_id AS summary, 'rca,automated,investigation' AS labels FROM outcomes"""))
def ticket_template(spark, sf_dir):
    """Two of the templates; a variable nobody knows stays in the text."""
    rows = view(spark, sf_dir, "outcomes").select(
        "job_id", F.concat(F.lit("nightly-"), "file_id").alias("job_name"), F.col("day").alias("timestamp"),
        F.concat("errors", F.lit(" errors")).alias("details"),
    )
    incident = tickets.render_template(rows, "servicenow", "rca_incident")
    return tickets.render_template(incident.withColumnRenamed("payload", "sn"), "jira", "rca_issue").select(
        "job_id", "sn.short_description", "sn.description", "payload.summary",
        F.array_join("payload.labels", ",").alias("labels"),
    )


@query("ticket_field_rules", "O-TKT-13", with_views("outcomes", f"""{_OUT}
    SELECT job_id, concat_ws('; ', CASE WHEN file_id % 3 = 0 AND file_id % 2 = 0 THEN 'short_description: required' END,
             CASE WHEN length(description) > 400 THEN NULL END,
             CASE WHEN category NOT IN ('Software', 'Network') THEN 'category: not allowed' END) AS incident_violations,
           CASE WHEN file_id % 2 = 0 THEN 'project_key: bad format' ELSE '' END AS issue_violations FROM sn"""))
def ticket_field_rules(spark, sf_dir):
    made = tickets.servicenow_payload(outcome_rows(spark, sf_dir), _SN)
    gap = (F.col("file_id") % 3 == 0) & (F.col("file_id") % 2 == 0)
    made = made.withColumn("payload", F.col("payload").withField(
        "short_description", F.when(gap, "").otherwise(F.col("payload.short_description"))
    ))
    checked = tickets.field_violations(made, "servicenow").withColumnRenamed("violations", "incident_violations")
    issues = tickets.jira_payload(checked, _JIRA).withColumn("payload", F.col("payload").withField(
        "project_key", F.when(F.col("file_id") % 2 == 0, "ops").otherwise("OPS")
    ))
    return tickets.field_violations(issues, "jira").select(
        "job_id", F.array_join("incident_violations", "; ").alias("incident_violations"),
        F.array_join("violations", "; ").alias("issue_violations"),
    )


@query("ticket_jira_request", "O-TKT-14", with_views("outcomes", f"""{_OUT}
    SELECT job_id, CASE WHEN file_id % 6 = 0 THEN 'Jira project key is required to create an issue' END AS reject_reason,
           CASE WHEN file_id % 6 <> 0 THEN 'OPS' END AS project, CASE WHEN file_id % 6 <> 0 THEN priority END AS priority,
           CASE WHEN file_id % 6 <> 0 AND file_id % 2 = 0 THEN 'oncall' END AS assignee,
           CASE WHEN file_id % 6 <> 0 THEN '10' || file_id END AS custom, CASE WHEN file_id % 6 <> 0 THEN 'api' END AS component,
           CASE WHEN file_id % 6 <> 0 THEN 'Blocks' END AS link FROM jr"""))
def ticket_jira_request(spark, sf_dir):
    made = tickets.jira_payload(outcome_rows(spark, sf_dir), _JIRA).select("job_id", "file_id", "payload.*").withColumns({
        "project_key": F.when(F.col("file_id") % 6 != 0, F.col("project_key")),
        "assignee": F.when(F.col("file_id") % 2 == 0, "oncall"),
        "custom_fields": F.struct(F.concat(F.lit("10"), "file_id").alias("customfield_10001")),
        "components": F.array(F.struct(F.lit("api").alias("name"))),
        "issue_links": F.array(F.struct(F.struct(F.lit("Blocks").alias("name")).alias("type"))),
    })
    sent = tickets.jira_request(made)

    def part(path):
        return F.get_json_object("body", path)

    return sent.select(
        "job_id", "reject_reason", part("$.fields.project.key").alias("project"),
        part("$.fields.priority.name").alias("priority"), part("$.fields.assignee.name").alias("assignee"),
        part("$.fields.customfield_10001").alias("custom"), part("$.fields.components[0].name").alias("component"),
        part("$.update.issuelinks[0].add.type.name").alias("link"),
    )


@query("ticket_servicenow_request", "O-TKT-15", with_views("outcomes", f"""{_OUT}
    SELECT job_id, '' AS assignment_group, priority, 'Server' AS subcategory, 'ops' AS assigned_to FROM sn"""))
def ticket_servicenow_request(spark, sf_dir):
    """Fields the payload has, even as empty texts, are left alone."""
    made = tickets.servicenow_payload(outcome_rows(spark, sf_dir), _SN)
    names = [n for n in made.schema["payload"].dataType.names if n not in ("subcategory", "assigned_to")]
    defaults = ServiceNowDefaults(assignment_group="desk", subcategory="Server", priority="5", assigned_to="ops")
    body = tickets.servicenow_request(F.col("payload"), names, defaults)
    return made.select("job_id", body.alias("b")).select(
        "job_id", "b.assignment_group", "b.priority", "b.subcategory", "b.assigned_to"
    )


@query("ticket_filter", "O-TKT-16", with_views("tickets", """
    SELECT job_id, ticket_id, status FROM tickets WHERE platform = 'jira' AND status = 'Resolved'
      AND (contains(lower(ticket_id), 's-1') OR contains(lower(status), 's-1') OR contains(platform, 's-1'))"""))
def ticket_filter(spark, sf_dir):
    found = tickets.filter_tickets(view(spark, sf_dir, "tickets"), "jira", "Resolved", "S-1")
    return found.select("job_id", "ticket_id", "status")


@query("ticket_search", "O-TKT-17", with_views("tickets", """
    SELECT job_id, ticket_id FROM tickets WHERE contains(lower(payload), 'urgent') OR contains(lower(metadata), 'urgent')
      OR contains(lower(ticket_id), 'urgent') OR contains(lower(status), 'urgent')"""))
def ticket_search(spark, sf_dir):
    return tickets.search_tickets(view(spark, sf_dir, "tickets"), "URGENT").select("job_id", "ticket_id")


@query("ticket_counters", "O-TKT-18", with_views("tickets", """
    SELECT job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'New') AS BIGINT) AS new,
           CAST(count(*) FILTER (status = 'In Progress') AS BIGINT) AS in_progress,
           CAST(count(*) FILTER (status IN ('Resolved', 'Closed')) AS BIGINT) AS resolved,
           CAST(count(*) FILTER (dry_run AND metadata <> '{}') AS BIGINT) AS failed FROM tickets GROUP BY job_id"""))
def ticket_counters(spark, sf_dir):
    return tickets.status_counters(view(spark, sf_dir, "tickets"))


@query("ticket_by_platform", "O-TKT-19", with_views("tickets", """
    , c AS (SELECT platform, CASE WHEN lower(status) LIKE '%progress%' THEN 'progress' WHEN status IN ('Resolved', 'Closed', 'Done')
              THEN 'resolved' WHEN status LIKE '%fail%' THEN 'failed' WHEN status LIKE '%dry%' THEN 'dry' ELSE 'other' END AS status_class FROM tickets)
    SELECT status_class, CAST(count(*) FILTER (platform = 'servicenow') AS BIGINT) AS servicenow,
           CAST(count(*) FILTER (platform = 'jira') AS BIGINT) AS jira FROM c GROUP BY status_class"""))
def ticket_by_platform(spark, sf_dir):
    return tickets.tickets_by_platform(view(spark, sf_dir, "tickets"))


@query("ticket_profiles", "O-TKT-20", with_views("outcomes", f"""{_OUT}
    SELECT job_id, 'profile-' || file_id % 40 AS profile_name, CASE WHEN file_id % 40 < 25 AND file_id % 40 % 2 = 0
           THEN 'Group NATION_' || file_id % 40 ELSE '' END AS assignment_group, state FROM sn"""))
def ticket_profiles(spark, sf_dir):
    """Nations as profiles; the odd ones belong to the other platform."""
    profiles = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("profile-"), "n_nationkey").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, "servicenow").otherwise("jira").alias("platform"),
        F.to_json(F.struct(F.concat(F.lit("Group "), "n_name").alias("assignment_group"))).alias("defaults"),
    )
    rows = tickets.servicenow_payload(outcome_rows(spark, sf_dir), _SN).withColumn(
        "profile_name", F.concat(F.lit("profile-"), F.col("file_id") % 40)
    )
    made = tickets.apply_profile(rows, profiles, "assignment_group string", "servicenow")
    return made.select("job_id", "profile_name", "payload.assignment_group", "payload.state")
