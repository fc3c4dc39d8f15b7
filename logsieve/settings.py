"""Arguments of the operators. All are plain values fixed before a plan is built."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

# Results are only comparable when these are kept as they are.
DEFAULT_PII_RULES = [
    "email::[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+",
    "phone::\\b\\+?\\d[\\d\\s().-]{7,}\\b",
    "ssn::\\b\\d{3}-\\d{2}-\\d{4}\\b",
    "credit_card::\\b(?:\\d[ -]*?){13,16}\\b",
    "ip_address::\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b",
]
REDACTION_TOKEN = "[REDACTED]"
SIGNAL_TERMS = ["error", "warning", "critical", "info"]
JOB_MODES = ["rca_analysis", "log_analysis", "embedding_generation"]
JOB_STATUSES = ["pending", "running", "completed", "failed", "cancelled"]
TERMINAL_STATUSES = ["completed", "failed", "cancelled"]
CLOSED_EVENT_TYPES = [
    "created", "queued", "started", "progress", "warning",
    "needs_input", "retry", "completed", "failed", "cancelled",
]
PLATFORMS = ["servicenow", "jira"]
MESSAGE_ROLES = ["system", "user", "assistant"]
DEFAULT_ACTION = "Review the generated summary and log excerpts for next steps."
SYSTEM_PROMPT = "You are an experienced Site Reliability Engineer performing incident triage."
NO_SUMMARY = "No automated summary available."
FAILED_SUMMARY = "Automated analysis unavailable; review file summaries for context."
CHUNK_CHARS = 2000
TOP_KEYWORDS = 10
SAMPLE_LINES = 5
SCAN_BYTES = 4096
PRINTABLE_SHARE = 0.6
HISTOGRAM_BOUNDS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
}
FALLBACK_DIMENSION = 768
SERVICENOW_PRIORITY = {"critical": "1", "high": "2", "moderate": "3", "low": "4"}
JIRA_PRIORITY = {"critical": "Highest", "high": "High", "moderate": "Medium", "low": "Low"}
SERVICENOW_STATES = {
    "1": "New", "2": "In Progress", "3": "On Hold", "4": "Resolved", "6": "Cancelled", "7": "Closed",
}
ALLOWED_TYPES = ("log", "txt", "json", "xml", "csv", "yaml", "yml")
MAX_FILE_MB = 100
WATCH_INCLUDE = ("**/*.log", "**/*.txt", "**/*.json", "**/*.csv")
WATCH_EXCLUDE = ("**/~*", "**/*.tmp")
WATCH_MIME_TYPES = ("text/plain", "application/json")
BATCH_SECONDS = 5
DEBOUNCE_SECONDS = 5
PERIOD_SECONDS = {
    "second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "m": 60,
    "hour": 3600, "h": 3600, "day": 86400, "d": 86400,
}
# End of fixed values.


@dataclass(frozen=True)
class FilePolicy:
    allowed_types: tuple[str, ...] = ALLOWED_TYPES
    max_file_size_mb: int = MAX_FILE_MB

    @property
    def extensions(self) -> list[str]:
        return [ext.lower() for ext in self.allowed_types]

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024


def parse_pii_rules(entries) -> list[tuple[str, str]]:
    """``label::regex`` strings to (label, regex) pairs, in order.

    A blank entry stays as a rule that never matches, an entry without a label is named after its
    position, and an invalid regex is skipped with a warning. Entries are never split on commas.
    """
    rules = []
    for position, entry in enumerate(entries):
        label, mark, regex = entry.strip().partition("::")
        if not mark:
            label, regex = "", label
        label, regex = label.strip() or f"pattern_{position}", regex.strip() or "(?!)"
        try:
            re.compile(regex)
        except re.error as problem:
            warnings.warn(f"PII rule {label!r} skipped: {problem}", stacklevel=2)
            continue
        rules.append((label, regex))
    return rules


@dataclass(frozen=True)
class PrivacyPolicy:
    enabled: bool = True
    entries: tuple[str, ...] = tuple(DEFAULT_PII_RULES)
    token: str = REDACTION_TOKEN

    @property
    def rules(self) -> list[tuple[str, str]]:
        return parse_pii_rules(self.entries) if self.enabled else []


@dataclass(frozen=True)
class ServiceNowDefaults:
    category: str | None = None
    subcategory: str | None = None
    priority: str | None = None
    state: str | None = None
    assignment_group: str | None = None
    configuration_item: str | None = None
    assigned_to: str | None = None


@dataclass(frozen=True)
class JiraDefaults:
    project_key: str | None = None
    issue_type: str = "Incident"
    priority: str | None = None
    labels: tuple[str, ...] = ()
    assignee: str | None = None


@dataclass(frozen=True)
class TicketToggles:
    servicenow_enabled: bool = False
    jira_enabled: bool = False
    dual_mode: bool = False

    @property
    def active_platforms(self) -> list[str]:
        flags = {"servicenow": self.servicenow_enabled, "jira": self.jira_enabled}
        return [name for name, on in flags.items() if on]

    @property
    def dual_tracking(self) -> bool:
        return self.dual_mode and len(self.active_platforms) == 2

    def updated(self, **changes) -> "TicketToggles":
        """A partial update: arguments left out or None keep their value."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def as_list(value) -> list[str] | None:
    """None stays None, a scalar becomes a one-element list."""
    if value is None:
        return None
    items = value if isinstance(value, (list, tuple, set, frozenset)) else [value]
    return [str(item) for item in items]


@dataclass(frozen=True)
class WatchConfig:
    enabled: bool = True
    roots: tuple[str, ...] = ("watch-folder",)
    include_globs: tuple[str, ...] = WATCH_INCLUDE
    exclude_globs: tuple[str, ...] = WATCH_EXCLUDE
    max_file_size_mb: int = MAX_FILE_MB
    allowed_mime_types: tuple[str, ...] = WATCH_MIME_TYPES
    batch_window_seconds: int = BATCH_SECONDS
    debounce_seconds: int = DEBOUNCE_SECONDS
    auto_create_jobs: bool = True

    def updated(self, **changes) -> "WatchConfig":
        lists = {"roots", "include_globs", "exclude_globs", "allowed_mime_types"}
        return replace(self, **{
            k: tuple(as_list(v)) if k in lists else v for k, v in changes.items() if v is not None
        })


@dataclass(frozen=True)
class RateLimit:
    """``limit`` requests per ``seconds``; a limit of 0 means unlimited."""

    limit: int
    seconds: int

    @classmethod
    def parse(cls, spec: str) -> "RateLimit":
        quota, _, period = spec.partition("/")
        try:
            limit = max(int(quota), 0)
        except ValueError:
            return cls(0, 1)
        if not period:
            return cls(0, 1)
        name = period.strip().lower()
        seconds = PERIOD_SECONDS.get(name) or PERIOD_SECONDS.get(name.rstrip("s"), 60)
        return cls(limit, seconds)


def parse_since(value: str | None) -> datetime | None:
    """ISO time; ``Z`` or no zone means UTC; an unreadable value raises ValueError."""
    if not value:
        return None
    moment = datetime.fromisoformat(value.rstrip("Z"))
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment
