"""Log triage and incident analytics as PySpark DataFrame operators."""

from logsieve.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
