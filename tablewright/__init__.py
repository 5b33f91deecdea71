"""tablewright: analytics operators as Spark DataFrame and stream functions."""

from tablewright.session import build_session, prepare

__all__ = ["build_session", "prepare"]
