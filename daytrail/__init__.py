"""Personal-activity analytics as Spark jobs: plays, location segments and messages."""

from daytrail.session import build_session, prepare

__all__ = ["build_session", "prepare"]
