"""quarry: corpus preparation as Spark DataFrame / SQL / Structured Streaming jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` (use it through
``df.transform``) or a reader/writer built on ``spark.read`` / ``df.write``.
"""

from quarry.session import get_session, shared_dir  # noqa: F401

__all__ = ["get_session", "shared_dir"]
