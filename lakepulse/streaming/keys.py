"""What makes two messages of a queue the same."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Queues that compare contents, and the interval within which a message counts once.
CONTENT_QUEUES = ("analytics",)
DEDUP_MS = 300_000


def dedup_key(content_queues: Collection[str] = CONTENT_QUEUES) -> Column:
    """The sender's id; without one the content, on queues that compare it, or else the message's own id."""
    content = F.when(F.col("queue").isin(*content_queues), F.sha2("body", 256))
    return F.coalesce("dedup_id", content, "message_id")
