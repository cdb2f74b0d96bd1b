"""Spark settings sized to the input and the cluster."""

from __future__ import annotations

#: Bytes that a shuffle task and a scan task should handle.
SHUFFLE_TASK, SCAN_TASK = 128 << 20, 128 << 20


def settings(input_bytes: int, cores: int, shuffled: float = 1.0, executor_memory: int = 8 << 30, executor_cores: int = 4) -> dict[str, str]:
    """Settings for an input of so many bytes of which ``shuffled`` times as many are exchanged.

    Shuffle partitions keep a task near SHUFFLE_TASK, but never leave cores idle and
    never take more of an executor than a quarter of a core's share of its memory;
    adaptive execution joins the small ones and splits the skewed ones.
    """
    if input_bytes < 0 or cores < 1 or executor_cores < 1:
        raise ValueError("sizes are not negative and there is a core at least")
    task = min(SHUFFLE_TASK, max(16 << 20, executor_memory // executor_cores // 4))
    partitions = max(cores, -(-int(input_bytes * shuffled) // task))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(max(4 << 20, min(SCAN_TASK, input_bytes // cores if input_bytes else SCAN_TASK))),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task // 2),
        "spark.sql.session.timeZone": "UTC",
    }
