import pytest

from ravelin.session import settings


def test_partitions_grow_with_the_input_and_fill_the_cores():
    small, large = settings(10 << 20, 8), settings(100 << 40, 4000)
    assert small["spark.sql.shuffle.partitions"] == "8" and int(small["spark.sql.files.maxPartitionBytes"]) == 4 << 20
    assert int(large["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)
    assert int(settings(1 << 40, 8, executor_memory=2 << 30)["spark.sql.shuffle.partitions"]) == 8192
    with pytest.raises(ValueError):
        settings(1, 0)
