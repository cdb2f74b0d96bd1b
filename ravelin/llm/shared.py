"""Helpers the corpus operators share: shared-storage cuts, splits, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rows import scratch

#: ASCII white space separates words; every other character belongs to one.
SPACE = r"[\x20\x09-\x0D]+"


class Cut:
    """A DataFrame written to shared storage and read again.

    The new plan starts at files every executor can reach, so it has no lineage
    to recompute and carries no output partitioning: a later join exchanges both
    of its sides, which lets adaptive execution split a hot key.
    """

    def __init__(self, df: DataFrame, codec: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/cut-{uuid.uuid4().hex}"
        (df.write.option("compression", codec) if codec else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for cuts no returned plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    return Cut(df).df


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that nothing may learn from; a null id is false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words_of(text: Column) -> Column:
    """White-space words of a text, natively; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def share(key: Column, salt: str) -> Column:
    """A uniform number in [0, 1) fixed by key and salt: which rows a bounded sample takes."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)


def by_bytes(batches, column: str, limit: int):
    """Batches of about ``limit`` bytes in a string column, but for a single longer row, whatever batches come in."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    total = 0

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        # a row weighs something without text too, so that a chunk has no end of empty ones
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], np.int64) + 16
        at = 0
        while at < len(sizes):
            fit = int(np.searchsorted(np.cumsum(sizes[at:]), limit - total, side="right"))
            if not fit and held:
                yield together()
                held, total = [], 0
                continue
            fit = max(fit, 1)
            # a slice's buffers are those of the whole batch until it is copied
            held.append(batch.slice(at, fit).take(pa.array(np.arange(fit))))
            total += int(sizes[at : at + fit].sum())
            at += fit
    if held:
        yield together()


def by_group(batches, keys: list[str]):
    """Tables of one group each from batches sorted by ``keys``; a group may span batches."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        cuts = [0, *(np.flatnonzero([a != b for a, b in zip(rows[1:], rows)]) + 1).tolist(), len(rows)]
        for s, e in zip(cuts, cuts[1:]):
            if rows[s] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = rows[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)
