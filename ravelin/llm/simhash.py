"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has 64 bits; two within ``RADIUS`` = 2 bits agree on at least one
of three bands of bits, so the distinct fingerprints are dealt into shards by the
bits of a band, and every link lies inside a shard.  A shard of more than ``TREE``
fingerprints is dealt again, by three bands of the bits that its fingerprints need not
share, until its trees are small: each turn costs a hot fingerprint three copies, and after
five turns no shard can be large, as too few bits are left to differ.  A shard's tree, whose children are keyed by
their Hamming distance to the parent, is grown in one task and walked with the
shard's fingerprints along the edges that lie within the radius.  What leaves a
task is a spanning forest, never a list of pairs; the components of all forests are
found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Cut, by_group, cut

RADIUS, SEED, SHINGLE = 2, 42, 3
#: Fingerprints of a shard that one tree holds, and free bits with which a shard is always small enough.
TREE, FREE = 2048, 9


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def bands(mask: int) -> list[int]:
    """``mask`` with each of RADIUS + 1 bands of the bits it lacks: within the radius, two that agree on it agree on one of these."""
    free = [1 << k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(free[s:e]) for s, e in zip(cuts, cuts[1:])]


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text's 3-word shingles; 0 where there is no word."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        words, n = [b" ".join(words)], 1
        hashes = [xxhash.xxh64_intdigest(words[0], SEED)]
    else:
        n = len(words) - SHINGLE + 1
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    raw = np.array(hashes, np.uint64)
    for at in range(0, n, 1 << 16):
        part = raw[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > n)
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, keep: Column, text_col: str = "text") -> DataFrame:
    """(keep, fp): the fingerprint of each row as a signed long beside ``keep``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).dictionary_encode()  # copies in a batch count once
            own = np.array([fingerprint(t) for t in texts.dictionary.to_pylist()] + [0], np.uint64).view(np.int64)
            at = texts.indices.to_numpy(zero_copy_only=False) if not texts.indices.null_count else texts.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own[at.astype(np.int64)])], ["keep", "fp"])

    rows = docs.select(keep.alias("keep"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"keep {rows.schema['keep'].dataType.simpleString()}, fp long")


class Forest:
    """Union of indices by relabelling; cheap where most are already together."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, one: int, many: np.ndarray) -> None:
        seen = self.label[many]
        low = min(int(seen.min()), int(self.label[one]))
        if self.label[one] != low or (seen != low).any():
            old = np.union1d(seen, self.label[one])
            self.label[np.isin(self.label, old)] = low


def walk(tree: np.ndarray, queries: np.ndarray, shift: int, forest: Forest) -> None:
    """Join every tree point with every query within RADIUS.

    The tree is grown and searched in one descent: a node's first point is its
    key, the others fall into children by their distance to it, and the queries
    follow each child whose distance lies within RADIUS of their own.  Tree point
    i is index i of the forest, query j is index shift + j.
    """
    todo = [(np.arange(len(tree)), np.arange(len(queries)))]
    while todo:
        points, asked = todo.pop()
        own = np.bitwise_count(queries[asked] ^ tree[points[0]])
        near = asked[own <= RADIUS]
        if len(near):
            forest.join(int(points[0]), near + shift)
        rest = points[1:]
        if not len(rest):
            continue
        away = np.bitwise_count(tree[rest] ^ tree[points[0]])
        for d in np.unique(away).tolist():
            follow = asked[(own >= d - RADIUS) & (own <= d + RADIUS)]
            if len(follow):
                todo.append((rest[away == d], follow))


def shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, value), shard by shard: spanning edges (a, b) of each."""
    for _, rows in by_group(batches, ["mask", "value"]):
        signed = rows.column("fp").to_numpy()
        forest = Forest(len(signed))
        points = signed.view(np.uint64)
        walk(points, points, 0, forest)
        moved = np.flatnonzero(forest.label != np.arange(len(points)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[forest.label[moved]])], ["a", "b"])


def shards(distinct: DataFrame) -> DataFrame:
    """(fp, mask, value): shards of 2 to TREE fingerprints (or of FREE free bits) that hold every link of the distinct ones."""
    masks, out = bands(0), None
    rows = distinct.select("fp", F.explode(F.array([F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        keyed = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        counts = Cut(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")).df
        hot = (F.col("n") > TREE) & (F.bit_count("mask") < 64 - FREE)
        joined = keyed.join(counts, ["mask", "value"])
        ready = joined.where(~hot).select("fp", "mask", "value")
        out = ready if out is None else out.unionAll(ready)
        if counts.where(hot).isEmpty():
            return out
        finer = {m: bands(m) for m in masks}
        to = F.create_map([x for m, own in finer.items() for x in (F.lit(_signed(m)), F.array([F.lit(_signed(o)) for o in own]))])
        rows = cut(joined.where(hot).select("fp", F.explode(to[F.col("mask")]).alias("mask")))
        masks = sorted({o for own in finer.values() for o in own})


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` within RADIUS."""
    return shards(distinct).repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(shard_links, "a long, b long")


def link(docs: DataFrame, key: Column, text_col: str = "text") -> DataFrame:
    """(keep, fp, n_copies, least) of each row: its key, fingerprint, rows of that
    fingerprint, and the smallest key linked with it through any number of links."""
    found = cut(fingerprints(docs, key, text_col))
    distinct = cut(found.groupBy("fp").agg(F.min("keep").alias("least"), F.count("*").alias("n_copies")))
    roots = cut(components(links(distinct)))
    named = cut(roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("least").alias("name")))
    linked = cut(roots.join(named, "root").select(F.col("node").alias("fp"), "name", F.lit(True).alias("linked")))
    least = F.when(F.col("linked"), F.col("name")).otherwise(F.col("least"))
    names = cut(distinct.join(linked, "fp", "left").select("fp", "n_copies", least.alias("least")))
    return found.join(names, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, fingerprint, component_id, n_copies.

    component_id is the smallest doc_id linked, through any number of links, with
    the row, itself included; rows with a null id have a fingerprint and links but
    give no name (null where nothing else does).  A null or empty text has the
    fingerprint zero and is linked like any other; texts count whole, however long; repeated rows keep a row each;
    an empty table gives no rows.  Only the two named columns are read.  ``n_copies`` counts the rows of the same
    fingerprint.
    """
    fingerprint_hex = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return link(docs, F.col(id_col), text_col).select(F.col("keep").alias("doc_id"), fingerprint_hex, F.col("least").alias("component_id"), "n_copies")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest id, then the first in the scan."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("doc"))
    # written once, so that both readings mean one row by a number
    stored = Cut(rows, codec="zstd").df
    own = F.col(f"doc.`{id_col}`")
    key = F.struct(own.isNull().alias("unnamed"), own.alias("id"), F.col("rid"))
    stay = link(stored, key, f"doc.`{text_col}`").where("keep <=> least").select(F.col("keep.rid").alias("rid"))
    return stored.join(stay, "rid", "left_semi").select("doc.*")
