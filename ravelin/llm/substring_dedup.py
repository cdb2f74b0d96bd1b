"""Removal of repeated word sequences over a De Bruijn graph of 20-word edges.

Every window of WINDOW words is an edge of the graph, and a document is a path.
Rows are written to shared storage under a number first, so that every later step
means the same row by it.  The edges of a document are cut into stretches that share a
minimizer (the least hash of the SEED_WORDS-word sequences in the window, common
ones last), and a stretch is shipped as one row to the task of its minimizer.
There equal edges meet, and the first coordinate of each is found.  Later edges
that follow each other, and whose first coordinates follow each other, are one
nonbranching path: pieces of it are found in each task, and pieces on one diagonal
of two documents that adjoin are joined by Spark.

Edges meet by hashes (the 64 bits of the minimizer and 48 of the window's own; inside a
chunk by 64 of the window).  Source coordinates then verify: the pass that removes words
also reads, of every row, the words of its paths and those that others' paths have as
their source, and the SHA-256 of all that name one source must agree with the source's.
Where one does not, all paths are found anew under other hashes.

Texts are dealt with in chunks of some megabytes.  Equal edges inside a chunk are
settled there and only its first is shipped, so an edge that a third of all
documents hold reaches its task once for a chunk at most.  A word sequence that
many different windows share, so that its task would hold them all, is looked for in
a bounded number of rows and used as a minimizer only where a window has no other;
which are found so decides where edges meet, never what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Cut, by_bytes

WINDOW, SEED_WORDS = 20, 4
#: Bytes of text in a chunk, but for a single longer text.
CHUNK = 2_000_000
#: Words whose hashes a worker remembers.
REMEMBER = 300_000
#: Where common minimizers are looked for: files of the written rows, the first rows of each, one window in so many
#: (by its hash); a minimizer of so many distinct ones of these windows is common.
LOOK_FILES, LOOK_ROWS, LOOK_SHARE, COMMON = 64, 1000, 64, 4
#: Paths up to which they are broadcast to the rows; beyond, both sides are exchanged.
BROADCAST_PATHS = 200_000
#: A row's words in whose range sources are asked of one copy of the row (up to 64 copies), so that no list of them is long.
DEAL = 4096
#: Times that paths are found anew under other hashes before giving up.
ATTEMPTS = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words(dict):
    """Hashes of words under a seed."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finishing steps of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def edges(h: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window hash, minimizer) of each WINDOW-word window of the word hashes ``h``.

    Both follow from the window's words and ``common`` alone; a window all of whose
    seeds are common has a minimizer of its own.
    """
    power = lambda n: np.uint64(pow(int(_ODD), n, 1 << 64))
    n, w = len(h), {1: h}
    for k in (1, 2, 4, 8):
        w[2 * k] = w[k][:-k] * power(k) + w[k][k:]
    wide = mix(w[16][: n - WINDOW + 1] * power(4) + w[4][16 : 16 + n - WINDOW + 1])
    low = mix(w[SEED_WORDS] ^ _ODD)
    if common is not None and len(common):
        low = np.where(among(low, common), _TOP, low)
    for k in (1, 2, 4, 8):
        low = np.minimum(low[:-k], low[k:])
    low = np.minimum(low[:-1], low[1:])  # 17 seeds: the last 16 and one more
    return wide, np.where(low == _TOP, mix(wide ^ _ODD), low)


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that begin where ``breaks`` is true."""
    starts = np.flatnonzero(breaks)
    return starts, np.append(starts[1:], len(breaks))


def windows(texts: list[bytes | None], words: Words, common: np.ndarray | None = None):
    """(window hash, minimizer, index of the text, first word) of every window of the texts."""
    hs, which = [], []
    for i, text in enumerate(texts):
        ws = (text or b"").split()
        if len(ws) >= WINDOW:
            hs.append(np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws)))
            which.append(i)
    if not hs:
        none = np.array([], np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sizes = np.array([len(x) for x in hs])
    h = np.concatenate(hs)
    doc = np.repeat(np.array(which), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide, low = edges(h, common)
    valid = np.flatnonzero(doc[: len(wide)] == doc[WINDOW - 1 :])
    return wide[valid], low[valid], doc[valid], place[valid]


_FLOW = "m long, doc long, rid long, pos int, ws binary, len int, src_rid long, src_pos int"
_DIGESTS = pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int32()), ("len", pa.int32()), ("own", pa.bool_()), ("digest", pa.binary())]))
_PATHS = "rid long, pos int, len int, src_rid long, src_pos int"
_KINDS = {"m": pa.int64(), "doc": pa.int64(), "rid": pa.int64(), "pos": pa.int32(), "ws": pa.binary(), "len": pa.int32(), "src_rid": pa.int64(), "src_pos": pa.int32()}


def _flow(n: int, **cols) -> pa.RecordBatch:
    full = [cols[k] if isinstance(cols.get(k), pa.Array) else pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(full, list(_KINDS))


def ship(rid: np.ndarray, ids: list, texts: list[bytes | None], words: Words, common: np.ndarray | None = None) -> list[pa.RecordBatch]:
    """Of a chunk's rows the stretches to send, and the paths settled inside it."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rid[i]))
    wide, low, doc, place = windows([texts[i] for i in order], words, common)
    if not len(wide):
        return []
    rid, ids = rid[order], pa.array([ids[i] for i in order], pa.int64())
    _, first, back = np.unique(wide, return_index=True, return_inverse=True)
    source = first[back]
    out, here = [], np.arange(len(wide))
    later = np.flatnonzero(source != here)
    if len(later):
        d, p, sd, sp = doc[later], place[later], doc[source[later]], place[source[later]]
        s, e = runs(np.append(True, (np.diff(d) != 0) | (np.diff(p) != 1) | (np.diff(sd) != 0) | (np.diff(sp) != 1)))
        # settled paths pass through the same exchange, spread by their place
        spread = mix((np.arange(len(s)) + rid[0]).astype(np.uint64)).view(np.int64)
        out.append(_flow(len(s), m=spread, rid=rid[d[s]], pos=p[s], len=e - s, src_rid=rid[sd[s]], src_pos=sp[s]))
    sent = np.flatnonzero(source == here)
    d, p, m = doc[sent], place[sent], low[sent]
    s, e = runs(np.append(True, (np.diff(d) != 0) | (np.diff(p) != 1) | (m[1:] != m[:-1])))
    raw = wide[sent].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    ws = pa.array([raw[6 * a : 6 * b] for a, b in zip(s.tolist(), e.tolist())], pa.binary())
    out.append(_flow(len(s), m=m[s].view(np.int64), doc=ids.take(pa.array(d[s])), rid=rid[d[s]], pos=p[s], ws=ws))
    return out


def _ship_all(limit: int, seed: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        for part in by_bytes(batches, "text", limit):
            rid = part.column("rid").to_numpy()
            yield from ship(rid, part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), words, common.value)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m, doc, rid, pos): pieces of the paths of later edges.

    A minimizer's rows may span batches; of those before only the first
    coordinate of each distinct edge is held.
    """
    held_m, held = None, None  # minimizer, and its edges' hashes with their first coordinates
    names = _PATHS.replace(" long", "").replace(" int", "").split(", ")
    for batch in batches:
        passing = pc.is_null(batch.column("ws"))
        if pc.any(passing).as_py():
            yield pa.RecordBatch.from_arrays([batch.filter(passing).column(k) for k in names], names)
            batch = batch.filter(pc.invert(passing))
        if not batch.num_rows:
            continue
        ws = batch.column("ws")
        n = pc.binary_length(ws).to_numpy(zero_copy_only=False).astype(np.int64) // 6
        raw = np.zeros((int(n.sum()), 8), np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(ws.to_pylist()), np.uint8).reshape(-1, 6)
        row = np.repeat(np.arange(len(n)), n)
        col = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[row] for k in ("m", "rid", "pos")}
        col["pos"] += np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        col["w"] = raw.view("<u8").ravel().astype(np.uint64)
        extra = 0
        if held is not None and held_m == col["m"][0]:
            extra = len(held["w"])
            col = {k: np.concatenate([held[k], v]) for k, v in col.items()}
        # rows come in order of coordinates within a minimizer, and held ones are earlier: the first of equals is the source
        order = np.lexsort((np.arange(len(col["w"])), col["w"], col["m"]))
        m, w = col["m"][order], col["w"][order]
        head = np.append(True, (m[1:] != m[:-1]) | (w[1:] != w[:-1]))
        source = np.empty(len(order), np.int64)
        source[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        here = np.arange(len(order))
        last = (col["m"] == col["m"][-1]) & (source == here)
        held_m, held = col["m"][-1], {k: v[last] for k, v in col.items()}
        later = np.flatnonzero((source != here) & (here >= extra))
        if not len(later):
            continue
        src = source[later]
        breaks = np.append(True, (np.diff(col["rid"][later]) != 0) | (np.diff(col["rid"][src]) != 0) | (np.diff(col["pos"][later]) != 1) | (np.diff(col["pos"][src]) != 1))
        s, e = runs(breaks)
        a, b = later[s], src[s]
        cols = [col["rid"][a], col["pos"][a], e - s, col["rid"][b], col["pos"][b]]
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, names)], names)


def common_minimizers(stored: Cut, limit: int, seed: int) -> np.ndarray:
    """Minimizers that very many different windows share, in order; COMMON and the rows looked at bound their number."""
    files = sorted(stored.df.inputFiles())
    if not files:
        return np.array([], np.uint64)
    files = files[:: -(-len(files) // LOOK_FILES)]
    rows = stored.spark.read.schema(stored.df.schema).parquet(*files).where(F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)) < LOOK_ROWS).select("rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        for part in by_bytes(batches, "text", limit):
            wide, low, _, _ = windows(part.column("text").cast(pa.binary()).to_pylist(), words)
            looked = np.unique(np.stack([low, wide])[:, wide % np.uint64(LOOK_SHARE) == 0], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(looked[k].view(np.int64)) for k in (0, 1)], ["m", "w"])

    found = rows.mapInArrow(run, "m long, w long").groupBy("m").agg(F.count_distinct("w").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["m"] for r in found.select("m").toLocalIterator()], np.int64).view(np.uint64))


def _compacted(pieces: DataFrame) -> DataFrame:
    """Paths out of their pieces: those that adjoin on a diagonal of two rows are one."""
    diagonal = F.col("pos") - F.col("src_pos")
    here = Window.partitionBy("rid", "src_rid", "diagonal").orderBy("pos")
    starts = F.when(F.lag(F.col("pos") + F.col("len")).over(here) == F.col("pos"), 0).otherwise(1)
    rows = pieces.withColumn("diagonal", diagonal).withColumn("starts", starts).withColumn("path", F.sum("starts").over(here))
    rows = rows.groupBy("rid", "src_rid", "diagonal", "path").agg(F.min("pos").alias("pos"), F.sum("len").cast("int").alias("len"), F.min("src_pos").alias("src_pos"))
    return rows.select("rid", "pos", "len", "src_rid", "src_pos")


def _sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_PATHS else small


def numbered(docs: DataFrame, id_col: str, text_col: str) -> Cut:
    """(rid, id, text, doc) of each row, written once: rid tells rows apart, in order of the scan."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*others).alias("doc"))
    return Cut(rows, codec="zstd")


def repeated_paths(stored: Cut, chunk: int = CHUNK, seed: int = 0) -> Cut:
    """Paths of edges that also start earlier, by hashes of the seed: ``rid`` tells the
    row, ``pos`` the first window, ``len`` the windows; ``src_*`` is where the sequence
    starts first in the chunk or among the chunks' firsts.

    Earlier is a smaller id (null last), then an earlier row, then an earlier word.
    """
    spark, rows = stored.spark, stored.df.select("rid", "id", "text")
    common = spark.sparkContext.broadcast(common_minimizers(stored, chunk, seed))
    sent = rows.mapInArrow(_ship_all(chunk, seed, common), _FLOW)
    pieces = sent.repartition("m").sortWithinPartitions("m", F.asc_nulls_last("doc"), "rid", "pos").mapInArrow(_meet, _PATHS)
    return Cut(_compacted(pieces))


def cover(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words the windows of the spans (first window, windows) cover."""
    step = np.zeros(n + 1, np.int64)
    for pos, count in spans:
        step[pos] += 1
        step[min(n, pos + count + WINDOW - 1)] -= 1
    return np.cumsum(step[:n]) > 0


def _remove(as_is: bool):
    """Rows with their own paths (``own``) and what others' paths begin at (``asked``) to what is kept, and to digests for ``unlike``.

    A row that is asked for much comes several times, one after the other; only its ``first`` carries results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ws = None, []
        told = lambda x: hashlib.sha256(b" ".join(ws[x["pos"] : x["pos"] + x["len"] + WINDOW - 1])).digest()
        for batch in batches:
            at, words, removed, kept, digests = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("rid", "deal", "own", "asked"))
            for i, (rid, deal, own, asked, text) in enumerate(zip(*columns, batch.column("text").cast(pa.binary()))):
                if rid != known:
                    known, ws = rid, (text.as_py() or b"").split()
                met = [{"rid": x["src_rid"], "pos": x["src_pos"], "len": x["len"], "own": True, "digest": told(x)} for x in own or []]
                digests.append(met + [{"rid": rid, "pos": x["pos"], "len": x["len"], "own": False, "digest": told(x)} for x in asked or []])
                if deal:
                    at.append(None)
                    words.append(None)
                    removed.append(None)
                    kept.append(None)
                    continue
                gone = cover(len(ws), [(x["pos"], x["len"]) for x in own]) if own else None
                at.append(i)
                words.append(len(ws))
                removed.append(0 if gone is None else int(gone.sum()))
                if gone is None:
                    kept.append(text.as_py() if as_is else b" ".join(ws))
                else:
                    kept.append(b" ".join([w for w, g in zip(ws, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(at, pa.int64())), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([x is not None for x in at]), pa.array(digests, _DIGESTS)],
                ["doc", "n_words", "n_removed", "kept_text", "first", "digests"],
            )

    return run


def removed(stored: Cut, paths: DataFrame, n: int, as_is: bool = False) -> DataFrame:
    """What ``_remove`` says of every stored row under the n paths."""
    spot = lambda prefix, *more: F.struct(F.col(prefix + "pos").alias("pos"), "len", *more)
    own = paths.select("rid", F.lit(0).cast("long").alias("deal"), spot("", "src_rid", "src_pos").alias("own"), F.lit(None).cast("struct<pos:int,len:int>").alias("asked"))
    sources = paths.select(F.col("src_rid").alias("rid"), F.expr(f"src_pos div {DEAL} % 64").alias("deal"), spot("src_").alias("asked")).distinct()
    # each row that is asked for has a deal 0, which carries its results
    none = F.lit(None).cast(own.schema["own"].dataType)
    dealt = sources.select("rid", "deal", none.alias("own"), "asked")
    first = sources.where("deal > 0").select("rid", F.lit(0).cast("long").alias("deal"), none.alias("own"), F.lit(None).cast(sources.schema["asked"].dataType).alias("asked")).distinct()
    spots = own.unionAll(dealt).unionAll(first).groupBy("rid", "deal").agg(F.collect_list("own").alias("own"), F.collect_list("asked").alias("asked"))
    joined = stored.df.join(_sized(spots, 2 * n), "rid", "left").select("rid", "deal", "own", "asked", "text", "doc")
    kind = stored.df.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(_remove(as_is), f"doc {kind}, n_words long, n_removed long, kept_text string, first boolean, digests array<struct<rid:bigint,pos:int,len:int,own:boolean,digest:binary>>")


def unlike(done: DataFrame, n: int) -> int:
    """How many of the n paths have no source, or stand among other words than their source's, or were not read."""
    told = done.select(F.explode("digests").alias("x")).select("x.*")
    met = told.groupBy("rid", "pos", "len").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.bool_or(~F.col("own")).alias("sourced"), F.count_if("own").alias("paths"))
    right = met.where("sourced AND least = most").agg(F.sum("paths")).head()[0]
    return n - (right or 0)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, as_is: bool = False) -> DataFrame:
    """A row per input row: ``doc`` (a struct of its columns but the text), n_words,
    n_removed and kept_text, the kept words joined by one space; with ``as_is`` a
    text that loses none stays as it was, white space and all.

    A null or empty text has no words and keeps none; texts under WINDOW words lose
    none, and a very long text is a chunk of its own; of repeated rows the later lose
    what the first has; an empty table gives no rows.  Other columns, of any name,
    travel inside ``doc``.
    """
    stored = numbered(docs, id_col, text_col)
    results = ["doc", "n_words", "n_removed", "kept_text"]
    for seed in range(ATTEMPTS):
        paths = repeated_paths(stored, chunk, seed)
        n = paths.df.count()
        if not n:
            return removed(stored, paths.df, n, as_is).select(*results)
        done = Cut(removed(stored, paths.df, n, as_is), codec="zstd")
        paths.drop()
        if not unlike(done.df, n):
            stored.drop()
            return done.df.where("first").select(*results)
        done.drop()
    raise RuntimeError(f"window hashes collided under {ATTEMPTS} seeds")


def oracle() -> str:
    return f"""
    WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
    l AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, rid, i) AS k FROM g) WHERE k > 1),
    c AS (SELECT DISTINCT rid, i + j AS k FROM l, range({WINDOW}) t(j)),
    x AS (SELECT rid, list(k) AS gone FROM c GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda v, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
    FROM w LEFT JOIN x USING (rid)"""
