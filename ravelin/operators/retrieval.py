"""Lexical and vector retrieval: postings, BM25, exact names first, cosine, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import terms_of
from ..sources.rows import materialise

K1, B = 1.2, 0.75
#: Terms of queries, each counted for each query, and queries that a task holds; more are joined.
WANTED, QUERIES = 1_000_000, 20_000
#: Terms, and scores of documents and queries, that a task has at once.
CELLS = 1 << 21


def ascii_terms(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, lower-cased: no Python."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def postings(docs: DataFrame, id_col: str, text_col: str, native: bool = True) -> DataFrame:
    """(id, term, tf, length): how often each term stands in each text of how many terms."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    terms = docs.select(F.col(f"`{id_col}`").alias("id"), (ascii_terms(text) if native else terms_of(text)).alias("terms"))
    rows = terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return rows.groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query: str = "text", doc_id: str = "doc_id", text: str = "text", native: bool = True) -> DataFrame:
    """The k best documents of each query: query_id, doc_id, score, rank.

    Only terms that some query has are counted in documents.  Scores are summed to
    six decimals, so that ties do not depend on the order of addition; ties go to
    the smaller doc_id.  A document's length counts all its terms.
    """
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.explode(F.array_distinct(ascii_terms(F.col(f"`{query}`")) if native else terms_of(F.col(f"`{query}`")))).alias("term"))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    terms = source.select("doc_id", (ascii_terms(F.col("t")) if native else terms_of("t")).alias("terms"))
    pairs = asked.limit(WANTED + 1).toArrow()
    index = _Index(pairs.column("query_id"), pairs.column("term"), k) if pairs.num_rows <= WANTED else None
    if index is None or len(index.ids) > QUERIES:
        return _joined(asked, terms, k)
    # texts are read once: how often each of the terms asked for stands in them is kept
    shared = asked.sparkSession.sparkContext.broadcast(index)
    kind = T.StructType([T.StructField("doc_id", terms.schema["doc_id"].dataType), *(T.StructField(c, t) for c, t in (("words", T.IntegerType()), ("code", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.IntegerType()))))])
    kept = materialise(terms.mapInArrow(lambda batches: shared.value.encode(batches), kind))
    n, most, mean = kept.groupBy("doc_id").agg(F.count("*").alias("c"), F.sum("words").alias("w")).agg(F.sum("c"), F.max("c"), F.sum("w") / F.sum("c")).first()
    rows = kept.where(F.size("code") > 0).select("doc_id", "code", "tf", F.expr("array_repeat(words, size(code))").alias("length"))
    if (most or 0) > 1:  # rows of one id are one document, whose terms are counted for each length
        each = kept.select("doc_id", "words", F.explode(F.arrays_zip("code", "tf")).alias("x")).groupBy("doc_id", "words", "x.code").agg(F.sum("x.tf").cast("int").alias("tf"))
        rows = materialise(each.groupBy("doc_id").agg(F.collect_list(F.struct("code", "tf", F.col("words").alias("length"))).alias("x")).select("doc_id", "x.code", "x.tf", "x.length"))
    df = rows.select(F.explode("code").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    found = df.select("code", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).toArrow()  # a number a term
    idf = np.zeros(len(index.terms))
    idf[found.column("code").to_numpy()] = found.column("idf").to_numpy()
    weights = asked.sparkSession.sparkContext.broadcast((idf, mean))
    kind = T.StructType([asked.schema["query_id"], terms.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return top(rows.sortWithinPartitions("doc_id").mapInArrow(lambda batches: shared.value.best(batches, *weights.value), kind), k)


def _joined(asked: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``bm25`` of more queries than a task can hold, by joins: terms that are asked for become rows."""
    terms = materialise(terms.select("doc_id", F.size("terms").alias("length"), "terms"))
    corpus = terms.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    found = terms.select("doc_id", "length", F.explode("terms").alias("term")).groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf")).join(asked.select("term").distinct(), "term")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weighed = found.join(df, "term").join(F.broadcast(corpus)).select("doc_id", "term", F.round(weight * 1e6).cast("long").alias("w"))
    scored = asked.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("w"))
    return top(scored.select("query_id", "doc_id", (F.col("w") / 1e6).alias("score")), k)


class _Index:
    """The terms of all queries and the queries of each term; a task counts terms in texts with it, and scores texts."""

    def __init__(self, query: pa.ChunkedArray, term: pa.ChunkedArray, k: int):
        self.k, q, t = k, *(c.combine_chunks().dictionary_encode("encode") for c in (query, term))
        self.ids, self.terms = q.dictionary, t.dictionary
        order = np.argsort(t.indices.to_numpy(), kind="stable")
        self.asked = q.indices.to_numpy()[order].astype(np.int64)
        self.many = np.bincount(t.indices.to_numpy(), minlength=len(self.terms))
        self.start = np.cumsum(self.many) - self.many

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, words, code, tf): texts as the numbers of the terms asked for, each once."""
        wanted = pa.array(self.terms)
        for batch in batches:
            words = batch.column("terms").value_lengths().to_numpy()
            at = 0
            while at < len(words):
                size = max(1, int(np.searchsorted(np.cumsum(words[at:]), CELLS, side="right")))
                part = batch.slice(at, size)
                code = pc.index_in(part.column("terms").flatten(), value_set=wanted)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), words[at : at + size])[known]
                key, tf = np.unique(doc * len(wanted) + code.drop_null().to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * len(wanted)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % max(1, len(wanted)), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words[at : at + size].astype(np.int32)), *lists], ["doc_id", "words", "code", "tf"])
                at += size

    def best(self, batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score): the k best of a task's documents, which come in order of their ids."""
        n, k = len(self.ids), self.k
        score, ref, ids = np.full((n, k), -1.0), np.full((n, k), -1), None
        for batch in batches:
            ids = pa.concat_arrays([*([] if ids is None else [ids]), batch.column("doc_id")])
            base, sizes = len(ids) - batch.num_rows, batch.column("code").value_lengths().to_numpy()
            code, tf, length = (batch.column(c).flatten().to_numpy() for c in ("code", "tf", "length"))
            weight = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            # whole parts of 1e-6, and a little that tells a score of none from no common term
            weight = np.floor(weight * 1e6 + 0.5) + 2.0**-20
            ends = np.append(0, np.cumsum(sizes))
            work = np.append(0, np.cumsum(self.many[code]))[ends]
            at = 0
            while at < len(sizes):
                size = max(1, min(CELLS // n, int(np.searchsorted(work[at + 1 :] - work[at], CELLS, side="right"))))
                part = slice(ends[at], ends[min(at + size, len(sizes))])
                docs = len(sizes[at : at + size])
                many = self.many[code[part]]
                doc = np.repeat(np.repeat(np.arange(docs), sizes[at : at + size]), many)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query = self.asked[np.repeat(self.start[code[part]], many) + nth]
                sums = np.bincount(doc * n + query, weights=np.repeat(weight[part], many), minlength=docs * n).reshape(docs, n)
                least = score[:, -1] + 1.0
                if at + base == 0 and docs > k:
                    least = np.maximum(least, np.floor(np.partition(sums, -k, axis=0)[-k]))
                i, j = np.nonzero((sums >= least) & (sums > 0))
                if len(i):
                    held, to = np.unique(j, return_inverse=True)
                    to = np.append(np.repeat(np.arange(len(held)), k), to)
                    value, where = np.append(score[held].ravel(), np.floor(sums[i, j])), np.append(ref[held].ravel(), base + at + i)
                    order = np.lexsort((where, -value, to))
                    first = order[(np.searchsorted(to[order], np.arange(len(held)))[:, None] + np.arange(k)).ravel()]
                    score[held], ref[held] = value[first].reshape(-1, k), where[first].reshape(-1, k)
                at += docs
            used = np.unique(ref[ref >= 0])
            ids = ids.take(pa.array(used))
            ref = np.where(ref >= 0, np.searchsorted(used, ref), -1)
        if ids is not None:
            at, nth = np.nonzero(ref >= 0)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(at)), ids.take(pa.array(ref[at, nth])), pa.array(score[at, nth] / 1e6)], ["query_id", "doc_id", "score"])


def top(scored: DataFrame, k: int) -> DataFrame:
    """Rank (query_id, doc_id, score) by score, then doc_id; Spark keeps k a partition before it exchanges."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_first(queries: DataFrame, names: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Cards whose name or alias is the query, then by score, then by id.

    queries: (query_id, name); names: (doc_id, name), names and aliases alike, both
    normalised the same way.
    """
    exact = queries.join(names.distinct(), "name").select("query_id", "doc_id").distinct().withColumn("exact", F.lit(True))
    both = scored.join(exact, ["query_id", "doc_id"], "full").withColumns({"exact": F.coalesce("exact", F.lit(False)), "score": F.coalesce("score", F.lit(0.0))})
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "doc_id")
    return both.select("query_id", "doc_id", "score", "exact", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, to nine decimals; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.round(dot(a, b) / size, 9))


def among(cards: DataFrame, kinds: Sequence[str] = (), tables: Sequence[str] = (), roots: Sequence[str] = (), scope: str | None = None, without: DataFrame | None = None) -> DataFrame:
    """Cards (doc_id, kind, table_name, root, scope) that a search may find; nothing said, nothing left out.

    A scope admits its own cards and those of none.  ``without`` holds doc_ids, as a frame of any
    size.  It goes before the scores, so that the k best are of these.
    """
    for column, wanted in (("kind", kinds), ("table_name", tables), ("root", roots)):
        cards = cards.where(F.col(column).isin(*wanted)) if wanted else cards
    cards = cards.where(F.col("scope").isNull() | (F.col("scope") == scope)) if scope is not None else cards
    return cards.join(without.select("doc_id"), "doc_id", "left_anti") if without is not None else cards


#: Queries that ``nearest`` compares with all vectors.
MOST_QUERIES = 10_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors of highest cosine for each of a short list of queries, itself left out.

    The list is broadcast; one of more than ``MOST_QUERIES`` is refused.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("__q"))
    v = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("__v"))
    pairs = v.join(F.broadcast(q), F.col("doc_id") != F.col("query_id")).select("query_id", "doc_id", cosine(F.col("__q"), F.col("__v")).alias("score"))
    return top(pairs.where("score IS NOT NULL"), k)


#: Queries that a task of ``neighbours`` holds, queries and candidates whose cosines it has at once, parts that a larger table is cut into at least, and tasks.
BLOCK, ASKED, MET, PARTS, TASKS = 32768, 2048, 1024, 8, 64


def _exact(q: np.ndarray, c: np.ndarray, qn: np.ndarray, cn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``cosine`` of pairs of columns of q and c, products added in order of the axes; a score that is no number is the largest."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 18):
        a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        total = np.zeros(len(a))
        for x, y in zip(q, c):
            total += x[a] * y[b]
        nines = total / (qn[a] * cn[b]) * 1e9
        out[at : at + len(a)] = np.trunc(nines + np.copysign(0.5, nines)) / 1e9
    return np.where(np.isnan(out), np.inf, out)


class Asked:
    """A block of queries and the k best candidates met so far.

    Products of single precision decide which pairs are still open, with more slack
    than their error; only these get the exact score that ranks them.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.k, (self.v, self.size, self.unit) = ids, k, self.shape(v)
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.slack = (v.shape[1] + 8) * 2.0**-23 + 1e-8

    @staticmethod
    def shape(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, lengths and unit vectors; a length out of range has a unit vector of no numbers, so its pairs stay open."""
        columns, square = np.ascontiguousarray(v.T), np.zeros(len(v))
        for x in columns:
            square += x * x
        size = np.sqrt(square)
        fair = (square > 1e-200) & (square < 1e200)
        return columns, size, np.where(fair[:, None], v / np.where(fair, size, 1.0)[:, None], np.nan).astype(np.float32)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        # of equal vectors those of the k + 1 smallest ids can be among the best
        _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((ids, same))
        same, ids = same[order], ids[order]
        new = np.diff(same, prepend=-1) != 0
        other = np.cumsum(new | (np.diff(ids, prepend=ids[:1]) != 0))
        near = other - np.repeat(other[new], np.diff(np.append(np.flatnonzero(new), len(ids)))) <= self.k
        order, ids = order[near], ids[near]
        columns, size, unit = self.shape(v[order])
        for at in range(0, len(ids), MET):
            part = slice(at, at + MET)
            for first in range(0, len(self.ids), ASKED):
                self._step(slice(first, first + ASKED), ids[part], columns[:, part], size[part], unit[part])

    def _step(self, rows: slice, ids: np.ndarray, columns: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        rough, mine, least = self.unit[rows] @ unit.T, self.ids[rows], self.score[rows, -1]
        if len(ids) > self.k and (least == -np.inf).any():
            rough[mine[:, None] == ids[None, :]] = -np.inf
            known = np.where(np.isnan(rough), -np.inf, rough)
            least = np.maximum(least, np.partition(known, -self.k, axis=1)[:, -self.k] - self.slack)
        # what is no number is not smaller
        i, j = np.nonzero(~(rough < (least - self.slack).astype(np.float32)[:, None]))
        other = mine[i] != ids[j]
        i, j = i[other], j[other]
        score = _exact(self.v[:, rows], columns, self.size[rows], size, i, j)
        good = score >= self.score[rows, -1][i]
        i, j, score = i[good], j[good], score[good]
        if not len(i):
            return
        held, to = np.unique(i, return_inverse=True)
        n = len(held)
        to = np.append(np.repeat(np.arange(n), self.k), to)
        score = np.append(self.score[rows][held].ravel(), score)
        doc = np.append(self.found[rows][held].ravel(), ids[j])
        order = np.lexsort((doc, -score, to))
        best = order[(np.searchsorted(to[order], np.arange(n))[:, None] + np.arange(self.k)).ravel()]
        self.score[rows.start + held], self.found[rows.start + held] = score[best].reshape(n, -1), doc[best].reshape(n, -1)

    def rows(self) -> pa.RecordBatch:
        at, nth = np.nonzero(self.score > -np.inf)
        score = self.score[at, nth]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.found[at, nth]), pa.array(np.where(score == np.inf, np.nan, score))], ["query_id", "doc_id", "score"])


def _meeting(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asked = None, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if cells[s] != cell:
                    if asked:
                        yield asked.rows()
                    cell, held, asked = cells[s], [], None
                part = batch.slice(s, e - s)
                ids, v = part.column("id").to_numpy(), part.column("v").flatten().to_numpy().astype(float).reshape(e - s, -1)
                met = part.column("met").to_numpy(zero_copy_only=False)
                if not met.all():
                    held.append((ids[~met], v[~met]))
                if met.any() and (held or asked):
                    if not asked:
                        asked, held = Asked(*map(np.concatenate, zip(*held)), k), []
                    asked.meet(ids[met], v[met])
        if asked:
            yield asked.rows()

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            yield from run(batches)

    return quiet


def neighbours(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors of highest cosine for each vector, itself left out: query_id, doc_id, score, rank.

    All pairs of one dimension are compared.  Vectors are dealt into blocks of queries
    and shards of candidates, and each block meets each shard in a task, which holds the
    block and takes the shard batch by batch.  A row without an id or a length, or with a
    null component, takes no part; ids are whole numbers, ties go to the smaller.
    """
    v, kind = F.col("v"), vectors.schema[id_col].dataType
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull()))
    rows = rows.where(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0).withColumn("dim", F.size(v))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(PARTS, -(-n // ASKED)))
    shards = max(1, -(-min(TASKS, blocks * blocks) // blocks))
    hashed = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(parts))
    sent = lambda met, cells: rows.select("dim", F.explode(cells).alias("cell"), F.lit(met).alias("met"), "id", "v")
    asked = sent(False, F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: hashed("block", blocks) * shards + s))
    shard = sent(True, F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * shards + hashed("shard", shards)))
    # a number for each cell of one dimension
    both = asked.unionAll(shard).withColumn("cell", F.col("dim").cast("long") * (blocks * shards) + F.col("cell"))
    met = both.repartition(blocks * shards, "cell").sortWithinPartitions("cell", "met").select("cell", "met", "id", "v")
    found = met.mapInArrow(_meeting(k), "query_id long, doc_id long, score double")
    return top(found.select(F.col("query_id").cast(kind).alias("query_id"), F.col("doc_id").cast(kind).alias("doc_id"), "score"), k)


def fuse(ranked: list[DataFrame], k: int, offset: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists; the sum is kept to twelve decimals."""
    rows = ranked[0].select("query_id", "doc_id", "rank")
    for r in ranked[1:]:
        rows = rows.unionByName(r.select("query_id", "doc_id", "rank"))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (offset + F.col("rank"))), 12).alias("score"))
    return top(scored, k)


def hashed_weights(docs: DataFrame, id_col: str, text_col: str, dims: int = 256, native: bool = True) -> DataFrame:
    """(id, bucket, weight): texts as unit vectors of signed term counts, terms dealt to ``dims`` buckets by MD5.

    It needs no model and is the same everywhere; any other (id, bucket, weight)
    may take its place in ``rerank``.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    terms = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(ascii_terms(text) if native else terms_of(text)).alias("term"))
    digest = F.md5("term")
    bucket = (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.substring(digest, 7, 1) < "8", 1).otherwise(-1)
    counts = terms.select("id", bucket.alias("bucket"), sign.alias("s")).groupBy("id", "bucket").agg(F.sum("s").alias("n")).where("n != 0")
    size = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy("id")))
    return counts.select("id", "bucket", (F.col("n") / size).alias("weight"))


#: Ids of candidates that are sent to all tasks; more meet the texts in a join.
SENT = 1_000_000


def named(docs: DataFrame, candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that some candidate (doc_id) names."""
    ids = materialise(candidates.select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= SENT else ids, id_col, "left_semi")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, doc_id) by the cosine of their vectors (id, bucket, weight); only candidates are compared."""
    q = queries.select(F.col("id").alias("query_id"), "bucket", F.col("weight").alias("qw"))
    d = docs.select(F.col("id").alias("doc_id"), "bucket", F.col("weight").alias("dw"))
    scored = candidates.select("query_id", "doc_id").distinct().join(d, "doc_id").join(q, ["query_id", "bucket"])
    # whole parts of 1e-9, so that sums do not depend on their order
    part = F.round(F.col("qw") * F.col("dw") * 1e9).cast("long")
    return top(scored.groupBy("query_id", "doc_id").agg((F.sum(part) / 1e9).alias("score")), k)
