"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on at most ``FIT_PER_LANGUAGE`` learnable documents of each
language, taken by a hash of their id; their n-gram counts are summed by Spark.
The log-probability matrix, of ``BUCKETS`` rows and a column a language, is sent
to the executors.  A batch of texts is scored as one sparse structure: the bucket
of every n-gram and where each document's n-grams begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_out, share

BUCKETS, GRAMS = 1 << 15, (1, 2, 3)
#: Documents of a language that the model is fitted on, about, at most.
FIT_PER_LANGUAGE = 3000
#: Languages that one model may tell apart; its matrix then has 64 MB.
MOST_LANGUAGES = 500
#: Added to every count.
SMOOTH = 0.5
#: N-grams' worth of evidence that the score, not the decision, may rest on.
EVIDENCE = 60
#: Characters scored together, but for a single longer text; cutting them into n-grams takes some 130 bytes a character.
TOGETHER = 250_000
_LETTER = regex.compile(r"\p{L}")


def _fold() -> np.ndarray:
    """For each code point of the basic plane: itself in lower case if a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    def __init__(self):
        self.fold = _fold()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, starts): the n-gram buckets of all texts in turn and where each text's begin."""
        lens = np.array([len(t) + 1 for t in texts])
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < (1 << 16), self.fold[np.minimum(codes, (1 << 16) - 1)], codes)
        # a space after a space says nothing: such n-grams fall away, so layout does not count
        keep = np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))
        doc = np.repeat(np.arange(len(texts)), lens)
        codes, doc = codes[keep], doc[keep]
        found, of = [], []
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint32(0x01000193)
            h = (h ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            if n in GRAMS:
                mixed = h ^ (h >> np.uint32(15))
                found.append((mixed * np.uint32(0x85EBCA77) >> np.uint32(17)).astype(np.int32))
                of.append(doc[: len(h)] if n == 1 else np.where(doc[: len(h)] == doc[n - 1 :], doc[: len(h)], -1))
        buckets, of = np.concatenate(found), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        order = order[np.searchsorted(of[order], 0) :]
        return buckets[order], np.searchsorted(of[order], np.arange(len(texts) + 1))


def parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER characters of text."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if len(group) else [0]
    for s, e in zip(edges, edges[1:]):
        yield batch.slice(s, e - s)


class Model:
    """languages in order, and their log-probabilities: priors and BUCKETS x languages."""

    def __init__(self, languages: list[str], docs: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.prior = np.log(docs / docs.sum()) if len(docs) else docs
        smooth = counts + SMOOTH
        self.matrix = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows where ``learn`` holds and the language is not null.

    More than ``MOST_LANGUAGES`` different labels are an error: such a column holds something else.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    known = known.where("learn AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}  # a row a language
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.array([]), np.zeros((BUCKETS, 0)))
    rate = F.create_map([F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, FIT_PER_LANGUAGE / n))])
    sample = known.where(share(F.col("i"), "langid") < rate[F.col("lang")]).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), {}
        for batch in batches:
            for part in parts(batch, 1):
                buckets, starts = grams(part.column(1).to_pylist())
                for lang, s, e in zip(part.column(0).to_pylist(), starts, starts[1:]):
                    total[lang] = total.get(lang, 0) + np.bincount(buckets[s:e], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    counts = np.zeros((BUCKETS, len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    for r in summed.toLocalIterator():  # BUCKETS rows a language, at most
        counts[r["bucket"], place[r["lang"]]] = r["n"]
    return Model(languages, np.array([sizes[x] for x in languages], float), counts)


def identify(docs: DataFrame, model: Model, keep: Column, text_col: str = "text") -> DataFrame:
    """(keep, lang_pred, score) of each row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; else the likelier language by all n-grams and the prior, ties to the
    smaller name, and its posterior on at most EVIDENCE n-grams' worth of the
    text's evidence, which a strong prior of another language can hold under a half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = shared.value, Grams()
        for batch in batches:
            for part in parts(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                if m.languages:
                    buckets, starts = grams(texts)
                    n = np.maximum(np.diff(starts), 1)
                    total = np.empty((len(texts), len(m.languages)))
                    for k in range(len(m.languages)):  # sums of floats in one order, whatever the batch
                        ends = np.append(0, np.cumsum(m.matrix[buckets, k], dtype=np.float64))
                        total[:, k] = np.round((ends[starts[1:]] - ends[starts[:-1]]) / n, 9)
                    log = total * np.minimum(n, EVIDENCE)[:, None] + m.prior
                    best = (total * n[:, None] + m.prior).argmax(axis=1)
                    top = log.max(axis=1)
                    post = np.exp(log[np.arange(len(texts)), best] - top) / np.exp(log - top[:, None]).sum(axis=1)
                    for i, t in enumerate(texts):
                        if _LETTER.search(t):
                            lang[i], score[i] = m.languages[best[i]], post[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["keep", "lang_pred", "score"])

    rows = docs.select(keep.alias("keep"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows with an id that is not held out and a language; rows with a
    null id teach nothing and are predicted.  Repeated rows keep a row each, and
    further columns are not read.
    """
    out = held_out(F.col(id_col))
    model = fit(docs, ~out & F.col(id_col).isNotNull(), id_col, text_col, lang_col)
    found = identify(docs, model, F.col(id_col), text_col).withColumnRenamed("keep", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
