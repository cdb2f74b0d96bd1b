"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, pattern voters, lexicons mined from
labelled rows (whole words, word beginnings, and beginnings dense in a text, that
stand almost only in toxic texts, dealt into ``FAMILIES`` voters), and a voter that
speaks where no other does.  A generative label model estimates by
expectation-maximisation how often each voter speaks given the hidden label, hence
how far it is right; the correlation of voters given the label is estimated too, and a voter counts
the less the more it repeats others.  A voter that is silent says nothing.  Known
labels are no votes: they weigh in as ``ANCHOR`` of the rows where rates are
estimated, so that the hidden label is toxicity and not some other thing that voters
share, and what a row's posterior is follows from its votes.  A linear classifier is trained
on the posterior labels, and its output set to the labels' scale.

The model is fitted on at most ``FIT`` labelled rows of each label, the first by a
hash of the id, with whole texts.  A row of it weighs as much as its label has
learnable rows for each in the sample, so that the share of toxic rows, and with
it what a mined feature must show and what a score means, is that of the table
and not of the sample.  Every feature that passes its test is kept.  All texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, held_out

#: Labelled rows, clean and toxic, that the model is fitted on, at most.
FIT = (6000, 3000)
#: Voters that the mined features are dealt to.
FAMILIES = 12
#: What the known labels weigh against the rows' own posteriors where rates are estimated.
ANCHOR = 0.3
#: A mined feature is at least so pure, and its log-likelihood ratio against standing in texts at random so high:
#: chance takes hardly any feature so far, however many there are.
PURITY, SURE = 0.8, 25.0
#: Lengths of word beginnings.
PREFIXES = (4, 5, 6, 7)
#: Words of a text for one occurrence of a beginning that is dense in it; it occurs twice at least.
DENSE = 150
#: Least score that is predicted toxic.
CUTOFF = 0.3

#: Insults in the four languages of the corpus.
LEXICONS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting imbecile vermin freak retard bastard bitch whore slut asshole fuck fucking shit cunt".split(),
    "de": "idiot idioten trottel dumm dummkopf arschloch abschaum schlampe hure scheiße verpiss wichser missgeburt versager".split(),
    "fr": "idiot idiote imbécile crétin connard connasse salope pute merde abruti ordure débile".split(),
    "es": "idiota imbécil estúpido estúpida pendejo cabrón puta mierda basura gilipollas asqueroso inútil".split(),
}
#: Patterns of abuse.
PATTERNS = {
    "address": r"\byou(?:'re| are)? (?:an? |such an? |all )?(?:idiot|moron|loser|clown|scum|trash|pathetic|stupid|worthless|disgusting)",
    "wish": r"\b(?:kill yourself|go die|drop dead|hope you die|shut up)\b",
    "masked": r"\b(?:f[*@#]+ck|s[*@#]+t|b[*@#]+ch|id[1!]ot|st[*u]p[1!]d|m0r[o0]n)\b",
}
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(p, re.IGNORECASE) for p in PATTERNS.values()]
_LEXICONS = [frozenset(x) for x in LEXICONS.values()]


def fixed_votes(text: str, words: set[str]) -> list[bool]:
    return [not words.isdisjoint(x) for x in _LEXICONS] + [p.search(text) is not None for p in _PATTERNS]


def features(text: str) -> tuple[set[str], set[str], set[str]]:
    """The distinct lower-case words of a text, their beginnings (marked -), and the beginnings dense in it (marked +)."""
    found = _WORD.findall(text.lower())
    words = set(found)
    starts = Counter([w[:n] for w in found if len(w) > 4 for n in PREFIXES if len(w) > n])
    least = max(2, -(-len(found) // DENSE))
    return words, {x + "-" for x in starts}, {x + "+" for x, n in starts.items() if n >= least}


@dataclass
class Model:
    place: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(_LEXICONS) + len(_PATTERNS) + 1))
    scale: tuple[float, float] = (0.0, -4.0)

    def row(self, text: str) -> list[int]:
        """Places of the features that stand in a text: mined ones, then fixed votes."""
        sets = features(text)
        words = sets[0]
        found = sorted({self.place[f] for s in sets for f in s & self.place.keys()})
        n = len(self.place)
        return found + [n + k for k, v in enumerate(fixed_votes(text, words)) if v]

    def score(self, text: str) -> float:
        logit = float(self.weights[self.row(text)].sum() + self.weights[-1])
        a, b = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30))))


def label_model(votes: np.ndarray, start: np.ndarray, anchor: float = 0.0, rounds: int = 60, mass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, each voter's rates by label and vote, conditional correlations).

    votes: rows x voters of 1 (toxic), 0 (clean), -1 (silent); start: first posterior, which
    goes on to count as ``anchor`` of the rows in rates and prior; mass: what each row weighs, 1 on average.
    """
    post = start.astype(float)
    mass = np.ones(len(post)) if mass is None else mass
    heard = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)  # vote, row, voter
    signed = votes.astype(float)
    for _ in range(rounds):
        held = post + anchor * start
        rates = np.stack([np.einsum("vrj,r->jv", heard, w) + 0.5 for w in (mass * (1 + anchor - held), mass * held)])
        rates /= rates.sum(axis=2, keepdims=True)
        expect = rates[:, :, 2] - rates[:, :, 0]
        rest = signed - (1 - post)[:, None] * expect[0] - post[:, None] * expect[1]
        weighed = rest * mass[:, None]
        spread = np.sqrt((rest * weighed).mean(axis=0)) + 1e-9
        corr = (rest.T @ weighed) / len(rest) / np.outer(spread, spread)
        weight = 1 / (1 + np.clip(np.abs(corr) - np.eye(len(corr)) - 0.1, 0, None).sum(axis=0))
        say = np.log(rates[1] / rates[0]) * weight[:, None]  # voter, vote
        say[:, 0] = 0
        prior = np.clip((mass * held).mean() / (1 + anchor), 0.01, 0.99)
        log = np.log(prior / (1 - prior)) + np.einsum("vrj,jv->r", heard, say)
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-6:
            break
    return post, rates, corr


class Sparse:
    """Rows of ones at ``places``; a last column, the bias, has a one in every row."""

    def __init__(self, places: list[list[int]], width: int):
        self.at = np.fromiter((k for x in places for k in x), np.int64)
        self.row = np.repeat(np.arange(len(places)), [len(x) for x in places])
        self.rows, self.width = len(places), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], minlength=self.rows) + w[-1]

    def turned(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, v[self.row], minlength=self.width), v.sum())

    def any_of(self, group: np.ndarray, groups: int) -> np.ndarray:
        """rows x groups: does a place of the group stand in the row?"""
        out = np.zeros((self.rows, groups), bool)
        out[self.row, group[self.at]] = True
        return out


def linear(x: Sparse, y: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Ridge logistic regression on soft labels by accelerated gradient steps; bias last."""
    u = np.ones(x.width + 1)
    for _ in range(50):  # the largest singular value bounds the curvature
        u = x.turned(x.times(u / np.linalg.norm(u)))
    step = 4.0 / (1.05 * np.linalg.norm(u) + 4 * ridge)
    w = v = np.zeros(x.width + 1)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(v), -30, 30)))
        new = v - step * (x.turned(p - y) + ridge * np.append(v[:-1], 0))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def platt(logit: np.ndarray, gold: np.ndarray, rounds: int = 100, mass: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit + b) fitted to the labels, each class smoothed by a row; Newton steps, halved while they do not help."""
    mass = np.ones(len(gold)) if mass is None else mass
    n1 = (mass * gold).sum()
    y = np.where(gold == 1, (n1 + 1) / (n1 + 2), 1 / (mass.sum() - n1 + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((mass * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * w[0] ** 2)

    w = np.array([0.5, 0.0])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (mass * (p - y)) + np.array([0.1 * w[0], 0])
        move = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6]), g)
        step = 1.0
        while step > 1e-4 and loss(w - step * move) > now:
            step /= 2
        new = loss(w - step * move)
        if new >= now - 1e-9:
            break
        w, now = w - step * move, new
    return float(max(w[0], 0.0)), float(w[1])


def _featured(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [sorted(set().union(*features(t or ""))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    return sample.mapInArrow(run, "toxic int, found array<string>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out; a document whose labels disagree teaches nothing."""
    i = F.col(id_col)
    known = labels.where(i.isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(i)).groupBy(i.alias("i"))
    known = known.agg(F.min(label_col).cast("int").alias("toxic"), F.max(label_col).alias("most")).where("toxic = most")
    # a label without its document is no learnable row
    known = cut(known.join(docs.select(i.alias("i")), "i", "left_semi").select("i", "toxic"))
    true = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("toxicity"), "i"), "i").limit(FIT[y]) for y in (0, 1)]
    picked = cut(pick[0].unionAll(pick[1]).select("i", "toxic"))  # sum(FIT) rows at most
    text = docs.select(i.alias("i"), F.col(text_col).cast("string").alias("text"))
    # an id that stands twice teaches once, by the first of its texts in order
    sample = cut(text.join(F.broadcast(picked), "i").groupBy("i", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    base = true[1] / (true[0] + true[1])
    # of a row of the sample, by label; 1 on average, as the sample's evidence is that of its own size
    mass = [true[y] / sizes[y] * (sizes[0] + sizes[1]) / (true[0] + true[1]) for y in (0, 1)]
    mined = _featured(sample).select("toxic", F.explode("found").alias("f")).groupBy("f").agg((F.count_if(F.col("toxic") == 1) * F.lit(mass[1])).alias("p"), (F.count_if(F.col("toxic") == 0) * F.lit(mass[0])).alias("n"))
    pure = F.col("p") / (F.col("p") + F.col("n"))
    sure = F.col("p") * F.log(pure / base) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - pure) / (1 - base))).otherwise(0)
    # a feature has to stand in a dozen rows of the sample or so: their number is bounded by the sample's texts
    names = sorted(r["f"] for r in mined.where((pure >= PURITY) & (sure >= SURE)).select("f").collect())
    model = Model({f: k for k, f in enumerate(names)})
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.row(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["toxic", "at"])

    got = sorted((r["toxic"], list(r["at"])) for r in sample.mapInArrow(rows, "toxic int, at array<int>").collect())
    fixed = len(_LEXICONS) + len(_PATTERNS)
    x = Sparse([at for _, at in got], len(names) + fixed)
    gold = np.array([y for y, _ in got])
    voter = np.array([sum(f[:4].encode()) % FAMILIES for f in names] + list(range(FAMILIES, FAMILIES + fixed)), int)
    speak = x.any_of(voter, FAMILIES + fixed)
    votes = np.hstack([np.where(speak, 1, -1), np.where(speak.any(axis=1), -1, 0)[:, None]])
    post, _, _ = label_model(votes, gold, ANCHOR, mass=np.array(mass)[gold])
    # the label's share moves the bias only, which the scale sets anew
    model.weights = linear(x, post)
    model.scale = platt(x.times(model.weights), gold, mass=np.array(mass)[gold])
    return model


def score(docs: DataFrame, model: Model, keep: Column, text_col: str = "text") -> DataFrame:
    """(keep, score, predicted) of each row; a null or empty text gets the score of one in which nothing is found."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = np.array([m.score(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= CUTOFF).astype(np.int32))], ["keep", "score", "predicted"])

    rows = docs.select(keep.alias("keep"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, score double, predicted int")


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, held_out, score, predicted.

    Rows with a null id teach nothing and are scored; repeated rows are scored
    each and teach once; without labels of both kinds every score is low; an empty
    table gives no rows.  Texts are read whole, however long.  Other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col)
    found = score(docs, model, F.col(id_col), text_col).withColumnRenamed("keep", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
