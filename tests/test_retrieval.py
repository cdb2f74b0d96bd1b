"""Retrieval over whole tables: all pairs of vectors, and texts scored where they lie."""

import math

import numpy as np

from ravelin import queries
from ravelin.operators import retrieval


def _score(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return round(dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))), 9)


def _brute(vectors, k):
    out = set()
    for q, a in vectors:
        met = sorted((-_score(a, b), c) for c, b in vectors if c != q and len(b) == len(a) and any(a) and any(b))
        out |= {(q, c, rank) for rank, (_, c) in enumerate(met[:k], 1)}
    return out


def test_every_vector_is_asked(spark, monkeypatch):
    rng = np.random.default_rng(5)
    same = rng.normal(size=6).tolist()
    vectors = [(n, same if n % 4 == 1 else rng.normal(size=6 if n % 9 else 3).tolist()) for n in range(150)] + [(900, [0.0] * 6), (901, [1e-120] + [0.0] * 5)]
    df = spark.createDataFrame(vectors + [(902, None), (None, same)], "vec_id long, embedding array<double>")
    for sizes in ((32768, 2048, 1024), (40, 16, 8)):
        for name, n in zip(("BLOCK", "ASKED", "MET"), sizes):
            monkeypatch.setattr(retrieval, name, n)
        found = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.neighbours(df, 5).collect()}
        assert found == _brute(vectors, 5)


def test_vector_queries_ask_every_row(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    found = queries.QUERIES["cosine_topk"](spark, sf)
    assert found.select("query_id").distinct().count() == n and found.count() == 10 * n
    assert queries.QUERIES["rrf_fusion"](spark, sf).select("query_id").distinct().count() == n
    assert "%" not in queries._COSINE


def _bm25(queries, docs, k):
    terms = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    asked = [(q, w) for q, t in queries for w in dict.fromkeys(terms(t))]
    tf = {}
    for d, t in docs:
        for w in terms(t):
            tf[d, len(terms(t)), w] = tf.get((d, len(terms(t)), w), 0) + 1
    n, mean = len(docs), sum(len(terms(t)) for _, t in docs) / len(docs)
    df, total = {}, {}
    for _, _, w in tf:
        df[w] = df.get(w, 0) + 1
    for (d, length, w), m in tf.items():
        part = round(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * m * 2.2 / (m + 1.2 * (0.25 + 0.75 * length / mean)) * 1e6)
        for q, v in asked:
            if v == w:
                total[q, d] = total.get((q, d), 0) + part
    return {(q, d, total[q, d] / 1e6, rank) for q in {q for q, _ in asked} for rank, d in enumerate(sorted((d for p, d in total if p == q), key=lambda d: (-total[q, d], d))[:k], 1)}


def test_bm25_scores_texts_where_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda: f"w{int(rng.zipf(1.4)) % 60}"
    docs = [(n % 97, " ".join(word() for _ in range(int(rng.integers(0, 30))))) for n in range(120)] + [(200, None), (201, "w1")]
    asked = [(n % 11, " ".join(word() for _ in range(6))) for n in range(13)] + [(50, "never"), (51, "")]
    q, d = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    take = lambda: {tuple(r) for r in retrieval.bm25(q, d, 7).select("query_id", "doc_id", "score", "rank").collect()}
    want = _bm25(asked, docs, 7)
    assert take() == want
    monkeypatch.setattr(retrieval, "CELLS", 40)
    assert take() == want
    plan = retrieval.bm25(q, d, 7)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    assert take() == want


def test_only_what_was_found_gets_a_vector(spark, sf, monkeypatch):
    made, real = [], retrieval.hashed_weights
    monkeypatch.setattr(retrieval, "hashed_weights", lambda docs, id_col, text_col: made.append((id_col, docs.count())) or real(docs, id_col, text_col))
    found = queries.QUERIES["snippet_rerank"](spark, sf)
    docs = queries._bm25(spark, sf, 20).select("doc_id").distinct().count()
    assert dict(made)["doc_id"] == docs < spark.read.parquet(f"{sf}/documents.parquet").count() and found.count()


def test_many_references_are_counted_without_a_join_of_values(spark, monkeypatch):
    from ravelin.operators import reference

    left = spark.createDataFrame([(n, None if n % 11 == 0 else "" if n % 13 == 0 else " " if n % 17 == 0 else f"v{n % 9}", f"s{n % 3}" if n % 5 else None, "xyz"[n % 3] if n % 7 else None) for n in range(200)], "__row long, a string, s string, c string")
    right = spark.createDataFrame([(n, f"v{n % 6}" if n % 8 else None, f"s{n % 4 % 3}") for n in range(9)], "__row long, k string, s string")
    refs = {"p": ({}, {}), "q": ({"c": "x"}, {}), "r": ({"c": "y"}, {"s": "s"}), "t": ({}, {"s": "s"})}
    made = {i: reference.Reference("a", "k", sel, scope) for i, (sel, scope) in refs.items()}
    plans, real = [], reference.materialise
    monkeypatch.setattr(reference, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    frames = {"l": left, "r": right}
    found = {r["id"]: r.asDict() for r in reference.check_many(frames, [(i, "l", "r", ref) for i, ref in made.items()] + [("u", "r", "l", reference.Reference("k", "a"))]).collect()}
    made["u"] = None
    for i, ref in made.items():
        want = reference.check(*((left, right, ref) if ref else (right, left, reference.Reference("k", "a")))).first().asDict()
        assert {c: v for c, v in found[i].items() if c != "id"} == want
    assert len(plans) == 2 and not any("Join" in p for p in plans)
