import hashlib
import struct
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from ravelin.llm import bpe, mixing, queries
from tests.llm.test_operators import brute_dedup, brute_fingerprint, rows, words


def test_stages_hold_together(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = rows(docs)
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
        elif name == "near_duplicates":
            fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
            groups: list[set] = []
            for i, f in fps.items():
                near = [g for g in groups if any((f ^ fps[j]).bit_count() <= 2 for j in g)]
                groups = [g for g in groups if g not in near] + [{i}.union(*near)]
            assert {r["doc_id"] for r in after} == {min(g) for g in groups}
        elif name == "repeated_passages":
            kept = {i: (n, gone, sha) for i, n, gone, sha in brute_dedup([(r["doc_id"], r["text"]) for r in before])}
            for r in after:
                n, gone, sha = kept.pop(r["doc_id"])
                assert r["n_chars"] == len(r["text"]) and hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == sha
            assert all(n == gone for n, gone, _ in kept.values())
        elif name == "mixing":
            assert Counter(r["doc_id"] for r in after) == {r["doc_id"]: r["copies"] for r in rows(mixing.copies(spark.read.parquet(str(tmp_path / "repeated_passages")))) if r["copies"]}
        else:
            ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            expected = Counter()
            for r in before:
                ids = encoding.encode_ordinary(r["text"])
                expected[r["doc_id"], hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += 1
            assert Counter((r["doc_id"], r["ids_sha256"]) for r in after) == expected
    assert Counter(map(repr, rows(corpus_pipeline.run(spark, sf)))) == Counter(map(repr, after))


def test_queries_equal_their_sql(spark, sf):
    for name, sql in queries.ORACLE.items():
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = con.sql(sql)
        df = queries.QUERIES[name](spark, sf)
        assert sorted(df.columns) == sorted(found.columns)
        cols = sorted(df.columns)
        own = Counter(tuple(r[c] for c in cols) for r in df.collect())
        assert own == Counter(tuple(r[found.columns.index(c)] for c in cols) for r in found.fetchall()), name


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_awkward_rows_and_no_rows(spark, awkward, nothing, sf, tmp_path):
    for label, docs in (("awkward", awkward), ("nothing", nothing)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            if name != "byte_bpe":
                assert docs.columns == columns
            if name == "language_id" and label == "awkward":
                assert all(any(c.isalpha() for c in r["text"]) and r["lang"] for r in docs.collect())
        assert (docs.count() > 0) == (label == "awkward")


def test_documents_stay_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "日本語", None), (3, "12 34 !?", None), (4, "", None), (5, None, None)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["lang"]) for r in kept.collect()} == {(1, None), (2, None)}
