"""Each operator against a brute-force version, on awkward rows, and on an empty table."""

import hashlib
import re
import struct
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import bpe, components, langid, license_scan, mixing, quality, simhash, substring_dedup, topk, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def rows(df):
    return [r.asDict() for r in df.collect()]


def pairs(awkward):
    return [(r["doc_id"], r["text"]) for r in awkward.collect()]


def same(found, expected):
    assert Counter(map(repr, found)) == Counter(map(repr, expected))


# licence scan


def brute_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for label, phrase in license_scan.BASE:
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(awkward):
    found = rows(license_scan.scan(awkward))
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found], [(i, *brute_base(t)) for i, t in pairs(awkward)])
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert any("mit" in r["labels"].split(",") for r in found)


def test_license_scan_tolerates_an_inserted_word(spark, tmp_path):
    text = "x " * 7 + "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files"
    spark.createDataFrame([(1, text), (2, "permission is granted to nobody")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {r["doc_id"]: r for r in rows(license_scan.scan(spark.read.parquet(str(tmp_path / "d"))))}
    assert found[1]["labels"] == "mit" and found[1]["n_base"] == 0 and found[2]["labels"] == ""


def test_license_words_are_lower_cased_by_ascii_only(spark, tmp_path):
    spark.createDataFrame([(1, "all rights reserved \u212a cc b\u0130"), (2, "ALL RIGHTS RESERVED")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {r["doc_id"]: r for r in rows(license_scan.scan(spark.read.parquet(str(tmp_path / "d"))))}
    assert found[1]["n_words"] == 6 and found[1]["base_labels"] == found[2]["base_labels"] == "reserved"


# SimHash


def brute_fingerprint(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(awkward):
    found = rows(simhash.near_duplicates(awkward))
    expected = [(i, brute_fingerprint(t)) for i, t in pairs(awkward)]
    root = list(range(len(expected)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(expected)):
        for j in range(i):
            if (expected[i][1] ^ expected[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(expected):
        least[find(k)] += [i] if i is not None else []
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found], [(i, f"{f:016x}", min(least[find(k)], default=None)) for k, (i, f) in enumerate(expected)])


def test_bk_tree_links_all_within_the_radius():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centres] + [centres]))
    forest = simhash.Forest(len(points))
    simhash.walk(points, points, 0, forest)
    label = np.arange(len(points))
    for _ in range(len(points)):
        new = np.array([label[np.bitwise_count(points ^ p) <= 2].min() for p in points])
        if (new == label).all():
            break
        label = new
    assert len(set(zip(forest.label.tolist(), label.tolist()))) == len(set(label.tolist())) == len(set(forest.label.tolist()))


@pytest.mark.parametrize("tree", [4, 2048])
def test_links_of_hot_shards(spark, monkeypatch, tree):
    """Many fingerprints that share two of three bands: their shards are dealt again and again, and no link is lost."""
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = np.random.default_rng(8)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ int(x) << 44 for x in rng.integers(0, 1 << 19, 300)} | {base ^ (1 << b) for b in range(40, 62)} | {base, 5, 5 ^ 3, 5 ^ 3 ^ 12})
    label = np.array(fps)
    for _ in fps:
        new = np.array([label[np.bitwise_count(np.array(fps, np.uint64) ^ np.uint64(p)) <= 2].min() for p in fps])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in rows(components.components(simhash.links(df)))}
    assert [found.get(f, f) for f in fps] == label.tolist()
    sizes = Counter((r["mask"], r["value"]) for r in rows(simhash.shards(df)))
    assert all(n <= tree or mask.bit_count() >= 64 - simhash.FREE for (mask, _), n in ((((m + (1 << 64)) % (1 << 64), v), n) for (m, v), n in sizes.items()))


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b").repartition(7)
    assert {r["root"] for r in rows(components.components(chain))} == {0}
    assert rows(components.components(chain.limit(0))) == []


# substring dedup


def brute_dedup(docs):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        ws = words(docs[k][1])
        gone = set()
        for i in range(len(ws) - 19):
            window = tuple(ws[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[k] = (docs[k][0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return list(out.values())


@pytest.mark.parametrize("chunk", [2_000_000, 300])
def test_substring_dedup(awkward, chunk):
    found = rows(substring_dedup.dedup(awkward, chunk=chunk))
    got = [(r["doc"]["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found]
    same(got, brute_dedup(pairs(awkward)))
    assert found[0]["doc"].asDict().keys() == set(awkward.columns) - {"text"}


def deduped(df, **more):
    return Counter((r["doc"]["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows(substring_dedup.dedup(df, **more)))


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """(documents, DataFrame): a passage in every third, a phrase in all, and columns with clashing names."""
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(i, " ".join(f"d{i}x{k}" if k % 9 else "of the said one" for k in range(20 + i % 9)) + (f" {passage}" if i % 3 == 0 else "")) for i in range(60)]
    path = str(tmp_path_factory.mktemp("passages") / "d")
    spark.createDataFrame([(i, t, t, "y" * 300, i, i) for i, t in docs], "doc_id long, whole string, text string, doc string, rid long, spans long").coalesce(1).write.parquet(path)
    return docs, spark.read.parquet(path)


@pytest.mark.parametrize(("setting", "value"), [("maxBytesPerBatch", "3000"), ("maxBytesPerBatch", "65536"), ("maxRecordsPerBatch", "7")])
def test_substring_dedup_does_not_depend_on_arrow_batches(spark, passages, setting, value):
    docs, df = passages
    key = f"spark.sql.execution.arrow.{setting}"
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        assert deduped(df, chunk=2000) == Counter(brute_dedup(docs))
        kept = corpus_pipeline.drop_repeated_passages(spark, df, "")
        brute = {i: h for i, _, _, h in brute_dedup(docs)}
        assert kept.columns == df.columns
        for r in rows(kept):
            assert hashlib.sha256(r["text"].encode()).hexdigest() == brute[r["doc_id"]] and r["rid"] == r["doc_id"] and r["whole"] == docs[r["doc_id"]][1]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize(("limit", "common"), [(0, 4), (200_000, 1), (0, 1)])
def test_substring_dedup_with_common_seeds_and_large_results(passages, monkeypatch, limit, common):
    """Every minimizer looked at is common, and paths are exchanged, not broadcast."""
    docs, df = passages
    monkeypatch.setattr(substring_dedup, "BROADCAST_PATHS", limit)
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    monkeypatch.setattr(substring_dedup, "LOOK_SHARE", 1 if common == 1 else 64)
    assert deduped(df, chunk=3000) == Counter(brute_dedup(docs))


def test_paths_with_other_words_than_their_source_are_found(passages):
    docs, df = passages
    stored = substring_dedup.numbered(df, "doc_id", "text")
    paths = substring_dedup.repeated_paths(stored, 2000).df
    n = paths.count()
    wrong = lambda p: substring_dedup.unlike(substring_dedup.removed(stored, p, n), n)
    assert n > 0 and wrong(paths) == 0
    assert wrong(paths.withColumn("src_pos", F.col("src_pos") - 1)) == n
    assert wrong(paths.withColumn("src_rid", F.lit(-1).cast("long"))) == n
    assert wrong(paths.withColumn("rid", F.lit(-1).cast("long"))) == n


def test_colliding_paths_are_found_anew(passages, monkeypatch):
    docs, df = passages
    tried, honest = [], substring_dedup.unlike
    monkeypatch.setattr(substring_dedup, "unlike", lambda done, n: tried.append(n) or (1 if len(tried) == 1 else honest(done, n)))
    assert deduped(df, chunk=3000) == Counter(brute_dedup(docs)) and len(tried) == 2
    monkeypatch.setattr(substring_dedup, "unlike", lambda done, n: 1)
    with pytest.raises(RuntimeError, match="collided"):
        deduped(df, chunk=3000)


def test_substring_dedup_asks_long_rows_in_deals(passages, monkeypatch):
    docs, df = passages
    monkeypatch.setattr(substring_dedup, "DEAL", 3)
    assert deduped(df, chunk=3000) == Counter(brute_dedup(docs))


def test_adjoining_pieces_are_one_path(spark):
    pieces = [(1, 0, 3, 0, 10), (1, 3, 2, 0, 13), (1, 6, 1, 0, 16), (1, 5, 1, 0, 30), (2, 3, 2, 0, 13)]
    found = rows(substring_dedup._compacted(spark.createDataFrame(pieces, substring_dedup._PATHS)))
    assert {tuple(r.values()) for r in found} == {(1, 0, 5, 0, 10), (1, 6, 1, 0, 16), (1, 5, 1, 0, 30), (2, 3, 2, 0, 13)}


def test_edges_equal_only_for_equal_windows():
    h = np.array([xxhash.xxh3_64_intdigest(str(i % 7).encode()) for i in range(60)], np.uint64)
    wide, low = substring_dedup.edges(h)
    assert len(wide) == 41 and all((wide[i] == wide[j]) == (i % 7 == j % 7) for i in range(41) for j in range(41))
    assert all(low[i] == low[i + 7] for i in range(34))


# BPE


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(awkward, reference_encoding):
    found = rows(bpe.encode_decode(awkward, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, full=True))
    expected = []
    for i, t in pairs(awkward):
        ids = reference_encoding.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found], expected)
    assert {bytes(r["decoded"]) for r in found} == {(t or "").encode() for _, t in pairs(awkward)}


def test_a_merge_of_an_earlier_rank_is_not_passed_over():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"aba": 299}
    # merging ab opens (ab, a) -> aba, which comes before the second ab
    assert list(memoryview(bpe.replay([b"abab"], bpe.Merges(ranks))[b"abab"]).cast("I")) == [299, ord("b")]
    tokens = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary("abab")
    assert tokens == [299, ord("b")]


def test_of_equal_ranks_the_left_one_comes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    tokens = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 40):
        assert list(memoryview(bpe.replay([b"ab", b"a" * n], bpe.Merges(ranks))[b"a" * n]).cast("I")) == tokens.encode_ordinary("a" * n)


def test_known_pieces_move_between_generations(monkeypatch, reference_encoding):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    e = bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    for text in ["alpha beta gamma delta", "epsilon alpha", "zeta beta alpha zyx"] * 2:
        assert list(memoryview(e.encode([text])[0]).cast("I")) == reference_encoding.encode_ordinary(text)


def test_an_encoder_keeps_a_bounded_part(monkeypatch, reference_encoding):
    monkeypatch.setattr(bpe, "REMEMBER_BYTES", 4000, raising=False)
    monkeypatch.setattr(bpe, "PAIRS", 100, raising=False)
    e = bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    for _ in range(40):
        text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1000))  # one piece
        assert list(memoryview(e.encode([text])[0]).cast("I")) == reference_encoding.encode_ordinary(text)
    assert sum(len(p) + len(ids) for kept in (e.known, e.older) for p, ids in kept.items()) < 20_000
    assert len(e.merges.made) < 2000


def test_long_rows_behind_short_ones_are_replayed_in_small_parts():
    seen = []

    class Recorder(bpe.Encoder):
        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return super().encode(texts)

    texts = ["a b"] * 3000 + ["a b c d " * 10_000] * 20 + ["x " * bpe.TOGETHER, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    encoder = Recorder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    done = pa.Table.from_batches(bpe.encoded([batch], encoder))
    assert done["doc_id"].to_pylist() == list(range(len(texts)))
    assert done["decoded_sha256"].to_pylist() == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert sum(seen) == sum(len(t or "") for t in texts)
    assert sorted(seen)[-2] <= bpe.TOGETHER <= 500_000 and max(seen) == len(texts[-3])


# language identification


def test_grams_are_cut_in_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab cd efg hi " * 200, None, "é"] * 500)], ["text"])
    grams = langid.Grams()
    tracemalloc.start()
    try:
        parts = [grams([t or "" for t in part.column(0).to_pylist()]) for part in langid.parts(batch, 0)]
        found = [len(starts) - 1 for _, starts in parts]
        del parts
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for part in langid.parts(batch, 0):
            grams([t or "" for t in part.column(0).to_pylist()])
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert sum(found) == batch.num_rows
    assert peak < 60e6


def test_language_id(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = rows(langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id"))
    held = [r for r in found if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    odd = rows(langid.predict(awkward))
    assert len(odd) == awkward.count() and sum(r["lang_pred"] == "und" and r["score"] == 0 for r in odd) == 3
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert rows(langid.predict(nothing)) == []
    assert all(r["lang_pred"] == "und" for r in rows(langid.identify(docs, langid.fit(nothing, nothing.doc_id.isNotNull()), docs.doc_id)))


def test_language_is_learned_without_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = docs.withColumn("lang", langid.F.when(langid.held_out(langid.F.col("doc_id")), "xx").otherwise(langid.F.col("lang")))
    assert "xx" not in {r["lang_pred"] for r in rows(langid.predict(changed))}


# top-k


def brute_top(vectors, k=20, every=20):
    usable = [(i, [int(np.floor(64 * x)) for x in np.array(v, float)]) for i, v in vectors if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        qv = min(v for i, v in usable if i == q)
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q and len(v) == len(qv))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


def test_a_long_text_outweighs_the_prior(spark):
    """Evidence under log(prior ratio) / EVIDENCE an n-gram decides where there is enough of it; the score stays tempered."""
    text = "lorem ipsum " * 500
    at = np.unique(langid.Grams()([text])[0])
    counts = np.full((langid.BUCKETS, 2), 10.0)
    counts[at, 1] = 11.0
    model = langid.Model(["common", "rare"], np.array([100_000.0, 1.0]), counts)
    docs = spark.createDataFrame([(1, text), (2, "lorem ipsum")], "doc_id long, text string")
    found = {r["keep"]: r for r in rows(langid.identify(docs, model, F.col("doc_id")))}
    assert found[1]["lang_pred"] == "rare" and found[1]["score"] < 0.5
    assert found[2]["lang_pred"] == "common" and found[2]["score"] > 0.5


@pytest.mark.parametrize("shard", [8192, 37])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "ASKED", 3)
    rng = np.random.default_rng(2)
    made = [(i, [float(np.float32(x)) for x in rng.normal(0, 1 + (i % 3), 8)]) for i in range(150)]
    made += [(i, made[40][1]) for i in range(200, 230)] + [(1, None), (2, []), (20, [1.0, None] * 4), (40, [float("nan")] * 8), (None, [1.0] * 8), (60, [1.0, 2.0]), (61, [0.5, 0.5])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df))]
    same(found, brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()]))
    assert rows(topk.top_k(df.limit(0))) == []
    clashing = df.selectExpr("vec_id", "embedding", "'x' AS norm", "1 AS shard", "2 AS v", "3 AS block", "4 AS floor")
    same([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(clashing))], found)


def test_top_k_multiplies_few_pairs_and_sends_few_vectors(spark, monkeypatch):
    """Vectors of unequal length and of few large axes: most pairs are settled by their bounds, most shards reach no query."""
    rng = np.random.default_rng(5)
    scale = 8 * rng.pareto(2.0, (6000, 1)) + 0.5
    v = np.floor(64 * scale * rng.normal(0, 0.8 ** np.arange(32), (6000, 32))).astype(np.int64)
    norm, ids = np.linalg.norm(v.astype(float), axis=1), np.arange(6000)
    axes = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    q, work = slice(0, 6000, 20), topk.Work()
    at, found, score = topk.best((ids[q], v[q], norm[q], np.full(300, topk.LEAST)), (ids, v, norm), axes, 20, work)
    brute = v[q] @ v.T
    brute[np.arange(300), ids[q]] = topk.LEAST
    expected = [(i, int(j), int(brute[i, j])) for i in range(300) for j in np.lexsort((ids, -brute[i]))[:20]]
    assert sorted(zip(at.tolist(), found.tolist(), score.tolist())) == sorted(expected)
    assert work.pairs == 300 * 6000 and work.exact < 0.05 * work.pairs and work.axes < 0.2 * 32 * work.pairs

    monkeypatch.setattr(topk, "SHARD", 500)
    monkeypatch.setattr(topk, "ASKED", 60)
    seen = []
    real = topk.reach
    monkeypatch.setattr(topk, "reach", lambda asked, longest: seen.append(real(asked, longest)) or seen[-1])
    df = spark.createDataFrame([(i, (x / 64).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = rows(topk.top_k(df))
    assert sorted((r["query_id"] // 20, r["vec_id"], r["score"]) for r in got) == sorted(expected)
    reached = [r["reach"] for r in seen[0].select("reach").collect()]
    assert sum(reached) < 0.5 * 300 * 11


# toxicity


def test_toxicity(spark, sf, awkward, nothing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = rows(toxicity.predict(docs, labels).join(labels, "doc_id"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"]]
    clean = [r for r in held if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    assert np.mean([r["score"] for r in held if r["toxic"]]) > 5 * np.mean([r["score"] for r in clean])
    odd = rows(toxicity.predict(awkward, labels))
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["predicted"] == 0 for r in rows(toxicity.predict(docs, labels.limit(0))))
    assert rows(toxicity.predict(nothing, labels)) == []


def test_toxicity_keeps_to_the_share_of_toxic_rows(spark, monkeypatch, tmp_path):
    """Caps that bind unevenly: what is mostly clean in the table is not toxic because the sample has few clean rows."""
    kinds = [(i, int(i % 4 == 0)) for i in range(600)]
    docs = [(i, ("zzvile blarg" if y else "calm blarg" if i % 3 == 0 else "calm") + f" n{chr(97 + i % 26)}") for i, y in kinds]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([*kinds, *((10_000 + i, 1) for i in range(2000))], "doc_id long, toxic int")  # and labels of no document
    monkeypatch.setattr(toxicity, "FIT", (20, 90))
    table = spark.read.parquet(str(tmp_path / "d"))
    model = toxicity.fit(table, labels)
    assert "zzvile" in model.place and "blarg" not in model.place
    scores = [r["score"] for r in rows(toxicity.score(table, model, F.col("doc_id")))]
    assert abs(np.mean(scores) - 0.25) < 0.05


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    rates = [0.9, 0.85, 0.8, 0.55]
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in rates] + [np.full(4000, -1)], axis=1)
    post, learned, _ = toxicity.label_model(votes, votes[:, :4].mean(axis=1) * 0.8 + 0.1)
    assert ((post > 0.5) == y).mean() > 0.9
    assert learned[1, 0, 2] > learned[1, 3, 2]


def brute_label_model(votes, known, anchor, rounds, mass):
    n, m = len(votes), len(votes[0])
    post = [float(k) for k in known]
    for _ in range(rounds):
        share = [[(mass[r] * (1 - post[r] + anchor * (1 - known[r])), mass[r] * (post[r] + anchor * known[r])) for r in range(n)]][0]
        rate = [[[sum(share[r][y] for r in range(n) if votes[r][j] == v) + 0.5 for v in (-1, 0, 1)] for j in range(m)] for y in (0, 1)]
        rate = [[[c / sum(cell) for c in cell] for cell in side] for side in rate]
        rest = [[votes[r][j] - sum(p * (rate[y][j][2] - rate[y][j][0]) for y, p in ((0, 1 - post[r]), (1, post[r]))) for j in range(m)] for r in range(n)]
        both = lambda i, j: sum(mass[r] * rest[r][i] * rest[r][j] for r in range(n)) / n
        spread = [both(j, j) ** 0.5 + 1e-9 for j in range(m)]
        corr = [[both(i, j) / spread[i] / spread[j] for j in range(m)] for i in range(m)]
        weight = [1 / (1 + sum(max(0.0, abs(corr[i][j]) - (i == j) - 0.1) for i in range(m))) for j in range(m)]
        prior = min(0.99, max(0.01, sum(s[1] for s in share) / n / (1 + anchor)))
        post = []
        for row in votes:
            log = np.log(prior / (1 - prior)) + sum(weight[j] * np.log(rate[1][j][v + 1] / rate[0][j][v + 1]) for j, v in enumerate(row) if v != -1)
            post.append(1 / (1 + np.exp(-min(30, max(-30, log)))))
    return post, rate, corr


def test_label_model_equals_brute_force():
    rng = np.random.default_rng(6)
    gold = (rng.random(120) < 0.25).astype(int)
    speak = np.stack([rng.random(120) < np.where(gold == 1, a, 0.05) for a in (0.6, 0.4, 0.3)], axis=1)
    speak = np.hstack([speak, speak[:, :1] | (rng.random((120, 1)) < 0.05)])  # a voter that repeats another
    votes = np.hstack([np.where(speak, 1, -1), np.where(speak.any(axis=1), -1, 0)[:, None]])
    mass = np.where(gold == 1, 0.7, 1.1)
    for anchor, rounds in ((0.3, 1), (0.3, 5), (0.0, 3)):
        post, rates, corr = toxicity.label_model(votes, gold, anchor, rounds, mass)
        p, r, c = brute_label_model(votes.tolist(), gold.tolist(), anchor, rounds, mass.tolist())
        assert np.allclose(post, p) and np.allclose(rates, r) and np.allclose(corr, c, atol=1e-6)
    post, _, corr = toxicity.label_model(votes, gold, toxicity.ANCHOR, mass=mass)
    assert corr[0, 3] > 0.5
    # the posterior follows from the votes, not from the label: rows that vote alike have one, whatever their label
    alike = defaultdict(set)
    for v, p in zip(votes.tolist(), post):
        alike[tuple(v)].add(round(float(p), 9))
    assert all(len(x) == 1 for x in alike.values()) and ((post > 0.5) != gold).any()


def test_linear_classifier_equals_a_dense_one():
    rng = np.random.default_rng(7)
    dense = rng.random((60, 5)) < 0.3
    y = np.clip(dense[:, 0] * 0.9 + 0.05, 0, 1)
    w = toxicity.linear(toxicity.Sparse([np.flatnonzero(r).tolist() for r in dense], 5), y, rounds=3000)
    x = np.hstack([dense, np.ones((60, 1))])
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.append(w[:-1], 0)
    assert np.abs(slope).max() < 1e-6


# quality


def brute_quality(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    cover = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality(awkward, nothing):
    ledger = quality.ledger(awkward)
    found = rows(quality.judge(ledger))
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found], [(i, *brute_quality(t)) for i, t in pairs(awkward)])
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in found)
    alone = {r["rule"]: r for r in rows(quality.ablation(ledger))}
    assert alone["too_few_words"]["n_failed"] == sum(r["n_words"] < 50 for r in found) >= alone["too_few_words"]["n_only"]
    assert rows(quality.judge(quality.ledger(nothing))) == []


# mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, awkward, nothing, sf):
    for docs in (awkward, spark.read.parquet(f"{sf}/documents.parquet")):
        found = rows(mixing.copies(docs))
        source = {r["at"]: r["source"] for r in docs.select(mixing.F.monotonically_increasing_id().alias("at"), "source").collect()}
        sizes = Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(words(r["text"]))
        target = brute_targets(sizes)
        taken, longest = Counter(), Counter()
        for r in found:
            s = source[r["rid"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["copies"] <= 2
            taken[s] += r["copies"] * r["size"]
            longest[s] = max(longest[s], r["size"])
        assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in sizes)
        assert sorted(map(repr, rows(mixing.copies(docs)))) == sorted(map(repr, found))
        assert mixing.mix(docs).count() == sum(r["copies"] for r in found) and mixing.mix(docs).columns == docs.columns
    assert rows(mixing.copies(nothing)) == []


@pytest.mark.parametrize("run", [license_scan.scan, simhash.near_duplicates, substring_dedup.dedup])
def test_empty_table(run, nothing):
    assert run(nothing).collect() == []


def test_empty_table_for_bpe(nothing):
    assert bpe.encode_decode(nothing, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


def test_a_column_of_too_many_languages_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "some words", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 4)
    assert len(langid.fit(docs, docs.doc_id.isNotNull()).languages) == 4
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.fit(docs, docs.doc_id.isNotNull())
