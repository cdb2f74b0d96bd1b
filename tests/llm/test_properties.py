"""Properties over arbitrary texts, without Spark."""

import html

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import bpe, html_extract, langid, simhash, substring_dedup
from tests.llm.test_operators import brute_dedup, brute_fingerprint

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)
MARKUP = ["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<script>", "</script>", "<!--", "-->", "<b", ">", "<br/>", "&amp;", "&", "<nav>", "</nav>", '<a href="']
NARROW = st.text("abAB \n'", max_size=120)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, NARROW), max_size=4))
def test_bpe_equals_the_library_and_decodes(texts):
    for text, ids in zip(texts, ENCODER.encode(texts)):
        assert list(memoryview(ids).cast("I")) == ENCODING.encode_ordinary(text)
        assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=1000, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=2, max_size=5), st.integers(256, 400), max_size=12), st.text("ab", min_size=1, max_size=20))
def test_replay_equals_piecewise_merging_for_any_ranks(extra, piece):
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {t.encode(): 256 + k for k, (t, _) in enumerate(sorted(extra.items(), key=lambda kv: (kv[1], kv[0])))}
    expected = tiktoken.Encoding("p", pat_str=r".+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(piece)
    assert list(memoryview(bpe.replay([b"ba", piece.encode(), b"aab"], bpe.Merges(ranks))[piece.encode()]).cast("I")) == expected


@settings(max_examples=100, deadline=None)
@given(st.one_of(TEXT, NARROW))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5))
def test_paths_in_a_chunk_cover_what_is_repeated(docs):
    texts = [" ".join(f"w{x}" for x in d) for d in docs]
    sent = substring_dedup.ship(np.arange(len(texts)), list(range(len(texts))), [t.encode() for t in texts], substring_dedup.Words())
    rows = [r for batch in sent for r in batch.to_pylist()]
    own = {}
    for r in rows:
        if r["ws"] is None:
            own.setdefault(r["rid"], []).append((r["pos"], r["len"]))
    gone = [int(substring_dedup.cover(len(d), own.get(i, [])).sum()) for i, d in enumerate(docs)]
    assert gone == [g for _, _, g, _ in sorted(brute_dedup(list(enumerate(texts))))]
    assert all(r["ws"] for r in rows if r["ws"] is not None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(MARKUP), TEXT), max_size=25))
def test_any_markup_is_read(parts):
    for text, _, _ in html_extract.blocks("".join(parts)):
        assert text == " ".join(text.split()) != ""


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_plain_text_comes_back(text):
    kept = " ".join(text.split())
    assert (html_extract.article(html_extract.blocks(f"<article><p>{html.escape(text)}</p></article>")) or "") == kept


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_grams_of_a_text_do_not_depend_on_its_neighbours(texts):
    grams = langid.Grams()
    buckets, starts = grams(texts)
    for k, t in enumerate(texts):
        alone, _ = grams(["x", t])
        own = buckets[starts[k] : starts[k + 1]]
        together, at = grams(["x", t])
        assert sorted(together[at[1] : at[2]]) == sorted(alone[at[1] : at[2]])
        if k:
            assert np.array_equal(np.sort(own), np.sort(grams(texts[k - 1 : k + 1])[0][grams(texts[k - 1 : k + 1])[1][1] :]))
