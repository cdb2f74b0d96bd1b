import collections
import random

import pytest

from ravelin.llm import html_extract as H


def text(page):
    return H.article(H.blocks(page))


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
    <article><h1>Title &amp; more</h1><p>One  <b>two</b>\n three.<p>Four &lt;five&gt; &#233;&nbsp;x
    <div class="cookie-notice">We use cookies</div><aside>Side</aside><form>Mail <input></form>
    <section id="comments"><p>Nice!</p></section><p>Last</p></article><footer>&copy; us</footer></body></html>"""
    assert text(page) == "Title & more\nOne two three.\nFour <five> é x\nLast"


def test_broken_markup():
    assert text("<article><h1>A</h1><p><b>B.<br><p>C</article><footer>x</footer>") == "A\nB.\nC"
    assert text("<article><p>A <3 b & c &amp") == "A <3 b & c &"
    assert text("<article><p>A</span></div>B</p><script>never closed <p>x") == "A\nB" or text("<article><p>A</span>B</p><script>x") == "AB"
    assert H.blocks("") == [] and text("<p>no article</p>") is None
    assert text("<article>" + "<p>x" * 3000 + "</article>").count("\n") == 2999


def test_suffix_classes_tell_equal_runs():
    import numpy as np

    tokens = np.array([1, 2, 3, 1, 2, 3, 1, 2])
    rank = H.suffix_classes(tokens, 3)
    assert rank[0] == rank[3] and rank[1] == rank[4] and len({int(rank[0]), int(rank[1]), int(rank[2])}) == 3


def test_pages_without_an_article_lose_what_their_host_repeats(spark, tmp_path):
    menu = "Home News Sport Weather Travel Contact About us today"
    pages = [(i, f"https://h.example/{i}", f"<body><div>{menu}</div><div>Page {i} says {i * i} things of {i + 50} kinds here</div><nav>skip</nav></body>") for i in range(5)]
    pages += [(9, "http://other.example/", f"<body><p>{menu}</p></body>"), (10, None, None), (None, "x", ""), (11, "u", "<article><p>A  b</p></article>")]
    pages.append(pages[-1])
    spark.createDataFrame([(*p, "en") for p in pages], "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "p"))
    found = H.extract(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert len(found) == len(pages)
    by = {r["page_id"]: r for r in found}
    assert by[3]["text"] == "Page 3 says 9 things of 53 kinds here" and by[9]["text"] == menu
    assert by[10]["text"] == by[None]["text"] == "" and by[10]["n_chars"] == 0
    assert by[11]["text"] == "A b" and by[11]["n_chars"] == 3


def test_an_article_loses_what_its_host_repeats(spark, tmp_path):
    """Boilerplate without a telling class, a block of its own or within one; what is unique stays."""
    line = "Read more stories like this one in our app"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    pages = [(i, f"https://h.example/{i}", f"<article><p>{body(i)}</p><p>{line}</p><div>{body(i + 50)} {line} end{i}</div></article>") for i in range(3)]
    pages += [(7, "https://two.example/7", f"<article><p>{line}</p></article>")] * 4  # one page, four times over
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    by = {r["page_id"]: r["text"] for r in H.extract(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert [by[i] for i in range(3)] == [f"{body(i)}\n{body(i + 50)} end{i}" for i in range(3)]
    assert by[7] == line


def test_repeats_are_counted_over_a_whole_host(spark, tmp_path):
    """Three of 600 pages share a line: no deal into groups, chunks or partitions may hide it."""
    line = "This story first ran in our Sunday paper edition"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(9))
    pages = [(i, f"https://h.example/{i}", f"<div>{own(i)}</div>" + (f"<div>{line}</div>" if i % 200 == 0 else "")) for i in range(600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "p"))
    for chunk in (H.CHUNK, 2000):
        by = {r["page_id"]: r["text"] for r in H.extract(spark.read.parquet(str(tmp_path / "p")), chunk=chunk).collect()}
        assert by == {i: own(i) for i in range(600)}


def brute(pages):
    """Texts by counting every run of tokens over the pages of its host."""
    parsed = {}
    for i, url, page in pages:
        found = H.blocks(page or "")
        declared = any(inside for _, inside, _ in found)
        parsed[i] = (url or "").split("/")[2:3], [t.split(" ") for t, _, _ in found], [not apart and (inside or not declared) for _, inside, apart in found]
    on = collections.defaultdict(set)
    spots = {}
    for i, (host, found, kept) in parsed.items():
        main = tuple(tuple(t) for t, k in zip(found, kept) if k)
        flat = [(b, t) for b, tokens in enumerate(found) for t in tokens]
        spots[i] = [(s, (tuple(host), tuple(t for _, t in flat[s : s + H.RUN]))) for s in range(len(flat) - H.RUN + 1)]
        for _, run in spots[i]:
            on[run].add(main)
    out = {}
    for i, (_, found, kept) in parsed.items():
        flat = [b for b, tokens in enumerate(found) for _ in tokens]
        hit = [s for s, run in spots[i] if len(on[run]) >= H.PAGES]
        across = {k for s in hit for k in range(s, s + H.RUN)}
        gone = {k for s in hit if flat[s] == flat[s + H.RUN - 1] for k in range(s, s + H.RUN)}
        lines, at = [], 0
        for tokens, k in zip(found, kept):
            own = range(at, at + len(tokens))
            left = [] if across.issuperset(own) else [t for p, t in zip(own, tokens) if p not in gone]
            if k and left:
                lines.append(" ".join(left))
            at += len(tokens)
        out[i] = "\n".join(lines)
    return out


@pytest.fixture(scope="module")
def hosts():
    """Hosts of 3, 200 and 2000 pages: menus, notices in articles, near copies, repeats that are too rare, pages of one text."""
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    pages = []
    for host, n in (("three", 3), ("some", 200), ("many", 2000)):
        menu, notice, rare, copied = some(12), some(9), some(10), some(40)
        for k in range(n):
            body = f"<p>{some(rng.randint(1, 40))}</p>" + (f"<div>{some(5)} {notice} {some(5)}</div>" if k % 7 == 0 else "") + (f"<p>{rare}</p>" if k in (1, 2) else "")
            if k % 50 == 3:
                body = f"<p>{copied}</p>"
            main = f"<article>{body}</article>" if k % 3 else body
            pages.append((len(pages), f"https://{host}.example/{k}", (f"<ul><li>{menu[:40]}<li>{menu}</ul>" if k % 50 == 0 or n == 3 else "") + main + f"<footer>{some(3)}</footer>"))
    return pages


VOCABULARY = [f"w{k}" for k in range(400)]


@pytest.mark.parametrize(("chunk", "keys"), [(H.CHUNK, H.BROADCAST_KEYS), (20_000, H.BROADCAST_KEYS), (30_000, 0)])
def test_repeats_equal_brute_force(spark, tmp_path, monkeypatch, hosts, chunk, keys):
    monkeypatch.setattr(H, "BROADCAST_KEYS", keys)
    spark.createDataFrame([(*p, "x", 1) for p in hosts], "page_id long, url string, html string, host string, chunk int").repartition(5).write.parquet(str(tmp_path / "p"))
    found = {r["page_id"]: r["text"] for r in H.extract(spark.read.parquet(str(tmp_path / "p")), chunk=chunk).collect()}
    expected = brute(hosts)
    assert found == expected
    assert sum(t == "" for t in expected.values()) < 20


def test_a_very_long_page(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(300_000))
    spark.createDataFrame([(1, None, f"<p>{long}</p>"), (2, None, "<p>a")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    by = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert by == {1: (long, len(long)), 2: ("a", 1)}


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_chunk_holds_each_distinct_token_once(monkeypatch):
    """Steps after the parse work on numbers of tokens; the texts come back as they were."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(H, "TaskContext", type("At", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    texts = ["", "naïve 日本語 😀", " ".join(f"w{k % 70_000}" for k in range(200_000)), "rarest " * 500, None]
    pages = [(i, None, t and f"<p>{t}</p><nav>menu {i}</nav><div>{t}</div>", "h") for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pages), (pa.int64(), pa.string(), pa.string(), pa.string()))], ["page_id", "url", "html", "host"])
    (chunk,) = H._pack(1 << 30)(iter([batch]))
    blob = chunk.column("pack")[0].as_py()
    assert zstandard.ZstdDecompressor().decompress(blob).count(b"rarest") == 1
    sheet = H.Sheet(blob)
    assert sheet.without(np.array([], np.uint64)) == ["\n".join(2 * [t.strip()]) if t else "" for t in (x or "" for x in texts)]
    assert len(sheet.h) == sum(2 * len((t or "").split()) + 2 * bool(t) for t in texts) and len(np.unique(sheet.h)) == 70_000 + 3 + 1 + 1 + 3


@pytest.mark.parametrize(("name", "apart"), [("ad", True), ("sidebar widget", True), ("reader-comments", True), ("siteNav", True), ("ad-free", False), ("has-sidebar", False), ("story", False), ("", False)])
def test_marks(name, apart):
    assert H._apart("div", f' class="{name}"', True) == apart


def test_an_article_with_a_telling_class_is_still_one():
    assert text('<article class="post has-comments"><p>A</p><article class="comment"><p>B</p></article></article>') == "A"
    assert text('<article class="blog-post related-story"><p>A</p></article>') == "A"
    assert text('<article hidden><p>A</p></article><main><p>B</p></main>') == "B"
