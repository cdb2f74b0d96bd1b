"""Main text of web pages, without what their host repeats.

A page is cut into blocks of text, and its blocks in turn are one stream of tokens.
A run of ``RUN`` tokens that stands on ``PAGES`` or more distinct pages of a host
is boilerplate, whatever the mark-up says, and the tokens it covers go: inside a
block those of runs that lie in it, and a block as a whole where runs that reach
across blocks cover all of it.  Of the rest, mark-up decides what is kept: blocks
in the page's article (or main) element, or any block where a page declares none,
outside whatever is declared to be something else.  Pages of one host whose blocks
kept by mark-up have the same text count as one: an article fetched or published many times stays.

Runs are counted over all pages of the host.  Pages are parsed once, into chunks on shared
storage that hold each distinct token once and its number wherever it stands.  A run on enough pages holds seeds of ``SEED`` tokens that stand on as many, so chunks first
send the least seed of each run, as a hash with a count of pages, to the task of its bucket;
only runs whose least seed is common enough are then sorted by a suffix array, and each
distinct one is sent with up to ``PAGES`` of its pages to be counted exactly.  Seeds and runs
that have enough pages go back to the chunks they stand in, or, where there are few
in all, to every task.  A chunk sends a run a few times at most, however large the host is, and
a host's runs lie in all buckets; neither chunks nor hosts' sizes change the result.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cut, by_bytes, by_group
from .substring_dedup import _ODD, among, mix, runs

#: Tokens of the shortest repeat (a power of two), distinct pages it is on, and tokens of a seed.
RUN, PAGES, SEED = 8, 3, 4
#: Bytes of HTML in a chunk, but for a single longer page.
CHUNK = 2_000_000
#: Bits of a hash that tell its bucket, and bits sent beside it.
BUCKET_BITS, KEY_BITS = 12, 40
#: Hashes up to which they are sent to every task; beyond, each chunk gets its own by an exchange.
BROADCAST_KEYS = 2_000_000

#: HTML elements by their part in a page.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
APART = frozenset("nav aside footer form script style textarea title noscript template head button select dialog menu iframe svg object audio video canvas datalist xmp noembed math".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words of a class or id that declare a part to be something other than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe taboola toolbar topbar widget widgets".split()
)
#: A class or id that begins or ends so says what a part has or lacks, not what it is.
ABOUT_FIRST, ABOUT_LAST = frozenset("has no not is with without".split()), frozenset("free less".split())
#: What a heading or paragraph is closed by.
_ENDS_P = BLOCK
_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.IGNORECASE)
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE) for name in RAW}


def _apart(name: str, attrs: str, inside: bool) -> bool:
    """Is an element declared to be no part of the article?"""
    if name in APART or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden":
            return True
        if kind == "aria-hidden":
            if value.lower() == "true":
                return True
        elif kind == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True
        elif kind == "role":
            if value.strip().lower() in ROLES:
                return True
        else:
            for each in value.split():
                parts = [p for p in _PART.sub(" ", each).lower().split() if p]
                if not parts or parts[0] in ABOUT_FIRST or parts[-1] in ABOUT_LAST:
                    continue
                marked = [p in MARKS for p in parts]
                # an article is a comment or an advert only where a class says nothing else of it
                if all(marked) if name in MAIN else any(marked):
                    return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in article, apart) of each block of a page, in order; white space made one space."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in article, apart
    inside = apart = False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, inside, apart))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in BLOCK or name in APART:
            flush()
        elif name in ("br", "td", "th", "img"):
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    state = stack[k - 1][1:] if k else (False, False)
                    if state != (inside, apart):
                        flush()
                    del stack[k:]
                    inside, apart = state
                    break
                if stack[k][0] in MAIN and name not in ("body", "html", *MAIN):
                    break  # a stray end tag does not leave the article
            continue
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if name in _ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
            _, inside, apart = stack[-1] if stack else ("", False, False)
        elif name in _ENDS_P and name != "p" or name == "p":
            # an open p, with inline elements still open in it, ends at the next block
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in BLOCK:
                    if stack[k][0] == "p":
                        del stack[k:]
                        _, inside, apart = stack[-1] if stack else ("", False, False)
                    break
        own = apart or _apart(name, attrs, inside)
        if own != apart or name in MAIN:
            flush()
        inside, apart = inside or (name in MAIN and not own), own
        stack.append((name, inside, apart))
    flush()
    return out


def article(found: list[tuple[str, bool, bool]]) -> str | None:
    """The main text where the page declares an article, else None."""
    if not any(inside for _, inside, _ in found):
        return None
    return "\n".join(text for text, inside, apart in found if inside and not apart)


def suffix_classes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix among all by its first ``depth`` tokens: a suffix array by doubling, to that depth."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        ahead = np.concatenate([rank[step:] + 1, np.zeros(step, np.int64)])
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


class Sheet:
    """The pages of a chunk as one stream of numbers of tokens, with the hashes of their words, hosts and kept texts."""

    def __init__(self, blob: bytes):
        source = pa.BufferReader(zstandard.ZstdDecompressor().decompress(blob))
        self.rows, stream = (pa.ipc.open_stream(source).read_all().combine_chunks().to_batches()[0] for _ in range(2))
        #: Distinct tokens, with spaces between, and the numbers of those that stand one after the other.
        self.tokens, planes = (stream.column(k)[0].as_py() for k in ("tokens", "planes"))
        self.numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        #: Tokens of each block, and blocks of each page.
        self.sizes = self.rows.column("sizes").flatten().to_numpy()
        self.blocks = pc.list_value_length(self.rows.column("sizes")).to_numpy()
        self.pages = self.rows.column("page").to_numpy().view(np.uint32)
        hosts = np.array([xxhash.xxh3_64_intdigest(x) for x in self.rows.column("host").to_pylist()], np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.tokens.split(b" ")), np.uint64)
        self.h = h = hashes[self.numbers]
        self.of = np.repeat(np.repeat(np.arange(len(self.blocks)), self.blocks), self.sizes)
        self.hosts = hosts[self.of]
        #: Where runs start (a run lies in one page; it may reach across blocks), their keys, and those of their least seeds.
        self.starts, self.keys, self.seeds = np.array([], np.int64), np.array([], np.uint64), np.array([], np.uint64)
        if len(h) >= RUN:
            wide, n = h, 1
            while n < RUN:
                wide, n = wide[:-n] * np.uint64(pow(int(_ODD), n, 1 << 64)) + wide[n:], 2 * n
                if n == SEED:
                    low = mix(wide ^ self.hosts[: len(wide)])
            n = 1
            while n < RUN - SEED + 1:
                step = min(n, RUN - SEED + 1 - n)
                low, n = np.minimum(low[:-step], low[step:]), n + step
            self.starts = np.flatnonzero(self.of[: len(wide)] == self.of[RUN - 1 :])
            self.keys = self.key(mix(wide[self.starts] ^ self.hosts[self.starts]))
            self.seeds = self.key(low[self.starts])

    @staticmethod
    def key(x: np.ndarray) -> np.ndarray:
        return x >> np.uint64(64 - BUCKET_BITS - KEY_BITS)

    def covered(self, found: np.ndarray) -> np.ndarray:
        """Which tokens the runs that start at ``found`` cover."""
        step = np.bincount(found, minlength=len(self.h) + 1) - np.bincount(found + RUN, minlength=len(self.h) + 1)
        return np.cumsum(step)[: len(self.h)] > 0

    def distinct_seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, distinct pages, PAGES at most) of each least seed, in order of keys."""
        order = np.lexsort((self.pages[self.of[self.starts]], self.seeds))
        k, p = self.seeds[order], self.pages[self.of[self.starts[order]]]
        once = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))[: len(k)]
        keys, n = np.unique(k[once], return_counts=True)
        return keys, np.minimum(n, PAGES).astype(np.uint8)

    def distinct_runs(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, page) of each distinct run of a host whose least seed is ``common``, with up to PAGES of its distinct pages, in order of keys."""
        open_ = among(self.seeds, common)
        starts, keys = self.starts[open_], self.keys[open_]
        if not len(starts):
            return keys, np.array([], np.uint32)
        kept = self.covered(starts)
        alike = suffix_classes(self.h[kept], RUN)[(np.cumsum(kept) - 1)[starts]]
        host, page = self.hosts[starts], self.pages[self.of[starts]]
        order = np.lexsort((page, host, alike, keys))
        k, c, o, p = keys[order], alike[order], host[order], page[order]
        fresh = np.append(True, (c[1:] != c[:-1]) | (o[1:] != o[:-1]) | (k[1:] != k[:-1]))
        once = fresh | np.append(True, p[1:] != p[:-1])
        order, fresh = order[once], fresh[once]
        at = np.arange(len(order))
        nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
        chosen = order[nth < PAGES]
        return keys[chosen], page[chosen]

    def without(self, gone: np.ndarray) -> list[str]:
        """The text left of each page, in the blocks kept by mark-up, when runs whose keys are in ``gone`` are taken out."""
        n = len(self.sizes)
        block = np.repeat(np.arange(n), self.sizes)
        hit = self.starts[among(self.keys, gone)]
        own = hit[block[hit] == block[hit + RUN - 1]]
        whole = np.bincount(block[self.covered(hit)], minlength=n) == self.sizes
        kept = self.rows.column("kept").flatten().to_numpy(zero_copy_only=False) & ~whole
        left = kept[block] & ~self.covered(own)
        tokens = np.array(self.tokens.decode().split(" "), object)[self.numbers[left]].tolist()
        cuts = [0, *np.cumsum(np.bincount(block[left], minlength=n)).tolist()]
        texts = [" ".join(tokens[a:b]) for a, b in itertools.pairwise(cuts)]
        return ["\n".join(filter(None, texts[a:b])) for a, b in itertools.pairwise([0, *np.cumsum(self.blocks).tolist()])]


def _pack(limit: int):
    """Rows of (page_id, url, html, host) to (chunk, pack): their blocks as numbers of tokens, and which of them mark-up keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for n, part in enumerate(by_bytes(batches, "html", limit)):
            found = [blocks(x or "") for x in part.column("html").to_pylist()]
            texts = [[t for t, _, _ in x] for x in found]
            declared = [any(i for _, i, _ in x) for x in found]
            kept = [[not a and (i or not d) for _, i, a in x] for x, d in zip(found, declared)]
            page = np.array([xxhash.xxh3_64_intdigest("\n".join([t for t, k in zip(x, y) if k])) & 0xFFFFFFFF for x, y in zip(texts, kept)], np.uint32)
            tokens = " ".join(itertools.chain.from_iterable(texts)).split(" ") if any(texts) else []
            number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
            numbers = np.fromiter(map(number.__getitem__, tokens), "<u4", len(tokens))
            # the high bytes of all numbers, and then the low ones, take less room when compressed
            planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
            cols = [*(part.column(k) for k in ("page_id", "url", "host")), pa.array([[t.count(" ") + 1 for t in x] for x in texts], pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.bool_())), pa.array(page)]
            sheet = pa.RecordBatch.from_arrays(cols, ["page_id", "url", "host", "sizes", "kept", "page"])
            sink = pa.BufferOutputStream()
            for each in (sheet, pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (" ".join(number).encode(), planes)], ["tokens", "planes"])):
                with pa.ipc.new_stream(sink, each.schema) as out:
                    out.write_batch(each)
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + n]), pa.array([press.compress(sink.getvalue())], pa.binary())], ["chunk", "pack"])

    return run


def _bytes(keys: np.ndarray) -> bytes:
    """The KEY_BITS low bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _keys(raw: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(raw) // (KEY_BITS // 8), 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel().astype(np.uint64) | np.uint64(bucket << KEY_BITS)


_SENT = "bucket int, chunk long, keys binary, beside binary"


def _by_bucket(chunk: int, keys: np.ndarray, beside: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a bucket of keys in order, with as many numbers beside them."""
    if len(keys):
        bucket = (keys >> np.uint64(KEY_BITS)).astype(np.int32)
        s, e = runs(np.append(True, bucket[1:] != bucket[:-1]))
        cuts = list(zip(s.tolist(), e.tolist()))
        raw, other, n, k = _bytes(keys), beside.tobytes(), KEY_BITS // 8, beside.itemsize
        cols = [pa.array(bucket[s]), pa.array(np.full(len(s), chunk)), pa.array([raw[n * a : n * b] for a, b in cuts], pa.binary()), pa.array([other[k * a : k * b] for a, b in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "keys", "beside"])


#: Stands for all chunks.
_ALL = -1


def _repeated(counts: bool):
    """Rows sorted by bucket: the keys on PAGES or more distinct pages, to each chunk that has them, and once to all.

    Beside the keys stand counts of pages of a chunk, whose sum may be too high, or pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in by_group(batches, ["bucket"]):
            key = np.concatenate([_keys(x, bucket) for x in rows.column("keys").to_pylist()])
            beside = np.frombuffer(b"".join(rows.column("beside").to_pylist()), np.uint8 if counts else np.uint32)
            chunk = np.repeat(rows.column("chunk").to_numpy(), [len(x) // (KEY_BITS // 8) for x in rows.column("keys").to_pylist()])
            order = np.lexsort((beside, key))
            k, p = key[order], beside[order].astype(np.int64)
            fresh = np.append(True, k[1:] != k[:-1])
            if not counts:
                p = (fresh | np.append(True, p[1:] != p[:-1])).astype(np.int64)
            first = np.flatnonzero(fresh)
            found = k[first][np.add.reduceat(p, first) >= PAGES]
            hit = np.flatnonzero(among(key, found))
            if not len(hit):
                continue
            hit = hit[np.lexsort((key[hit], chunk[hit]))]
            c, k = chunk[hit], key[hit]
            once = np.append(True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]))
            c, k = c[once], k[once]
            s, e = runs(np.append(True, c[1:] != c[:-1]))
            cols = [pa.array([_ALL, *c[s].tolist()]), pa.array(np.full(len(s) + 1, bucket, np.int32)), pa.array([_bytes(found), *(_bytes(k[a:b]) for a, b in zip(s, e))], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "bucket", "keys"])

    return run


class Repeated:
    """Keys on PAGES or more pages, and the way they reach the chunks."""

    def __init__(self, sent: DataFrame, counts: bool):
        found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(counts), "chunk long, bucket int, keys binary")
        self.cut = Cut(found)
        self.few = (self.cut.df.where(F.col("chunk") == _ALL).agg(F.sum(F.length("keys"))).first()[0] or 0) <= BROADCAST_KEYS * KEY_BITS // 8
        if self.few:
            rows = [_keys(r["keys"], r["bucket"]) for r in self.cut.df.where(F.col("chunk") == _ALL).toLocalIterator()]
            self.all = sent.sparkSession.sparkContext.broadcast(np.sort(np.concatenate(rows)) if rows else np.array([], np.uint64))
            self.cut.drop()

    def over(self, packs: DataFrame, each: Callable[[int, Sheet, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``each`` of (chunk, its sheet, keys in order) over all chunks."""
        shared = self.all if self.few else None
        if not self.few:
            own = self.cut.df.where(F.col("chunk") != _ALL).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys")).alias("hits"))
            packs = packs.join(own, "chunk", "left").select("chunk", "pack", "hits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = batch.column("hits").to_pylist() if shared is None else [None] * batch.num_rows
                for chunk, blob, own in zip(batch.column("chunk").to_pylist(), batch.column("pack"), hits):
                    keys = shared.value if shared else np.sort(np.concatenate([np.array([], np.uint64), *(_keys(x["keys"], x["bucket"]) for x in own or [])]))
                    yield from each(chunk, Sheet(blob.as_py()), keys)

        return packs.mapInArrow(run, schema)


def _send_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("pack")):
            yield from _by_bucket(chunk, *Sheet(blob.as_py()).distinct_seeds())


def _send_runs(chunk: int, sheet: Sheet, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _by_bucket(chunk, *sheet.distinct_runs(common))


def _unique_runs(chunk: int, sheet: Sheet, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    text = sheet.without(gone)
    yield pa.RecordBatch.from_arrays([sheet.rows.column("page_id"), sheet.rows.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """A row per input row: page_id, url, text (empty if none), n_chars (code points).

    A null or empty html has the empty text; a very long one is a chunk of its own.  Null ids and urls are kept; pages
    without a host share the host of no name; repeated rows keep a row each and
    count as one page, as do all with one kept text; an empty table gives no rows.  Other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    kind = rows.schema["page_id"].dataType.simpleString()
    packs = Cut(rows.withColumn("host", host).mapInArrow(_pack(chunk), "chunk long, pack binary"), codec="none").df
    common = Repeated(packs.mapInArrow(_send_seeds, _SENT), counts=True)
    gone = Repeated(common.over(packs, _send_runs, _SENT), counts=False)
    found = gone.over(packs, _unique_runs, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
