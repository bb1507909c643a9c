import gzip
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


import corpus_pipeline
from veloscore.llm import class_lm, decontaminate, html_extract, language_id, mixing, warc
from veloscore.llm import words as w

SF_SMALL = "/root/testdata/sf0.001"


def test_words_and_hashes():
    texts = ["One  two\nthree", None, "", "two", "é\x0bx", "a" * 2000000 + " two"]
    found = w.find_words(*w.buffers(pa.array(texts).slice(0)), w.NOT_SPACE, w.LOWER)
    assert found.counts.tolist() == [3, 0, 0, 1, 2, 2]
    h = found.hashes()
    assert h[1] == h[3] == h[-1] and len(set(h.tolist())) == 6
    assert w.sliding_min(np.array([5, 3, 4, 1, 7]), 3).tolist() == [3, 1, 1]
    assert [len(x) for x in w.pieces(pa.array(["aa", "bb", "c" * 9, ""]), 4)] == [2, 1, 1]
    sliced = pa.array(["xx yy", "Zz é"]).slice(1)
    assert class_lm.tokens(sliced)[0].to_pylist() == ["zz", "é"]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    seq = rng.integers(1, 5, 300)
    index = decontaminate.FMIndex(seq, 5)
    for size in (1, 2, 4):
        phrases = rng.integers(1, 5, (20, size))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(len(seq) - size + 1) if (seq[i:i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def brute_contamination(data, items):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    windows = {}
    for i, t in items:
        x = words(t)
        k = min(13, len(x))
        for a in range(len(x) - k + 1 if k else 0):
            windows.setdefault(tuple(x[a:a + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in data:
        x, got = words(t), set()
        hit = [False] * len(x)
        for k in {len(v) for v in windows}:
            for a in range(len(x) - k + 1):
                if found := windows.get(tuple(x[a:a + k])):
                    got |= found
                    hit[a:a + k] = [True] * k
        n = sum(hit)
        out.append((i, len(x), n, len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), n > 0 and 20 * n >= len(x)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [1 << 20, 10])
def test_decontamination_is_brute_force(docs, bench, block_words):
    data, items = [(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()]
    found = decontaminate.find_benchmark(docs.select("doc_id", "text"), bench, "r", block_words=block_words)
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = sorted(((r.doc_id, *(r.r[n] for n in names)) for r in found.collect()), key=repr)
    assert got == brute_contamination(data, items)


def test_decontamination_keeps_clean(docs, bench, empty):
    kept = decontaminate.keep_clean(docs, bench)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 10 not in ids and 16 not in ids and {1, 4, 5, 14} <= ids
    assert decontaminate.contamination(empty, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies, and this text is quite long to tempt.</div>
<main><article><h1>The title</h1><p>First   paragraph &amp; more,<br>with a break and <b>bold</b> text.<p>Short.</p><form><input value="x">Sign up</form>
<blockquote>A quoted block of text.</blockquote><div class="ad">Buy now</div><ul><li>item one</li><li>item two</li></ul><p hidden>secret</p></article>
<section class="comments"><article class="comment"><p>A reader's comment that is as long as the whole article and then some more of it.</p></article></section></main>
<aside>Related stories</aside><footer>&copy; someone</footer></body></html>"""


def test_html_extraction():
    want = "The title\nFirst paragraph & more, with a break and bold text.\nShort.\nA quoted block of text.\nitem one\nitem two"
    assert html_extract.main_text(PAGE) == want
    plain = PAGE.replace("main>", "div>").replace("<article>", "<div>").replace("</article>\n", "</div>\n")
    assert html_extract.main_text(plain) == want
    for odd in (None, "", "<", "&", "<p", "<![x[", "<!--", "<p>a", "</p>", "<nav>only</nav>", "<script>x", "<b></b>" * 50, "\x00<p>\x00"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("just text &lt; here") == "just text < here"
    long = "<article>" + "<p>x y</p>" * 5000 + "</article>"
    assert html_extract.main_text(long) == "\n".join(["x y"] * 5000)


LONG = "A paragraph that is long enough to be most of the article, with words and more words in it. " * 8
LONG = LONG.strip()


@pytest.mark.parametrize("page, want", [
    (f"<div><h1>Title</h1><p>short</p><p>{LONG}</p></div>", f"Title\nshort\n{LONG}"),
    (f"<body><div><h1>Title</h1></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title\n{LONG}\n{LONG}\n{LONG}"),
    (f"<body><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG[:200]}</p></section></body>", f"{LONG}\n{LONG}\n{LONG[:200]}"),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><article><p>teaser</p></article></body>", f"{LONG}\n{LONG}"),
])
def test_html_region_is_whole(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("around", ['<main class="content with-sidebar">{}</main>', '<div class="layout no-sidebar">{}</div>', '<div class="elementor-widget">{}</div>', '<article class="post share-enabled">{}</article>', '<form action="x">{}</form>'])
def test_html_names_do_not_drop_the_article(around):
    body = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><div class='sidebar'>Links</div>"
    assert html_extract.main_text(f"<body><nav>Home</nav>{around.format(body)}<footer>f</footer></body>") == f"Title\n{LONG}\nShort."


def test_html_names_of_many_sections_and_of_comments():
    parts = [f"{k} {LONG}" for k in range(4)]
    page = "<body>" + "".join(f'<div class="elementor-widget"><p>{x}</p></div>' for x in parts) + "</body>"
    assert html_extract.main_text(page) == "\n".join(parts)
    page = f'<body><div><p>{LONG}</p></div><article class="comment"><p>{LONG}</p><p>{LONG}</p></article></body>'
    assert html_extract.main_text(page) == LONG
    for side in ("ad", "sidebar"):  # more text than the article, and still none of it
        page = f'<body><div class="{side}">{LONG}</div><article><p>{LONG[:300]}</p></article></body>'
        assert html_extract.main_text(page) == LONG[:300]


@pytest.mark.parametrize("name", ["social-history", "notice-period", "related-work", "search-results", "comment-on-the-text", "widget", "share-price"])
def test_html_article_sections_keep_their_text(name):
    for part in (f'<section class="{name}"><h2>Part</h2><p>{LONG}</p></section>', f'<div id="{name}"><h2>Part</h2><p>{LONG}</p></div>'):
        page = f"<body><nav>Home</nav><article><h1>Title</h1><p>{LONG}</p>{part}<p>End.</p></article><footer>f</footer></body>"
        assert html_extract.main_text(page) == f"Title\n{LONG}\nPart\n{LONG}\nEnd."


def test_html_asides_in_an_article_are_judged_by_their_text():
    for tag in ("aside", "menu"):
        page = f"<body><{tag}><p>{LONG}</p></{tag}><article><p>{LONG}</p><{tag}><p>{LONG}</p></{tag}><{tag}>More</{tag}></article></body>"
        assert html_extract.main_text(page) == f"{LONG}\n{LONG}"


PLAIN = f"""<body><div><div><a href=a>Home</a> <a href=b>About</a> <a href=c>Contact</a> <a href=d>Login</a></div></div>
<div>{{}}<h1>The title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>{{}}</div><div><div>Copyright 2024 all rights reserved</div></div></body>"""


def test_html_clusters_decide_without_names(monkeypatch):
    want = f"The title\n{LONG}\nShort.\n{LONG}"
    bare = PLAIN.format("", "").replace("<div>", "").replace("</div>", "")
    assert html_extract.main_text(PLAIN.format("", "")) == want
    assert html_extract.main_text(bare.replace("Copyright", "<div>Copyright")) == want
    full = html_extract.clusters
    monkeypatch.setattr(html_extract, "clusters", lambda ratio, text, running: full(np.ones(len(ratio)), text, running))
    flat = html_extract.main_text(PLAIN.format("", ""))
    assert "Home About Contact Login" in flat and "Copyright 2024" in flat


def test_html_smoothing_takes_short_lines_along():
    ratio = np.array([2.0, 300.0, 20.0, 300.0, 2.0, 2.0, 2.0, 2.0, 2.0, 30.0])
    yes = np.ones(len(ratio), bool)
    seed, cluster = html_extract.clusters(ratio, yes, yes)
    assert np.flatnonzero(seed).tolist() == [1, 3] and cluster[:5].all() and not cluster[6:].any()
    _, apart = html_extract.clusters(ratio, yes, ~yes)
    assert np.flatnonzero(apart).tolist() == [1, 3]  # only running text goes on
    assert html_extract.smooth(np.ones(7)) == pytest.approx(np.ones(7))


@pytest.mark.parametrize("page", ["<div><p>x", "<b>", "<p><div><span>", "<table><tr><td>x", "<i></b>x", "<li>x<ul>"])
def test_html_is_linear_in_depth(page):
    """Twice the page takes about twice the time, however deep it is."""
    took = []
    for n in (5000, 20000):
        start = time.process_time()
        html_extract.main_text(page * n + "<hr>" * n + "</i>" * n)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "v", "", "t")], "page_id bigint, url string, html string, text string")
    got = {(r.page_id, r.n_chars == len(r.text), r.text[:9]) for r in html_extract.extract_pages(pages).collect()}
    assert got == {(1, True, "The title"), (2, True, ""), (3, True, "")}
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://x/é", PAGE), (2, None, "<p>a</p>"), (3, "u", None), (4, "u", ""), (4, "u", "")], "page_id bigint, url string, html string")
    got = warc.archive_of(pages).collect()
    assert Counter(r.page_id for r in got) == {1: 2, 2: 2, 4: 4}
    source = {r.page_id: warc.parse(bytes(r.record)) for r in warc.responses(pages).collect() if r.record}
    for r in got:
        head, block = warc.parse(bytes(r.record))
        h = dict(head)
        whole = dict(source[r.page_id][0])
        assert h["WARC-Refers-To"] == r.refers_to == whole["WARC-Record-ID"] and r.source_digest == whole["WARC-Payload-Digest"]
        assert h["WARC-Block-Digest"] == warc.digest(block) and int(h["Content-Length"]) == len(block) == r.content_length
        if r.warc_type == "metadata":
            fields = block.decode()
            assert all(f"source-{k}: {v}\r\n" in fields for k, v in source[r.page_id][0]) and "http-Content-Type: text/html" in fields
    twin = {(r.page_id, r.warc_type): r for r in got}
    assert twin[1, "metadata"].concurrent_to == twin[1, "conversion"].record_id
    assert "secret" in bytes(twin[1, "conversion"].record).decode() and "var a" not in bytes(twin[1, "conversion"].record).decode()


@pytest.mark.parametrize("record", [None, b"", b"junk", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx"])
def test_warc_without_derivatives(record):
    assert warc.derive(record) == []


def test_warc_folded_and_unknown_charset():
    record = warc.build([("WARC-Type", "response")], b"HTTP/1.0 200 OK\r\nContent-Type: text/html;\r\n charset=nonsense\r\n\r\n<p>hi</p>")
    assert warc.plain_text("<p>hi</p>") == "hi" and len(warc.derive(record)) == 2 and warc.derive(record) == warc.derive(record)


def _response(head, payload):
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + payload)


def _conversion(head, payload):
    found = {r["warc_type"]: r for r in warc.derive(_response(head, payload))}
    if "conversion" not in found:
        assert found["metadata"]["concurrent_to"] is None and b"Concurrent" not in found["metadata"]["record"]
        return None
    return warc.parse(found["conversion"]["record"])[1].decode()


def test_warc_codings():
    html = b"<p>h\xc3\xa9llo</p><p>there</p>"
    want = "h\u00e9llo\nthere"
    chunked = b"5\r\n" + html[:5] + b"\r\n%x;x=1\r\n" % (len(html) - 5) + html[5:] + b"\r\n0\r\n\r\n"
    packed = gzip.compress(html[:9]) + gzip.compress(html[9:])
    for head, body in ((b"Transfer-Encoding: chunked", chunked), (b"Content-Encoding: gzip", packed), (b"Content-Encoding: deflate", zlib.compress(html)), (b"Content-Encoding: deflate", zlib.compress(html)[2:-4]),
                       (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"), (b"Transfer-Encoding: chunked", html), (b"X: y", html)):
        assert _conversion(head, body) == want, head
    assert _conversion(b"Content-Encoding: br", html) is None
    record = _response(b"Transfer-Encoding: chunked", chunked)
    assert warc.derive(record)[0]["source_digest"] == warc.digest(html)
    assert warc.unchunked(b"ff\r\nshort") == b"short" and warc.unchunked(b"") == b""
    assert warc.uncoded(packed[:-12], "gzip") is not None and warc.uncoded(b"junk", "gzip") is None


def test_warc_content_types():
    png = b"\x89PNG\r\n\x1a\n\0\0"
    assert _conversion(b"Content-Type: image/png", png) is None and _conversion(b"X: y", png) is None
    assert _conversion(b"Content-Type: text/plain", b"a <x> b &amp;\n c") == "a <x> b &amp;\n c"
    assert _conversion(b"Content-Type: application/ld+json", b'{"a": "<b>"}') == '{"a": "<b>"}'
    assert _conversion(b"X: y", b"  <p>a</p>") == "a" and _conversion(b"X: y", b"a < b") == "a < b"
    assert _conversion(b"Content-Type: text/html", b"<meta charset=latin-1><p>\xe9</p>") == "\u00e9"


def test_warc_ids_of_pages_that_share_a_name(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>b</p>"), (1, "u", "<p>b</p>")], "page_id bigint, url string, html string").withColumn("record", F.lit("x")).withColumn("Made", F.lit(1))
    got = warc.archive_of(pages).collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 4 and len({r.refers_to for r in got}) == 2
    assert warc.archive_of(pages.limit(0)).collect() == []


def test_warc_page_text():
    text, links = warc.read_page("<title>T</title><p>a<b>b</b> c<br>d<script>x<p></script><!-- <a href=no> --><a href='u&amp;v'>l</a><template><a href=no>t</a></template><a>n</a><noscript>y")
    assert text == "T\nab c\nd l n" and links == ["u&v"]


@pytest.mark.parametrize("page", ["<a ", "<div", "<a href=x>", "<script>", "<!--", "<p>&amp;"])
def test_warc_is_linear(page):
    took = []
    for n in (10_000, 40_000):
        start = time.process_time()
        warc.read_page(page * n)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.3


def test_mixing(docs, empty):
    got = mixing.curriculum(docs).collect()
    assert len(got) == docs.count() and mixing.curriculum(empty).collect() == []
    again = mixing.curriculum(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = {id(r): r for r in got}
    assert all(0 <= r.taken <= 2 * r.size for r in sizes.values())
    total = sum(r.size for r in got)
    by_target = Counter()
    for r in got:
        by_target[r.target] += r.taken
    assert sum(math.floor(t) for t in by_target) == sum(by_target.values()) and abs(sum(by_target.values()) - 1.5 * total) <= 10
    used = mixing.uses(docs).collect()
    assert sum(r.words for r in used) == sum(r.taken for r in got) and all(0 <= r.position <= 1 for r in used)


def test_class_lm(docs, empty):
    got = class_lm.score_texts(docs, classes=6).collect()
    data = [(r.doc_id, ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] + ["\n"]) for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for i, x in data if not held(i) for t in x)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(x), sum(c[t] > 0 for t in x), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), 6)) for i, x in data)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and class_lm.score_texts(empty).collect() == []


def test_class_lm_beats_its_base(spark):
    got = class_lm.score_texts(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    unseen = [r for r in got if r.held_out]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def _words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def _plain_classes(texts, k):
    """Exchange with dictionaries: the classes of the best sweep, the number of sweeps, the bigrams."""
    times = Counter(x for t in texts for x in t)
    cls = {x: k - 1 for x in times}
    for c, x in enumerate(sorted(times, key=lambda x: (-times[x], x.encode()))[:k - 2]):
        cls[x] = c + 1
    n, best, sweeps = sum(times.values()) + len(texts), (-math.inf, None, None), 0
    while True:
        table, left, right = Counter(), Counter(), Counter()
        for t in texts:
            now = [0, *(cls[x] for x in t), 0]
            table.update(zip(now, now[1:]))
            left.update((x, now[i]) for i, x in enumerate(t))
            right.update((x, now[i + 2]) for i, x in enumerate(t))
        size = Counter()
        for (_, c), m in table.items():
            size[c] += m
        p = lambda a, b: (table[a, b] + 4 * size[b] / n) / (size[a] + 4)
        found = sum(m * math.log(m) for m in table.values()) - 2 * sum(m * math.log(m) for m in size.values())
        gain = found - best[0]
        if gain > 0:
            best = (found, dict(cls), (dict(table), dict(size)))
        if gain < class_lm.GAIN * n:
            return best, sweeps, times
        sweeps += 1
        new = {}
        for x in times:
            value = {b: round(sum(m * math.log(p(c, b)) for (y, c), m in left.items() if y == x) + sum(m * math.log(p(b, c)) for (y, c), m in right.items() if y == x) - times[x] * math.log(size[b]), 6) for b in sorted(size) if b}
            top = max(value.values())
            new[x] = cls[x] if value[cls[x]] >= top else next(b for b in value if value[b] == top)
        cls = new


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 6)])
def test_class_lm_is_brute_force(spark, monkeypatch, seed, k):
    """Classes, sweeps and scores of a small corpus, in many blocks and buckets."""
    monkeypatch.setattr(class_lm, "BLOCK", 60)
    monkeypatch.setattr(class_lm, "TOLD", 0 if seed == 2 else 1 << 20)  # joined, and broadcast
    rng = np.random.default_rng(seed)
    noun, verb, rare = [f"n{i}" for i in range(8)], [f"v{i}" for i in range(6)], [f"é{i}" for i in range(40)]
    rows = []
    for i in range(90):
        text = " ".join(w for _ in range(rng.integers(0, 12)) for w in (rng.choice(noun), rng.choice(verb) if rng.random() < 0.8 else rng.choice(rare)))
        rows.append((i if i % 11 else None, text if i % 13 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [_words(t) for (_, t), h in zip(rows, held, strict=True) if not h]
    (_, cls, (table, size)), sweeps, times = _plain_classes(texts, k)
    model = class_lm.Classes(df, k)
    assert {r[0]: (r[1], r[2]) for r in model.words().collect()} == {x: (times[x], cls[x]) for x in times}
    assert model.sweeps == sweeps >= 1
    n, once = sum(times.values()) + len(texts), sum(m == 1 for m in times.values())
    unseen = (once + 1) / (n + once + 2)

    def score(text):
        before, total = 0, 0.0
        for x in [*_words(text), None]:
            c = 0 if x is None else cls.get(x, -1)
            share = size.get(c, 0) / n
            if c < 0:
                p = unseen
            else:
                p = (1 - unseen) * (share if before < 0 else (table.get((before, c), 0) + 4 * share) / (size[before] + 4)) * (1 if x is None else times[x] / size[c])
            total += math.log10(p)
            before = c
        return total

    got = sorted((repr(r.doc_id), round(r.score, 6)) for r in model.scores().collect())
    assert got == sorted((repr(i), round(score(t), 6)) for i, t in rows)


def test_class_lm_probabilities_sum_to_one(spark):
    """Over all known words, an unknown one and the end, after any word."""
    train = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = "a b c a b d e a b f".split()
    rows = [(train, " ".join(words))] + [(held, f"b {x}") for x in sorted(set(words))] + [(held, "b zzz"), (held, "b")]
    got = class_lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), 4)
    by_text = sorted((r.n_tokens, r.score) for r in got.where(f"doc_id = {held}").collect())
    model = class_lm.Classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 4)
    cls = {r[0]: r[2] for r in model.words().collect()}
    assert set(cls.values()) <= {1, 2, 3} and len(by_text) == 8
    t = model.table
    share = t.sum(0) / t.sum()
    u = (model.once + 1) / (model.n + model.once + 2)
    p = (1 - u) * class_lm.transitions(t)[cls["b"]]
    assert p.sum() + u == pytest.approx(1) and share.sum() == pytest.approx(1)


def test_exchange_finds_classes():
    """Words 0-9 and 10-19 alternate; all begin in one class, but for one of each kind."""
    rng = np.random.default_rng(0)
    follows = np.zeros((20, 20), np.int64)
    for _ in range(20000):
        a, b = rng.integers(0, 10), rng.integers(10, 20)
        follows[a, b] += 1
        follows[b, a] += 1
    cls = np.full(20, 3)
    cls[0], cls[10] = 1, 2
    for _ in range(5):
        hot = np.eye(4, dtype=np.int64)[cls]
        table = hot.T @ follows @ hot
        counts = np.concatenate([follows.T @ hot, follows @ hot], axis=1).astype(float)
        cls = class_lm.best_classes(counts, follows.sum(0), cls, table)
    assert len(set(cls[:10])) == len(set(cls[10:])) == 1 and cls[0] != cls[10]


def test_gradients_are_right():
    rng = np.random.default_rng(4)
    net = language_id.ByteGru.fresh(["a", "b"], 3)
    names = ("embed", "gates", "cand", "out", "bias")
    for k in names:
        setattr(net, k, getattr(net, k).astype(float))
    strips, label = rng.integers(1, 9, (7, 5)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    _, g = net.gradients(strips, label)
    for k in names:
        a = getattr(net, k)
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        old, loss = a[at], []
        for step in (1e-2, -1e-2):
            a[at] = old + step
            loss.append(net.gradients(strips, label)[0])
        a[at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][at]) < 1e-3


def test_language_id(spark, docs, empty):
    data = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in data.collect()}
    got = language_id.languages(data).collect()
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.85 * len(unseen)
    net = language_id.train(data, steps=30)
    text = "Größe und Maß " * 20
    mean = net.label_positions(text).mean(0)
    p = np.exp(mean - mean.max())
    assert np.allclose(p / p.sum(), net.pooled(pa.array([text]))[0], atol=1e-5)
    odd = language_id.languages(docs).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {4, 5, 11, 12, None} and all(0 <= r.score <= 1 for r in odd)
    assert language_id.languages(empty).collect() == []
    assert language_id.keep_identified(docs).columns == docs.columns


def test_language_sample_is_of_whole_texts(spark):
    """Strips of every twentieth of a long text, all strips of a short one, whole characters or not."""
    long = "".join(chr(97 + i % 26) * language_id.STRIP for i in range(400))
    df = spark.createDataFrame([(1, long), (2, "é" * 100), (3, "x")], "doc_id bigint, text string")
    got = {r.doc_id: [bytes(x) for x in r.strips] for r in df.select("doc_id", language_id._drawn_strips(F.col("text")).alias("strips")).collect()}
    assert got[3] == [b"x"] and b"".join(got[2]) == ("é" * 100).encode()
    places = [long.encode().index(x) // language_id.STRIP for x in got[1]]
    assert len(got[1]) == language_id.SAMPLE_STRIPS and len(set(got[1])) > 10 and max(map(len, got[1])) == language_id.STRIP
    assert sorted(places) != list(range(language_id.SAMPLE_STRIPS))


def test_language_id_learns_every_language(spark):
    rng = np.random.default_rng(9)
    data = []
    for k in range(72):  # of few letters each, no two languages the same ones
        letters = [chr(0x400 + k * 3 + x) for x in range(3)]
        for i in range(4 if k else 40):
            data.append((1000 * k + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(30)), f"l{k:02}"))
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    truth = {i: lang for i, _, lang in data}
    got = language_id.languages(df).collect()
    trained = {truth[r.doc_id] for r in got if not r.held_out}
    mine = [r for r in got if truth[r.doc_id] in trained]
    right = [r for r in mine if r.lang_pred == truth[r.doc_id]]
    assert len(trained) > 64 and len({r.lang_pred for r in got}) > 64 and len(right) >= 0.9 * len(mine)


def test_pipeline(spark, docs, tmp_path, bench):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {1, 9, 13, 14, 15}
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    bench.limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
