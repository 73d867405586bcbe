"""Periodic runs, HTML extraction and vector codes against brute force and hand-made pages."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.common import DDL, EDGES, documents, prose
from weftline.llm import html_text, periodic, queries, vector_codes
from weftline.llm import words as W

FOLDER = "/root/testdata/sf0.001"


# Periodic runs


def _runs(w):
    found, numbers = {}, {}
    ids = np.array([numbers.setdefault(x, len(numbers)) for x in w])
    for q in range(1, len(w) // 4 + 1):
        start, equal = None, ids[q:] == ids[:-q]
        if equal.sum() < 3 * q:
            continue
        for i, same in enumerate([*equal.tolist(), False]):
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(6, 4 * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def _digest(d, text, tails=True):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(d).encode())
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(w, runs)).hexdigest())


def _periodic_words(r):
    k = r.choice([1, 2, 3, 5, 50])
    w = [r.randrange(k) for _ in range(r.randrange(120))]
    for _ in range(r.randrange(4)):
        if len(w) > 1:
            a, p = r.randrange(len(w)), r.randrange(1, 30)
            w = w[:a] + w[a : a + p] * r.randrange(2, 9) + w[a + r.randrange(3) :]
    return w[:300]


@pytest.mark.parametrize("longest", [2, 1 << 12])
def test_runs_of_random_texts(monkeypatch, longest):
    monkeypatch.setattr(periodic, "LONGEST_KEY", longest)
    r = random.Random(longest)
    for _ in range(300):
        docs = [_periodic_words(r) for _ in range(r.randrange(1, 5))]
        h = W.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(7))
        assert periodic.find_runs(h, np.cumsum([0, *map(len, docs)])) == [_runs(d) for d in docs]


def test_runs_of_long_texts():
    for w, want in (([1] * 400_000, [(0, 400_000, 1)]), ([1, 2, 3] * 100_000 + [9], [(0, 300_000, 3)]), (list(range(20_000)) * 5, [(0, 100_000, 20_000)]), (list(range(50_000)) * 3, [])):
        assert periodic.find_runs(W.mix(np.array(w, np.uint64)), [0, len(w)]) == [want]


def test_collapse(spark):
    rows = [*EDGES, (50, "a b " * 5 + "c"), (51, "x\t\n x  x x x x y" + " p q r" * 7), (52, " ".join(["k"] * 5)), (53, "Z " * 6)]
    docs = documents(spark, [(d, t) for d, t in rows]).selectExpr("*", "'mine' as row", "7L as n_words", "'c' as collapsed", "1 as start")
    out = periodic.collapse(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_words", "collapsed")] + ["runs", "collapsed", "n_words"]
    got = sorted((str(r["doc_id"]), r["text"] or "", [tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"], r["row"], r["start"]) for r in out.collect())
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        want.append((str(d), t or "", _runs(w), _collapsed(w, _runs(w)).decode(), len(w), "mine", 1))
    assert got == sorted(want)
    assert periodic.collapse(spark.createDataFrame([], DDL)).count() == 0
    found = {r["doc_id"]: tuple(r)[1:] for r in periodic.summary(out.where("doc_id >= 50")).collect()}
    assert found == {d: _digest(d, t, tails=False) for d, t in rows if d is not None and d >= 50}


def test_op11_against_brute_force(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    assert got == {r["doc_id"]: _digest(r["doc_id"], r["text"]) for r in docs}
    assert sum(x[0] > 0 for x in got.values()) > len(docs) / 20


def test_tails_of_odd_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = documents(spark, [(ids[0], None), (ids[1], ""), (ids[2], " \t"), (ids[3], "one"), (ids[4], prose(1, 3000)), (ids[5], "a b"), (None, "a b c d e f"), (7, "x " * 9)])
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.summary(periodic.collapse(queries.with_tails(docs))).collect()}
    want = {r["doc_id"]: _digest(r["doc_id"], r["text"], r["doc_id"] is not None) for r in docs.collect()}
    assert got == want


# HTML extraction


def _text(page):
    found = html_text.blocks(page)
    return html_text._article(found)


MARKED = [
    ("", ""),
    ("plain <", None),
    ("<article><h1>T &amp; t&amp</h1><p><b>one<br><p>two&nbsp; \n three<p>four</article>after", "T & t&\none\ntwo three\nfour"),
    ("<body><nav>m<div>x</nav><header>h</header><main><header><h1>Title</h1></header><p>a <a href='>'>link</a>b</p></main><footer>f</footer>", "Title\na linkb"),
    ("<article><p>a<script>var t='</p><p>no</p>';</script>b<style>p{}</style><!-- <p>no</p> -->c</article>", "abc"),
    ("<article>x<aside>no<p>no</p></aside>y<form>no</form><div class='ad box'>no</div><div class=\"cookieNotice\">no</div>z</article><section id=comments><article>no</article></section>", "x\ny\nz"),
    ("<div class='page with-sidebar'><article class='post'>yes</article><div class=sidebar>no</div></div>", "yes"),
    ("<article><p>1 &lt; 2 &#65; &#x42; &bogus; &quo</p><p hidden>no</p><p style='display: none'>no</p><ul><li>i<li>j</ul><table><tr><td>c<td>d</table></article>", "1 < 2 A B &bogus; &quo\ni\nj\nc\nd"),
    ("<ARTICLE><P>A</P></ARTICLE><TITLE>no</TITLE>", "A"),
    ("<article><p>one</p><p>cut <b", "one\ncut"),
    ("<article><p>a < b <3 </p></ p><a title=\"unclosed>x</a><p>c</article>", "a < b <3\nx\nc"),
    ("<head><title>no</title><meta charset=x><p>loose</p>", None),
    ("<div role=main><p>yes</p></div><div role=search>no</div><p>outside</p>", "yes"),
    ("<nav>only</nav>", ""),
    ("<article>" + "<b>x " * 3000 + "</article>", " ".join(["x"] * 3000)),
    ("<article><p>a<span class=ad>no</span>b</p><noscript>no</noscript><h2>c</h2>d<textarea>no</textarea></article>", "ab\nc\nd"),
]


@pytest.mark.parametrize("page, want", MARKED)
def test_marked_pages(page, want):
    assert _text(page) == want


def test_scanner_is_linear():
    for page in ("<a href=\"" * 200_000, "<!-- " * 200_000, "</p>" * 200_000, "<" * 400_000, "<b>" * 200_000 + "</i>" * 200_000, "<script>" * 100_000, "<div><p>" * 100_000 + "x" + "</div>" * 100_000, "&" * 400_000):
        html_text.blocks(page)


def test_suffixes_in_order():
    r = random.Random(3)
    for _ in range(50):
        t = [r.randrange(3) for _ in range(r.randrange(60))]
        order, same = html_text.suffix_array(np.array(t, np.uint64), 8)
        keys = [tuple(t[i : i + 8]) for i in order]
        assert sorted(order.tolist()) == list(range(max(0, len(t) - 7)))
        seen = [k for k, _ in zip(keys, keys[1:], strict=False)]
        assert [bool(x) for x in same] == [i > 0 and seen[i - 1] == k for i, k in enumerate(keys)]
        assert len(set(keys)) == sum(not x for x in same)


NOTICE = "We use cookies on this site to give you the best experience we can."
MENU = "".join(f"<div><a href=/{x}>{x} of the house</a></div>" for x in ("Home", "News", "Sport", "Contact"))


def _page(body, host="a.example", n=0, notice=NOTICE):
    return (n, f"http://{host}/{n}", f"<html><body><div>{MENU}</div><p>{notice}</p>{body}<p>All rights kept by the owner of this very site, since 1999.</p></body></html>")


def test_pages_without_an_article(spark):
    texts = [f"<p>{prose(i, 60)}</p><p>{prose(1000 + i, 30)}</p>" for i in range(30)]
    rows = [_page(t, n=i) for i, t in enumerate(texts)]
    copied = f"<p>{prose(500, 80)}</p><p>{prose(501, 40)}</p>"
    rows += [_page(copied, n=100 + i) for i in range(12)]
    rows += [(200, "http://b.example/x", f"<p>{NOTICE}</p><p>{prose(600, 50)}</p>"), (201, "http://b.example/y", f"<div class=notice>{NOTICE}</div><article>{prose(601, 20)}</article>")]
    rows += [(300, None, None), (301, "odd", ""), (302, None, f"<p>{prose(700, 20)}</p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, 5, "t") for r in rows], "page_id long, url string, html string, n_chars int, page string")
    plain = lambda t: "\n".join(re.findall(r"<p>(.*?)</p>", t))
    want = {i: plain(t) for i, t in enumerate(texts)} | {100 + i: plain(copied) for i in range(12)}
    want |= {200: prose(600, 50), 201: prose(601, 20), 300: "", 301: "", 302: prose(700, 20)}
    for chunk in (100, 1 << 18):
        html_text.CHUNK_TOKENS = chunk
        out = html_text.extract(pages)
        assert out.columns == ["page_id", "url", "page", "text", "n_chars"]
        got = out.collect()
        assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) and r["page"] == "t" for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_prefix_counts_are_those_of_all_pages(spark):
    rows = [(f"h{i % 2}", i, " ".join(random.Random(i).choice("abc") for _ in range(60))) for i in range(20)]
    src = spark.createDataFrame([(zlib.crc32(h.encode()), f"<p>{t}</p><nav>{t[:40]}</nav>") for h, _, t in rows], "host long, html string").repartition(3)
    got = src.mapInArrow(html_text._prefixes, "host long, prefix long, pages long, articles long, furniture long").groupBy("host", "prefix").sum("pages", "furniture").collect()
    pages, furniture = defaultdict(set), defaultdict(set)
    for h, i, t in rows:
        w, f = t.split(), t[:40].split()
        both = w + f
        for k in range(len(both) - 7):
            pages[h, tuple(both[k : k + 8])].add(i)
        for k in range(len(f) - 7):
            furniture[h, tuple(f[k : k + 8])].add(i)
    assert Counter(r[2] for r in got) == Counter(map(len, pages.values()))
    assert Counter(r[3] for r in got if r[3]) == Counter(map(len, furniture.values()))


def test_op12_against_the_articles(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op12_html_extraction(spark, FOLDER).collect()}
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        text = "\n".join(x for x in parts if x)
        assert got[r["page_id"]] == (r["url"], text, len(text))


# Vector codes


def _brute(rows, parts=8, entries=16, rounds=6):
    """rows of (id, vector, label) -> [(id, code, error, label_error)], digest of the codebooks."""
    size = min(((i, v) for i, v, _ in rows if i is not None and _fine(v)), default=(0, []))[1]
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if _fine(v) and len(v) == len(size)]
    cuts = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(len(size)), parts))]).tolist()
    first = {}
    for i, v, _ in sorted((x for x in kept if x[0] is not None), key=lambda x: (x[0], x[1])):
        first.setdefault(i, v)
    books = [[list(first[i][a:b]) for i in sorted(first)[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for book, a, b in zip(books, cuts, cuts[1:], strict=False):
                d = [sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)) for e in book]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for e in range(len(books[k])):
                mine = [v[a:b] for (_, v, _), row in zip(kept, found, strict=True) if row[k][0] == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    coded = [(i, "".join(f"{c:02x}" for c, _ in row), sum(d for _, d in row), label) for (i, _, label), row in zip(kept, assign(), strict=True)]
    by_label = Counter()
    for _, _, e, label in coded:
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    within = lambda x: x if x < 2**63 else None
    return sorted(((i, c, within(e), within(by_label[label])) for i, c, e, label in coded), key=str), digest


def _fine(v):
    return bool(v) and all(x is not None and np.isfinite(x) and abs(x) * 4096 < 2**60 for x in v)


def _codes(df):
    books, places = vector_codes.train(df)
    out = vector_codes.with_label_error(vector_codes.encode(df, books, places))
    return out, vector_codes.codebooks_digest(books)


def _check(spark, rows, ddl="vec_id long, embedding array<double>, label int"):
    df = spark.createDataFrame(rows, ddl)
    out, digest = _codes(df)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=str)
    assert (got, digest) == _brute(rows)


def test_codes_of_odd_vectors(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)], r.choice([0, 1, None])) for i in range(80)]
    rows += [(5, None, 1), (6, [], 1), (7, [1.0] * 15, 1), (8, [1.0] * 15 + [None], 1), (9, [float("nan")] * 16, 1), (10, [float("inf")] * 16, None), (11, [2.0**60] * 16, 0), (None, [0.5] * 16, 2), (12, rows[12][1], 1), (13, [0.25] * 16, 1)]
    _check(spark, rows)
    _check(spark, rows[:7])
    _check(spark, [(i, [float(i % 3)] * 9, 1) for i in range(40)])
    _check(spark, [(i, [r.gauss(0, 1) * 10.0 ** r.randrange(9) for _ in range(8)], 1) for i in range(40)])
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert _codes(nothing)[0].count() == 0 and _codes(nothing)[1] == hashlib.sha256(b"").hexdigest()


def test_codes_keep_other_columns(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    rows = [(i, [float(i * k % 7) for k in range(8)], i % 4 or None, "r", 3, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string, error int, key string")
    out, _ = _codes(df)
    assert out.columns == ["vec_id", "embedding", "label", "row", "key", "code", "error", "label_error"]
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=str)
    assert got == _brute([x[:3] for x in rows])[0]


def test_tree_search_is_exact_and_skips():
    rng = np.random.default_rng(1)
    for m in (2, 50, 5000, 1 << 27, 1 << 58):
        for _ in range(20):
            book, rows = rng.integers(-m, m, (int(rng.integers(1, 20)), int(rng.integers(1, 9)))), None
            rows = rng.integers(-m, m, (50, book.shape[1]))
            if m > vector_codes.WIDE:
                book, rows = book.astype(object), rows.astype(object)
            best, least = vector_codes.VantageTree(book).nearest(rows)
            for q, b, d in zip(rows, best, least, strict=True):
                all_ = [sum((int(x) - int(y)) ** 2 for x, y in zip(q, e, strict=True)) for e in book]
                assert (all_.index(min(all_)), min(all_)) == (b, d)
    visits = [0]
    vector_codes.VantageTree(rng.integers(-4000, 4000, (16, 2))).nearest(rng.integers(-4000, 4000, (10_000, 2)), visits)
    assert visits[0] < 0.7 * 160_000


def test_op13_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()]
    got = queries.op13_vector_codes(spark, FOLDER).collect()
    want, digest = _brute(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want and {r["codebooks_sha256"] for r in got} == {digest}


def test_marked_pages_go_through_the_arrays(spark, tmp_path):
    """Every token of marked pages is sorted with its host's, and shared text of articles stays."""
    same = prose(900, 40)
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<nav>{MENU}</nav><article><p>{prose(i, 30)}</p><p>{same}</p></article><p>{NOTICE}</p><footer>{prose(2000 + i, 9)}</footer>") for i in range(40)]
    rows += [(50, None, "<nav>only</nav>"), (51, "", None), (52, "http://h0.example/0", rows[0][2])]
    log, plain = str(tmp_path / "tokens"), html_text.suffix_array

    def logged(batches):
        def counted(tokens, depth=html_text.DEPTH):
            with open(log, "a") as f:
                f.write(f"{len(tokens)}\n")
            return plain(tokens, depth)

        html_text.suffix_array = counted
        try:
            yield from html_text._by_chunks(batches)
        finally:
            html_text.suffix_array = plain

    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: f"{prose(i, 30)}\n{same}" for i in range(40)} | {50: "", 51: "", 52: f"{prose(0, 30)}\n{same}"}
    F = html_text.F
    src = pages.select(F.struct("page_id").alias("row"), F.xxhash64(html_text.host(F.col("url"))).alias("host"), F.xxhash64("url", "html").alias("page"), "html")
    assert src.mapInArrow(logged, "row struct<page_id: long>, page long, decided string").count() == len(rows)
    assert sum(map(int, open(log))) == sum(len(t.split()) for _, _, x in rows for t, _ in html_text.blocks(x or ""))


def test_short_blocks_and_pages_of_furniture_alone_but_for_a_line(spark):
    """Unmarked furniture in blocks of fewer tokens than a run has, and furniture that is over three quarters of its page."""
    made = lambda i: f"<div>Share this page</div><p>{prose(i, 30)}</p><div>Top</div><h2>{'Summary' if i < 3 else f'Part {i}'}</h2><p>{prose(100 + i, 20)}</p><div>Share this page</div>"
    want = {i: f"{prose(i, 30)}\n{'Summary' if i < 3 else f'Part {i}'}\n{prose(100 + i, 20)}" for i in range(8)}
    rows = [(i, f"http://a.example/{i}", made(i)) for i in range(8)]
    most = f"<p>{prose(300, 90)}</p><p>{prose(301, 60)}</p>"
    rows += [(20 + i, f"http://b.example/{i}", f"{most}<p>{prose(200 + i, 12)}</p><p>{prose(302, 40)}</p>") for i in range(6)]
    want |= {20 + i: prose(200 + i, 12) for i in range(6)}
    # Copies of one text that differ in a few words, and two pages that share most of theirs, keep it.
    rows += [(40 + i, f"http://c.example/{i}", f"<p>{prose(400, 60)}</p><p>day {i}</p>") for i in range(5)]
    want |= {40 + i: f"{prose(400, 60)}\nday {i}" for i in range(5)}
    rows += [(50 + i, f"http://d.example/{i}", f"<p>{prose(500, 60)}</p><p>{prose(501 + i, 9)}</p>") for i in range(2)]
    want |= {50 + i: f"{prose(500, 60)}\n{prose(501 + i, 9)}" for i in range(2)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (100, 1 << 18):
        html_text.CHUNK_TOKENS = chunk
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages.repartition(3)).collect()} == want
