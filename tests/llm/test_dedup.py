import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import DDL, EDGES, SPACE, UPPER, components, documents, prose
from weftline.llm import components as C
from weftline.llm import embed_dedup, fm_index, license_scan, line_dedup, minhash, substring
from weftline.llm import words as W


@pytest.fixture(scope="module")
def corpus():
    """Edge cases, near copies around the threshold, shared passages, repeated lines."""
    rows, r = list(EDGES), random.Random(5)
    passage = prose(99, 60)
    for g in range(6):
        base = prose(1000 + g, 150).split()
        for k in range(12):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8])):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            if k % 4 == 0:
                at = r.randrange(len(words))
                words[at:at] = passage.split()
            rows.append((100 + 12 * g + (k * 7) % 12, " ".join(words)))
    lines = [prose(2000 + i, 8).capitalize() for i in range(6)]
    for k in range(20):
        rows.append((300 + k, "\n".join(r.choice([*lines, "", prose(3000 + k, 6)]) for _ in range(10))))
    return rows


def _shingles(t):
    w = SPACE.findall((t or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_agrees_with_all_pairs(spark, corpus, percent):
    sets = {}
    for d, t, *_ in corpus:
        if d is not None:
            assert d not in sets or sets[d] == _shingles(t)
            sets[d] = _shingles(t)
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(edges, ids)
    got = minhash.near_duplicates(documents(spark, corpus), percent=percent).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert len(set(comp.values())) < len(ids)


def test_minhash_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    base = prose(1, 120).split()
    rows = []
    for k in range(30):
        words = list(base)
        words[k * 3] = f"edit{k}"
        rows.append((k, " ".join(words)))
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_minhash_nothing_and_clashing_columns(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).withColumnsRenamed({"lang": "regs", "source": "key"})
    assert [r["doc_id"] for r in minhash.keep_one(df).collect()] == [1]


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_recall_on_the_documents(spark, percent):
    """Every link between different texts of a whole table, against all pairs that share a shingle; and the components."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows, r = list(zip(table["doc_id"], table["text"], strict=True)), random.Random(percent)
    for d, t in rows[:400]:  # planted copies, from a word changed to far below the threshold
        words = (t or "").split(" ")
        for k in range(3):
            copy = list(words)
            for _ in range(r.randint(1, 1 + len(copy) // 30)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**9)}"
            rows.append((10**6 + 10 * d + k, " ".join(copy)))
    sets = {d: frozenset(_shingles(t)) for d, t in rows}
    first, by_shingle = {}, {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    for s, d in first.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    pairs = {(a, b) for ids in by_shingle.values() if len(ids) > 1 for i, a in enumerate(ids) for b in ids[i + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(links) > 400
    want = components([*links, *((d, first[s]) for d, s in sets.items() if s)], sets)
    docs = documents(spark, rows).repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent=percent).collect()} == want


def test_sketch_estimates_are_close():
    a = np.unique(W.mix(np.arange(1, 2001, dtype=np.uint64)))
    b = np.unique(W.mix(np.arange(201, 2201, dtype=np.uint64)))
    x, y = minhash.registers(a), minhash.registers(b)
    assert minhash.likely(x, y[None], minhash.EMPTY, minhash.COLLISION, 0.82)[0]
    far = minhash.registers(np.unique(W.mix(np.arange(10_000, 12_000, dtype=np.uint64))))
    assert not minhash.likely(x, far[None], minhash.EMPTY, minhash.COLLISION, 0.8)[0]


def _windows(rows, width):
    """Brute force: words covered by a window that also starts in a smaller document."""
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault((d, t), SPACE.findall(t or ""))
    least = {}
    for (d, _), w in texts.items():
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(least.get(k, d), d)
    out = {}
    for (d, t), w in texts.items():
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - width + 1):
                if least[tuple(w[i : i + width])] < d:
                    gone[i : i + width] = [True] * width
        out[d, t] = gone
    return texts, out


@pytest.mark.parametrize("shard", [600_000, 500])
def test_substring_agrees_with_all_windows(spark, corpus, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    texts, gone = _windows(corpus, 50)
    got = substring.remove(documents(spark, corpus), width=50).collect()
    assert len(got) == len(corpus)
    for r in got:
        k = (r["doc_id"], r["text"])
        kept = " ".join(w for w, g in zip(texts[k], gone[k], strict=True) if not g)
        assert (r["n_words"], r["n_removed"], r["clean_text_words"]) == (len(texts[k]), sum(gone[k]), kept)
        assert " ".join(SPACE.findall(r["clean_text"] or "")) == kept
        assert (r["clean_text"] is None) == (r["text"] is None)
    assert sum(map(sum, gone.values())) > 1000


def test_substring_nothing(spark):
    assert substring.remove(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "a  b\n c")])
    df = df.withColumns({n: df["doc_id"] for n in ("spans", "_spans", "_d", "_kd", "row", "key", "d", "t", "n_words")})
    got = substring.remove(df).first()
    assert got["clean_text"] == "a  b\n c" and got["n_removed"] == 0 and got["n_words"] == 3 and all(got[n] == 1 for n in ("spans", "_spans", "_d", "_kd", "row", "key", "d", "t"))


@pytest.mark.parametrize("width", [51, 65, 100])
def test_substring_of_other_widths(spark, width):
    """Texts that agree for longer than 64 words before they differ, and in all of them."""
    base, rows, r = prose(3, 400, 3).split(), [], random.Random(width)
    for k in range(60):
        words = list(base[: r.randint(120, 400)])
        for _ in range(k % 5):
            words[r.randrange(len(words))] = f"edit{r.randrange(4)}"
        rows.append((k, " ".join(words)))
    texts, gone = _windows(rows, width)
    for x in substring.remove(documents(spark, rows), width=width).collect():
        k = (x["doc_id"], x["text"])
        assert x["clean_text_words"] == " ".join(w for w, g in zip(texts[k], gone[k], strict=True) if not g)


def test_exact_copies_are_found_by_the_index(spark, monkeypatch):
    monkeypatch.setattr(substring, "_search", lambda table, width: (np.zeros(0, np.int64),) * 3)
    rows = [(k, prose(4, 80)) for k in range(3)]
    assert {x["n_removed"] for x in substring.remove(documents(spark, rows)).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(2, 6))
def test_fm_index_finds_what_a_scan_finds(texts, width):
    symbols = np.concatenate([[*t, 0] for t in texts]).astype(np.int64)
    size = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size + 1)
    index = fm_index.FMIndex(symbols, owner, 4, width)
    ask = np.flatnonzero(size >= width)
    lengths = fm_index.matching_statistics(index, symbols, owner, begin[ask], begin[ask] + size[ask], width)
    for at in np.flatnonzero(lengths >= 0).tolist():
        own = owner[at]
        earlier = [x for t in texts[:own] for x in [",".join(map(str, ["", *t, ""]))]]
        t, e = texts[own], at - begin[own]
        longest = max(n for n in range(min(width, e + 1) + 1) if n == 0 or any("," + ",".join(map(str, t[e + 1 - n : e + 1])) + "," in x for x in earlier))
        assert lengths[at] == longest
    mark = np.zeros(len(symbols), bool)
    for a, b in zip(*fm_index.intervals(lengths, width), strict=True):
        mark[a:b] = True
    _, gone = _windows([(d, " ".join(map(str, t))) for d, t in enumerate(texts)], width)
    for d, t in enumerate(texts):
        assert mark[begin[d] : begin[d] + len(t)].tolist() == gone[d, " ".join(map(str, t))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_fm_index_counts(text, pattern):
    symbols = np.array([*text, 0], np.int64)
    index = fm_index.FMIndex(symbols, np.zeros(len(symbols), np.int32), 5, 8)
    lo, hi = np.array([0]), np.array([len(symbols)])
    for c in reversed(pattern):
        lo, hi = index.step(np.array([c]), lo, hi)
        if lo[0] >= hi[0]:
            break
    n = sum(text[i : i + len(pattern)] == pattern for i in range(len(text)))
    assert max(0, int(hi[0] - lo[0])) == n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_fm_index_knows_the_smallest_owner(n, seed):
    r = np.random.default_rng(seed)
    symbols = np.append(r.integers(1, 4, n), 0)
    owner = r.integers(0, 1000, n + 1).astype(np.int32)
    index = fm_index.FMIndex(symbols, owner, 4, 4)
    lo = r.integers(0, n + 1, 50)
    hi = r.integers(lo + 1, n + 2)
    assert index.smallest(lo, hi).tolist() == [int(index.owner[a:b].min()) for a, b in zip(lo, hi, strict=True)]
    with pytest.raises(ValueError):
        fm_index.matching_statistics(index, symbols, owner, lo, hi, 5)


def test_line_dedup_agrees_with_brute_force(spark, corpus):
    import re

    seen, want = {}, {}
    texts = sorted({(d, t) for d, t, *_ in corpus if d is not None and t is not None})
    at = {}
    for d, t in texts:
        lines = t.split("\n")
        at[d, t] = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        for k in range(len(at[d, t]) - 1):
            seen.setdefault((lines[at[d, t][k]], lines[at[d, t][k + 1]]), (d, t, k))
    for d, t in texts:
        lines, gone = t.split("\n"), set()
        for k in range(len(at[d, t]) - 1):
            if seen[lines[at[d, t][k]], lines[at[d, t][k + 1]]] != (d, t, k):
                gone |= {at[d, t][k], at[d, t][k + 1]}
        want[d, t] = (len(at[d, t]), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    got = line_dedup.remove(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if (r["doc_id"], r["text"]) in want:
            assert (r["n_lines"], r["n_removed"], r["clean_text"]) == want[r["doc_id"], r["text"]]
        else:
            assert r["n_removed"] == 0 and r["clean_text"] == r["text"]
    assert sum(w[1] for w in want.values()) > 20


@pytest.mark.parametrize("window", [1, 3])
def test_winnowed_runs_of_other_lengths(spark, window):
    """All windows of so many lines, against the selected minima; and fewer lines selected than there are."""
    r = random.Random(window)
    rows = [(k, "\n".join(r.choice("abcdefgh") if r.random() < 0.7 else f"{k} {i}" for i in range(40))) for k in range(30)]
    seen, want = {}, {}
    for d, t in rows:
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - window + 1):
            if seen.setdefault(tuple(lines[i : i + window]), (d, i)) != (d, i):
                gone |= set(range(i, i + window))
        want[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    df = documents(spark, rows)
    assert {x["doc_id"]: x["clean_text"] for x in line_dedup.remove(df, window=window).collect()} == want
    n = line_dedup.fingerprints(df, window).count()
    assert n == 1200 if window == 1 else n < 900


def test_lines_of_fingerprints_alone_are_found(spark, monkeypatch):
    """Without the selected lines nothing is found: they are not a filter beside another path."""
    real = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda *a: real(*a).where("false"))
    assert line_dedup.repeats(documents(spark, [(1, "a\nb\nc"), (2, "a\nb\nc")])).count() == 0


def test_line_dedup_nothing_and_clashing_columns(spark):
    assert line_dedup.remove(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "a\nb"), (2, "a\nb\nc")]).withColumnsRenamed({"lang": "gone", "source": "d", "n_chars": "t"})
    df = df.withColumn("row", df["d"]).withColumn("n_removed", df["d"])
    got = {x["doc_id"]: (x["clean_text"], x["n_removed"], x["gone"], x["d"], x["row"]) for x in line_dedup.remove(df).collect()}
    assert got == {1: ("a\nb", 0, "en", "src0", "src0"), 2: ("c", 2, "en", "src0", "src0")}


def test_single_lines_and_copies_of_one_line_leave_the_texts_of_the_pipeline(spark):
    import corpus_pipeline

    rows = [(1, "a one\nsubscribe now\nb one"), (2, "c two\nsubscribe now\n\nd two"), (3, "one line " * 60), (4, "one line " * 60), (5, "e\nf\ne"), (6, "subscribe now"), (7, None)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline._lines(spark, documents(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: "c two\n\nd two", 3: rows[2][1], 4: "", 5: "e\nf", 6: "", 7: None}


def test_every_line_agrees_with_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    name, folder = "op8_every_line", "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select doc_id, n_lines, n_removed, kept_sha256 from ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 0


def test_line_dedup_plan_is_native(spark, corpus):
    plan = line_dedup.remove(documents(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def _vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + r.normal(size=16) * 0.25).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0] * 15 + [float("inf")]), (505, [1.0] * 15 + [None]), (None, rows[0][1]), (506, rows[0][1]), (506, rows[0][1]), (507, [1.0, 0.0]), (508, [2.0, 0.0]), (509, [2.0 * x for x in rows[3][1]])]
    return rows


@pytest.mark.parametrize("interval,block", [(8192, 512), (64, 16)])
def test_embeddings_agree_with_all_pairs(spark, interval, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "INTERVAL_ROWS", interval)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", block)
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, size int, block string")
    ok = [i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    links, edges = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links[a] += 1
                    edges.append((rows[a][0], rows[b][0]))
    comp = components([(a, b) for a, b in edges if a != b], {i for i, _ in rows if i is not None})
    want = sorted((str(i), n, str(comp.get(i)), i is not None and comp[i] == i) for (i, _), n in zip(rows, links, strict=True))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embed_dedup.near_duplicates(df).collect())
    assert got == want
    assert len(edges) > 500


def test_embeddings_nothing(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    want = components([(a, b) for a, b in edges if a is not None], {x for e in edges for x in e if x is not None})
    got = {x["node"]: x["component"] for x in C.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert len(got) == sum(1 for n in want if any(n in e and e[0] != e[1] and None not in e for e in edges))


def test_license_scan_agrees_with_brute_force(spark):
    import re

    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    mit = license_scan.NOTICES[0][0]
    rows = [*EDGES, (20, "MIT License; the mit license"), (21, "gnu general public gnu General-Public license"), (22, "CC BY cc by\ncc\tBY 4.0"), (23, "pre " + mit.upper() + " post"), (24, " ".join(w for i, w in enumerate(mit.split()) if i % 9)), (25, "apache license apache license"), (26, None), (22, "mit license"), (27, "licensed under the apache license version 2 0 " * 3), (28, "permission to use copy x modify and or distribute y this software for any z purpose with"), (29, "this software this program is free software you can the software redistribute it and or modify")]
    want = []
    for d, t, *_ in rows:
        w = words.findall((t or "").translate(UPPER))
        hits = sorted((i, l) for p, l in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want.append((str(d), len(w), len(hits), str(hits[0][0] if hits else None), str(max(h[0] for h in hits) if hits else None), ",".join(sorted({h[1] for h in hits}))))
    got = license_scan.summary(license_scan.scan(documents(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == sorted(want)
    def standing(w, notice):
        """The largest share of the notice's word pairs in a chain of rising positions within 12 of some offset, by dynamic programming."""
        n = notice.split()
        pairs = [(p, q) for p in range(len(w) - 1) for q in range(len(n) - 1) if w[p : p + 2] == n[q : q + 2]]
        best = 0
        for d in {p - q for p, q in pairs}:
            near = [(p, q) for p, q in pairs if abs(p - q - d) <= 12]
            length = {}
            for p, q in near:
                length[p, q] = 1 + max((length[x] for x in length if x[0] < p and x[1] < q), default=0)
            best = max(best, *length.values())
        return best / (len(n) - 1) if best >= 3 and best >= 0.5 * (len(n) - 1) else 0

    labels = {r["doc_id"]: r["labels"] for r in got}
    by_row = {(r["doc_id"], r["n_words"]): (r["labels"], r["score"]) for r in got}
    for d, t, *_ in rows:
        w = words.findall((t or "").translate(UPPER))
        if len(w) < 5000:
            held = {label: standing(w, notice) for notice, label in license_scan.NOTICES}
            base = {label for p, label in license_scan.PHRASES if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
            assert by_row[d, len(w)] == (",".join(sorted(base | {k for k, v in held.items() if v})), pytest.approx(max([*held.values(), float(bool(base))]))), t
    assert "mit-text" in labels[23] and "mit-text" in labels[24] and labels[8] == ""
    assert all(0 <= r["score"] <= 1 for r in got)


def test_words_that_are_said_again_and_again_are_no_notice(spark):
    texts = ["of the " * 20, "the software " * 20, "and or " * 12, "apache license a b c " * 4, "the software " * 3000]
    got = license_scan.summary(license_scan.scan(documents(spark, list(enumerate(texts))))).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {0: "", 1: "", 2: "", 3: "apache", 4: ""}
    assert {r["score"] for r in got if r["doc_id"] != 3} == {0.0}


def test_notices_in_a_row_are_spans_of_their_own(spark):
    short, long = "licensed under the apache license version 2 0", license_scan.NOTICES[0][0]
    cut_in = " ".join([*long.split()[:9], "x y z", *long.split()[9:]])
    df = documents(spark, [(1, " ".join([short] * 5)), (2, f"{long} {cut_in} {long}")]).withColumnsRenamed({"lang": "found", "source": "row", "n_chars": "template"})
    got = {r["doc_id"]: [(s["first"], s["last"], round(s["score"], 2)) for s in r["spans"] if s["label"] in ("apache-notice", "mit-text")] for r in license_scan.scan(df).collect()}
    n = len(long.split())
    assert got[1] == [(8 * i, 8 * i + 7, 1.0) for i in range(5)]
    assert [x[:2] for x in got[2]] == [(0, n - 1), (n, 2 * n + 2), (2 * n + 3, 3 * n + 2)]


def test_license_scan_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], DDL)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1cé漢", max_size=12), max_size=8))
def test_words_are_those_of_a_regular_expression(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    _, starts, ends, first = W.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    joined = b"".join(raw)
    for k, t in enumerate(texts):
        assert [joined[a:b].decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)] == SPACE.findall(t)


def test_word_hashes_tell_words_apart():
    words = [f"w{i}" for i in range(50_000)] + [hashlib.md5(str(i).encode()).hexdigest() for i in range(50_000)]
    raw = " ".join(words).encode()
    h, *_ = W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(np.unique(h)) == len(words)


def test_word_hashes_have_no_structure():
    """Words of two letters that collide under any polynomial modulo a power of two, and words that differ in one place."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    words = [w[:n] for n in (64, 100, 1024, 2048, 4096) for w in (a, a.translate(str.maketrans("ab", "ba")))]
    words += ["x" * i + "y" + "x" * (n - i - 1) for n in (7, 8, 9, 16, 17, 127, 128, 129) for i in range(n)] + ["x" * n for n in range(1, 300)]
    raw = " ".join(words).encode()
    h, *_ = W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(np.unique(h)) == len(set(words))
    again, *_ = W.words(np.frombuffer(raw.upper(), np.uint8), np.array([0, len(raw)]), lower=True)
    assert (again == h).all()


def test_words_without_a_common_shingle_do_not_meet(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    one = documents(spark, [(1, a), (2, b)])
    assert {r["component_id"] for r in minhash.near_duplicates(one, percent=85).collect()} == {1, 2}
    fill = prose(1, 49)
    many = documents(spark, [(1, f"{fill} {a}"), (2, f"{fill} {b}")])
    assert {r["n_removed"] for r in substring.remove(many, width=50).collect()} == {0}
