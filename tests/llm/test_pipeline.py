"""The pipeline against a brute-force version of all its stages."""

import random
import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tests.llm.common import DDL, SPACE, UPPER, components, prose
from tests.llm.test_quality import _judged
from weftline.llm import bpe


def _rows():
    r = random.Random(11)
    passage, lines = prose(50, 70), [prose(60 + i, 9) for i in range(4)]
    rows = [(1, None), (2, ""), (3, "too short"), (4, "### $$$ " * 60)]
    for i in range(60):
        rows.append((10 + i, "\n".join(prose(100 * i + k, 12) for k in range(8))))
    for i in range(10):  # near copies on one line each, so that line windows leave them alone
        words = prose(7, 150).split()
        words[r.randrange(150)] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    for i in range(8):
        rows.append((200 + i, prose(900 + i, 60) + " " + passage + " " + prose(950 + i, 60)))
        rows.append((300 + i, "\n".join([prose(1000 + i, 30), *lines, prose(1100 + i, 30)])))
    rows += [(400, rows[10][1]), (401, rows[11][1])]
    return [(d, t, r.choice(["en", "de"]), "s", None if t is None else len(t)) for d, t in rows]


def _line_dedup(texts):
    seen, out = {}, {}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        at, gone = [i for i, x in enumerate(lines) if SPACE.search(x)], set()
        for a, b in zip(at, at[1:], strict=False):
            if (lines[a], lines[b]) in seen:
                gone |= {a, b}
            else:
                seen[lines[a], lines[b]] = d
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def _near(texts):
    sets = {}
    for d, t in texts.items():
        w = SPACE.findall(t.translate(UPPER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(edges, ids)
    return {d: t for d, t in texts.items() if comp[d] == d}


def _substrings(texts, width=50):
    least, words = {}, {d: SPACE.findall(t) for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            least.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/in/documents.parquet")
    docs, found = spark.read.parquet(f"{tmp_path}/in/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"{tmp_path}/in").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found.append(docs)
    texts = {d: t for (d, t, *_), (_, kept) in zip(rows, _judged([r[:4] for r in rows]), strict=True) if kept}
    assert len(texts) < len(rows)
    stages = [texts, _line_dedup(texts), _near(_line_dedup(texts))]
    for want, df in zip(stages, found, strict=False):
        assert df.columns == columns
        assert {r["doc_id"]: r["text"] for r in df.collect()} == want
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
    assert len(stages[2]) < len(stages[1]) and stages[1] != stages[0]
    last = _substrings(stages[2])
    assert sum(n for n, _ in last.values()) > 100
    got = {r["doc_id"]: r["text"] for r in found[3].collect()}
    assert {d: SPACE.findall(t) for d, t in got.items()} == {d: w for d, (_, w) in last.items()}
    assert all(got[d] == stages[2][d] for d, (n, _) in last.items() if n == 0)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = bpe.encoding(f.read(), P.PATTERN)
    want = set()
    for d, t in got.items():
        ids = np.array([*enc.encode_ordinary(t), 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want |= {(d, k, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in found[4].collect()} == want


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_as_results_stay(spark, tmp_path):
    """Whatever a stage calls its results, columns of the user pass through with their values."""
    text = "\n".join(prose(k, 12) for k in range(8))
    ddl = DDL + ", clean_text string, clean_text_words string, n_lines long, n_words long, n_removed long, _clean string, __x string, kept boolean, n_shingles long"
    rows = [(d, t, "en", "s", len(t), "mine", "words", 7, 8, 9, "c", "x", False, 5) for d, t in ((1, text), (2, text), (3, text + "\n" + prose(9, 60)))]
    docs = spark.createDataFrame(rows, ddl)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == spark.createDataFrame([], ddl).columns
        assert {tuple(r)[5:] for r in docs.collect()} == {("mine", "words", 7, 8, 9, "c", "x", False, 5)}
