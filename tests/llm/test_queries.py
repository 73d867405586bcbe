"""The registered queries: columns and types of the contracts, every row of their tables, and what brute force finds there."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm.common import SPACE, UPPER, components
from weftline.llm import bpe, license_scan, queries

FOLDER = "/root/testdata/sf0.001"
CONTRACTS = {
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op13_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op8_every_line": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op9_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def rows(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, FOLDER)
            made[name] = (made[name].dtypes, made[name].collect())
        return made[name]

    return rows


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows(db, results, name):
    types, rows = results(name)
    assert ", ".join(" ".join(t) for t in types) == CONTRACTS[name]
    if name not in ("op2_best_fit_packing", "op3_chat_format"):
        table, key = ("embeddings", "vec_id") if name[:4] in ("op5_", "op13") else ("pages", "page_id") if "op12" in name else ("documents", "doc_id")
        assert sorted(r[key] for r in rows) == sorted(x for (x,) in db.execute(f"select {key} from {table}").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_the_sql(db, results, name):
    types, rows = results(name)
    cols = ", ".join(k for k, _ in types)
    assert sorted(map(tuple, rows)) == sorted(db.execute(f"select {cols} from ({entry.oracle_sql()[name]})").fetchall())


def test_ids_and_pieces(db, results):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = bpe.encoding(f.read(), P.PATTERN)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    digests, pieces, total = {}, set(), 0
    for d, t in db.execute("select doc_id, text from documents").fetchall():
        ids = enc.encode_ordinary(t or "")
        digests[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        pieces |= {(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
        total += len(ids)
    assert {r[0]: tuple(r)[1:] for r in results("op1_byte_bpe")[1]} == digests
    packed = results("op2_best_fit_packing")[1]
    assert {tuple(r)[:5] for r in packed} == pieces and len(packed) == len(pieces)
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= -(-total // 2048) + 1


def test_conversations(db, results):
    turns = defaultdict(list)
    for c, r, t in db.execute("select conv_id, role, text from conversations order by conv_id, turn, role, text").fetchall():
        turns[c].append((r, t or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [("user", said), ("assistant", said)]
    want = {}
    for c, x in turns.items():
        loss = "".join(t for r, t in x if r == "assistant")
        want[c] = (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = results("op3_chat_format")[1]
    assert {r[0]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)


def test_vectors(db, results):
    rows = db.execute("select vec_id, embedding from embeddings").fetchall()
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [i for i, _ in rows]
    comp = components([(ids[a], ids[b]) for a, b in np.argwhere(np.triu(near, 1))], ids)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in results("op5_embedding_near_dedup")[1]} == {i: (int(n) - 1, comp[i], comp[i] == i) for i, n in zip(ids, near.sum(1), strict=True)}


def test_near_documents(db, results):
    sets = {}
    for d, t in db.execute("select doc_id, text from documents").fetchall():
        w = SPACE.findall((t or "").translate(UPPER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = components(edges, ids)
    assert {r[0]: tuple(r)[1:] for r in results("op7_minhash_near_dedup")[1]} == {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def test_licenses(db, results):
    want, found = {}, {r[0]: tuple(r)[1:6] for r in results("op10_license_scan")[1]}
    for d, t in db.execute("select doc_id, text from documents").fetchall():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        hits = sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want[d] = (len(w), len(hits), hits[0][0] if hits else None, max(h[0] for h in hits) if hits else None, ",".join(sorted({h[1] for h in hits})))
    assert found == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in results("op10_license_scan")[1])


def test_predictions_are_learned_values(db, results):
    known = {x for (x,) in db.execute("select distinct lang from documents where lang is not null").fetchall()}
    rows = results("op6_language_id")[1]
    assert {r["lang_pred"] for r in rows} <= known | {"und"} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert Counter(r["lang_pred"] for r in rows).most_common(1)[0][0] != "und"
