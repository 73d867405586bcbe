import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import EDGES, documents, prose
from weftline.llm import bpe, chat, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
ADDED = bpe.added_tokens(P.path("byte_bpe_50k.json"))
_TOKENIZER: list = []


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        return bpe.encoding(f.read(), P.PATTERN)


def test_encode_and_decode(spark, enc):
    docs = documents(spark, EDGES).withColumnRenamed("lang", "ids")  # a column that clashes is replaced
    ranks = bpe.load_ranks(docs, RANKS)
    out = bpe.digests(bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks, P.PATTERN)).collect()
    want = []
    for d, t in EDGES:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))


def test_decode_takes_bytes_that_are_no_text(spark, enc):
    ranks = bpe.load_ranks(spark.range(1), RANKS)
    ids = [enc.encode_single_token(b"\xff"), enc.encode_single_token(b"a")]
    df = spark.createDataFrame([(1, ids), (2, None), (3, [])], "k int, ids array<int>")
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode(df, ranks, P.PATTERN).collect()}
    assert got == {1: b"\xffa", 2: b"", 3: b""}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t\x1c\x85 '.!é漢", max_size=300), st.integers(1, 40))
def test_pieces_encode_as_the_whole(text, limit):
    with open(RANKS, "rb") as f:
        enc = bpe.encoding(f.read(), P.PATTERN)
    pieces = bpe.safe_pieces(text, limit)
    assert "".join(pieces) == text
    assert [i for x in pieces for i in enc.encode_ordinary(x)] == enc.encode_ordinary(text)


def test_ids_agree_with_the_tokenizers_library(enc):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    import pyarrow.parquet as pq

    texts = [x for _, x in EDGES if x is not None] + [prose(1, 500), "it's we'll  don't\n\n x", "a<|endoftext|>b", "hello <|endoftext|> x", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "\u2028x\u3000 y\u00a0 z\t\n  \r\n1234567 ½ ² ٣"]
    texts += [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if x]
    for t, got in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.ids == bpe.encode_text(enc, t, ADDED)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "\n", "<|end", "'s", "x1"]), max_size=12).map("".join)))
def test_ids_of_any_text_agree_with_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    if not _TOKENIZER:
        with open(RANKS, "rb") as f:
            _TOKENIZER.extend((Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.encoding(f.read(), P.PATTERN)))
    assert _TOKENIZER[0].encode(text, add_special_tokens=False).ids == bpe.encode_text(_TOKENIZER[1], text, ADDED)


def test_long_white_space(enc):
    for blank in (" ", "\t", "\n"):
        for n in (bpe.LONG_CHARS - 1, bpe.LONG_CHARS, bpe.LONG_CHARS + 1, 100_000):
            for text in (blank * n, f"one{blank * n}two three", f"{blank * n}x", f"x y{blank * n}", f"a{blank * n}b{blank * n}.c"):
                assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    text = "one" + " " * 5_000_000 + "two" + "\t\n" * 500_000
    assert enc.decode(bpe.encode_text(enc, text)) == text


def test_packing(spark, enc):
    docs = documents(spark, EDGES + [(99, "hello <|endoftext|> x")] + [(100 + i, prose(i, 5 + 37 * i % 900)) for i in range(120)])
    out = packing.pack(docs, bpe.load_ranks(docs, RANKS), P.PATTERN, capacity=512, added=ADDED).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    total = 0
    for d, t in {(d, t) for d, t, *_ in docs.select("doc_id", "text").collect()}:
        ids = [*bpe.encode_text(enc, t or "", ADDED), 0]
        mine = sorted(by_doc[d], key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))
        copies = 2 if d == 9 else 1
        at = 0
        for i in range(0, len(mine), copies):
            r = mine[i]
            assert all((x["piece"], x["start"], x["length"]) == (i // copies, at, r["length"]) for x in mine[i : i + copies])
            assert r["length"] == 512 or r["piece"] == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
        total += copies * len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    counts = Counter(r["length"] for r in out)
    assert total == sum(k * n for k, n in counts.items())
    assert -(-total // 512) <= len(by_seq) <= sum(t for t, _ in packing._best_fit(counts, 512))


def test_packing_clashing_columns(spark):
    docs = documents(spark, [(1, "a b"), (None, "c")]).withColumnsRenamed({"lang": "length", "source": "part", "n_chars": "rank"})
    got = packing.pack(docs, bpe.load_ranks(docs, RANKS), P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in got) == [("1", 0, 3), ("None", 0, 2)]


def test_encoding_nothing(spark):
    docs = documents(spark, [])
    ranks = bpe.load_ranks(docs, RANKS)
    assert bpe.digests(bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks, P.PATTERN)).count() == 0


def test_packing_nothing(spark):
    docs = documents(spark, [])
    assert packing.pack(docs, bpe.load_ranks(docs, RANKS), P.PATTERN).count() == 0


def _best(sizes, capacity):
    """Fewest bins, by trying all placements of the sizes in falling order."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_is_optimal_on_small_cases(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = packing.plan(counts, 20)
    used = defaultdict(int)
    for times, chosen in plan:
        assert sum(chosen) <= 20
        for s in chosen:
            used[s] += times
    assert used == counts
    assert sum(t for t, _ in plan) == _best(sizes, 20)


def test_plan_beats_best_fit_where_that_wastes():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}
    assert sum(t for t, _ in packing._best_fit({s: c for s, c in counts.items()}, 10)) >= sum(t for t, _ in packing.plan(counts, 10)) == 4


def test_plan_is_that_of_the_search_where_it_reaches_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "_best_fit", lambda *a: 1 / 0)
    counts = {1000 + k: 3 + k % 5 for k in range(0, 1000, 7)} | {48 + k: 9 for k in range(900)}
    total = sum(s * c for s, c in counts.items())
    assert sum(t for t, _ in packing.plan(counts, 2048)) == -(-total // 2048)


def test_plan_of_short_pieces_comes_near_the_volume_bound():
    import random

    r = random.Random(0)
    for n, least, most in ((3000, 150, 290), (20_000, 200, 285)):
        counts = Counter(r.randint(least, most) for _ in range(n))
        plan, used = packing.plan(counts, 2048), Counter()
        for times, chosen in plan:
            assert sum(chosen) <= 2048
            for s in chosen:
                used[s] += times
        assert used == counts
        assert sum(t for t, _ in plan) <= 1.005 * -(-sum(s * c for s, c in counts.items()) // 2048)


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[INST|0] ", " [/INST]</s>", "[ANS|1]", "[/SYS]", "[as:x|0]", "\\", "\\\\", "%", "\n", " ", "é", "<", "[", "ok"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "as:user", "INST", "a|1] b"]), st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join)), max_size=6))
def test_chat_grammar_round_trip(turns):
    assert chat.parse("".join(chat.render_turn(r, t) for r, t in turns)) == turns


@pytest.mark.parametrize("text", ["x", "<s>[INST|0] a", "<s>[INST|3] a [/INST]</s>", "<s>[INST|0] a [/ANS]</s>"])
def test_chat_refuses_what_is_not_in_the_grammar(text):
    with pytest.raises(ValueError):
        chat.parse(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "é|"]), st.lists(st.sampled_from(CONTROLS), max_size=6).map("".join)), max_size=5), st.integers(1, 9))
def test_chat_parser_takes_pieces_of_any_length(turns, size):
    text, parser, got = "".join(chat.render_turn(r, t) for r, t in turns), chat.Parser(), []
    for i in range(0, len(text), size):
        got += parser.feed(text[i : i + size])
    parser.close()
    assert got == turns


def test_chat_reads_a_conversation_as_one_text(spark, monkeypatch):
    """Rows are cut elsewhere than between turns; a lost or changed turn is noticed; a very long text is a turn like others."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"text {k} </s>" * (k + 1)) for k in range(40)] + [(2, 0, "assistant", "x [/INST]" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df).collect()
    whole = "".join(r["formatted"] for r in formatted if r["conv_id"] == 1)
    assert chat.parse(whole) == [(r, t) for c, _, r, t in rows if c == 1]
    sources = [r["source"] for r in formatted if r["conv_id"] == 1]
    cuts = [whole[i : i + 1000] for i in range(0, len(whole), 1000)]
    cuts = [*cuts, *[""] * (len(sources) - len(cuts))][: len(sources) - 1] + ["".join(cuts[len(sources) - 1 :])]
    ddl = "conv_id long, formatted string, source binary"
    again = spark.createDataFrame([(1, f, s) for f, s in zip(cuts, sources, strict=True)], ddl).coalesce(1)
    want = {r["conv_id"]: tuple(r) for r in chat.read_back(chat.format_conversations(df)).collect()}
    # Its rows end where they like: texts are not those of the turns of the same rows.
    got = chat.read_back(again).first()
    assert tuple(got) == want[1] and want[2][3] == 9 * 300_000
    for bad in (cuts[:-1] + [cuts[-1] + chat.render_turn("user", "more")], [cuts[0].replace("text 0", "text X"), *cuts[1:]]):
        with pytest.raises(Exception, match="formatted|lost|start"):
            chat.read_back(spark.createDataFrame([(1, f, s) for f, s in zip(bad, sources, strict=True)], ddl).coalesce(1)).collect()


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 2, "assistant", "\\c"), (2, None, None, "x"), (None, 0, "user", "y"), (1, 1, "assistant", "b</s>"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df)).collect()}

    def want(turns):
        loss = "".join(t for r, t in turns if r == "assistant")
        return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())

    assert got == {1: want([("user", ""), ("assistant", "b</s>"), ("assistant", "b</s>"), ("assistant", "\\c")]), 2: want([("", "x")]), None: want([("user", "y")]), 3: want([("assistant", "")])}


def test_chat_nothing(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_rank_file_is_whole():
    with open(RANKS, "rb") as f:
        assert len({base64.b64decode(x.split()[0]) for x in f.read().splitlines()}) == 50256
