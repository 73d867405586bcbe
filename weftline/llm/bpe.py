"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Null texts count as empty: no ids, empty bytes. Very long texts are cut before the regular expression sees them, at places
that no match reaches over; very long runs of white space, which hold no such place, never reach it: each is one match, but for
its last character where a word follows, and goes to the library as such. Rows that repeat are encoded as often as they occur; an empty table gives an empty result. Other
columns pass through untouched, whatever their names; only one named as the result is replaced.
"""

from __future__ import annotations

import base64
import json
import re

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts over so many characters are cut before the regular expression sees them.
LONG_CHARS = 1 << 16
#: Between a non-space and a blank or line feed no match of the pattern can reach over: none has white space after other characters.
_SAFE = re.compile(r"(?<=\S)[ \n]")
#: White space of the pattern's regular expressions, in runs that these can't take.
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_CHARS)
_made: dict[int, object] = {}


def load_ranks(df: DataFrame, path: str) -> Broadcast:
    """The rank file as a broadcast: one fixed vocabulary file of a few MB, whatever the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoding(ranks: Broadcast | bytes, pattern: str):
    raw = ranks.value if isinstance(ranks, Broadcast) else ranks
    key = hash((raw, pattern))
    if key not in _made:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _made[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def safe_pieces(text: str, limit: int = LONG_CHARS) -> list[str]:
    """``text`` in pieces of about ``limit`` characters or more whose encodings, joined, are that of the text."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if out else [text]


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a tokenizer file of the tokenizers library adds to its vocabulary; that library finds them in texts before all else."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def encode_text(enc, text: str, added: dict[str, int] | None = None) -> list[int]:
    """Ids of the whole text; the texts between ``added`` tokens are encoded each by itself."""
    if added:
        found = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
        if len(found) > 1:
            return [i for k, x in enumerate(found) for i in ([added[x]] if k % 2 else encode_text(enc, x))]
    if len(text) <= LONG_CHARS:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [i for x in safe_pieces(text[at : m.start()]) for i in enc.encode_ordinary(x)]
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + [i for x in safe_pieces(text[at:]) for i in enc.encode_ordinary(x)]


def encode(df: DataFrame, ranks: Broadcast, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` array<int>: the ids of the whole text, no special tokens. Row by row; no shuffle."""
    schema = T.StructType([f for f in df.schema if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        import numpy as np

        enc = encoding(ranks, pattern)
        for b in batches:
            t, keep = b.schema.get_field_index(text), [i for i, n in enumerate(b.schema.names) if n != ids]
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [encode_text(enc, x or "") for x in part.column(t).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
                flat = np.fromiter((i for x in got for i in x), np.int32, int(offsets[-1]))
                arrays = [part.column(i) for i in keep] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(arrays, names=[b.schema.names[i] for i in keep] + [ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: Broadcast, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with a column ``decoded`` binary: the raw bytes of the ids (null: empty), valid UTF-8 or not."""
    schema = T.StructType([f for f in df.schema if f.name != decoded] + [T.StructField(decoded, T.BinaryType(), False)])

    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            t, keep = b.schema.get_field_index(ids), [i for i, n in enumerate(b.schema.names) if n != decoded]
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                column = part.column(t)
                got = [enc.decode_bytes(column[i].values.to_numpy().tolist()) if column[i].is_valid else b"" for i in range(len(column))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [pa.array(got, pa.binary())], names=[b.schema.names[i] for i in keep] + [decoded])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
