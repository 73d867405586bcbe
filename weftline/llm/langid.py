"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text; a task adds up a matrix (languages x buckets) and only its nonzero
cells are shuffled. The log-probability matrix that is collected and broadcast has at most ``MOST_CELLS`` cells: beyond 128
languages it has fewer buckets, and a column of over 32,768 different labels is refused, as it can't be one of languages.

Null texts, and texts without a letter, are ``und`` with score 0; so is every text if nothing was learned. Labels that are
null teach nothing. Ties go to the language first in alphabetical order. Texts are read whole, in slices, however long.
Repeated rows teach and are judged as often as they occur. An empty table gives an empty result. Other columns pass through,
whatever their names; only those named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import batch

BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3, 4), 0.5
#: Cells of the matrix at most (8 bytes each), and the fewest buckets that are left to tell languages apart.
MOST_CELLS, LEAST_BUCKETS = 1 << 23, 1 << 8
#: Characters of texts that are handled as one array.
SLICE_CHARS = 1 << 17


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of the lower-cased texts; runs of anything but letters count as one blank."""
    joined = "\n".join(f" {t.lower()} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = code == 10
    ends = np.cumsum([len(f" {t.lower()} ") + 1 for t in texts])
    row = np.zeros(len(code), np.int64)
    row[ends[:-1]] = 1
    row = np.cumsum(row)
    letter = _letters(code)
    gap = ~letter
    keep = letter | (gap & ~np.concatenate(([False], gap[:-1])))
    keep[np.concatenate(([0], ends[:-1]))] = True
    code, row, letter = code[keep], row[keep], letter[keep]
    del stop
    code = np.where(letter, code, 32).astype(np.uint64)
    rows, buckets = [], []
    for n in ORDERS:
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = row[: len(h)] == row[n - 1 :]
        rows.append(row[: len(h)][inside])
        buckets.append((h[inside] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


_table: list[np.ndarray] = []


def _letters(code: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append(np.array([chr(c).isalpha() for c in range(0x3000)]))
    low = _table[0]
    return np.where(code < len(low), low[np.minimum(code, len(low) - 1)], True)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE_CHARS):
            size += len(texts[j] or "") + 3
            j += 1
        yield i, j
        i = j


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in alphabetical order, log-probabilities: a row for each, a column for each bucket, the last the log prior)."""
    src = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _slices(texts):
                row, bucket = _features(texts[i:j])
                names, code = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    t = total.setdefault(str(name), np.zeros(BUCKETS + 1, np.int64))
                    t[:BUCKETS] += np.bincount(bucket[code[row] == k], minlength=BUCKETS)
                    t[BUCKETS] += int((code == k).sum())
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield batch(out, [name] * len(at), at.astype(np.int32), t[at])

    languages = src.select("lang").distinct().count()
    buckets = BUCKETS
    while languages * buckets > MOST_CELLS:
        buckets //= 2
    if buckets < LEAST_BUCKETS:
        raise ValueError(f"{languages} different values of {lang} are no languages")
    # At most a row for each cell. The last bucket, of the number of texts, keeps a place of its own.
    bucket = F.when(F.col("bucket") == BUCKETS, buckets).otherwise(F.col("bucket").bitwiseAND(F.lit(buckets - 1))).alias("bucket")
    rows = src.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", bucket).agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), buckets + 1))
    if langs:
        counts[np.searchsorted(langs, rows["lang"]), rows["bucket"]] = rows["n"]
    grams, docs = counts[:, :buckets] + SMOOTHING, counts[:, buckets:]
    return langs, np.hstack([np.log(grams) - np.log(grams.sum(1, keepdims=True)), np.log(docs / docs.sum()) if langs else docs])


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior probability. Row by row; no shuffle."""
    langs, logp = model
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))
    schema = T.StructType([f for f in df.schema if f.name not in (pred, score)] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        buckets = len(table) - 1
        for b in batches:
            keep = [i for i, n in enumerate(b.schema.names) if n not in (pred, score)]
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            names, scores = [], []
            for i, j in _slices(texts):
                part = [t or "" for t in texts[i:j]]
                known = [bool(langs) and has_letter(t) for t in part]
                if any(known):
                    row, bucket = _features(part)
                    bucket &= buckets - 1
                    logs = np.stack([np.bincount(row, table[bucket, k], minlength=len(part)) for k in range(len(langs))], 1) + table[buckets]
                    best = logs.argmax(1)
                    p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                for k, ok in enumerate(known):
                    names.append(langs[best[k]] if ok else "und")
                    scores.append(float(p[k]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[b.schema.names[i] for i in keep] + [pred, score])

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that training leaves out. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
