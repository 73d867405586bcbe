"""Substring de-duplication with compressed FM-indexes.

A word goes if a window of ``width`` consecutive words covers it whose word sequence also starts in a document of smaller id.

1. Winnowing: each window's smallest 8-word hash is an anchor, so that equal windows share an anchor at the same place.
   Anchors are grouped to the smallest document that holds them (the hub); those of a single document go.
2. Around each shared anchor lies every window that it stands for. A document's stretches of one hub are joined to segments.
   Equal segments of a hub are indexed once, for the smallest document that holds them, and streamed at most twice: for that
   document, and once for all later ones, which find at least that copy.
3. Segments are dealt to shards by their hub, up to a number of words each, so that whatever can match shares a shard. A hub
   with more words than a shard holds is split: its segments are indexed in blocks and streamed against each block.
4. A shard builds an FM-index, computes the matching statistics of the segments streamed against it by backward search, and
   reports the intervals that matches of ``width`` words cover; they are joined to the documents.

A document's own repeats do not count, nor do documents without an id. Rows that share an id count as one document, each
judged by its own text. Null texts have no words. Texts are read whole. An empty table gives an empty result. Every other
column passes through ``remove``, whatever its name; only those named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.common import batch, cut, nested, own_exchange, text_slices
from weftline.llm.fm_index import FMIndex, intervals, matching_statistics

ANCHOR_WORDS = 8
#: Words that one FM-index takes, twice at most; and words that a segment is cut into for streaming at a time.
SHARD_WORDS, STREAM_WORDS = 600_000, 512


def _anchors(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every anchor: the smallest 8-word hash of each window inside a text."""
    g = W.grams(h, ANCHOR_WORDS)
    w = width - ANCHOR_WORDS + 1
    least = W.sliding_min(g, w)
    if not len(least):
        return np.zeros(0, np.int64), g[:0]
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(least))
    least = np.where(at + width <= ends[at], least, np.uint64(0))
    # A hash is an anchor if it is the smallest of some window around it.
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    most = ~W.sliding_min(~padded, w)
    pos = np.flatnonzero((most[: len(g)] == g) & (g != 0))
    return pos, g[pos]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text")).where("d is not null and text is not null")


def _found_anchors(docs: DataFrame, width: int) -> DataFrame:
    out = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("a", pa.int64()), ("p", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offsets in text_slices(b.column(2)):
                h, _, _, first = W.words(data, offsets)
                pos, g = _anchors(h, first, width)
                doc = np.searchsorted(first, pos, "right") - 1
                rows = pa.array(doc + i)
                yield batch(out, b.column(0).take(rows), b.column(1).take(rows), g.view(np.int64), (pos - first[doc]).astype(np.int32))

    return docs.mapInArrow(run, "d long, t long, a long, p int")


def _segments(marked: DataFrame, width: int) -> DataFrame:
    """(hub, d, t, start, n, digest, words): stretches of a document around its anchors of one hub; words as 64-bit hashes, digest of 128 bits."""
    out = pa.schema([("hub", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("body", pa.binary())])
    before = width - ANCHOR_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for i, j, data, offsets in text_slices(b.column(2)):
                _, starts, ends, first = W.words(data, offsets)
                rows = []
                for k in range(j - i):
                    d, t = b.column(0)[i + k].as_py(), b.column(1)[i + k].as_py()
                    base, n = int(first[k]), int(first[k + 1] - first[k])
                    hubs = np.array(b.column(3)[i + k].values.field("hub").to_numpy(zero_copy_only=False), np.int64)
                    at = np.array(b.column(3)[i + k].values.field("p").to_numpy(zero_copy_only=False), np.int64)
                    order = np.lexsort((at, hubs))
                    hubs, at = hubs[order], at[order]
                    lo, hi = np.maximum(0, at - before), np.minimum(n, at + width)
                    fresh = np.concatenate(([True], (hubs[1:] != hubs[:-1]) | (lo[1:] > hi[:-1])))
                    heads = np.flatnonzero(fresh)
                    tails = np.concatenate((heads[1:], [len(at)])) - 1
                    for x, y in zip(heads, tails, strict=True):
                        s, e = int(lo[x]), int(hi[y])
                        body = data[starts[base + s] : ends[base + e - 1]].tobytes()
                        rows.append((int(hubs[x]), d, t, s, e - s, hashlib.blake2b(b" ".join(body.split()), digest_size=16).digest(), body))
                if rows:
                    yield batch(out, *zip(*rows, strict=True))

    return marked.mapInArrow(run, "hub long, d long, t long, start int, n int, digest binary, body binary")


def _search(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the intervals found for the rows that are streamed, of a table (d, body, indexed, streamed)."""
    bodies = table["body"].combine_chunks()
    parts = []
    for _, _, data, offsets in text_slices(bodies):
        h, _, _, first = W.words(data, offsets)
        parts.append((h, np.diff(first)))
    h = np.concatenate([x for x, _ in parts])
    size = np.concatenate([x for _, x in parts])
    _, ids = np.unique(h, return_inverse=True)
    # A separator 0 stands behind each segment.
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    symbols = np.zeros(begin[-1], np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    symbols[inside] = ids + 1
    indexed = table["indexed"].to_numpy()
    d = table["d"].to_numpy()
    _, rank = np.unique(d, return_inverse=True)
    owner = np.repeat(rank.astype(np.int32), size + 1)
    part = np.repeat(indexed, size + 1)
    index = FMIndex(symbols[part], owner[part], int(symbols.max()) + 1, width)
    ask = np.flatnonzero(table["streamed"].to_numpy() & (size >= width))
    first, end = [], []
    for r in ask.tolist():
        a, n = int(begin[r]), int(size[r])
        cuts = range(0, max(1, n - width + 1), STREAM_WORDS)
        first += [a + c for c in cuts]
        end += [min(a + n, a + c + STREAM_WORDS + width - 1) for c in cuts]
    up, down = intervals(matching_statistics(index, symbols, owner, np.array(first, np.int64), np.array(end, np.int64), width), width)
    row = np.searchsorted(begin, up, "right") - 1
    return row, up - begin[row], down - begin[row]


def _shards(distinct: DataFrame) -> DataFrame:
    """(hub, blocks, shard): hubs of one block are packed into shards of SHARD_WORDS to twice as many words; those of more have shards of their own.

    Hubs are dealt to so many groups that each has a few shards' words on average, and counted off within their group.
    """
    per_hub = cut(distinct.groupBy("hub").agg(F.sum(F.col("n") * F.when(F.col("copied"), 2).otherwise(1)).alias("words")))
    total = per_hub.agg(F.sum("words")).first()[0] or 0
    group = F.pmod(F.xxhash64("hub"), F.lit(max(1, -(-total // (4 * SHARD_WORDS)))))
    small = per_hub.where(F.col("words") <= SHARD_WORDS).withColumn("group", group)
    upto = F.sum("words").over(Window.partitionBy("group").orderBy("hub"))
    packed = small.select("hub", F.lit(1).cast("long").alias("blocks"), F.xxhash64("group", F.floor(upto / SHARD_WORDS)).alias("shard"))
    large = per_hub.where(F.col("words") > SHARD_WORDS).select("hub", F.ceil(F.col("words") / SHARD_WORDS).cast("long").alias("blocks"), F.lit(None).cast("long").alias("shard"))
    return packed.unionByName(large)


def repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, spans array<struct(start, end)>): word intervals to remove, by document id and hash of its text; disjoint, in order."""
    src = _keyed(docs, doc_id, text)
    anchors = _found_anchors(src, width)
    hubs = anchors.groupBy("a").agg(F.min("d").alias("hub"), F.max("d").alias("far")).where("hub < far").select(own_exchange("a"), "hub")
    marks = anchors.join(hubs, "a").groupBy("d", "t").agg(F.collect_set(F.struct("hub", "p")).alias("marks"))
    marked = src.join(marks.hint("shuffle_hash"), ["d", "t"]).select("d", "t", "text", "marks")
    # Repeated rows of one id and text give one segment.
    found = cut(_segments(marked, width))
    distinct = found.groupBy("hub", "digest").agg(F.min("d").alias("d"), F.max("d").alias("far"), F.min_by("body", "d").alias("body"), F.first("n").alias("n"))
    distinct = cut(distinct.withColumn("copied", F.col("far") > F.col("d")))
    shards = _shards(distinct)
    sized = distinct.join(shards, "hub").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    # A segment is streamed for its first document (later: false) unless that is the hub's, and for later ones if there are any.
    # In the block of its own it is indexed as well, in the others of a split hub streamed alone, and there indexed for theirs.
    role = lambda shard, indexed, streamed, later: F.struct(shard.alias("shard"), indexed.alias("indexed"), streamed.alias("streamed"), F.lit(later).alias("later"))
    yes, no = F.lit(True), F.lit(False)
    at = lambda i, j: F.when(F.col("blocks") == 1, F.col("shard")).otherwise(F.xxhash64("hub", i, j))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != F.col("own"))
    own = F.col("own")
    first = F.col("d") > F.col("hub")
    roles = F.concat(
        F.array(role(at(own, own), yes, first, False), role(at(own, own), no, F.col("copied"), True)),
        F.transform(others, lambda k: role(at(own, k), yes, no, False)),
        F.transform(others, lambda k: role(at(k, own), no, first, False)),
    )
    roles = F.filter(roles, lambda r: r["indexed"] | r["streamed"])
    dealt = sized.select("hub", "digest", "d", "far", "body", F.explode(roles).alias("r")).select("hub", "digest", F.when(F.col("r.later"), F.col("far")).otherwise(F.col("d")).alias("d"), "body", "r.*")
    out = pa.schema([("hub", pa.int64()), ("digest", pa.binary()), ("later", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        row, start, end = _search(table, width)
        rows = pa.array(row)
        return pa.table([*(table[c].take(rows).combine_chunks() for c in ("hub", "digest", "later")), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=out)

    hits = dealt.groupBy("shard").applyInArrow(search, "hub long, digest binary, later boolean, start int, end int").groupBy("hub", "digest", "later").agg(F.collect_set(F.struct("start", "end")).alias("hits"))
    least = distinct.select("hub", "digest", F.col("d").alias("least"))
    back = found.drop("body").join(least, ["hub", "digest"]).withColumn("later", F.col("d") > F.col("least")).join(hits, ["hub", "digest", "later"])
    return back.select("d", "t", F.explode("hits").alias("h"), F.col("start").alias("s")).groupBy("d", "t").agg(F.collect_set(F.struct((F.col("h.start") + F.col("s")).alias("start"), (F.col("h.end") + F.col("s")).alias("end"))).alias("spans"))


def remove(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", clean: str = "clean_text", total: str = "n_words", removed: str = "n_removed") -> DataFrame:
    """``docs`` with the text left over (all between kept words stays as it is), its words joined by one blank, and the counts of words and of removed ones."""
    from pyspark.sql import types as T

    spans = repeats(docs, width, doc_id, text)
    keyed = nested(docs, key=F.col(doc_id).cast("long"), hash=F.xxhash64(F.col(text)), text=F.col(text))
    joined = keyed.join(spans.hint("shuffle_hash"), (F.col("key") == F.col("d")) & (F.col("hash") == F.col("t")), "left").select("row", "text", "spans")
    extra = [T.StructField(clean, T.StringType()), T.StructField(f"{clean}_words", T.StringType(), False), T.StructField(total, T.LongType(), False), T.StructField(removed, T.LongType(), False)]
    keep = [f.name for f in docs.schema if f.name not in {e.name for e in extra}]
    schema = T.StructType([*(docs.schema[n] for n in keep), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                spans = s.column(2).to_pylist()
                left, joined_words, n_words, n_removed = [], [], [], []
                for x, cuts in zip(s.column(1).to_pylist(), spans, strict=True):
                    raw = (x or "").encode()
                    found = raw.split()
                    n_words.append(len(found))
                    if not cuts:
                        left.append(x)
                        joined_words.append(b" ".join(found).decode())
                        n_removed.append(0)
                        continue
                    gone = np.zeros(len(found) + 1, np.int64)
                    np.add.at(gone, [c["start"] for c in cuts], 1)
                    np.add.at(gone, [c["end"] for c in cuts], -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    joined_words.append(b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g]).decode())
                    data = np.frombuffer(raw, np.uint8)
                    _, starts, _, _ = W.words(data, np.array([0, len(data)]))
                    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
                    bounds = np.append(starts, len(raw))
                    left.append(b"".join(raw[bounds[i] if k else (0 if i == 0 else bounds[i]) : bounds[j]] for k, (i, j) in enumerate(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))).decode())
                arrays = [s.column(0).field(n) for n in keep] + [pa.array(left, pa.string()), pa.array(joined_words, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(e.name for e in extra)])

    return joined.mapInArrow(run, schema)
