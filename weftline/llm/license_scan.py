"""License scans by diagonal voting.

Each template is a list of words. All rolling k-gram hashes of all documents are joined to the template positions; a match at
document word p and template word q votes for the diagonal p - q. Votes are gathered for each document, template and
diagonal, neighbouring diagonals of one template are merged (words added or left out), and spans are verified: a phrase must
stand whole on its diagonal; of a notice, a given share of its k-grams must stand in order, each counted once, within the
neighbouring diagonals. So a k-gram that is said again and again counts once, and notices in a row are spans of their own.

Words are those of the lower-cased text (A-Z only) made of letters, digits and all characters beyond ASCII. Null texts count
as empty. Rows that share an id stay rows of their own. Templates that a text holds equally well all add their labels; of
overlapping spans of one template the best stands, of equally good ones the first. An empty table gives an empty result.
Other columns are not carried, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.common import batch, text_slices

K = 2
#: Diagonals so near to one are merged with it; the share, and the number, of a notice's k-grams that a span must hold.
NEIGHBOURS, SHARE, LEAST_VOTES = 12, 0.5, 3

#: Phrases that are matched whole, with their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Opening passages of common public notices, matched in part, with the labels that they add.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-text"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-text"),
    ("this work is licensed under the gnu general public license version 3", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
]
#: The k-gram that stands for the document itself; its position is the number of words.
_WHOLE = 0


def _hashes(phrase: str) -> np.ndarray:
    raw = np.frombuffer(phrase.encode(), np.uint8)
    return W.grams(W.words(raw, np.array([0, len(raw)]), W.LETTERS_DIGITS, lower=True)[0], K)


def templates(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(h, template, q): a row for each k-gram of each template, phrases first, and one for whole documents."""
    rows = [(_WHOLE, -1, 0)]
    for i, (text, _) in enumerate([*phrases, *notices]):
        rows += [(x, i, q) for q, x in enumerate(_hashes(text).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "h long, template int, q int")


def rolling(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, p, h): every k-gram of every document, and a row (p: words of the document) with the hash that no k-gram has."""
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("p", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(1)):
                h, _, _, first = W.words(data, offsets, W.LETTERS_DIGITS, lower=True)
                count = np.diff(first)
                doc = np.repeat(np.arange(j - i), count)
                g = W.grams(h, K)
                inside = doc[: len(g)] == doc[K - 1 :] if len(g) else np.zeros(0, bool)
                g[g == _WHOLE] = 1
                doc, p = doc[: len(g)][inside], (np.arange(len(h)) - first[doc])[: len(g)][inside] if len(g) else np.zeros(0, np.int64)
                at = np.concatenate((np.arange(j - i), doc))
                ids = b.column(0).slice(i, j - i)
                yield batch(out, n + at, ids.take(pa.array(at)), np.concatenate((count, p)), np.concatenate((np.zeros(j - i, np.uint64), g[inside])).view(np.int64))
                n += j - i

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "row long, doc_id long, p long, h long")


def chain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The longest chain of matches in which text and template positions both rise, as indices; p is in rising order."""
    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(p), -1)
    # Of matches at one text position the later template position comes first, so that a chain takes one of them.
    order = np.lexsort((-q, p))
    for x in order.tolist():
        k = bisect.bisect_left(tails, q[x])
        before[x] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [int(q[x])], [x]
    out, x = [], ends[-1] if ends else -1
    while x >= 0:
        out.append(x)
        x = int(before[x])
    return np.array(out[::-1], np.int64)


def verify(diagonal: np.ndarray, votes: list[np.ndarray], size: int, neighbours: int = NEIGHBOURS, share: float = SHARE) -> list[tuple[int, int, float]]:
    """(first word, last k-gram, score) of the passages of one document that hold one template of ``size`` k-grams.

    Each diagonal is merged with its neighbours within ``neighbours``; the score is the share of the template's k-grams on the
    longest chain in order there. Of passages that overlap the best, then the first, stands.
    """
    order = np.argsort(diagonal, kind="stable")
    diagonal, votes = diagonal[order], [votes[i] for i in order.tolist()]
    count = np.array([len(v) for v in votes])
    q = np.concatenate(votes)
    p = q + np.repeat(diagonal, count)
    begin = np.concatenate(([0], np.cumsum(count)))
    lo, hi = np.searchsorted(diagonal, diagonal - neighbours), np.searchsorted(diagonal, diagonal + neighbours, "right")
    found, last = set(), None
    for i, j in zip(begin[lo].tolist(), begin[hi].tolist(), strict=True):
        if (i, j) == last or j - i < share * size or len(np.unique(q[i:j])) < max(LEAST_VOTES, share * size):
            continue
        last = i, j
        parts = [np.arange(i, j)]
        while parts:
            rows = parts.pop()
            c = rows[chain(p[rows], q[rows])]
            if len(c) >= max(LEAST_VOTES, share * size):
                first, end = int(p[c[0]]), int(p[c[-1]])
                found.add((-len(c) / size, first, end))
                parts += [rows[p[rows] < first], rows[p[rows] > end + K - 1]]
    firsts: list[int] = []
    lasts: list[int] = []
    out = []
    for score, first, end in sorted(found):
        k = bisect.bisect_left(firsts, first)
        if (k == len(firsts) or firsts[k] > end + K - 1) and (k == 0 or lasts[k - 1] + K - 1 < first):
            firsts.insert(k, first)
            lasts.insert(k, end)
            out.append((first, end, -score))
    return sorted(out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row a document: doc_id, n_words, spans array<struct(label, base, first, last, score)>.

    One pass over the texts; votes are added up by task before they are dealt out by document. A task then holds the
    diagonals of one document at a time. The template table is bounded by its texts.
    """
    t = templates(docs.sparkSession, phrases, notices)
    matches = rolling(docs, doc_id, text).join(F.broadcast(t), "h")
    by_diagonal = matches.groupBy("row", "doc_id", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_list("q").alias("votes"))
    by_row = by_diagonal.groupBy("row", "doc_id").agg(F.collect_list(F.struct("template", "diagonal", "votes")).alias("found"))
    texts = [*phrases, *notices]
    sizes = [len(_hashes(x)) for x, _ in texts]
    span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans = [], []
            for row in range(b.num_rows):
                found = b.column(1)[row].values
                template, diagonal, votes = (found.field(i) for i in range(3))
                template, diagonal = template.to_numpy(), diagonal.to_numpy()
                at, q = votes.offsets.to_numpy(), votes.values.to_numpy()
                mine = []
                for k in np.unique(template).tolist():
                    rows = np.flatnonzero(template == k)
                    if k < 0:
                        n_words.append(int(diagonal[rows[0]]))
                    elif k < len(phrases):
                        whole = rows[at[rows + 1] - at[rows] == sizes[k]]
                        mine += [{"label": texts[k][1], "base": True, "first": x, "last": x + sizes[k] + K - 2, "score": 1.0} for x in diagonal[whole].tolist()]
                    else:
                        mine += [{"label": texts[k][1], "base": False, "first": x, "last": y + K - 1, "score": z} for x, y, z in verify(diagonal[rows], [q[at[r] : at[r + 1]] for r in rows.tolist()], sizes[k])]
                spans.append(sorted(mine, key=lambda s: (s["first"], s["last"], s["label"])))
            yield batch(out, b.column(0), n_words, pa.array(spans, pa.list_(span)))

    return by_row.select("doc_id", "found").mapInArrow(run, "doc_id long, n_words long, spans array<struct<label: string, base: boolean, first: long, last: long, score: double>>")


def summary(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        label(base).alias("base_labels"),
        label("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
