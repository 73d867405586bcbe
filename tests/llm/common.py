"""Small corpora with the edge cases that every operator must take, and brute-force versions."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, ddl=DDL):
    full = [(d, t, *(rest or ("en", "src0")), None if t is None else len(t)) for d, t, *rest in rows]
    return spark.createDataFrame(full, ddl)


def prose(seed, n, vocabulary=400):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) + str(r.randint(0, vocabulary)) for _ in range(n))


#: Null, empty, blank, control characters, astral characters, one long word, one very long text, ties and repeats.
EDGES = [
    (0, None),
    (1, ""),
    (2, " \t\n\x0b\f\r "),
    (3, "a"),
    (4, "\x1c\x1d one\x1ftwo \x85 three"),
    (5, "😀 é ß 漢字 kana かな " * 20),
    (6, "x" * 5000),
    (7, prose(7, 30_000)),
    (8, prose(8, 200)),
    (9, prose(8, 200)),
    (9, prose(8, 200)),
    (10, "word " * 300),
    (None, prose(8, 200)),
]


def components(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
