"""Hand-made frames: nulls, empty and very long texts, ties, repeated rows, and
extra columns whose names clash with those the operators use."""

import hashlib
import random

SF_SMALL = "/root/testdata/sf0.001"

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "fingerprint string, contamination int, shard int, row long, n long, pid int")


def prose(seed, n):
    r = random.Random(seed)
    parts = ["ba", "lo", "ri", "tén", "mu", "sha", "ko", "der", "x7"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts():
    a = prose(1, 120)
    near = a.split()
    near[60] = "other"
    return [a, a, " ".join(near), a.upper(), prose(2, 400), prose(3, 5), "one two", "word", "", "",
            None, None, "   \n\t ", "...!!!", "né é ü", prose(4, 30_000), "z" * 50_000,
            prose(5, 40) + "\n" + prose(6, 60) + "\n" + prose(5, 40), prose(7, 200), prose(7, 200)]


def documents(spark, more=()):
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "src0",
             len(t) if t else None, "x", 7, 3, 5, 1, 0)
            for i, t in enumerate([*texts(), *more])]
    rows += [rows[4], rows[4], (None, prose(8, 50), None, None, None, None, None, None, None,
                                None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def reachable(nodes, links):
    """node -> smallest reachable node."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
