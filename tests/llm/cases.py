"""Small awkward tables that every operator must take."""

import hashlib
import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, label int, fp bigint"


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(hashlib.md5(str(r.randrange(size)).encode()).hexdigest()[:6].translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n))


def rows():
    """Nulls in any column, empty and very long texts, copies, near copies, ties and repeated rows."""
    a, b = words(120, 1), words(200, 2, 10**6)
    texts = {
        1: a, 2: a, 3: a.replace(" ", "\t\n "), 4: b, 5: b + " tail", 6: None, 7: "", 8: "   ", 9: "one", 10: "x" * 20_000, 11: "ab " * 5_000,
        12: words(20_000, 3, 10**6), 13: "Été à la 😀 mer ▁ fin", 14: a[:300] + " " + words(100, 4, 10**6) + " " + a[:300], 15: None,
    }
    out = [(k, t, "en" if k % 3 else None, f"src{k % 2}" if k % 4 else None, None, None, None, None, None) for k, t in texts.items()]
    return out + [out[0], (None, a, None, None, 1, 0.5, True, 1, 3), (None, None, None, None, None, None, None, None, None)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, some=True):
    made = [(k, k % 2, k % 2) for k in range(1, 15)] + [(None, 1, 1), (3, None, None), (3, 1, 0), (999, 1, 1)]
    return spark.createDataFrame(made if some else [], "doc_id bigint, quality int, toxic int")
