"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, rate string"


def documents(seed=7):
    rnd = random.Random(seed)
    words = ["The", "quick", "brown", "fox", "é", "naïve", "|", "a###b", "x", "zebra", "中文", "ab cd"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", "  ", "\t", "\x0b", "\x1c"]) for _ in range(n))
    base = [text(rnd.choice([0, 1, 3, 4, 7, 8, 9, 15, 30, 80])) for _ in range(60)]
    long = text(4000)
    texts = base + base[:10] + [long, long + " tail", None, None, "", " ", "\n\n", "a" * 3000, "x " * 200, "same line here\n" * 30, "Same Line Here\n" * 30]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, 1, "r") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a null key", None, None, None, None, None), (None, None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
