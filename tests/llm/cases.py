"""Rows that every text operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, key string, tag string, score double, spans string, gone_id bigint, gone_tag bigint, again boolean, count bigint"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def documents(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = ["the", "and", "of", "é", "Über", "naïve", "x1", "data", "Model", "don't", " ", "日本", "a,b"]
    passages = [[r.choice(vocabulary) + str(r.randint(0, 9)) for _ in range(r.randint(8, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) + str(r.randint(0, 99)) for _ in range(r.randint(0, 30))]
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "long word " * 30_000), (n + 4, "The\x0bsame"), (n + 5, "The same"), (None, "The same"), (None, None), rows[3], rows[3], (rows[4][0], rows[5][1])]
    return rows


def frame(spark, rows):
    full = [(d, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "src", None, k % 2 == 0, "k", None, 0.5, "", d, 0, True, 9) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
