"""Small tables with the cases that must not crash: nulls, empty, white space only, long, repeated, non-ASCII."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept_ string, ids string, score string, row_ string, id string"


def vocabulary(rnd, n=60):
    return ["".join(rnd.choice("abdeilnorstuéß") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def texts(seed=3, n=30):
    rnd = random.Random(seed)
    words = vocabulary(rnd)
    passage = " ".join(rnd.choice(words) for _ in range(70))
    other = " ".join(rnd.choice(words) for _ in range(55))
    out = [None, "", "  \n\t ", "one", "Two words", "Ünï　code\u0085x \x0b\x1c tail"]
    for i in range(n):
        body = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(3)]
        if i % 3 == 0:
            body.insert(1, passage)
        if i % 4 == 0:
            body.insert(rnd.randint(0, 3), other)
        if i % 5 == 0:
            body.append(passage[20:])
        out.append(rnd.choice(["\n", " ", "  "]).join(body))
    out += [out[-1], out[-2], passage, passage, " ".join([passage] * 3)]
    out.append(" ".join(rnd.choice(words) for _ in range(30_000)))
    out.append("x" * 100_000)
    return out


def documents(spark, seed=3, repeated=True):
    rows = [(i, t, "en", "s", None, "k", "i", "s", "r", "d") for i, t in enumerate(texts(seed))]
    rows.append((None, texts(seed)[8], None, None, None, None, None, None, None, None))
    if repeated:
        rows += rows[6:9]
    return spark.createDataFrame(rows, DDL)
