"""Small corpora for the operators: random prose with copies, edits, blanks, nulls and extra columns."""

import random

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key int"


def prose(rng, n, end=" "):
    return end.join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split(" "))


def documents(seed=1, n=120):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            t = rng.choice(texts)
        elif texts and kind < 0.45:
            t = edited(rng, rng.choice(texts) or "x", rng.choice([0.01, 0.03, 0.06, 0.1]))
        else:
            t = prose(rng, rng.choice([1, 3, 8, 30, 120, 300]))
        if rng.random() < 0.1:
            t += "\n" + passage
        if rng.random() < 0.1:
            t = (t[:40] + "\n") * 5 + t
        texts.append(t)
    texts += ["", None, "   ", "\t\n", "é " * 30, "A B c", "a b C", prose(rng, 9000), " x  y z w "]
    return [(i * 3 + 1, t, "en", "s", len(t or ""), 0.5, 7) for i, t in enumerate(texts)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
