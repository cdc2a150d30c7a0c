"""Rows that exercise the cases every corpus operator must define."""

import random

WORDS = [f"w{i}" for i in range(120)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, block string, keys string"


def documents(n=80, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 150)))
        text = text.replace("w7 ", "w7. ").replace("w9 ", "W9!\n")
        rows.append((i, text))
    base = rows[5][1] * 3
    for i in range(12):  # near copies
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "edit"
        rows.append((n + i, " ".join(words)))
    rows += [(n + 20 + i, rows[3][1]) for i in range(15)]  # exact copies
    rows += [(900, None), (901, ""), (902, "  \n\t "), (903, "one"), (904, "ONE\x1ctwo x y"), (None, "no id here at all"), (905, "long " * 30000 + "w1 w2 w3. " * 500), (7, rows[7][1]), (7, rows[7][1]), (908, "naïve Σίσυφος ǅ é ́x </s> <|endoftext|> \U0001f600!?")]
    return [(i, t, "en", "src0", None if t is None else len(t), "s", None, "k") for i, t in rows]
