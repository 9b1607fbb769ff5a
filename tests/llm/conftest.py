import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=40, seed=3):
    """Documents with copies, near copies, shared passages, and odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "an", "er", "on", "ti", "sh", "é", "ou")) for _ in range(r.randint(1, 4)))
    out = []
    passage = " ".join(word() for _ in range(60))
    for i in range(n):
        kind = i % 5
        own = " ".join(word() for _ in range(r.randint(6, 120)))
        if kind == 1 and out:
            own = out[r.randrange(len(out))][1] or own
        elif kind == 2 and out and out[-2][1] and len(out[-2][1].split()) > 40:
            w = out[-2][1].split()
            w[r.randrange(len(w))] = "changed"
            own = " ".join(w)
        elif kind == 3:
            own = own + " " + passage + " " + word()
        out.append((i, own))
    return out


ODD = [
    (None, "a document without an id"), (None, None), (100, None), (101, ""), (102, " \n\t "), (103, "short one"), (104, "short one"), (104, "short one"), (105, "日本語のテキスト"), (106, "x" * 200_000),
    (107, "word " * 30_000), (108, "!!! ... ###"), (109, "Short One"), (None, "a document without an id"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[k % 3], "s", None) for k, (i, t) in enumerate([*texts(), *ODD])]
    clash = "shard int, slot int, score string, items string, token_ids string, n_bytes string, kept string, key string, langs string, part int"
    return spark.createDataFrame([(*r, *(None,) * 10) for r in rows], f"{COLUMNS}, {clash}").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
