"""Ranked search, whitening and byte-level BPE against brute force and the libraries, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import byte_bpe, lexical_search, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- ranked lexical search


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """Every document scored for every item."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, length, df = len(bags), sum(n for _, _, n in bags), Counter(x for _, b, _ in bags for x in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 75 + 25 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 12 * m)) for x in terms(text) if bag[x])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "The that on the er THE"), (2, None), (3, " .!? "), (4, "notaword"), (None, "the er"), (5, "sh ti an ouer été"), (5, "sh ti an ouer été"), (6, "word word x日本語のテキスト"), (7, "an " * 300 + "on")]


@pytest.mark.parametrize("segment, block", [(8 << 20, 1 << 18), (3000, 4)])
def test_ranked_search(spark, docs, empty, monkeypatch, segment, block):
    """One large segment, and many small ones with blocks of few items and first bounds from some of them."""
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "SEED_SHARE", 3)
    monkeypatch.setattr(lexical_search, "DEPTH", 2)
    items = spark.createDataFrame([(*r, "x", 1) for r in ITEMS], "item_id long, text string, rank string, doc_id int")
    index = lexical_search.build_index(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for k in (1, 5, 1000):
        got = Counter(tuple(r) for r in index.search(items, k=k).select("item_id", "rank", "doc_id", "score").collect())
        assert got == ranked(rows, ITEMS, k)
    assert index.search(items.limit(0)).count() == 0
    none = lexical_search.build_index(empty)
    assert none.search(items).count() == 0 and (none.n_docs, none.n_terms) == (0, 0)


def test_ranked_search_among_thousands_of_copies(spark):
    """Copies tie at every score; the smallest ids win."""
    rows = [(i, "alpha beta gamma" if i % 3 else f"alpha own{i} delta beta") for i in range(6000)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    items = [(0, "alpha gamma"), (1, "delta own3 own9 beta"), (2, "alpha")]
    got = Counter(tuple(r) for r in lexical_search.build_index(docs).search(spark.createDataFrame(items, "item_id long, text string"), k=20).collect())
    assert got == ranked(rows, items, 20)


def test_lists_are_left_early():
    """A document at the head of a rare term's list ends the search before common lists are read to their ends."""
    import pyarrow as pa

    texts = ["rare rare rare common"] + ["common filler words here"] * 5000
    row = lexical_search.segment_of(pa.array(range(len(texts)), pa.int64()), pa.chunked_array([texts]), 0).select(["terms", "doc_ids", "lengths", "starts", "codes", "tf"])
    own = lexical_search.Lists(row, pa.array([b"common", b"rare"]), len(texts), 4 * len(texts))
    looked, scores = [], own.scores
    own.scores = lambda docs, w: looked.append(len(docs)) or scores(docs, w)
    best, w = lexical_search.Best(1, 1), np.array([1, 9000])
    own.threshold_search(np.array([0, 1]), w, w, best)
    assert best.id.tolist() == [0] and sum(looked) <= 2 * lexical_search.DEPTH


# ---- whitening


def exact(rows, shift=0, k=8):
    """Integer entries and deviations with Python's integers, and the covariance in double precision."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v in good)
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    good = [(i, [math.floor(1024 * x) + shift for x in v]) for i, v in good if len(v) == dim]
    n, s = len(good), [sum(c) for c in zip(*(v for _, v in good))]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for _, v in good]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s)] for _, v in good])
    cov = y.T @ y / n
    return good, dev, y, cov, np.linalg.eigvalsh(cov)[::-1][:k]


@pytest.mark.parametrize("dim, n, size, shift", [(12, 300, 1.0, 100_000), (3, 40, 1e9, 0), (9, 5, 2.0, 7), (5, 60, 1e-3, 100_000), (2, 50, 1e14, -5)])
def test_whitening(spark, dim, n, size, shift):
    r = np.random.default_rng(dim)
    mix = r.normal(size=(dim, dim)) * size
    rows = [(int(i), (r.normal(size=dim) @ mix).tolist()) for i in range(n)]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (900, None), (901, []), (902, [None] * dim), (903, [math.nan] * dim), (904, [math.inf] * dim), (905, [1.0] * (dim + 1))]
    df = spark.createDataFrame([(*x, 5, "x") for x in rows], "vec_id long, embedding array<double>, n int, component string").repartition(4)
    good, dev, y, cov, values = exact(rows, shift)
    got = whitening.whiten(df, shift=shift).collect()
    k = min(8, dim)
    assert len(got) == k * len(good) and {x.n for x in got} == {len(good)}
    assert Counter((x.vec_id, x.deviation) for x in got if x.component == 1) == Counter((i, Decimal(d) if d < 10**38 else None) for (i, _), d in zip(good, dev))
    seen = [j for j in range(k) if values[j] > values[0] * 1e-12]
    share = {x.component: x.explained for x in got}
    assert all(abs(share[j + 1] - values[j] / np.trace(cov)) <= 1e-6 * share[j + 1] for j in seen)
    assert {x.identity_error for x in got}.pop() < 1e-6 and {x.component for x in got if x.whitened is None} == {j + 1 for j in range(k) if j not in seen}
    order = {}
    for x in got:
        order.setdefault((x.vec_id is None, x.vec_id or 0, x.deviation), {}).setdefault(x.component, []).append(x.whitened)
    z = np.array([[order[(i is None, i or 0, Decimal(d) if d < 10**38 else None)][j + 1].pop() for j in seen] for (i, _), d in zip(good, dev)])
    assert np.abs(z.T @ z / len(z) - np.eye(len(seen))).max() < 1e-6
    # each component is an eigenvector: what it and the others measure is uncorrelated, with its own eigenvalue
    axes = np.linalg.lstsq(y, z * np.sqrt(values[seen]), rcond=None)[0]
    if len(good) > dim:
        assert np.abs(cov @ axes - axes * values[seen]).max() < 1e-6 * values[0]


def test_whitening_without_rows_or_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 2.0]) for i in range(4)], schema)).collect()
    assert len(same) == 8 and all((x.whitened, x.explained, x.deviation, x.identity_error) == (None, 0.0, 0, 0.0) for x in same)
    with pytest.raises(Exception, match="2\\*\\*61"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], schema)).collect()


def test_deviations_beyond_a_long_are_exact():
    r = random.Random(2)
    for n, top in ((10, 100), (10**9, 10**6), (10**11, 10**5), (7, 1 << 60)):
        x = np.array([[r.randint(-top, top) for _ in range(4)] for _ in range(20)])
        s = [r.randint(-n * top // 2, n * top // 2) for _ in range(4)]
        m = whitening.Fitted(n, np.array([v // n for v in s]), np.array([v % n for v in s], object), np.zeros(0), np.zeros((0, 4)), 0.0)
        want = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
        assert m.deviation(x).to_pylist() == [w if w < 10**38 else None for w in want]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=byte_bpe.ranks_of(ranks[0]), special_tokens={})


def test_byte_bpe_equals_the_library(docs, empty, ranks, encoding):
    every = ("n_tokens", "token_ids", "token_data", "decoded", "decoded_bytes")
    got = byte_bpe.encode(docs.withColumn("n_tokens", F.lit("x")), *ranks, results=every)
    assert got.select(*docs.columns).count() == docs.count()
    for text, n, ids, data, back, raw in got.select("text", *(F.col(c) for c in every)).collect():
        if text is None:
            assert (n, ids, data, back, raw) == (None,) * 5
        else:
            want = encoding.encode_ordinary(text)
            assert ids == want and n == len(want) and bytes(data) == np.array(want, "<u4").tobytes()
            assert back == text and bytes(raw) == text.encode()
    assert byte_bpe.encode(empty, *ranks, results=every).count() == 0


PARTS = ["a", "the", " ", "  ", "\n", "\t", " ", "　", " ", "​", "\x85", "\x1c", "\0", "é", "漢", "。", "🙂", "é", "'s", "'LL", "'", "!", "...", "1", "23", "٣", "<|endoftext|>", "İ", "\r\n"]


def fuzz(n=3000):
    r = random.Random(7)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["x" * 150_000, " " * 9000, "漢字" * 30_000 + "。" + "漢" * 50_000, "ab.c" * 40_000, " " * 70_000]


def rows_of(texts):
    import pyarrow as pa

    from rasterloom.llm.common import text_bytes

    return text_bytes(pa.array(texts))


def test_byte_bpe_of_random_texts(ranks, encoding, monkeypatch):
    texts = fuzz()
    for kept in (24 << 20, 0):  # also when nothing is kept between slices
        monkeypatch.setattr(byte_bpe, "KEPT_BYTES", kept)
        enc = byte_bpe.Encoder(byte_bpe.library_model(*ranks))
        for part in (texts, texts[:500]):
            ids, at = enc.encode(*rows_of(part))
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [encoding.encode_ordinary(t) for t in part]


def test_units_are_cut_where_no_match_goes_on(ranks):
    import regex

    for text in fuzz(1500):
        data, offsets = rows_of([text])
        ends = {len(text[: m.end()].encode()) for m in regex.finditer(ranks[1], text)} if len(text) < 1000 else None
        starts = byte_bpe.unit_starts(data, offsets).tolist()
        assert starts[:1] == ([0] if text else []) and (ends is None or set(starts[1:]) <= ends)


def test_character_offsets(spark, ranks):
    """The library's own offsets are the brute-force version."""
    from tokenizers import Tokenizer

    texts = [t for t in fuzz(300) if len(t) < 1000] + ["", None, "漢字🙂 été"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    library = Tokenizer.from_str(byte_bpe.library_model(*ranks))
    for text, first, last in byte_bpe.encode(df, *ranks, results=("char_starts", "char_ends")).collect():
        assert list(zip(first or [], last or [])) == (library.encode(text, add_special_tokens=False).offsets if text else [])


def test_decoding_of_any_ids(spark, ranks, encoding):
    r = random.Random(3)
    ids = [[r.randrange(50_256) for _ in range(r.randint(0, 30))] for _ in range(300)]
    ids += [encoding.encode_ordinary("漢🙂")[:k] for k in range(7)] + [[], None, [1, None], [50_256], [-1, 5], [2**31 - 1]]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(ids)], "k int, token_ids array<int>, decoded string")
    for k, x, text, raw in byte_bpe.decode(df, *ranks, results=("decoded", "decoded_bytes")).collect():
        if x is None or any(i is None or not 0 <= i < 50_256 for i in x):
            assert text is None and raw is None
        else:
            assert bytes(raw) == encoding.decode_bytes(x) and text == bytes(raw).decode("utf-8", "replace")
    assert byte_bpe.decode(df.limit(0), *ranks).count() == 0


def test_query_digests(spark, sf_dir, encoding):
    from rasterloom.llm import queries as q

    texts = dict(q.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = q.op13_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for doc, n, ids, back in got:
        want = encoding.encode_ordinary(texts[doc] or "")
        assert (n, ids, back) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[doc] or "").encode()).hexdigest())


def test_query_of_whitening(spark, sf_dir):
    from rasterloom.llm import queries as q

    rows = [(i, [float(x) for x in v]) for i, v in q.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    good, dev, _, _, values = exact(rows, 100_000)
    got = q.op12_whitening(spark, sf_dir).collect()
    assert Counter((x.vec_id, x.deviation) for x in got) == Counter({(i, d): 8 for (i, _), d in zip(good, dev)}) and max(x.identity_error for x in got) < 1e-4
