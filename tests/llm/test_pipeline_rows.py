"""Each stage of the pipeline on rows with nulls, empty and very long texts, ties, repeated rows and clashing columns, against brute force."""

from collections import Counter

import corpus_pipeline as p
import numpy as np
import pytest

from rasterloom.llm import quality
from tests.llm.test_operators import hits, library, rows, word_sets


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    """Few hash ranges, so that small tables need few tasks; results don't depend on them."""
    near, repeats = p.jaccard.representatives, p.suffix_dedup.remove_repeats
    monkeypatch.setattr(p.jaccard, "representatives", lambda docs, **more: near(docs, **more, bits=2))
    monkeypatch.setattr(p.suffix_dedup, "remove_repeats", lambda docs, **more: repeats(docs, **more, bits=1))


def checked(spark, docs, sf_dir, step):
    """A stage's rows (doc_id, text), which have all columns of its input, and its input's."""
    out = step(spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes
    return Counter(rows(out, "doc_id", "text")), rows(docs, "doc_id", "text")


def test_quality_on_odd_rows(spark, docs, sf_dir):
    got, own = checked(spark, docs, sf_dir, p.keep_quality)
    stats = quality.with_statistics(docs.where(~p.held_out()).select("doc_id", "text"))
    forest = quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_texts(docs, forest).select("doc_id", "text", "score").collect()
    assert len(scored) == len(own) and got == Counter((r.doc_id, r.text) for r in scored if r.score >= p.LEAST_QUALITY)


def test_near_copies_on_odd_rows(spark, docs, sf_dir):
    got, own = checked(spark, docs, sf_dir, p.keep_one_of_near_copies)
    sets, group = [word_sets(t) for _, t in own], list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    left = list(got.elements())
    # one row of each group, of the smallest id where the group has one; rows without words all stay
    for g in set(group):
        members = [own[i] for i in range(len(own)) if group[i] == g]
        ids = [d for d, _ in members if d is not None]
        if not word_sets(members[0][1]):
            assert members[0] in left
        else:
            assert sum(got[m] > 0 for m in set(members)) == 1
            assert any(got[m] and m[0] == (min(ids) if ids else None) for m in members)
    assert sum(got.values()) == sum(1 if word_sets(own[i][1]) else 0 for i in {group.index(g) for g in group}) + sum(not s for s in sets)


def test_repeated_passages_on_odd_rows(spark, docs, sf_dir):
    got, own = checked(spark, docs, sf_dir, p.remove_repeated_passages)
    first, length, last = {}, 50, float("inf")
    for i, t in own:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s, v = b[k : k + length], last if i is None else i
            first[s] = min(v, first.get(s, v))
    want = Counter()
    for i, t in own:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = True
        # characters that a removal cut in two go with it
        at, cut = 0, ""
        for c in t or "":
            n = len(c.encode())
            cut += "" if gone[at : at + n].any() else c
            at += n
        want[i, None if t is None else cut] += 1
    assert got == want


def test_contamination_on_odd_rows(spark, docs, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = spark.createDataFrame([(900, "before " + items[0][1] + " after", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(dirty, allowMissingColumns=True).select(*docs.columns)
    got, own = checked(spark, both, sf_dir, p.drop_contaminated)
    assert got == Counter((d, t) for d, t in own if not hits(t, items, 10)[1]) and not any(d == 900 for d, _ in got)


def test_tokens_of_odd_rows(spark, docs, sf_dir):
    sp, texts = library(), rows(docs, "doc_id", "text")
    want = Counter((d, 0 if t is None else len(sp.encode(t)), None if t is None else tuple(sp.encode(t)), None if t is None else True) for d, t in texts)
    got = p.to_tokens(spark, docs, sf_dir).select("doc_id", "n_tokens", "token_ids", "round_trip").collect()
    assert Counter((d, n, None if ids is None else tuple(ids), back) for d, n, ids, back in got) == want
