"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, jaccard, langid, quality, sentencepiece_codec, sharding, suffix_dedup, token_count, topk, warc
from rasterloom.llm.graph import connected_components
from rasterloom.llm.piece_model import UNIGRAM, PieceModel

MODEL = sentencepiece_codec.read_model(sentencepiece_codec.MODEL)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def library(kind=None):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    if kind:
        m.trainer_spec.model_type = kind
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_sentencepiece_equals_the_library(docs, empty):
    sp = library()
    got = rows(sentencepiece_codec.encode(docs, MODEL, decoded=True), "text", "token_ids", "decoded")
    for text, ids, back in got:
        if text is None:
            assert ids is None and back is None
        else:
            want = sp.encode(text)
            assert ids == want and back == sp.decode(want)
    coded = sentencepiece_codec.encode(docs, MODEL)
    assert Counter(rows(sentencepiece_codec.decode(coded, MODEL), "decoded")) == Counter((b,) for _, _, b in got)
    assert sentencepiece_codec.encode(empty, MODEL, decoded=True).count() == 0


def test_pieces_of_random_strings():
    r = random.Random(1)
    strings = ["".join(r.choice("abcdetionsh  ▁\n\té漢🙂\0ß.,0<>=-") for _ in range(r.randint(0, 60))) for _ in range(800)] + ["=" * 90, " " * 50 + "x"]
    for kind in (None, UNIGRAM):
        sp, m = library(kind), PieceModel(MODEL, kind)
        enc, count = sentencepiece_codec.Encoder(m), token_count.Counter([m])
        # scores add up in single precision over a whole text in the library, so unigram paths are compared word by word
        some = strings if kind is None else [w for s in strings for w in re.split(r"[\s▁\0🙂<>=]", s) if w]
        ids, at = enc.encode(some)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == sp.encode(some)
        assert count.count_all(some)[0][0].tolist() == [len(x) for x in sp.encode(some)]
    dec = sentencepiece_codec.Decoder(PieceModel(MODEL))
    lists = [[r.randrange(400) for _ in range(r.randint(0, 30))] for _ in range(500)]
    assert dec.decode(np.array([x for p in lists for x in p]), np.concatenate([[0], np.cumsum([len(p) for p in lists])])) == library().decode(lists)


def test_token_counts(docs, empty):
    sp = library()
    for text, n in rows(token_count.count_tokens(docs, MODEL), "text", "n_tokens"):
        assert n == (None if text is None else len(sp.encode(text)))
    assert token_count.count_tokens(empty, MODEL).count() == 0


def best_paths(m, word):
    """(score, pieces) of a word by trying every segmentation, the earliest start of the last piece first among equals."""
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        options = [(m.add(best[s][0], m.scores[m.ids[word[s:e]]]), best[s][1] + 1) for s in range(e) if word[s:e] in m.ids]
        if word[e - 1] not in m.ids:
            options.append((m.add(best[e - 1][0], m.unk_score), best[e - 1][1] + (len(word[e - 1].encode()) if m.byte_fallback else 1)))
        top = max(x for x, _ in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1]


def test_unigram_scores_of_both_operators(docs):
    """Scores and counts of the unigram reading against every segmentation; both operators give the same score."""
    m = PieceModel(MODEL, UNIGRAM, double=True)
    r = random.Random(5)
    words = ["▁" + "".join(r.choice("abcdetionshé漢🙂ß.,0") for _ in range(r.randint(0, 30))) for _ in range(300)] + ["▁" + "ab漢" * 60]
    counter = token_count.Counter([PieceModel(MODEL), m])
    counter.learn(sorted(set(words)))
    enc = sentencepiece_codec.Encoder(PieceModel(MODEL), m)
    enc.learn(sorted(set(words)))
    for w in words:
        score, n = best_paths(m, w)
        k = counter.code[w]
        assert (counter.score[1][k], counter.count[1][k]) == (score, n) and enc.score[enc.code[w]] == score
    counted = token_count.count_tokens(docs, MODEL, kinds={"n_tokens": None, "n_unigram": UNIGRAM}, scores={"unigram_score": "n_unigram"}, double=True)
    a = Counter(rows(counted, "doc_id", "text", "unigram_score"))
    assert a == Counter(rows(sentencepiece_codec.encode(docs, MODEL, scored=True), "doc_id", "text", "path_score"))
    assert all((t is None) == (s is None) for _, t, s in a)


def test_pairs_of_pieces_stay_as_merging_says():
    m, r = PieceModel(MODEL), random.Random(6)

    def merged(text):
        parts = list(text)
        while True:
            found = [(-m.scores[m.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in m.ids]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    names = [*r.sample(sorted(m.ids), 300), "漢", "🙂", "e", "th", "▁the"]
    for a in ["", *names]:
        for b in r.sample(names, 20):
            assert m.stays(a, b) == (merged(a + b) == ([a, b] if a else [b])), (a, b)


def test_language_mixture(spark, docs, empty):
    r = random.Random(2)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    en, fr = ["the", "and", "shell", "thing", "with"], ["été", "où", "ça", "leçon", "êtes"]
    train = spark.createDataFrame([(say(en, 50), "en"), (say(fr, 50), "fr"), (None, "en"), ("x", None)], "text string, lang string")
    langs, model = langid.fit(train)
    assert langs == ["en", "fr"] and np.allclose(np.exp(model.astype(float)).sum(1), 1, atol=1e-3)
    probe = spark.createDataFrame([(0, say(en, 30)), (1, say(fr, 30)), (2, say(en, 60) + " " + say(fr, 30)), (3, "123 !!"), (4, None), (5, "")], "i int, text string")
    got = {r.i: r for r in langid.identify(probe, langs, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "fr", "en", "und", "und", "und"]
    assert got[0].score > 0.99 and set(got[2].langs) == {"en", "fr"} and got[2].langs["en"] == pytest.approx(2 / 3, abs=0.1)
    assert all(got[i].score == 0 for i in (3, 4, 5))
    assert langid.identify(docs, langs, model).where("lang_pred = 'und' AND score > 0").count() == 0
    assert langid.identify(docs, langs, model).count() == docs.count()
    assert langid.fit(empty) [0] == [] and set(rows(langid.identify(docs, *langid.fit(empty)), "lang_pred")) == {("und",)}


def test_top_k(spark):
    r = np.random.default_rng(6)
    vec = [(i, r.normal(0, 0.1, 8).astype(np.float32).tolist()) for i in range(150)]
    vec += [(200 + i, [0.25] * 8) for i in range(40)]  # ties
    odd = [(300, None), (None, [0.1] * 8), (301, [float("nan")] + [0.0] * 7), (302, [None] + [0.0] * 7), (400, [0.5] * 3), (401, [0.5] * 3), (500, [])]
    df = spark.createDataFrame([(*v, "x") for v in vec + odd], "vec_id long, embedding array<float>, score string").repartition(5)
    q = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vec + odd[4:]}
    want = set()
    for i, v in q.items():
        if i % 10 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in q.items() if j != i and len(w) == len(v)))[:10]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)}
    for block in (7, 2048):
        got = rows(topk.exact_top_k(df, F.col("vec_id") % 10 == 0, block=block), "query_id", "rank", "vec_id", "score")
        assert len(got) == len(set(got)) and set(got) == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_warc(spark, tmp_path):
    pages = [(i, ("http://b.example/p?q", "https://a.example/x#f", None)[i % 3], ("same", "", None, f"own {i} é", "same")[i % 5]) for i in range(60)] + [(None, "http://c.d/", "same"), (7, "https://a.example/x", None), (None, None, "alone")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, kind string").repartition(4)
    got = warc.archive_round_trip(df, str(tmp_path / "w"))
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        ref = first.get(h or "")
        own = ref is None or i == ref
        want[i, len(body), warc.digest32(body), "response" if own else "revisit", None if own else ref] += 1
    assert Counter(rows(got, "id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    order = [(r.urlkey) for r in got.orderBy("seq_range", "seq").collect()]
    assert order == sorted(order)
    assert warc.archive_round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_sharding(docs, empty, tmp_path):
    out = sharding.shuffle_into_shards(docs, n_shards=5, n_buckets=4, path=str(tmp_path / "s"))
    got = rows(out, "doc_id", "text", "shard", "slot")
    assert Counter((i, t) for i, t, *_ in got) == Counter(rows(docs, "doc_id", "text"))
    by = defaultdict(list)
    for *_, shard, slot in got:
        by[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(2), n_shards=5, n_buckets=4, path=str(tmp_path / "t"))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows(again, "doc_id", "text", "shard", "slot"), key=key) == sorted(got, key=key)
    assert sharding.shuffle_into_shards(empty, path=str(tmp_path / "e")).count() == 0


def word_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(spark, docs, empty, monkeypatch):
    all_ = rows(docs, "doc_id", "text")
    sets = [word_sets(t) for _, t in all_]
    parent = list(range(len(all_)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(all_)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(all_):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(all_))
    got = jaccard.components(docs, bits=2)
    assert Counter(rows(got, "doc_id", "n_shingles", "component_id")) == want
    kept = jaccard.representatives(docs, bits=2)
    assert kept.columns == docs.columns
    groups = Counter(find(i) if sets[i] else ("none", i) for i in range(len(all_)))
    assert kept.count() == len(groups)
    monkeypatch.setattr(jaccard, "MOST_IDS", -1)  # the way for more ids than are broadcast
    assert Counter(rows(jaccard.representatives(docs, bits=2), "doc_id", "text")) == Counter(rows(kept, "doc_id", "text"))
    assert jaccard.components(empty, bits=2).count() == 0


def test_hot_lists_and_blocks(spark):
    """A large group of near copies: lists longer than the bound, in several blocks."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"c{i}"
        texts.append(" ".join(w))
    sets = [word_sets(t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    every = jaccard.frequent_enough(df, 5, 75, 100, 2)
    held = every.where("tokens IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min("doc_id").alias("least"))
    held = held.cache()
    classes = jaccard.prefixes(held.select("key", "n", "tokens"), 75, 100, 2)
    links = jaccard.class_links(classes, 75, 100, hot=4, members=7)
    of = {bytes(k): d for k, d in rows(held, "key", "least")}
    found = {tuple(sorted((of[bytes(a)], of[bytes(b)]))) for a, b in rows(links, "a", "b")}
    true = {(j, i) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert all(p in true for p in found)

    def comps(pairs):
        p = {}
        f = lambda x: x if p.setdefault(x, x) == x else f(p[x])
        for a, b in pairs:
            p[f(a)] = f(b)
        return {frozenset(y for y in p if f(y) == f(x)) for x in p}

    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    reps = set(first.values())
    assert comps(found) == comps({(a, b) for a, b in true if a in reps and b in reps})
    held.unpersist()


def test_t_occurrence_by_brute_force():
    r = np.random.default_rng(7)
    for counted in (0, 10**9):  # by counting, by the heap
        old, jaccard.COUNTED = jaccard.COUNTED, counted
        for _ in range(40):
            sets = [np.unique(r.integers(0, 40, r.integers(1, 30))).astype(np.uint64) for _ in range(12)]
            sets += [s.copy() for s in sets[:3]]
            block = jaccard.InvertedBlock([len(s) for s in sets], sets, 75, 100)
            for s in sets:
                want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
                assert sorted(block.search(len(s), s)) == want
        jaccard.COUNTED = old


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = dict(rows(connected_components(e), "node", "root"))
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_quality_trees(spark, docs, empty):
    r = np.random.default_rng(8)
    x = r.random((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    f = quality.fit(x[:1500], y[:1500], n_trees=60)
    assert ((f.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    one = x[7]
    total = f.base
    for root in f.roots:  # the flattened walk against a plain one
        at = root
        while f.left[at] != at:
            at = f.left[at] if one[f.feature[at]] <= f.threshold[at] else f.right[at]
        total += f.value[at]
    assert f.score(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x[:0], y[:0]).score(x[:2]) == pytest.approx([0.5, 0.5])
    stats = quality.with_statistics(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(stats, labels, least=2)
    a = sorted(r.score for r in quality.score_statistics(stats, forest).collect())
    b = sorted(r.score for r in quality.score_texts(docs, forest).collect())
    assert len(a) == docs.count() and a == pytest.approx(b) and all(0 <= s <= 1 for s in a)
    assert quality.score_texts(empty, forest).count() == 0


def test_statistics_by_hand():
    import pyarrow as pa

    s = dict(zip(quality.FEATURES, quality.statistics(pa.array(["AB ab ab ab\nab!", None, ""]))[0]))
    assert s["upper"] == pytest.approx(2 / 15) and s["again"] == pytest.approx(2 / 5) and s["top_word"] == pytest.approx(3 / 5) and s["distinct"] == pytest.approx(3 / 5) and s["shout"] == pytest.approx(1 / 15)


def test_top_k_of_empty_and_large_vectors(spark):
    """Components of any size take part, also those over 2**63 and products that cancel; against Python's integers."""
    r = random.Random(4)
    vectors = [(0, []), (10, []), (34, []), (33, None), (40, [float("inf"), 1.0]), (50, [1e300, 1e300]), (51, [3.0, -3.0]), (20, [2.0**62, 1.0]), (21, [1.0, 2.0**62]), (30, [4e5, -1.0])]
    vectors += [(100 + i, [r.choice((-1, 1)) * r.random() * 10.0 ** r.randint(0, 8) for _ in range(3)]) for i in range(60)] + [(200, [2e5] * 64), (201, [-2e5] * 64), (202, [3e7] * 64), (203, [1.0] * 64), (210, [3e7] * 63 + [-1e7])]
    usable = {i: v for i, v in vectors if v is not None and all(x != float("inf") for x in v)}

    def best(query, k):
        score = lambda v: sum(int(a) * int(b) for a, b in zip(map(math.floor, usable[query]), map(math.floor, v)))
        found = sorted((-score(v), i) for i, v in usable.items() if i != query and len(v) == len(usable[query]))
        return [(query, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]

    def run(ids):
        df = spark.createDataFrame([(i, v, "x") for i, v in vectors if i in ids], "vec_id long, embedding array<double>, score string").repartition(3)
        return sorted(rows(topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5, scale=1.0, block=3), "query_id", "rank", "vec_id", "score"))

    fits = {i for i in usable if i not in (50, 51, 20, 21)}
    held, usable = usable, {i: v for i, v in usable.items() if i in fits}
    assert run(fits) == sorted(x for q in fits if q % 10 == 0 for x in best(q, 5))
    # 1e300 * 3 - 1e300 * 3 is 0, and 2**62 + 2**62 doesn't fit
    usable = {i: held[i] for i in (50, 51)}
    assert run({50, 51}) == [(50, 1, 51, 0)]
    with pytest.raises(Exception, match="query 20 and vector 21 doesn't fit in a long"):
        run({20, 21})


def test_shards_of_rows_with_maps(spark, docs):
    df = docs.select("doc_id", "text", F.create_map(F.lit("en"), F.col("doc_id").cast("double")).alias("langs"))
    got = sharding.shuffle_into_shards(df, n_shards=5, bucket_bytes=1 << 14).select("doc_id", "text", "langs", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows(docs, "doc_id", "text"))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in sizes.items())
    assert all(r.langs == {"en": None if r.doc_id is None else float(r.doc_id)} for r in got)


def test_archives_are_read_in_pieces():
    r = random.Random(3)
    payloads = [bytes(r.randrange(256) for _ in range(r.choice((0, 10, 40_000)))) for _ in range(40)]
    blobs = [warc._gzip(warc.record("http://a/b", warc.capture_time(1), 1, p, warc.digest32(p), None, "n", f"f/{i}")) for i, p in enumerate(payloads)]
    got = list(warc.parse_archive(b"".join(blobs)))
    assert [b for _, _, b in got] == payloads and [at for at, _, _ in got] == [sum(map(len, blobs[:i])) for i in range(len(blobs))]
    assert len(list(warc.parse_archive(b"".join(blobs)[:-3]))) == 39
    twice = [warc.record(None, "t", None, b"", "D", None, "n", p) for p in ("f/0", "f/9")]
    assert twice[0] != twice[1]


def test_training_rows_are_the_least_hashes(spark, monkeypatch):
    stats = spark.createDataFrame([(i, [float(i)] * len(quality.FEATURES)) for i in range(5000)], "doc_id long, stats array<float>").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 6000)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, **o: seen.append((x[:, 0].tolist(), y.tolist())))
    quality.train(stats, labels, max_rows=300)
    want = [r.doc_id for r in stats.orderBy(F.xxhash64("doc_id")).limit(300).collect()]
    assert seen == [([float(i) for i in want], [float(i % 2) for i in want])]


def hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        v = words(t)
        if i is None or not v:
            continue
        n = min(window, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, empty, monkeypatch):
    source = [t for _, t in rows(docs, "doc_id", "text") if t and 40 < len(t) < 2000]
    items = [(1, " ".join(source[0].split()[3:20])), (2, "short one"), (3, None), (None, source[1]), (4, "..."), (5, source[2].upper() + " tail"), (1, source[3]), (6, "nowhere to be found at all"), (7, "word " * 12)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    want = Counter((d, *hits(t, items, 10)[:2], tuple(hits(t, items, 10)[2])) for d, t in rows(docs, "doc_id", "text"))
    got = lambda df: Counter((d, n, k, tuple(i)) for d, n, k, i in rows(df, "doc_id", "n_words", "n_hit", "items"))
    assert got(decontaminate.decontaminate(docs, bench)) == want
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 400)
    assert got(decontaminate.decontaminate(docs, bench)) == want  # several item blocks
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for (_, _, k, _), n in want.items() if not k)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark, monkeypatch):
    """Hit words and items by trying every stretch of every document; documents beside each other don't add up."""
    r = random.Random(12)
    word = lambda: r.choice("alpha beta gamma delta eps q q the the".split())
    texts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(60)] + ["alpha one", "beta gamma", "alpha q", None]
    items = [(f"i{k}", " ".join(word() for _ in range(r.randint(1, 9)))) for k in range(25)] + [("abc", "alpha beta gamma"), ("qqa", "q q alpha")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for window, within in ((4, 7), (3, 20), (9, 9)):
        want = {}
        for d, t in enumerate(texts):
            w, hit, found = (t or "").split(), set(), set()
            for item, text in items:
                own = text.split()
                for j in range(max(1, len(own) - window + 1)):
                    phrase = Counter(own[j : j + window])
                    for i in range(len(w)):
                        if not phrase - Counter(w[i : i + within]):
                            hit |= {k for k in range(i, min(len(w), i + within)) if w[k] in phrase}
                            found.add(item)
            want[d] = (len(w), len(hit), sorted(found), bool(hit))
        index = decontaminate.build_index(docs, gap=20)
        got = decontaminate.search(index, items, window=window, within=within)
        assert {d: (n, h, i, c) for d, n, h, i, c in rows(got, "doc_id", "n_words", "n_hit", "items", "contaminated")} == want
    with pytest.raises(Exception, match="gap"):
        decontaminate.search(decontaminate.build_index(docs, gap=4), items, window=3, within=6).collect()
    # tiles beside exact phrases, in one and in several blocks of items
    bench = spark.createDataFrame(items, "item_id string, text string")
    tiles = {i: {tuple(t.split()[j : j + 4]) for j in (*range(0, len(t.split()) - 4, 4), max(0, len(t.split()) - 4))} for i, t in items}
    want = {d: sorted(i for i, of in tiles.items() if any(not Counter(p) - Counter((t or "").split()[k : k + 6]) for p in of for k in range(len((t or "").split())))) for d, t in enumerate(texts)}
    for size in (decontaminate.ITEM_BYTES, 100):
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", size)
        assert {d: sorted(i) for d, i in rows(decontaminate.decontaminate(docs, bench, window=4, near=6), "doc_id", "near_items")} == want


def test_words_outside_the_items_do_not_match(spark, monkeypatch):
    phrase = ["alpha", "beta", "gamma"]
    least = min(phrase, key=lambda w: decontaminate.tokens(pa.array([w]))[0][0])  # term 0, which is made the most frequent
    texts = [" ".join("other" if w == least else w for w in phrase), least, least, least, " ".join(phrase)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    hit = lambda df: [r.doc_id for r in df.where("contaminated").collect()]
    index = decontaminate.build_index(docs)
    assert hit(decontaminate.search(index, [("q", " ".join(phrase))])) == [4]
    assert hit(decontaminate.search(index, [("q", " ".join(phrase))], within=4)) == [4]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1)
    bench = spark.createDataFrame([(1, " ".join(phrase)), (2, "other words stand here")], "item_id long, text string")
    assert hit(decontaminate.decontaminate(docs, bench)) == [4]


def test_repeats_by_brute_force(docs, empty):
    length = 50
    all_ = [(i, (t or "").encode()) for i, t in rows(docs, "doc_id", "text")]
    first = {}
    for i, b in all_:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            v = float("inf") if i is None else i
            first[s] = min(v, first.get(s, v))
    want = Counter()
    for i, b in all_:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (float("inf") if i is None else i):
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int)) == -1).sum())
        left = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    for bits in (1, 7):
        got = suffix_dedup.remove_repeats(docs, length, bits=bits)
        assert Counter(rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
        assert all(hashlib.sha256(bytes(k)).hexdigest() == h for k, h in rows(got, "kept", "kept_sha256"))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_equal_short_fingerprints_remove_nothing(spark):
    # two windows with equal leading 41 bits of their fingerprints, each beside a text that shares its anchor, and two reaches of
    # one anchor with equal last 40 bits
    windows = ["nzbxmzsdyputtykttzhzoiykrttuccwkrtdtbtgnqnhncyajfz", "#zbxmzsdyputtykttzhzoiykrttuccwkrtdtbtgnqnhncyajfz", "kaouirmppoyvufseldnuocrdyyqjqkwmilapurbvrcnqifqsnc", "#aouirmppoyvufseldnuocrdyyqjqkwmilapurbvrcnqifqsnc"]
    reaches = ["hvghpvzvxzlriplmzcvkiytfmbzacpdzbbdsigvzrmejzylqzy", "rlvuvtfnjvppddymzcvkiytfmbzacpdzbbdxxikjdjrdgpskjc"]
    for texts in (windows, reaches):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bits=1)
        assert sorted(rows(got, "doc_id", "n_removed")) == [(i, 0) for i in range(len(texts))]


def removed_windows(texts, length, before=()):
    """For (id, bytes) of each text the places of windows that start in a text with a smaller id, or in one of ``before``."""
    least = {b[i : i + length]: suffix_dedup.EARLIER for b in before for i in range(len(b) - length + 1)}
    for d, b in sorted(texts):
        for i in range(len(b) - length + 1):
            least.setdefault(b[i : i + length], d)
    return [[i for i in range(len(b) - length + 1) if least[b[i : i + length]] < d] for d, b in texts]


def repeated(r, n, low=0, high=400):
    """Bytes with shared passages, periods, zeros and high bytes."""
    parts = [bytes(r.choice(b"abc\0\xff ") for _ in range(r.randint(20, 120))) for _ in range(12)] + [b"ab" * 70, b"\0" * 90]
    return [b"".join(r.choice(parts)[: r.randint(1, 200)] for _ in range(r.randint(low, high) // 40)) for _ in range(n)]


@pytest.mark.parametrize("level", [7, 50, 1 << 16])
def test_suffix_arrays_and_levels(level):
    r, length = random.Random(level), 45
    texts = [(r.randrange(12), b) for b in repeated(r, 30)]
    data = np.frombuffer(b"".join(b for _, b in texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for _, b in texts])])
    place, first, last, doc = suffix_dedup.anchors(data, offsets, length)
    covered = [(offsets[d] + i) for d, (_, b) in enumerate(texts) for i in range(len(b) - length + 1)]
    assert [t for f, e in zip(first, last) for t in range(f, e + 1)] == covered
    assert all(f <= p <= f + length and e <= p <= e + length - suffix_dedup.GRAM + length for p, f, e in zip(place, first, last))
    ids = np.array([texts[d][0] for d in doc])
    strings = np.concatenate([data[f : e + length] for f, e in zip(first, last)])
    family = suffix_dedup.LevelFamily()
    gone = suffix_dedup.find_windows(strings, place - first, last - first, ids, length, family, level)
    got = sorted(int(place[k] - a) for k, a in zip(*np.nonzero(gone)))
    assert got == sorted(int(offsets[d]) + i for d, of in enumerate(removed_windows(texts, length)) for i in of)
    sizes = [len(x) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for x in family.levels:  # in the order of letters
        rows_ = [bytes(v) for v in x.ahead]
        assert rows_ == sorted(rows_)


def test_hot_anchors_and_small_levels_change_nothing(docs):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = Counter(rows(suffix_dedup.remove_repeats(docs), *cols))
    assert Counter(rows(suffix_dedup.remove_repeats(docs.repartition(5), bits=2, hot=0, level=16), *cols)) == want


def test_stored_family(spark, tmp_path):
    """Batches that come one after the other, against all texts at once; a family opened anew goes on."""
    r, before, path = random.Random(8), [], f"file://{tmp_path}/family"
    names = []
    for k in range(5):
        texts = [(i, b.decode("latin-1").encode()) for i, b in enumerate(repeated(r, (20, 6, 6, 3, 0)[k]))]
        df = spark.createDataFrame([(i, b.decode()) for i, b in texts], "doc_id long, text string").repartition(2)
        family = suffix_dedup.StoredFamily(spark, path, length=50, bits=2)
        assert [n for n, _ in family.levels] == names
        got = dict(rows(family.add(df), "doc_id", "kept"))
        for (i, b), windows in zip(texts, removed_windows(texts, 50, before)):
            gone = {t + j for t in windows for j in range(50)}
            assert bytes(got[i]) == bytes(c for j, c in enumerate(b) if j not in gone)
        before += [b for _, b in texts]
        names = [n for n, _ in family.levels]
        sizes = [n for _, n in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len(names) < 5


def test_other_batches_are_an_error():
    rows_ = [{"part": -1, "batch": 3, "sum": 5, "head": b""}, {"part": 2, "batch": 3, "sum": 6}]
    table = pa.RecordBatch.from_pylist(rows_, pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("sum", pa.int64()), ("head", pa.binary())]))
    with pytest.raises(RuntimeError, match="other rows"):
        list(suffix_dedup._Job.by_batch(iter([table])))


def test_more_ranges_than_tasks(spark, docs, monkeypatch):
    """Tasks that work off several ranges or buckets give what single ones give."""
    from rasterloom.llm import common

    few = docs.select("doc_id", "text").where("length(text) < 1000").where("doc_id < 25 OR doc_id IS NULL")

    def results():
        deduped = suffix_dedup.remove_repeats(few, bits=4)
        linked = jaccard.components(few)
        dealt = sharding.shuffle_into_shards(few, n_shards=5, n_buckets=12)
        return [Counter(map(str, df.drop("kept").collect())) for df in (deduped, linked, dealt)]

    one_each = results()
    monkeypatch.setattr(common, "MOST_TASKS", 2)
    assert common.tasks_for(spark, 16) == 4 and results() == one_each
