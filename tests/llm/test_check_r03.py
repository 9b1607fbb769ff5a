"""What the check tool's report of round 3 names: CPU of op1_sentencepiece, memory of the pipeline."""

import hashlib
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import sentencepiece_codec, suffix_dedup
from rasterloom.llm.piece_model import UNIGRAM, PieceModel

MODEL = sentencepiece_codec.read_model(sentencepiece_codec.MODEL)


def made_words(n, longest=40, letters="abcdetionshé漢🙂ß.,0<"):
    r = random.Random(11)
    return sorted({"▁" * r.randint(0, 1) + "".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)})


def test_words_side_by_side_equal_words_on_the_stack():
    words = made_words(3000)
    for kind, scored in ((None, True), (UNIGRAM, False)):
        enc = sentencepiece_codec.Encoder(PieceModel(MODEL, kind), PieceModel(MODEL, UNIGRAM, double=True) if scored else None)
        for a, b in zip(enc.side_by_side(words), enc.one_by_one(words)):
            assert a.dtype == b.dtype and np.array_equal(a, b)


def test_words_of_all_lengths_keep_their_ids():
    r = random.Random(12)
    texts = [" ".join(r.choice("aeiont") * r.choice((1, 3, 95, 96, 97, 300)) + r.choice(("", "é", "漢")) for _ in range(6)) for _ in range(60)]
    m = PieceModel(MODEL)
    enc = sentencepiece_codec.Encoder(m)
    for _ in range(2):  # the second time with words that were kept
        ids, at = enc.encode(texts)
        for i, t in enumerate(texts):
            alone = sentencepiece_codec.Encoder(m).one_by_one(m.units(m.normalise(t)))[0]
            assert ids[at[i] : at[i + 1]].tolist() == alone.tolist()


def test_learning_words_takes_no_step_of_python_for_each_letter():
    words, lines = made_words(4000, 12, "etaoinshr"), 0
    enc = sentencepiece_codec.Encoder(PieceModel(MODEL), PieceModel(MODEL, UNIGRAM, double=True))

    def traced(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return traced if frame.f_code.co_filename == sentencepiece_codec.__file__ else None

    before = sys.gettrace()
    sys.settrace(traced)
    try:
        enc.learn(words)
    finally:
        sys.settrace(before)
    assert lines < sum(map(len, words)), lines


def peak_mb(f):
    """What f gives, and the MB that numpy and Python held meanwhile at most."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def batch():
    """As many bytes as a batch of suffix_dedup has, in documents of all sizes, also empty ones."""
    r = np.random.default_rng(3)
    data = r.integers(97, 101, suffix_dedup.BATCH, dtype=np.uint8)
    cuts = np.sort(r.integers(0, len(data), 2000))
    return data, np.concatenate([[0, 0], cuts, [len(data), len(data)]])


def test_anchors_take_little_memory_and_stay_within_documents(batch):
    data, offsets = batch
    (place, first, last, doc), mb = peak_mb(lambda: suffix_dedup.anchors(data, offsets, 50))
    assert mb < 64
    windows = np.zeros(len(data) + 1, np.int64)
    np.add.at(windows, first, 1), np.add.at(windows, last + 1, -1)
    inside = [np.arange(b, e - 49) for b, e in zip(offsets, offsets[1:]) if e - b >= 50]
    want = np.zeros(len(data), np.int64)
    want[np.concatenate(inside)] = 1  # every window of every document, and no other
    assert np.array_equal(np.cumsum(windows[:-1]), want)
    assert (offsets[doc] <= first).all() and (last + 50 <= offsets[doc + 1]).all() and (last <= place).all()


def test_strings_are_put_together_in_little_memory(batch):
    data, _ = batch
    size = np.full(1 << 16, 60)
    begin = np.random.default_rng(4).permutation((len(data) - 60) // 60)[: 1 << 16] * 60
    got, mb = peak_mb(lambda: suffix_dedup._gathered(data, begin, size))
    assert mb < 24 and np.array_equal(got.reshape(-1, 60), data[begin[:, None] + np.arange(60)])


def test_removed_bytes_take_little_memory(batch):
    data, offsets = batch
    text = data.tobytes().decode()
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(offsets) - 1), pa.int64()), pa.array([text[i:j] for i, j in zip(offsets, offsets[1:])])], ["doc_id", "text"])
    r = random.Random(5)
    spans = [(b, b + r.randint(50, min(400, e - b))) for b, e in ((r.randint(i, j - 50), j) for i, j in zip(offsets, offsets[1:]) if j - i >= 50)]
    job = suffix_dedup._Job(50, 6, 0, 1, None, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])
    rows = [suffix_dedup._row(part=-1, batch=0, sum=0, head=suffix_dedup._head(docs)), suffix_dedup._row(part=suffix_dedup.SPANS, batch=0, sum=0, at=np.array(spans, np.int64).tobytes())]
    got, mb = peak_mb(lambda: [x for b in job.finish(iter(rows)) for x in b.to_pylist()])
    assert mb < 72
    of = dict.fromkeys(range(len(docs)), ())
    for b, e in spans:
        of[int(np.searchsorted(offsets, b, "right")) - 1] = (b, e)
    for x in got:
        i, j = offsets[x["doc_id"]], offsets[x["doc_id"] + 1]
        b, e = of[x["doc_id"]] or (j, j)
        assert (x["n_bytes"], x["n_removed"], x["n_spans"]) == (j - i, e - b, int(e > b))
        assert x["spans"] == [[b - i, e - i]][: int(e > b)] and x["kept_sha256"] == hashlib.sha256((text[i:b] + text[e:j]).encode()).hexdigest()
