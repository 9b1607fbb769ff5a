"""Language identification by multilingual mixture inference.

A language's model is a smoothed distribution of hashed byte trigrams of lower-cased words (with their borders), counted over
all training texts. A document is a mixture: each word is drawn from one language. Expectation-maximisation estimates the
proportions; starting from all languages, the least one is taken away again and again, and the set with the best
log-likelihood less ``penalty`` * languages * log(words) / 2 is kept. The answer is the largest proportion of that set.

The model is broadcast: languages x BUCKETS x 4 bytes, at most MODEL_BYTES (else an error).

Defined results: a null text or one without letters is ``und`` with score 0, as is every text if no language is learned.
Training skips null languages and texts. Ties go to the language first in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, chunks, lean, text_bytes, words

BITS = 15
BUCKETS = 1 << BITS
MODEL_BYTES = 256 << 20
#: Text bytes worked on at once.
CHUNK = 1 << 20
SMOOTH = 0.5

_SPACE = np.full(256, 32, np.uint8)
_SPACE[97:123] = np.arange(97, 123)
_SPACE[128:] = np.arange(128, 256)
_LETTER = _SPACE != 32


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.string()))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte, word starts and ends, and each row's first word. Other bytes count as spaces."""
    start, end, first = words(data, offsets, _LETTER)
    wide = np.full(len(data) + 2, 32, np.uint32)
    wide[1:-1] = _SPACE[data]
    key = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    key[edge] = (np.uint32(32) << np.uint32(16)) | (key[edge] & np.uint32(0xFFFF))  # rows don't touch
    key[edge - 1] = (key[edge - 1] & np.uint32(0xFFFF00)) | np.uint32(32)
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32), start, end, first


def count_ngrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows with text and language; counted in each partition before the shuffle."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            col = lowered(batch.column(1))
            coded = batch.column(0).dictionary_encode()
            langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            data, offsets = text_bytes(col)
            for i, j in chunks(np.diff(offsets), CHUNK):
                part, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                bucket, start, end, first = trigrams(part, o)
                inside = _LETTER[part]
                own = np.repeat(lang[i:j], np.diff(o))[inside].astype(np.int64) * BUCKETS + bucket[inside]
                n = np.bincount(own, minlength=len(langs) * BUCKETS).reshape(-1, BUCKETS)
                for k in np.flatnonzero(n.any(1)):
                    total[langs[k]] = total.get(langs[k], 0) + n[k]
        for k, n in total.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b].astype(np.int64))], ["lang", "bucket", "n"])

    return rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in sorted order, and log probabilities (languages x BUCKETS)."""
    counted = count_ngrams(docs, lang_col, text_col).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("of"))
    langs, rows = [], []
    for lang, of in sorted(counted.toLocalIterator()):  # BUCKETS entries a language
        if (len(rows) + 1) * BUCKETS * 4 > MODEL_BYTES:
            raise ValueError("too many languages for the broadcast model")
        n = np.full(BUCKETS, SMOOTH)
        n[[b for b, _ in of]] += [c for _, c in of]
        langs.append(lang)
        rows.append(np.log(n / n.sum()).astype(np.float32))
    return langs, np.array(rows, np.float32).reshape(-1, BUCKETS)


def mixture(like: np.ndarray, first: np.ndarray, rounds: int = 12, penalty: float = 8.0) -> np.ndarray:
    """Proportions (documents x languages) of the chosen language sets; like: log-likelihood of each word (words x languages).

    ``first``: the first word of each document (n + 1). A document without words gets zeros.
    """
    n_docs, n_langs = len(first) - 1, like.shape[1]
    size = np.diff(first)
    some = np.flatnonzero(size)
    out = np.zeros((n_docs, n_langs))
    if not len(some) or not n_langs:
        return out
    top = like.max(1)
    p = np.exp(like - top[:, None])
    doc, begin = np.repeat(np.arange(len(some)), size[some]), first[some]
    n = size[some].astype(float)
    top_sum = np.add.reduceat(top.astype(float), begin)
    pi = np.full((len(some), n_langs), 1.0 / n_langs)
    best, chosen = np.full(len(some), -np.inf), pi.copy()
    for left in range(n_langs, 0, -1):
        for _ in range(rounds if left > 1 else 1):
            joint = p * pi[doc]
            total = joint.sum(1) + 1e-300
            pi = np.add.reduceat(joint / total[:, None], begin, axis=0) / n[:, None]
        like_now = top_sum + np.add.reduceat(np.log((p * pi[doc]).sum(1) + 1e-300), begin)
        score = like_now - penalty * left * np.log(n + 1) / 2
        better = score > best
        best[better], chosen[better] = score[better], pi[better]
        if left > 1:  # without the least language
            masked = np.where(pi > 0, pi, np.inf)
            pi = pi.copy()
            pi[np.arange(len(some)), masked.argmin(1)] = 0
            empty = pi.sum(1) <= 0
            pi[empty] = chosen[empty]
            pi /= pi.sum(1, keepdims=True)
    out[some] = chosen
    return out


ADDED = (T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.MapType(T.StringType(), T.DoubleType())))


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """docs with the main language, its proportion, and all languages of the chosen set with theirs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*[c for c in docs.columns if c not in {f.name for f in ADDED}])
    schema = T.StructType([*docs.schema.fields, *ADDED])
    at, held = docs.columns.index(text_col), spark.sparkContext.broadcast((langs, np.ascontiguousarray(model.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, by_bucket = held.value
        for batch in batches:
            col = batch.column(at)
            data, offsets = text_bytes(lowered(col))
            parts = []
            for i, j in chunks(np.diff(offsets), CHUNK):
                bucket, start, end, first = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not langs:
                    parts.append(np.zeros((j - i, 0)))
                    continue
                if not len(start):
                    parts.append(np.zeros((j - i, len(langs))))
                    continue
                edges = np.stack([start, end], 1).ravel()
                last = edges[-1] == len(bucket)
                like = np.add.reduceat(by_bucket[bucket], edges[:-1] if last else edges, axis=0)[::2]
                parts.append(mixture(like, first, penalty=penalty))
            pi = np.concatenate(parts) if parts else np.zeros((0, len(langs)))
            texts = col.to_pylist()
            found, score, sets = [], [], []
            for k, t in enumerate(texts):
                x = pi[k]
                if t is None or not x.any() or not any(map(str.isalpha, t)):
                    found.append("und"), score.append(0.0), sets.append([])
                    continue
                b = int(x.argmax())
                found.append(langs[b]), score.append(min(1.0, float(x[b]))), sets.append([(langs[l], float(x[l])) for l in np.flatnonzero(x)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
