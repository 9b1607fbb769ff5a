"""Sharding by a two-pass external shuffle.

Pass one scatters rows into memory-sized buckets by a seeded hash (one Spark shuffle by bucket).
Pass two loads one bucket at a time, puts it in an order that depends on its rows alone, and
applies a seeded Fisher-Yates permutation (numpy's Generator.permutation). The permuted buckets, laid end to end,
are one random order of the whole table; it is cut into shards whose row counts differ by one at most.

A lost task is safe to repeat: bucket, base order and permutation depend only on the rows and the seed.
Rows that are equal in every column are interchangeable. Null ids and texts are hashed and sorted as values
of their own (null first); an empty table gives an empty result. Input columns named like an output
column (shard, slot) are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import bounded_batches, fresh_path, input_bytes, lean, tasks_for

OUT = ("shard", "slot")


def bucket_count(docs: DataFrame, bucket_bytes: int, expansion: int = 4) -> int:
    """Buckets of about bucket_bytes; columnar files are taken to grow by ``expansion`` in memory."""
    n = input_bytes(docs)
    if n is None:
        n = sum(docs.agg(*[F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) for c in docs.columns]).first())
        expansion = 1
    return max(1, math.ceil(n * expansion / bucket_bytes))


def _key(f: T.StructField) -> Column:
    """A column by which rows can be hashed and sorted: maps, which can't, as text."""
    return F.to_json(F.struct(F.col(f.name))) if "map<" in f.dataType.simpleString() else F.col(f.name)


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, seed: int = 20240501, bucket_bytes: int = 32 << 20, n_buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write docs in random order as ``path``/shard=N/ and return them with shard and slot.

    Shard counts differ by one row at most; slots of a shard count from 0 without gaps.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*[c for c in docs.columns if c not in OUT])
    n_buckets = n_buckets or bucket_count(docs, bucket_bytes)
    keys = [_key(f) for f in docs.schema.fields]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_buckets)).cast("int")
    scattered = docs.withColumn("__bucket", bucket)
    # one count for each bucket: bounded by input size / bucket size
    counts = np.zeros(n_buckets, np.int64)
    for b, n in scattered.groupBy("__bucket").count().toLocalIterator():
        counts[b] = n
    base = np.concatenate([[0], np.cumsum(counts)])
    held = spark.sparkContext.broadcast(base)  # 8 bytes a bucket
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total = held.value, int(held.value[-1])
        edges = -(-np.arange(n_shards + 1) * total // n_shards)  # first position of each shard

        def full(b: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            order = np.random.Generator(np.random.PCG64([seed, b])).permutation(len(rows))
            at = base[b] + np.arange(len(rows))
            shard = np.searchsorted(edges, at, "right") - 1
            for i in range(0, len(rows), 2000):
                part = rows.take(pa.array(order[i : i + 2000])).drop_columns(["__bucket"])
                part = part.append_column("slot", pa.array(at[i : i + 2000] - edges[shard[i : i + 2000]])).append_column("shard", pa.array(shard[i : i + 2000].astype(np.int32)))
                yield from part.combine_chunks().to_batches()

        now, parts = -1, []
        for batch in batches:
            ids = batch.column("__bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                if int(ids[i]) != now and parts:
                    yield from full(now, parts)
                    parts = []
                now = int(ids[i])
                parts.append(batch.slice(i, j - i))
        if parts:
            yield from full(now, parts)

    path = path or fresh_path(spark, "shards")
    (
        scattered.repartition(tasks_for(spark, n_buckets), "__bucket")
        .sortWithinPartitions("__bucket", *keys)
        .mapInArrow(lean(permute), schema)
        .write.partitionBy("shard").parquet(path)
    )
    return spark.read.schema(schema).parquet(path)
