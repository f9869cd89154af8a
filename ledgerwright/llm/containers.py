"""Filling containers of fixed capacity with texts, sizes in tokens of a public tokenizer.

Method: optimal length buckets. A dynamic program over the global histogram of lengths (at most `capacity` numbers,
whatever the corpus) chooses the bucket boundaries with the least padding. Batches within single buckets can't reach
little unused space, however (a bucket of 1,200 tokens fills a container of 2,048 to 59 %), so the token budget is spent
over the buckets: recipes, multisets of buckets, are drawn up greedily on the bucket counts until every item is placed.
Items get dense numbers within their bucket from salted counts and find their container by interval; no global sort,
no text leaves the task that tokenises it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.runtime import broadcast_if_small, cut

CAPACITY, BUCKETS = 2_048, 256
#: Items per salt when they are numbered: no task numbers a whole bucket of a large corpus.
PER_SALT = 500_000


@lru_cache(4)
def encoding(ranks: str | None = None, pattern: str | None = None):
    """A byte-level tokenizer from a file of ranks; by default the 50k one of the public collection."""
    import tiktoken

    if ranks is None or pattern is None:
        import public_tokenizers as public

        ranks, pattern = ranks or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), pattern


def divide(text: str, capacity: int, ranks: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of a text: one piece if it fits, else as many full pieces as it takes, cut between words.

    A word longer than a container is cut hard, by characters.
    """
    enc, pattern = encoding(ranks)
    n = len(enc.encode_ordinary(text))
    if n <= capacity:
        return [(0, len(text), n)]
    import regex

    units: list[str] = []
    for word in regex.findall(pattern, text):
        if len(word.encode()) > capacity and len(enc.encode_ordinary(word)) > capacity:
            units += [word[i : i + capacity // 4] for i in range(0, len(word), capacity // 4)]
        else:
            units.append(word)
    out, start, at, used = [], 0, 0, 0
    for unit in units:
        size = len(enc.encode_ordinary(unit))
        if used and used + size > capacity:
            out.append((start, at, used))
            start, used = at, 0
        at += len(unit)
        used += size
    out.append((start, at, used))
    # tokens may join differently once a piece stands alone: count it as it stands, and halve what no longer fits
    checked: list[tuple[int, int, int]] = []
    todo = out[::-1]
    while todo:
        a, b, _ = todo.pop()
        size = len(enc.encode_ordinary(text[a:b]))
        if size > capacity and b - a > 1:
            todo += [((a + b) // 2, b, 0), (a, (a + b) // 2, 0)]
        else:
            checked.append((a, b, size))
    return checked


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` length classes with the least total padding to them, by dynamic programming."""
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes], np.float64)
    n = len(sizes)
    if n <= buckets:
        return sizes.tolist()
    c, s = np.r_[0, counts.cumsum()], np.r_[0, (counts * sizes).cumsum()]
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((buckets, n + 1), np.int64)
    for k in range(buckets):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + sizes[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(cost.argmin())
            new[j], back[k, j] = cost[i], i
        new[0] = 0
        best = new
    bounds, j = [], n
    for k in range(buckets - 1, -1, -1):
        if j == 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(back[k, j])
    return bounds[::-1]


def recipes(bounds: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(items per bucket of a container, number of such containers) until every item is placed; each entry uses a bucket up or nearly so."""
    left = dict(enumerate(counts))
    out = []
    while any(left.values()):
        room, take = capacity, {}
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                take[b] = min(room // max(bounds[b], 1), left[b])
                room -= take[b] * bounds[b]
        times = min(left[b] // m for b, m in take.items())
        for b, m in take.items():
            left[b] -= m * times
        out.append((take, times))
    return out


def _items(df: DataFrame, text: str, key: str, capacity: int, ranks: str | None) -> DataFrame:
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in batch.itertuples(index=False, name=None):
                if not t:
                    rows.append((k, 1, 0, 0, 0))
                else:
                    rows += [(k, i, a, b, n) for i, (a, b, n) in enumerate(divide(t, capacity, ranks), 1)]
            yield pd.DataFrame(rows, columns=["k", "piece", "start_at", "end_at", "n_tokens"])

    return src.mapInPandas(measure, f"k {kind}, piece int, start_at int, end_at int, n_tokens int")


def packed(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, buckets: int = BUCKETS, ranks: str | None = None) -> DataFrame:
    """key, piece, start_at, end_at, n_tokens, container: every text, or piece of one longer than a container, in one container.

    start_at and end_at count code points; pieces of a text cover it without gap or overlap. Null and empty texts have no
    tokens and a null container. Repeated rows are placed each; extra columns are ignored, whatever their names.
    """
    if capacity < 8:
        raise ValueError("a container holds at least 8 tokens")
    spark = df.sparkSession
    items = cut(_items(df, text, key, capacity, ranks))  # used three times below: texts are tokenised once
    histogram = {r.n_tokens: r.n for r in items.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return items.select(F.col("k").alias(key), "piece", "start_at", "end_at", "n_tokens", F.lit(None).cast("bigint").alias("container"))
    bounds = bucket_bounds(histogram, buckets)
    of = {size: int(np.searchsorted(bounds, size)) for size in histogram}
    counts = [0] * len(bounds)
    for size, n in histogram.items():
        counts[of[size]] += n
    spans, next_id, used = [], 0, [0] * len(bounds)
    for take, times in recipes(bounds, counts, capacity):
        for b, m in take.items():
            spans.append((b, used[b], used[b] + m * times, m, next_id))
            used[b] += m * times
        next_id += times
    bucket_of = spark.createDataFrame(list(of.items()), "n_tokens int, bucket int")
    span_of = spark.createDataFrame(spans, "bucket int, lo long, hi long, m long, base long")
    salts = max(1, -(-sum(histogram.values()) // PER_SALT))
    salt = F.pmod(F.xxhash64("k", "piece"), F.lit(salts))
    placed = items.join(F.broadcast(bucket_of), "n_tokens").withColumn("salt", salt)
    sizes = placed.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("bucket").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).select("bucket", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("bucket", "salt").orderBy("k", "piece")) - 1
    placed = placed.withColumn("number", number).join(broadcast_if_small(before, 100_000), ["bucket", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    placed = placed.join(F.broadcast(span_of), "bucket").where("number >= lo AND number < hi")
    placed = placed.select("k", "piece", "start_at", "end_at", "n_tokens", (F.col("base") + F.floor((F.col("number") - F.col("lo")) / F.col("m"))).alias("container"))
    empty = items.where("n_tokens = 0").withColumn("container", F.lit(None).cast("bigint"))
    return placed.unionByName(empty).withColumnRenamed("k", key)


def fill(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, unused: how many containers there are, and the share of their room that is unused."""
    per = containers.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(1 - F.sum("n") / (F.count("*") * capacity), 6).alias("unused"))
