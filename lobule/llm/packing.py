"""Filling containers of fixed capacity with documents by best-two-fit.

Lengths are counted in tokens; documents are spread by hash over shards of bounded size, and each shard packs its own containers, so
nothing is serial and only a shard's last containers can stay half empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobule.shared import groups, slots, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into words before byte-pair merging, as published with this vocabulary.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD = 32_768  # documents in a shard, about


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of each document; a null text has null tokens, an empty one 0. Special tokens in a text are ordinary text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [None if x is None else len(encode(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    texts = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return texts.mapInArrow(count, "id long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (1 <= size <= capacity).

    A container is filled greedily with the largest items that fit. If a gap stays, its smallest item is replaced by the two unpacked
    items that together fit the widened gap best, if they fill more than it did; this repeats until no pair is better.
    """
    place = np.empty(len(sizes), np.int64)
    stock: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        stock.setdefault(int(sizes[i]), []).append(i)
    left = np.bincount(sizes, minlength=capacity + 1)
    there = 0  # bit s: an item of size s is left
    for s in stock:
        there |= 1 << s

    def largest(upto: int) -> int:
        return (there & ((1 << (upto + 1)) - 1)).bit_length() - 1

    def take(s: int) -> int:
        nonlocal there
        i = stock[s].pop()
        left[s] -= 1
        if not stock[s]:
            there ^= 1 << s
        return i

    def give(i: int) -> None:
        nonlocal there
        s = int(sizes[i])
        stock[s].append(i)
        left[s] += 1
        there |= 1 << s

    number = 0
    while there:
        held, gap = [], capacity
        while (s := largest(gap)) > 0:
            held.append(take(s))
            gap -= s
        while gap and len(held) > 1 and there:
            small = min(held, key=lambda i: (sizes[i], i))
            room, best, pair = gap + int(sizes[small]), int(sizes[small]), None
            have = np.where(left[:room] > 0, np.arange(room), 0)  # sizes below room that are left
            below = np.maximum.accumulate(have)  # the largest of them up to each size
            a = np.flatnonzero(have)
            b = below[room - a]
            b = np.where((b == a) & (left[a] < 2), below[a - 1], b)
            both = np.where(b > 0, a + b, 0)
            if len(both) and both.max() > best:
                at = both.argmax()
                best, pair = int(both[at]), (int(a[at]), int(b[at]))
            if pair is None:
                break
            held.remove(small)
            held += [take(pair[0]), take(pair[1])]
            give(small)
            gap = room - best
        place[held] = number
        number += 1
    return place


def pack_documents(documents: DataFrame, id_column: str, text_column: str, capacity: int = 2048, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(id, piece, first_token, n_tokens, container): every document's place.

    A document longer than `capacity` is cut into full containers and a rest, which is packed like any other; no other document is
    cut. Empty documents are one piece of no tokens in some container of their shard; null texts are pieces with null tokens and a null
    container. container: "<shard>-<number>". Repeated ids are packed each on their own. Other columns are ignored.
    """
    counts = stage(token_counts(documents, id_column, text_column, vocabulary), "tokens")
    shards = max(1, -(-counts.count() // shard))
    rest = F.pmod("n_tokens", F.lit(capacity))
    full = F.floor(F.col("n_tokens") / capacity)
    pieces = counts.where("n_tokens is not null").withColumn("last", F.when((rest > 0) | (F.col("n_tokens") == 0), full).otherwise(full - 1))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("first_token", F.col("piece") * capacity)
    pieces = pieces.select("id", F.col("piece").cast("int").alias("piece"), "first_token", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("first_token")).alias("n_tokens"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), t in groups(batches, ["shard"]):
            sizes = t.column("n_tokens").to_numpy()
            place = np.zeros(len(sizes), np.int64)
            some = np.flatnonzero(sizes > 0)
            place[some] = best_two_fit(sizes[some], capacity)
            names = pa.array([f"{key}-{p}" for p in place.tolist()])
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("id", "piece", "first_token", "n_tokens")), names], ["id", "piece", "first_token", "n_tokens", "container"])

    sorted_pieces = pieces.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "id", "piece")
    packed = sorted_pieces.mapInArrow(fill, "id long, piece int, first_token long, n_tokens long, container string")
    nothing = counts.where("n_tokens is null").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens", F.lit(None).cast("string").alias("container"))
    return packed.unionByName(nothing)
