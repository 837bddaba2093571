"""Importance resampling of documents towards a target text, by hashed word n-grams.

A feature is a run of one to three words; its bucket is its CRC-32 modulo a number. A bucket's gain is the log ratio of its share in the target
and in the documents, a document's weight the sum over its features, and the documents with the highest weight plus Gumbel noise, drawn
from a hash of the id, are a sample without replacement in proportion to the weights.

Method: a head of frequent words with their exact checksum states, and of frequent pairs with their states and buckets, is broadcast. A word
occurs in the head or its checksum is taken directly from its bytes; a pair likewise, by moving the state of its first word over its second;
a run of three moves the state of its first two. Head and tail give the same buckets, so the head changes the time and nothing else. Totals
of the buckets are exact sums over all documents.

The head: blocks of text report the words and pairs that make up ``HEAD_SHARE`` of their own words. What makes up that share of all words is
reported by at least one block, and only what reaches it by the reported numbers is taken, which bounds the head by 1 / HEAD_SHARE words
and as many pairs at any size of the corpus.

Words are told apart within a slice, and from those of the head, by 64-bit hashes.

Defined results: null texts have no words and weigh 0, as do empty ones; rows of the same id are separate documents with the same noise and
are drawn in any order among equal scores; rows without an id count in the totals, have no score and are not drawn; with an empty target or
an empty table all gains follow from the smoothing alone; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.crc import joined
from tallyflow.llm.kernels import U, Words, slices
from tallyflow.llm.ranks import ranked
from tallyflow.llm.rendezvous import bound_batches, shared_folder

BUCKETS = 10_000
RUN = 3  # words of the longest feature
HEAD_SHARE = 2.0**-14
BLOCK_BYTES = 2 << 20
MIN_WORDS, PERCENT, SEED = 20, 5, "42"

#: Bytes that belong to no word once A-Z are lower-cased: ASCII but for digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


@dataclass
class Head:
    """Frequent words by hash, with checksums alone and behind a space; frequent pairs by the words' numbers, with states and buckets."""

    hashes: np.ndarray
    crcs: np.ndarray
    spaced: np.ndarray
    pairs: np.ndarray
    pair_crcs: np.ndarray
    pair_buckets: np.ndarray

    @staticmethod
    def of(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int = BUCKETS) -> Head:
        hashes = _hashes(words)
        order = np.argsort(hashes)
        words = [words[i] for i in order]
        number = {w: i for i, w in enumerate(words)}
        own = sorted((number[a] * len(words) + number[b], zlib.crc32(a + b" " + b)) for a, b in pairs if a in number and b in number)
        keys, crcs = np.array([k for k, _ in own], np.int64), np.array([c for _, c in own], np.uint32)
        alone, spaced = (np.array([zlib.crc32(lead + w) for w in words], np.uint32) for lead in (b"", b" "))
        return Head(hashes[order], alone, spaced, keys, crcs, (crcs % buckets).astype(np.int64))


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words as a slice that holds them gives them."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return Words(data, np.array([0, len(data)]), between=BETWEEN).hashes() if words else np.zeros(0, U)


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among others, -1 where there are none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Features:
    """The buckets of all features of a slice of documents, one array for each number of words, in order of their first word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, head: Head, buckets: int = BUCKETS) -> None:
        words = Words(buf, offsets, lower=True, between=BETWEEN)
        self.words = words
        self.n_words = np.diff(words.first)
        hashes, pick, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = _place(head.hashes, hashes)
        known = np.flatnonzero(place >= 0)
        alone, spaced = np.zeros(len(hashes), np.uint32), np.zeros(len(hashes), np.uint32)
        alone[known], spaced[known] = head.crcs[place[known]], head.spaced[place[known]]
        data, tail = words.buf.tobytes(), np.flatnonzero(place < 0)
        for i, s, e in zip(tail.tolist(), words.start[pick[tail]].tolist(), words.end[pick[tail]].tolist(), strict=True):
            word = data[s:e]
            alone[i], spaced[i] = zlib.crc32(word), zlib.crc32(b" " + word)
        size = words.end - words.start + 1  # with the space before it
        state, behind, number = alone[which], spaced[which], place[which]

        self.first = [np.arange(len(words))]  # places of the first words of the features of each length
        self.buckets = [state % buckets]
        at = np.flatnonzero(words.one_document(2)) if len(words) > 1 else np.zeros(0, np.int64)
        pair = _place(head.pairs, np.where((number[at] >= 0) & (number[at + 1] >= 0), number[at] * len(head.hashes) + number[at + 1], -1))
        frequent, rest = np.flatnonzero(pair >= 0), np.flatnonzero(pair < 0)
        two, bucket = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
        two[frequent], bucket[frequent] = head.pair_crcs[pair[frequent]], head.pair_buckets[pair[frequent]]
        two[rest] = joined(state[at[rest]], behind[at[rest] + 1], size[at[rest] + 1])
        bucket[rest] = two[rest] % buckets
        self.first.append(at)
        self.buckets.append(bucket)
        inner = at + 2 < len(words)
        inner[inner] = words.doc[at[inner]] == words.doc[at[inner] + 2]
        at, two = at[inner], two[inner]
        self.first.append(at)
        self.buckets.append(joined(two, behind[at + 2], size[at + 2]) % buckets)

    def totals(self, buckets: int = BUCKETS) -> np.ndarray:
        return sum(np.bincount(b, minlength=buckets) for b in self.buckets)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Sum of gains by document."""
        by_word = np.zeros(len(self.words) + 1, np.int64)
        for first, bucket in zip(self.first, self.buckets, strict=True):
            by_word[first + 1] += gains[bucket]
        sums = np.cumsum(by_word)
        return sums[self.words.first[1:]] - sums[self.words.first[:-1]]

    def n_features(self) -> np.ndarray:
        return sum(np.maximum(self.n_words - k, 0) for k in range(RUN))


def _frequent(share: float):
    """(feature, n) of the words and pairs of every block that reach the share, and the block's number of words with the empty feature."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("text"), BLOCK_BYTES):
                words = Words(buf, offsets, lower=True, between=BETWEEN)
                if not len(words):
                    continue
                least = max(1, math.ceil(share * len(words)))
                data, out = words.buf.tobytes(), {b"": len(words)}
                hashes = words.hashes()
                _, pick, n = np.unique(hashes, return_index=True, return_counts=True)
                for i, k in zip(pick[n >= least].tolist(), n[n >= least].tolist(), strict=True):
                    out[data[words.start[i] : words.end[i]]] = k
                if len(words) > 1:
                    at = np.flatnonzero(words.one_document(2))
                    _, pick, n = np.unique(words.ranges().windows(2)[at], return_index=True, return_counts=True)
                    for i, k in zip(at[pick[n >= least]].tolist(), n[n >= least].tolist(), strict=True):
                        out[data[words.start[i] : words.end[i]] + b" " + data[words.start[i + 1] : words.end[i + 1]]] = k
                yield pa.record_batch([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], names=["feature", "n"])

    return report


def head_of(texts: DataFrame, share: float = HEAD_SHARE, buckets: int = BUCKETS) -> Head:
    """The head of a table of ``text``: at most 2 / share features reach the share, and no others come to the driver."""
    shared_folder(texts.sparkSession)
    counts = texts.mapInArrow(_frequent(share), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")).checkpoint()
    total = counts.where(F.length("feature") == 0).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = counts.where((F.length("feature") > 0) & (F.col("n") >= share * total)).collect()
    features = sorted(bytes(r["feature"]) for r in rows)
    pairs = [tuple(f.split(b" ")) for f in features if b" " in f]
    return Head.of([f for f in features if b" " not in f], pairs, buckets)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def bucket_totals(texts: DataFrame, head, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. ``head`` is broadcast; every task sends its own totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("text")):
                sums += Features(buf, offsets, head.value, buckets).totals(buckets)
        held = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array(sums[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for every bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, head, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    given = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("text")):
                f = Features(buf, offsets, head.value, len(given.value))
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.record_batch([ids, pa.array(f.n_words), pa.array(f.n_features()), pa.array(f.weights(given.value))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: str = SEED, head_share: float = HEAD_SHARE, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` numbers the ``percent`` drawn of those with at
    least ``min_words`` words and is null for all others."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared_folder(spark)
    head = spark.sparkContext.broadcast(head_of(_texts(docs, text_col), head_share, buckets))
    gains = gains_of(bucket_totals(_texts(docs, text_col), head, buckets), bucket_totals(_texts(target, target_col), head, buckets))
    weighed = weigh(docs, gains, head, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).checkpoint()  # texts are read once
    may = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    placed = ranked(weighed.withColumn("_may", F.when(may, "1").otherwise("0")), "_may", [F.desc("score"), F.col("doc_id")], "_place", "_size", weighed.count())
    drawn = (F.col("_may") == "1") & (F.col("_place") < F.floor(F.col("_size") * percent / 100))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("_place") + 1).alias("rank"))
