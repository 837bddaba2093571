"""Toxicity scores from a learned lexicon, misspellings and context.

Learning, from at most ``SAMPLE`` labelled documents of the training folds (half of each label, chosen by a hash; one of each group of
copies and, with few exceptions, near copies): every word, and every beginning of 4 to 8 letters that several words share, whose share of toxic documents stands out
becomes a term or a stem; there are no more of them than the sample has words. Words that look like a misspelled term but occur in clean documents are kept
as innocent. A document's hits are then summed into a few features, and a ridge logistic regression on these gives the score. For the
regression each half of the sample is scored with the lexicon of the other half, so that it learns how far terms carry over.

Scoring, over all documents whole: each distinct word of a task is looked up once, exactly, by stem, or by its Levenshtein automaton on the
trie of terms (``lexicon``); the automaton runs for words whose deletion neighbourhood meets a term's, which is tested for all of them at once. Around every hit a window of ``WINDOW`` words to each side is read: a hit between quotation marks, or
next to a word that reports speech, counts as quoted and goes into features of its own.

Defined results: null and empty texts have no hits and get the score of a document without any; labels other than 0 and 1 are not used;
a document with several labels is toxic if one says so; without documents of both labels nothing is learned and all
scores are the smoothed share of toxic labels; rows without an id are scored too; a column of the results' name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tallyflow.llm.kernels import U, Words, mix, slices
from tallyflow.llm.lexicon import Lexicon
from tallyflow.llm.minhash_dedup import shingle_sets
from tallyflow.llm.rendezvous import bound_batches

SAMPLE = 20_000
MIN_Z, MIN_ODDS = 3.0, 2.0  # log odds of a term, as a multiple of their error and as they are
STEM_LETTERS = (4, 8)
WINDOW = 8
FOLDS = 5
_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„‟«»‹›]|(?<!\\w)['‘’]|['‘’](?!\\w)")
_REPORTS = frozenset("said says called calls quote quoted quotes word words term wrote insult sagte nannte zitat wort dit appelle citation mot dijo llama cita palabra".split())
_CACHE = 1 << 21
HIT = StructType([StructField("term", StringType()), StructField("word", StringType()), StructField("place", IntegerType()), StructField("edits", IntegerType()), StructField("quoted", BooleanType())])
_HIT = pa.struct([("term", pa.string()), ("word", pa.string()), ("place", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_())])


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@dataclass
class Hit:
    term: str
    word: str
    place: int
    edits: int
    quoted: bool
    weight: float


class Reader:
    """Finds the hits of documents. Tokens are looked up once: hashes of those without hits are kept in one array, up to a bounded
    number, and the hits of the others, which are few, by hash."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.clean = np.zeros(0, U)
        self.hits: dict[int, list[tuple[str, tuple[str, float, int]]]] = {}

    def _look_up(self, tokens: list[bytes]) -> list[list[tuple[str, tuple[str, float, int]]]]:
        """(word, hit) of the words of each token that have one. Tokens hold no line breaks."""
        words = [_WORD.findall(line) for line in b"\n".join(tokens).decode().lower().split("\n")]
        hits = self.lexicon.look_up_all(list(dict.fromkeys(w for own in words for w in own)))
        return [[(w, hits[w]) for w in own if w in hits] for own in words]

    def _of(self, words: Words, data: bytes, hashes: np.ndarray, pick: np.ndarray) -> dict[int, list]:
        """Hits by number of the distinct token."""
        if len(self.clean) + len(hashes) > _CACHE:
            self.clean = np.zeros(0, U)
        at = np.searchsorted(self.clean, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.clean):
            known = self.clean[np.minimum(at, len(self.clean) - 1)] == hashes
        rest = np.flatnonzero(~known)
        names = dict(zip(rest.tolist(), hashes[rest].tolist(), strict=True))
        out = {i: self.hits[name] for i, name in names.items() if name in self.hits}
        new = [i for i in names if i not in out]
        if new:
            tokens = [data[s:e] for s, e in zip(words.start[pick[new]].tolist(), words.end[pick[new]].tolist(), strict=True)]
            found = dict(zip(new, self._look_up(tokens), strict=True))
            none = [i for i in new if not found[i]]
            out |= {i: own for i, own in found.items() if own}
            if len(self.hits) < _CACHE:
                self.hits |= {names[i]: own for i, own in found.items() if own}
            self.clean = np.insert(self.clean, at[none], hashes[none])
        return out

    def read(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[Hit]]]:
        """(document of the slice, hits) of the documents that have hits."""
        words = Words(buf, offsets)
        if not len(words):
            return
        hashes, pick, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        data = buf.tobytes()
        hits = self._of(words, data, hashes, pick)
        flags = np.zeros(len(hashes), bool)
        flags[list(hits)] = True
        places = np.flatnonzero(flags[which])
        docs = words.doc[places]
        for doc in np.unique(docs).tolist():
            first, end = int(words.first[doc]), int(words.first[doc + 1])
            out = []
            for place in places[docs == doc].tolist() if len(places) < 64 else places[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, "right")].tolist():
                low, high = max(first, place - WINDOW), min(end, place + WINDOW + 1)
                before = data[words.start[low] : words.end[place]].decode()
                after = data[words.start[place] : words.end[high - 1]].decode()
                for word, (term, weight, edits) in hits[which[place]]:
                    out.append(Hit(term, word, place - first, edits, quoted(before, after, word), weight))
            yield doc, out


def quoted(before: str, after: str, word: str) -> bool:
    """Whether a word stands between quotation marks, or close to a word that reports speech. Both texts hold the word's token."""
    token = before.rsplit(None, 1)[-1]
    at = token.lower().find(word)
    lead, trail = token[: max(at, 0)], token[max(at, 0) + len(word) :]
    left = before[: len(before) - len(token)] + lead
    right = trail + after[len(token) :]
    if len(_QUOTES.findall(left)) % 2 and _QUOTES.search(right):
        return True
    return bool(_REPORTS & set(_WORD.findall(left.lower())[-3:]))


FEATURES = 6


def features(hits: list[Hit]) -> list[float]:
    """What a document's hits amount to: sums of weights, distinct terms, misspellings."""
    plain = [h for h in hits if not h.quoted]
    held = [h for h in hits if h.quoted]
    exact, near = {}, {}
    for h in plain:
        into = near if h.edits else exact
        into[h.term] = max(into.get(h.term, 0.0), h.weight)
    return [
        np.log1p(sum(exact.values())), np.log1p(len(exact)), np.log1p(sum(h.weight for h in plain if not h.edits)),
        np.log1p(sum(near.values())), np.log1p(sum({h.term: h.weight for h in held}.values())), float(bool(exact)),
    ]


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        b += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, hits: list[Hit]) -> float:
        z = float(np.dot(self.coefficients, [*features(hits), 1.0]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with two MinHash values of their five-word shingles, by which near copies are known."""
    for batch in batches:
        for lo, hi, buf, offsets in slices(batch.column("text")):
            sets = shingle_sets(np.arange(hi - lo), buf, offsets, 5)
            least = [[int(mix(s ^ U(c)).min().view(np.int64)) if len(s) else 0 for s in sets] for c in (0, 0x5851F42D4C957F2D)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in least)], names=["text", "toxic", "m1", "m2"]
            )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, half, toxic, documents) of a task's part of the sample."""
    counts: Counter = Counter()
    for batch in batches:
        for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic")), strict=True):
            counts.update((w, half, toxic) for w in set(_WORD.findall(text.lower())))
    items = list(counts.items())
    for lo in range(0, len(items), 50_000):
        some = items[lo : lo + 50_000]
        yield pa.record_batch([
            pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.int32()), pa.array([k[2] for k, _ in some], pa.int32()), pa.array([n for _, n in some], pa.int64()),
        ], names=["word", "half", "toxic", "n"])


def _log_odds(t: Column, c: Column, toxic: int, clean: int) -> tuple[Column, Column]:
    """Smoothed log odds that a term stands in a toxic rather than a clean document, and as a multiple of their error."""
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    return odds, odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def _look_alikes(lexicon: Lexicon):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            hits = lexicon.look_up_all(words)
            yield batch.filter(pa.array([w in hits and hits[w][2] > 0 for w in words], pa.bool_()))

    return look


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, folds: int = FOLDS) -> ToxicityModel:
    """A model learned from documents outside fold 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1.0)
    nothing = ToxicityModel(Lexicon({}, {}), np.append(np.zeros(FEATURES), np.log(share / (1 - share))))
    if len(totals) < 2:
        return nothing
    chosen = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most ``sample`` rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(chosen, "doc_id").select("text", "toxic").mapInArrow(_least_shingles, "text string, toxic int, m1 long, m2 long")
    for least in ("m1", "m2"):  # one of each group of copies, also of near copies: they would count as so many witnesses
        rows = rows.groupBy("toxic", least).agg(F.min_by(F.struct("text", "m1", "m2"), F.xxhash64("text")).alias("r")).select("toxic", "r.*")
    rows = rows.select("text", "toxic", (F.abs("m1") % 2).cast("int").alias("half")).persist()
    try:
        n = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
        if not all(sum(n.get((k, h), 0) for h in (0, 1)) for k in (0, 1)):
            return nothing
        words = rows.mapInArrow(_word_counts, "word string, half int, toxic int, n long").groupBy("word").agg(
            *(F.sum(F.when((F.col("toxic") == k) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"{'ct'[k]}{h}") for k in (0, 1) for h in (0, 1))
        ).persist()
        try:
            return _learned(spark, rows, words, n, totals)
        finally:
            words.unpersist()
    finally:
        rows.unpersist()


def _learned(spark, rows: DataFrame, words: DataFrame, n: dict, totals: dict) -> ToxicityModel:
    low, high = STEM_LETTERS
    stems = words.where(F.length("word") > low).withColumn("k", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.length("word") - 1))))
    stems = stems.groupBy(F.expr("substring(word, 1, k)").alias("term")).agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1")), F.count("*").alias("words")).where("words > 1")
    every = words.withColumnRenamed("word", "term").withColumn("words", F.lit(0).cast("long")).unionByName(stems)
    sides = {"all": ("t0 + t1", "c0 + c1", (0, 1)), "h0": ("t0", "c0", (0,)), "h1": ("t1", "c1", (1,))}
    for name, (t, c, halves) in sides.items():
        odds, z = _log_odds(F.expr(t), F.expr(c), *(sum(n.get((k, h), 0) for h in halves) for k in (1, 0)))
        every = every.withColumn(f"{name}_odds", odds).withColumn(f"{name}_z", z)
        every = every.withColumn(f"{name}_z", F.when(F.col(f"{name}_odds") >= MIN_ODDS, F.col(f"{name}_z")).otherwise(0.0))
    best = F.greatest(*(F.col(f"{s}_z") for s in sides))
    picked = every.where(best >= MIN_Z).orderBy(F.desc(best), "term", "words").collect()  # a part of the sample's words

    def lexicon(side: str) -> Lexicon:
        own = [r for r in picked if r[f"{side}_z"] >= MIN_Z]
        terms = {r["term"]: r[f"{side}_odds"] for r in own if not r["words"]}
        heads = {r["term"]: r[f"{side}_odds"] for r in own if r["words"]}
        first = Lexicon(terms, heads)
        given = spark.sparkContext.broadcast(first)
        alike = words.where("c0 + c1 > 0").select("word")
        alike = alike.mapInArrow(lambda batches: _look_alikes(given.value)(batches), "word string").collect()  # a part of the sample's distinct words
        return Lexicon(terms, heads, frozenset(r["word"] for r in alike))

    lexicons = {side: lexicon(side) for side in sides}
    given = spark.sparkContext.broadcast(lexicons)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {h: Reader(given.value[f"h{1 - h}"]) for h in (0, 1)}  # each half by the other half's lexicon
        for batch in batches:
            half = batch.column("half").to_numpy()
            out = np.zeros((batch.num_rows, FEATURES))
            for lo, _, buf, offsets in slices(batch.column("text")):
                for h in (0, 1):
                    for doc, hits in readers[h].read(buf, offsets):
                        if half[lo + doc] == h:
                            out[lo + doc] = features(hits)
            yield pa.record_batch([batch.column("toxic"), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = rows.mapInArrow(measured, "toxic int, x array<double>").collect()  # at most ``sample`` rows
    y = np.array([r["toxic"] for r in seen], float)
    weight = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    weight /= weight.mean()
    return ToxicityModel(lexicons["all"], logistic_fit(np.array([r["x"] for r in seen], float), y, weight))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score: str = "toxicity", hits: str = "toxic_hits") -> DataFrame:
    """``docs`` with the score and the hits of every text."""
    bound_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (score, hits)]
    schema = StructType([*kept, StructField(score, DoubleType()), StructField(hits, ArrayType(HIT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(given.value.lexicon)
        none = given.value.score([])
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                scores, found = np.full(hi - lo, none), [[] for _ in range(hi - lo)]
                for doc, own in reader.read(buf, offsets):
                    scores[doc] = given.value.score(own)
                    found[doc] = [{"term": h.term, "word": h.word, "place": h.place, "edits": h.edits, "quoted": h.quoted} for h in own]
                columns = [batch.column(batch.schema.get_field_index(f.name)).slice(lo, hi - lo) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(found, pa.list_(_HIT))], names=schema.names)

    return docs.mapInArrow(run, schema)
