"""Categories from a table of keyword rules: any number of them, a user's own ones too. The first matching rule wins.

The keyword rules of `categorize` are one CASE expression, which fits a fixed table of some dozens. A table of thousands is matched
by an automaton instead (Aho and Corasick, 1975): it reads a text once, whatever the number of words. It is built from a block of rules
and sent to the tasks, which run it over all texts of a batch in step; a larger table is several blocks in order of the rules, and a later
block decides only what no earlier one did. So what is broadcast and held by a task is bounded by ``BLOCK_LETTERS``. As each block reads
all texts, a table of more than ``MOST_BLOCKS`` of them is joined to the texts instead, see `word_hits`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.categorize import parse_rules
from tallyflow.functions.word_hits import first_categories, slices

RULES = "rule_no long, txn_type string, category string, word string, absent boolean"
BLOCK_LETTERS = 100_000
MOST_BLOCKS = 4
#: Letters of the pieces that texts are cut into, so that a long text is read as many short ones.
PIECE = 512


class Automaton:
    """Finds the first of some rules that matches a text. A rule is (type or None for any, words, words that must be absent)."""

    def __init__(self, rules: list[tuple[str | None, list[str], list[str]]]) -> None:
        self.types = [kind for kind, _, _ in rules]
        self.words: list[tuple[int, bool]] = []  # rule, whether the word must be absent
        self.always: list[tuple[int, bool]] = []  # those of empty words
        points = sorted({ord(c) for _, words, absent in rules for w in (*words, *absent) for c in w})
        self.points = np.array(points, np.uint32)
        column = {p: i + 1 for i, p in enumerate(points)}  # 0 is any other letter
        step: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        self.longest = 1
        for rule, (_, words, absent) in enumerate(rules):
            for w, gone in [*((w, False) for w in words), *((w, True) for w in absent)]:
                if not w:
                    self.always.append((rule, gone))
                    continue
                state = 0
                for c in w:
                    after = step[state].get(column[ord(c)])
                    if after is None:
                        after = step[state][column[ord(c)]] = len(step)
                        step.append({})
                        ends.append([])
                    state = after
                ends[state].append(len(self.words))
                self.words.append((rule, gone))
                self.longest = max(self.longest, len(w))
        self.table = np.zeros((len(step), len(points) + 1), np.int32)
        back = [0] * len(step)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                self.table[state] = self.table[back[state]]
                ends[state] = ends[state] + ends[back[state]]
            for c, after in step[state].items():
                back[after] = int(self.table[state, c]) if state else 0
                self.table[state, c] = after
                queue.append(after)
        self.first = np.cumsum([0, *map(len, ends)])
        self.ends = np.array([w for own in ends for w in own], np.int64)

    def _found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, word) of the words that texts contain."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = np.searchsorted(self.points, points)
        column[column == len(self.points)] = 0
        column = np.where(self.points[column] == points, column + 1, 0) if len(self.points) else np.zeros(len(points), np.int64)
        pieces = np.maximum(-(-sizes // PIECE), 1)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.cumsum(sizes) - sizes
        begin = starts[owner] + number * PIECE
        end = np.minimum(begin + PIECE + self.longest - 1, starts[owner] + sizes[owner])  # a word that begins in a piece ends in it
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, length, owner = begin[order], (end - begin)[order], owner[order]
        state = np.zeros(len(begin), np.int32)
        busy = np.diff(self.first) > 0
        seen = []
        for j in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -j, "left"))
            state[:n] = self.table[state[:n], column[begin[:n] + j]]
            hit = np.flatnonzero(busy[state[:n]])
            if len(hit):
                seen.append(np.unique(owner[hit] * len(self.table) + state[hit]))
        pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        text, at = pairs // len(self.table), pairs % len(self.table)
        n = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(text, n), self.ends[place]

    def first_rules(self, texts: list[str], kinds: list[str]) -> np.ndarray:
        """Number of the first rule that matches each text, -1 where none does."""
        text, word = self._found(texts)
        rule, gone = (np.array([w[k] for w in self.words], d) for k, d in ((0, np.int64), (1, bool)))
        rows = [(text, rule[word], gone[word])]
        for r, absent in self.always:
            rows.append((np.arange(len(texts)), np.full(len(texts), r), np.full(len(texts), absent)))
        text, rule, gone = (np.concatenate([x[k] for x in rows]) for k in range(3))
        kind_of = {None: -1}
        own = np.array([kind_of.setdefault(k, len(kind_of)) for k in self.types], np.int64)
        given = np.array([kind_of.get(k, -2) if k is not None else -2 for k in kinds], np.int64)
        fits = (own[rule] == -1) | (own[rule] == given[text])
        key = text * max(len(self.types), 1) + rule
        key = np.setdiff1d(key[fits & ~gone], key[gone])
        out = np.full(len(texts), -1, np.int64)
        which, first = np.unique(key // max(len(self.types), 1), return_index=True)
        out[which] = key[first] % max(len(self.types), 1)
        return out


def rule_table(spark, text: str = fv.CATEGORY_RULES) -> DataFrame:
    """The library's own rules as a table. Rules of a default category are not in it."""
    rows = []
    for number, rule in enumerate(parse_rules(text), 1):
        rows += [(number, rule.txn_type, rule.category, w, False) for w in rule.words]
        rows += [(number, rule.txn_type, rule.category, w, True) for w in rule.absent]
    return spark.createDataFrame(rows, RULES)


def _blocks(rules: DataFrame, letters: int) -> Iterator[list[tuple[str, str | None, list[str], list[str]]]]:
    """Rules in order, in blocks of about so many letters; the table comes to the driver a partition at a time."""
    block, size, number = [], 0, None
    for row in rules.orderBy("rule_no").select("rule_no", "txn_type", "category", "word", "absent").toLocalIterator():
        if row["word"] is None or row["rule_no"] is None:
            continue
        if row["rule_no"] != number:
            if size >= letters:
                yield block
                block, size = [], 0
            block.append((row["category"], row["txn_type"], [], []))
            number = row["rule_no"]
        block[-1][3 if row["absent"] else 2].append(row["word"])
        size += len(row["word"])
    if block:
        yield block


def with_table_category(
    df: DataFrame, rules: DataFrame, description: str = "description", txn_type: str = "txn_type", own_category: str | None = None,
    defaults: dict[str, str] | None = None, block_letters: int = BLOCK_LETTERS, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """Add `category`: the user's own column where it is set, else that of the matching rule with the least number, else the default.

    `rules` has a row for each word: rule_no, txn_type (NULL for any), category, word, absent. A rule matches a description that
    contains one of its words and none of its absent ones. Descriptions are lower-cased, words are taken as they are; NULL
    descriptions are empty. All rows of a rule have the same type and category.
    """
    defaults = defaults or {"income": fv.DEFAULT_INCOME_CATEGORY}
    out = df.withColumn("_lowered", F.lower(F.coalesce(F.col(description), F.lit("")))).withColumn("_named", F.lit(None).cast("string"))
    schema = StructType([*(f for f in out.schema.fields if f.name != "_named"), StructField("_named", StringType())])
    out = out.select(*schema.names)
    letters = rules.agg(F.sum(F.length("word"))).first()[0] or 0
    if letters > most_blocks * block_letters:
        key = F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), txn_type), F.lit("")), F.lit("\0"), F.col("_lowered")), 256)
        keyed = out.drop("_named").withColumn("_key", key)
        named = first_categories(keyed.select(F.col("_key").alias("key"), F.col(txn_type).alias("kind"), F.col("_lowered").alias("lowered")), rules)
        out = keyed.join(named.select(F.col("key").alias("_key"), F.col("named").alias("_named")), "_key", "left").select(*schema.names)
    for block in _blocks(rules, block_letters) if letters <= most_blocks * block_letters else ():
        given = df.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([r[1:] for r in given.value])
            for batch in batches:
                named = batch.column(batch.num_columns - 1).to_pylist()
                open_ = [i for i, name in enumerate(named) if name is None]
                some = batch.take(pa.array(open_, pa.int64()))
                texts, kinds = (some.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_lowered", txn_type))
                for a, b in slices(texts):  # what is held for each letter is many times the text
                    for i, rule in zip(open_[a:b], automaton.first_rules(texts[a:b], kinds[a:b]).tolist(), strict=True):
                        if rule >= 0:
                            named[i] = given.value[rule][0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string())], names=batch.schema.names)

        out = out.mapInArrow(match, schema)
    default = F.lit(fv.DEFAULT_EXPENSE_CATEGORY)
    for kind, name in defaults.items():
        default = F.when(F.col(txn_type) == kind, name).otherwise(default)
    own = [F.col(own_category)] if own_category else []
    return out.withColumn("category", F.coalesce(*own, F.col("_named"), default)).drop("_lowered", "_named")
