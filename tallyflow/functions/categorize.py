"""Ordered keyword categorisation and type inference as one CASE expression each, no UDF."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv


@dataclass(frozen=True)
class Rule:
    txn_type: str
    category: str
    words: tuple[str, ...]
    absent: tuple[str, ...] = ()


def word_list(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.replace("\n", " ").split(",") if w.strip())


def parse_rules(text: str = fv.CATEGORY_RULES) -> list[Rule]:
    """One rule per line: type | category | words | words that must be absent."""
    rules = []
    for line in text.strip().splitlines():
        fields = [f.strip() for f in line.split("|")]
        rules.append(Rule(fields[0], fields[1], word_list(fields[2]), word_list(fields[3]) if len(fields) > 3 else ()))
    return rules


def shortest_words(words: tuple[str, ...]) -> list[str]:
    """Drop words that contain another word of the same rule: the shorter one already matches them."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(w) for w in shortest_words(words)])


def category_case(lowered: Column, txn_type: Column, rules: list[Rule] | None = None) -> Column:
    """First matching rule wins. `lowered` must be an existing column, see `with_category`."""
    rules = parse_rules() if rules is None else rules

    def chain(kind: str, default: str) -> Column:
        case = None
        for rule in (r for r in rules if r.txn_type == kind):
            test = contains_any(lowered, rule.words)
            if rule.absent:
                test = test & ~contains_any(lowered, rule.absent)
            case = F.when(test, rule.category) if case is None else case.when(test, rule.category)
        return F.lit(default) if case is None else case.otherwise(default)

    return F.when(txn_type == "income", chain("income", fv.DEFAULT_INCOME_CATEGORY)).otherwise(
        chain("expense", fv.DEFAULT_EXPENSE_CATEGORY)
    )


def with_category(
    df: DataFrame,
    description: str = "description",
    txn_type: str = "txn_type",
    own_category: str | None = None,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """Add `category`: the user's own column where it is set, else the first matching rule.

    The lower-cased text is a column of its own, so that it is computed once per row and not once per word.
    """
    lowered = df.withColumn("_lowered", F.lower(F.coalesce(F.col(description), F.lit(""))))
    case = category_case(F.col("_lowered"), F.col(txn_type), rules)
    if own_category:
        case = F.coalesce(F.col(own_category), case)
    return lowered.withColumn("category", case).drop("_lowered")


def type_from_sign(amount: Column, lowered: Column) -> Column:
    """Positive is income, negative expense; zero goes by the words of the description."""
    zero_income = contains_any(lowered, word_list(fv.ZERO_AMOUNT_INCOME_WORDS))
    return F.when(amount > 0, "income").when(amount < 0, "expense").when(zero_income, "income").otherwise("expense")


def type_from_column(value: Column, lowered: Column | None = None) -> Column:
    """A type column that mentions income or credit is income, whatever the sign of the amount.

    For long texts give `lowered`, an existing column of the lower-cased value: it is computed once per row then, not once per word.
    """
    if lowered is None:
        lowered = F.lower(F.coalesce(value, F.lit("")))
    return F.when(contains_any(lowered, fv.INCOME_TYPE_WORDS), "income").otherwise("expense")


def category_in(category: Column, names: tuple[str, ...]) -> Column:
    return F.lower(category).isin(*names)
