"""Recommendations out of free-text or JSON responses, as column expressions over the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv

FIELDS = ("category", "priority", "action", "impact", "timeline")
RECOMMENDATIONS = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bullet_lines(text: Column, most: int | None = None) -> Column:
    """The lines that start with a bullet, without bullets and white space at their ends; the first `most` of them if given."""
    marked = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"^[-•*]"))
    bare = F.transform(marked, lambda line: F.regexp_replace(line, r"^[-•* ]+|[-•* ]+$", ""))
    stripped = F.transform(bare, lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return stripped if most is None else F.slice(stripped, 1, most)


def with_advice_list(responses: DataFrame, text: str = "text", name: str = "advice", most: int | None = None) -> DataFrame:
    """A list of advice per response.

    A JSON list is taken as it is, other JSON gives three standing sentences, plain text gives its bullet lines (`most` of them,
    if given), and a missing response gives three other sentences.
    """
    parsed = responses.withColumn("_json", F.try_parse_json(F.col(text)))
    is_list = F.schema_of_variant("_json").startswith("ARRAY")
    value = (
        F.when(F.col(text).isNull(), _texts(fv.FAILED_ADVICE))
        .when(F.col("_json").isNull(), bullet_lines(F.col(text), most))
        .when(is_list, F.try_variant_get("_json", "$", "array<string>"))
        .otherwise(_texts(fv.NON_LIST_ADVICE))
    )
    return parsed.withColumn(name, value).drop("_json")


def with_recommendations(responses: DataFrame, text: str = "text", name: str = "recommendations") -> DataFrame:
    """Recommendations per response: those of a JSON list, else every sentence after a marker word."""
    category, priority, impact, timeline = (F.lit(v) for v in fv.ADVICE_FIELDS)
    sentences = F.regexp_extract_all(F.col(text), F.lit("(?i)" + fv.ADVICE_PATTERN), F.lit(1))
    found = F.transform(
        sentences,
        lambda s: F.struct(
            category.alias("category"),
            priority.alias("priority"),
            F.regexp_replace(s, r"^\s+|\s+$", "").alias("action"),
            impact.alias("impact"),
            timeline.alias("timeline"),
        ),
    )
    is_json = F.try_parse_json(F.col(text)).isNotNull()
    return responses.withColumn(name, F.when(is_json, F.from_json(F.col(text), RECOMMENDATIONS)).otherwise(found))
