"""Advice and recommendations out of response texts; conversations stand for stored responses."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import query
from tallyflow.functions import fixed_values as fv
from tallyflow.operators import advice
from tallyflow.sources.star import table

# User turns become a JSON list, assistant turns bullet lines with tabs and carriage returns, system turns other JSON.
RESPONSES = """responses AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN CAST(to_json([text, 'and ' || role]) AS VARCHAR)
         WHEN 'assistant' THEN '* ' || replace(text, '. ', E' .\\t\\r\\n-\\t') ELSE '{"k": ' || length(text) || '}' END AS text FROM conversations)"""


def _responses(spark, sf_dir):
    role, text = F.col("role"), F.col("text")
    as_list = F.to_json(F.array(text, F.concat(F.lit("and "), role)))
    as_lines = F.concat(F.lit("* "), F.replace(text, F.lit(". "), F.lit(" .\t\r\n-\t")))
    as_json = F.concat(F.lit('{"k": '), F.length(text).cast("string"), F.lit("}"))
    made = F.when(role == "user", as_list).when(role == "assistant", as_lines).otherwise(as_json)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("text"))


def _sentences(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""
WITH {RESPONSES},
lists AS (
  SELECT conv_id, turn, CASE WHEN json_valid(text) THEN
           CASE WHEN json_type(text) = 'ARRAY' THEN from_json(text, '["VARCHAR"]') ELSE {_sentences(fv.NON_LIST_ADVICE)} END
         ELSE list_transform(list_filter(string_split(text, E'\\n'), lambda l: regexp_matches(l, '^[-•*]')),
                             lambda l: trim(trim(l, '-•* '), E' \\t\\r\\n')) END AS items FROM responses)
SELECT conv_id, turn, pos, items[pos] AS advice FROM (SELECT conv_id, turn, items, unnest(range(1, len(items) + 1)) AS pos FROM lists)""")
def advice_lists(spark, sf_dir):
    out = advice.with_advice_list(_responses(spark, sf_dir))
    return out.select("conv_id", "turn", F.posexplode("advice").alias("pos", "advice")).withColumn(
        "pos", (F.col("pos") + 1).cast("bigint")
    )


@query(r"""
WITH marked AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Recommendation: ' || text WHEN 'assistant' THEN text || ' My ADVICE: ' || text || ' A suggestion' || text
         ELSE '[{"category": "' || role || '", "priority": "high", "action": "a' || length(text) || '"}]' END AS text FROM conversations),
found AS (SELECT conv_id, turn, regexp_extract_all(text, '(?i)""" + fv.ADVICE_PATTERN + r"""', 1) AS hits
          FROM marked WHERE NOT json_valid(text))
SELECT conv_id, turn, pos, 'general' AS category, 'medium' AS priority, regexp_replace(hits[pos], '^\s+|\s+$', '', 'g') AS action,
       'positive' AS impact, 'immediate' AS timeline
FROM (SELECT conv_id, turn, hits, unnest(range(1, len(hits) + 1)) AS pos FROM found)
UNION ALL
SELECT conv_id, turn, 1, text->>'$[0].category', text->>'$[0].priority', text->>'$[0].action', NULL, NULL FROM marked WHERE json_valid(text)""")
def advice_extract(spark, sf_dir):
    """Marker words put before the text; system turns as a JSON list."""
    role, text = F.col("role"), F.col("text")
    as_json = F.concat(
        F.lit('[{"category": "'), role, F.lit('", "priority": "high", "action": "a'), F.length(text).cast("string"), F.lit('"}]')
    )
    made = (
        F.when(role == "user", F.concat(F.lit("Recommendation: "), text))
        .when(role == "assistant", F.concat(text, F.lit(" My ADVICE: "), text, F.lit(" A suggestion"), text))
        .otherwise(as_json)
    )
    responses = table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("text"))
    out = advice.with_recommendations(responses)
    return out.select("conv_id", "turn", F.posexplode("recommendations").alias("pos", "r")).select(
        "conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("pos"), "r.*"
    )
