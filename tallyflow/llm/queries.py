"""One query per operator, over its whole table, with the digests that stand for its real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that remain when passages of 13 words held by a smaller document go."""
    from tallyflow.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that remain when strings of 400 bytes that start anywhere else go."""
    from tallyflow.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that remain when those of 40 code points in five documents stay only in the last document."""
    from tallyflow.llm.line_dedup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, last IS NOT NULL AND doc_id < last AS gone FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in a word BPE, and whether they are over a context of 2,048."""
    import public_tokenizers

    from tallyflow.llm.token_counts import token_counts

    out = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 % of their five-word shingles."""
    from tallyflow.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op7_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to every fiftieth one by inner product."""
    from tallyflow.llm.impact_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op7_impact_search"] = """
WITH components AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d, len(embedding) AS dims FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM components WHERE x IS NULL OR NOT isfinite(x)),
cells AS (
  SELECT vec_id, d, dims, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM components WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.d = c.d AND q.dims = c.dims AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query
def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and loss texts of all conversations and one full of control strings, read back from the packed prefix trees."""
    from tallyflow.llm.chat_tree import chat_tree, read_back

    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return read_back(*chat_tree(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage."""
    from tallyflow.llm.decontaminate import PASSAGE, contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), passage=PASSAGE)


@query
def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to the text."""
    import public_tokenizers

    from tallyflow.llm.sentence_pieces import byte_piece_ids, decode, encode, piece_numbers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path), path)
    numbers = piece_numbers("piece_ids", byte_piece_ids(path))
    return out.select("doc_id", *numbers, F.xxhash64("piece_ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    from tallyflow.llm.toxicity import fit, fold, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")), score="score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from the files they were written to."""
    import uuid

    import public_tokenizers

    from tallyflow.llm.rendezvous import shared_folder
    from tallyflow.llm.token_files import read_checksums, write_tokens

    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    return read_checksums(spark, path)


#: DuckDB macros are not to be had in one query, so the checksum is a list expression: its table, and the states after each byte.
CRC32_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crcs
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))"""


def crc32_sql(bytes_: str) -> str:
    """The checksum of a list of byte values, where ``crcs`` is in scope."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, crcs[CAST(xor(c & 255, b) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT))"


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document in a Merkle manifest by language, and whether they hold where a third of the texts was lower-cased."""
    from tallyflow.llm.merkle_manifest import FIELDS, ascii_lower, build_manifest, folded, leaf_digest, proof_digest, proofs

    docs = _table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_digest(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))
    manifest = build_manifest(docs.withColumn("changed", F.when(tampered, changed)), keep=("changed",))
    out = proofs(spark, manifest).withColumn("claim", F.coalesce("changed", "digest"))
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest("trail").alias("proof_sha256"), folded("claim", "trail").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _framed_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _levels_sql(name: str, levels: int) -> str:
    """CTEs that climb ``levels`` levels from ``{name}0`` (tree, place, node, claim, proof, size); a tree of one node climbs no further."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k}_runs AS (
  SELECT tree, place // 8 AS run, sha256(string_agg(node, '' ORDER BY place)) AS parent, list(node ORDER BY place) AS family
  FROM (SELECT DISTINCT tree, place, node, size FROM {name}{k}) WHERE size > 1 GROUP BY ALL),
{name}{k + 1} AS (
  SELECT l.* REPLACE (CASE WHEN size > 1 THEN l.place // 8 ELSE l.place END AS place, coalesce(parent, node) AS node,
    CASE WHEN size > 1 THEN sha256(array_to_string(family[:l.place % 8], '') || claim || array_to_string(family[l.place % 8 + 2:], '')) ELSE claim END AS claim,
    CASE WHEN size > 1 THEN proof || array_to_string(family[:l.place % 8], '') || array_to_string(family[l.place % 8 + 2:], '') ELSE proof END AS proof,
    (size + 7) // 8 AS size)
  FROM {name}{k} l LEFT JOIN {name}{k}_runs r ON r.tree = l.tree AND r.run = l.place // 8 AND size > 1)""")
    return ",\n".join(out)


# Ten levels hold a thousand million documents a language, three hold 512 languages.
ORACLES["op12_merkle_manifest"] = f"""
WITH {CRC32_TABLE},
marked AS (
  SELECT *, {crc32_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 3 = 0 AS tampered FROM documents, crc_table),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_framed_sql('text')} AS leaf,
         CASE WHEN tampered THEN {_framed_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_framed_sql('text')} END AS claim
  FROM marked),
a0 AS (
  SELECT doc_id, tree, leaf, leaf AS node, claim, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS size FROM hashed),
{_levels_sql('a', 10)},
b0 AS (
  SELECT doc_id, leaf, node AS subroot, '' AS tree, node, claim, proof, place, size FROM (
    SELECT a10.* REPLACE (g.place AS place, g.size AS size) FROM a10 JOIN (
      SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT tree FROM a10)) g USING (tree))),
{_levels_sql('b', 3)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = node AS verified FROM b3"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five percent of the documents of 20 words and more, drawn by how much they resemble the benchmark."""
    from tallyflow.llm.importance_resampling import resample

    out = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# Checksums are taken of distinct features only, and byte by byte from their hexadecimal form.
ORACLES["op13_importance_resampling"] = rf"""
WITH {CRC32_TABLE},
texts AS (
  SELECT row_number() OVER () AS row, doc_id, TRUE AS own, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, FALSE, text FROM benchmark),
worded AS (
  SELECT row, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
held AS (
  SELECT row, own, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                          || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM worded),
counted AS (SELECT row, own, f, count(*) AS n FROM held GROUP BY ALL),
named AS (
  SELECT f, {crc32_sql("list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT))")} % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM counted JOIN named USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM sums) + 10000 AS DOUBLE)
                                      / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM sums) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums),
weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN named USING (f) JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded LEFT JOIN weights USING (row) WHERE own),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20 AND doc_id IS NOT NULL) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND doc_id IS NOT NULL AND place <= 5 * n // 100 THEN CAST(place AS BIGINT) END AS rank FROM placed"""
