"""Queries of the operators of this folder, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canvasser.llm import alignment, bpe_tables, chat, decontaminate, jaccard, licences, lines, neighbours, quality, repeats, token_counts, toxicity, whitening
from canvasser.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of common licenses; the templates are a parameter of the operator."""
    templates = spark.createDataFrame(licences.TEMPLATES, "license string, text string")
    return licences.report(table(spark, sf_dir, "documents"), templates)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tables.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) whose texts hold control strings and a backslash."""
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.format_turns(chat.text_parts(messages)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_license_scan, op3_neighbours, op4_toxicity, op5_line_dedup, op6_token_counts, op7_jaccard_join, op8_repeats, op9_bpe_round_trip, op10_quality, op11_whitening, op12_alignment, op13_chat_format)
}

# Fixed value: the words of the contract, after A-Z are folded.
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CHECKS: dict[str, str] = {
    "op1_decontaminate": f"""
WITH items AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM sized)),
docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
spots AS (SELECT r, w, unnest(generate_series(1, len(w))) AS k FROM docs WHERE len(w) > 0),
hits AS (SELECT r, k, s.n, item FROM (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
    FROM spots, (SELECT DISTINCT n FROM windows) WHERE k + n - 1 <= len(w)) s JOIN windows USING (win, n)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)""",
    "op13_chat_format": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
sized AS (SELECT *, 6 + length(regexp_replace(role, '[\\<>\n]', '..', 'g')) + 2 + length(text)
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '\\*(?:<turn |</turn>|<image |<audio |<document |<other )'), lambda m : length(regexp_extract(m, '^\\*')) + 1)), 0) + 9 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(size) AS bigint) AS formatted_chars
FROM sized GROUP BY conv_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
