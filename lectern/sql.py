"""The operators by name in SQL: table functions, scalar functions and views of a session.

    sql.install(spark)
    sql.views(spark, {"documents": spark.read.parquet(path)})
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunk(text, 1000, 100) c")

Functions are SQL themselves, so that the optimizer sees through them; they belong to the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import BLANK, HEADER_LENGTH, LIMITING_SECTION, LIMITING_TEXT, NAMED_HEADER, NON_CONTENT, NUMBERED_HEADER


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(words: list[str]) -> str:
    return ", ".join(map(_quoted, words))


_STRIP = f"btrim({{0}}, {_quoted(BLANK)})"
#: name(arguments), kind of the result, and the expression.
SCALARS = [
    ("word_tokens(t STRING)", "ARRAY<STRING>", "regexp_extract_all(lower(t), '([a-z0-9]+)', 1)"),
    ("content_hash(t STRING)", "STRING", r"substring(sha2(trim(regexp_replace(t, '(?U)\\s+', ' ')), 256), 1, 12)"),
    ("paper_slug(id STRING)", "STRING", "split_part(id, '::', 1)"),
    ("is_header_line(line STRING)", "BOOLEAN", f"length({_STRIP.format('line')}) BETWEEN 1 AND {HEADER_LENGTH} AND ({_STRIP.format('line')} RLIKE {_quoted('(?U)' + NUMBERED_HEADER)} OR {_STRIP.format('line')} RLIKE {_quoted('(?iu)' + NAMED_HEADER)})"),
    ("is_non_content_label(section STRING)", "BOOLEAN", f"lower({_STRIP.format("coalesce(section, '')")}) IN ({_in(NON_CONTENT)})"),
    ("is_limiting(section STRING, t STRING)", "BOOLEAN", f"coalesce(section, '') RLIKE {_quoted('(?i)' + LIMITING_SECTION)} OR coalesce(t, '') RLIKE {_quoted('(?i)' + LIMITING_TEXT)}"),
]
#: Table functions: name(arguments), columns, and the query.
TABLES = [
    (
        "chunk(t STRING, size INT, overlap INT)",
        "chunk_index INT, char_start INT, char_end INT, text STRING",
        f"""SELECT k, k * (size - overlap), least(k * (size - overlap) + size, length(t)), {_STRIP.format("substring(t, k * (size - overlap) + 1, size)")}
        FROM (SELECT explode(CASE WHEN length(t) > 0 THEN sequence(0, CASE WHEN length(t) <= size THEN 0 ELSE cast(ceil((length(t) - size) / (size - overlap)) AS INT) END) END) AS k)""",
    ),
    ("text_lines(t STRING)", "line_no INT, line STRING", "SELECT posexplode(split(t, '\\n', -1))"),
    ("terms(t STRING)", "term STRING, tf BIGINT", "SELECT term, count(*) FROM (SELECT explode(regexp_extract_all(lower(t), '([a-z0-9]+)', 1)) AS term) GROUP BY term"),
]


def install(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, anew if they are; their names. A null text has no rows, and a scalar of
    null is null where it isn't a test."""
    for head, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
    return [head.split("(")[0] for head, *_ in SCALARS + TABLES]


def views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Tables and results by name, for the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
