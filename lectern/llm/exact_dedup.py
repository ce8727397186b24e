"""Exact dedup (9, native): a merge tree over sorted digest runs, DataFrame functions only.

Every scan partition makes one run of (digest, length, check, copies, identifier that stays): the part of
the first aggregation that runs before the exchange. In each round the runs whose numbers agree but for their
lowest digit in base FAN_IN are exchanged, sorted by digest (a multiway merge, run by run) and folded by a
streaming aggregation over the merged order, until one run is left: a binomial tree with a wider fan. A run
is a logical thing: its entries are dealt by (run, digest), so no task holds a whole run, and a digest with a
third of all rows arrives in a round as one entry a run. Every level verifies what it retains: entries merge
only where the length and an independent 64-bit hash agree with the digest. At the root the texts themselves
are compared, by their smallest and largest, for each digest with copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt_join, fresh, stored, table, text_or_empty

#: Runs that one merge takes.
FAN_IN = 8


def _merge(entries: DataFrame, largest: bool) -> DataFrame:
    """One level. The identifier is folded as a struct, which Spark aggregates over sorted rows, not by hashing."""
    pick = F.max if largest else F.min
    return entries.groupBy("run", "digest", "size", "check").agg(F.sum("copies").alias("copies"), pick(F.struct("keep_id")).alias("kept")).select("run", "digest", "size", "check", "copies", F.col("kept.keep_id").alias("keep_id"))


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = FAN_IN) -> DataFrame:
    """(digest, size, check, copies, keep_id): each distinct text once. ``digest`` is binary SHA-256.

    A null id is smaller and larger than none: it is kept only where a text has no other.
    """
    if keep not in ("min", "max") or fan_in < 2:
        raise ValueError("keep is min or max, and fan_in 2 or more")
    text = text_or_empty(text_col)
    merged = docs.select(F.spark_partition_id().alias("run"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("check"), F.lit(1).cast("long").alias("copies"), F.col(id_col).alias("keep_id"))
    if keep == "min":  # structs put nulls first
        merged = merged.withColumn("keep_id", F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id")))
    # The first round is written before its runs are counted: another job over ``docs`` may have other partitions.
    merged = stored(_merge(merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), keep == "max"), "runs")
    highest = merged.agg(F.max("run")).first()[0] or 0
    while highest:
        merged = _merge(merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), keep == "max")
        highest //= fan_in
    if keep == "min":
        merged = merged.withColumn("keep_id", F.col("keep_id.id"))
    return merged.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = FAN_IN) -> DataFrame:
    """Every row of ``docs``, all its columns, and keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; a null text counts as empty. ``keep`` says whether the
    smallest ("min") or the largest ("max") id of equal texts stays. Ids are compared as they are: a null
    id never stays beside another, and in a group of null ids only keep_id is null and every row is kept.
    Rows that repeat an id and its text all carry that keep_id and are all kept (the id stays). Columns
    of ``docs`` named like the results are replaced, others stay whatever their names. An empty table gives
    an empty one. Two texts that differ and agree in SHA-256, length and the 64-bit hash are an error.
    """
    plain, text = docs.drop("keep_id", "group_size", "kept", "text_sha256"), text_or_empty(text_col)
    digest, size, check, copies, keep_id, low = fresh(plain, "digest", "size", "check", "copies", "kept_id", "low_text")
    keys = [digest, size, check]
    groups = stored(digest_groups(docs, id_col, text_col, keep, fan_in).where("copies > 1"), "groups")
    n = groups.count()
    keyed = plain.withColumns({digest: F.unhex(F.sha2(text, 256)), size: F.octet_length(text).cast("long"), check: F.xxhash64(text)})
    found = groups.select(F.col("digest").alias(digest), F.col("size").alias(size), F.col("check").alias(check), F.col("copies").alias(copies), F.col("keep_id").alias(keep_id))
    # The root's check of the bytes: equal texts have one smallest and largest text; each task sends one pair
    # of them for a digest.
    repeated = dealt_join(keyed.select(*keys, text.alias(low)), found.select(*keys), keys, "left_semi", n)
    false = repeated.groupBy(*keys).agg(F.min(low).alias("low"), F.max(low).alias("high")).where("low <> high")
    if not false.isEmpty():
        raise ValueError("two different texts have the same SHA-256, length and 64-bit hash")
    out = dealt_join(keyed, found, keys, "left", n)
    own = F.when(F.col(copies).isNull(), F.col(id_col)).otherwise(F.col(keep_id))
    sha = F.lower(F.hex(digest))
    return out.select(*(F.col(c) for c in plain.columns), own.alias("keep_id"), F.coalesce(copies, F.lit(1).cast("long")).alias("group_size"), F.col(id_col).eqNullSafe(own).alias("kept"), sha.alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
}
