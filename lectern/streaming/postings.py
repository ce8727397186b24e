"""A posting index that grows by batches, and BM25 over it without a pass over the corpus.

Each batch writes four tables of its own under ``path``, by its number:

* ``postings``: (part, term, keys, dl, tf), in PARTS directories by hash of the term and sorted by term within, so that a
  query reads the directories and row groups of its terms alone;
* ``terms``: (part, term, df), what the batch adds to each term's document frequency;
* ``totals``: (n, dl), chunks and tokens that it adds;
* ``steps``: (df, change), how many terms more or fewer have a document frequency after the batch.

All four are sums, so batches commute in everything but ``steps``, which needs the frequencies before it; the mean idf
of all terms, which replaces negative ones, follows from ``steps`` alone. A batch that is run again replaces its own
tables, so a streaming query that restarts from its checkpoint counts nothing twice. A batch is part of the index
once ``totals``, written last, is there.
"""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import tokens
from lectern.operators.chunking import fixed_chunks
from lectern.operators.retrieval import B, K1, SENT_WEIGHTS, Totals, asked_terms, postings, scored_postings, top_k
from lectern.sources.scratch import written

#: Directories of each batch's postings and terms.
PARTS = 32
_SCHEMAS = {"totals": "n long, dl long", "steps": "df long, change long", "terms": "term string, df long, part int"}


def _part(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int").alias("part")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are whole, in order."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    jvm = spark.sparkContext._jvm
    names = [(s.getPath().getName()) for s in fs.listStatus(root)]
    done = lambda name: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/totals/_SUCCESS"))
    return sorted(int(x.removeprefix("batch-")) for x in names if x.startswith("batch-") and done(x))


def _read(spark: SparkSession, path: str, table: str, numbers: list[int], schema: str | None = None) -> DataFrame:
    schema = schema or _SCHEMAS[table]
    if not numbers:
        return spark.createDataFrame([], schema)
    frames = [spark.read.schema(schema).parquet(f"{path}/batch-{i}/{table}") for i in numbers]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def append(chunks: DataFrame, path: str, number: int, keys: list[str]) -> None:
    """Add chunks (keys, text) as batch ``number``; what stood under that number is replaced.

    A null or empty text counts as a chunk without terms. An empty batch adds nothing. Chunks that repeat, here or
    in another batch, count again.
    """
    spark = chunks.sparkSession
    before = [i for i in batches(spark, path) if i != number]
    here = f"{path}/batch-{number}"
    fs, p = _fs(spark, here)
    fs.delete(p, True)
    texts = chunks.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    posts = postings(texts, keys).where("term is not null").withColumn("part", _part())
    posts.repartition("part", F.pmod(F.xxhash64(*keys), F.lit(8))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{here}/postings")
    made = spark.read.schema(posts.schema).parquet(f"{here}/postings")
    terms = written(made.groupBy("term").agg(F.count("*").alias("df")), "batch-terms")
    terms.withColumn("part", _part()).repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{here}/terms")
    # Frequencies of the batch's terms before it; no other term's changes.
    old = _read(spark, path, "terms", before).join(terms.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("old"))
    moved = terms.join(old, "term", "left").select(F.explode(F.array(F.struct(F.col("old").alias("df"), F.lit(-1).alias("change")), F.struct((F.coalesce("old", F.lit(0)) + F.col("df")).alias("df"), F.lit(1).alias("change")))).alias("s")).select("s.*")
    moved.where("df is not null").groupBy("df").agg(F.sum("change").alias("change")).where("change <> 0").coalesce(1).write.parquet(f"{here}/steps")
    texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(F.col("text"))).cast("long")), F.lit(0)).alias("dl")).write.parquet(f"{here}/totals")


def totals(spark: SparkSession, path: str) -> Totals:
    """From the batches' sums alone: one row of each, and their steps."""
    numbers = batches(spark, path)
    whole = _read(spark, path, "totals", numbers).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
    n = whole.n or 0
    steps = _read(spark, path, "steps", numbers).groupBy("df").agg(F.sum("change").alias("terms"))
    mean = steps.agg((F.sum(F.col("terms") * Totals(n, 0, 0).raw(F.col("df"))) / F.sum("terms")).alias("mean")).first()
    return Totals(n, (whole.dl or 0) / max(n, 1), mean["mean"] or 0.0)


def bm25(spark: SparkSession, path: str, queries: DataFrame, keys: list[str], k: int = 10, b: float = B) -> DataFrame:
    """(qid, keys, score, rank): as retrieval.bm25() over the union of all whole batches.

    Reads the directories of the queries' terms. Their postings meet by chunk, where all queries are scored at once and
    each task passes on ``k`` chunks a query; with more than SENT_WEIGHTS weights they are joined on (part, term), and
    AQE splits a term that a third of all chunks have.
    """
    numbers, whole = batches(spark, path), totals(spark, path)
    asked = written(asked_terms(queries).withColumn("part", _part()), "asked")
    parts = [r.part for r in asked.select("part").distinct().collect()]  # PARTS at most
    df = _read(spark, path, "terms", numbers).where(F.col("part").isin(parts)).join(asked.select("part", "term").distinct(), ["part", "term"]).groupBy("part", "term").agg(F.sum("df").alias("df"))
    weights = written(asked.join(df, ["part", "term"]).select("part", "qid", "term", (F.col("times") * whole.idf(F.col("df"))).alias("weight")), "weights")
    kinds = _kinds(spark, path, numbers)
    if not kinds:
        return spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, score double, rank int")
    posts = _read(spark, path, "postings", numbers, kinds).where(F.col("part").isin(parts))
    some = weights.select("qid", "term", "weight").limit(SENT_WEIGHTS + 1).toPandas()
    if len(some) <= SENT_WEIGHTS:
        scored = scored_postings(posts, some, queries.schema["qid"].dataType, keys, whole.avgdl, k, b).withColumn("score", F.round("score", 6))
        return top_k(scored, "qid", k, F.desc("score"), *keys)
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - b + b * F.col("dl") / whole.avgdl))
    scored = posts.join(weights, ["part", "term"]).groupBy("qid", *keys).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scored, "qid", k, F.desc("score"), *keys)


def _kinds(spark: SparkSession, path: str, numbers: list[int]) -> str | None:
    """The schema of the postings, if any batch has some."""
    for i in numbers:
        fs, some = _fs(spark, f"{path}/batch-{i}/postings/part=*")
        if fs.globStatus(some):
            return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/batch-{i}/postings").schema)
    return None


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The index as one batch under ``into``: fewer files, the same sums."""
    numbers, here = batches(spark, path), f"{into}/batch-0"
    kinds = _kinds(spark, path, numbers)
    if not kinds:
        return
    posts = _read(spark, path, "postings", numbers, kinds)
    posts.repartition("part", F.pmod(F.xxhash64("term", "dl", "tf"), F.lit(8))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{here}/postings")
    _read(spark, path, "terms", numbers).groupBy("part", "term").agg(F.sum("df").alias("df")).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{here}/terms")
    _read(spark, path, "steps", numbers).groupBy("df").agg(F.sum("change").alias("change")).where("change <> 0").coalesce(1).write.parquet(f"{here}/steps")
    _read(spark, path, "totals", numbers).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).write.parquet(f"{here}/totals")


def index_stream(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, files: int | None = None, size: int = 1000, overlap: int = 100) -> StreamingQuery:
    """Index the fixed chunks of every Parquet file that comes to ``source``; ends when all there are done.

    ``files`` is the most files of a batch. The checkpoint numbers the batches, and a number that is run again after
    a failure replaces what it had written.
    """
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    chunks = fixed_chunks(reader.parquet(source), size, overlap)
    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: append(df, path, i, ["doc_id", "chunk_index"])).trigger(availableNow=True).start()
