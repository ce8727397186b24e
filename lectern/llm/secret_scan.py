"""Secret scans (3, native): base patterns everywhere, weak parts only where complementary parts co-occur.

The base kinds (assign, access, hex) are reported as they match. The method adds parts that say little
alone: login names (weak_id), long random-looking strings (weak_secret) and endpoints (endpoint). Each is
reported if a part that complements it lies within SCOPE code points of it in the same text: an
identifier (access or weak_id) and a secret (assign, hex or weak_secret) complement each other, and an
endpoint needs one of either that is a base part or a weak one that is itself reported. Parts meet in an equi-join on text and cell of SCOPE code points, the
neighbouring cells included, with the distance as the rest of the condition; a cell holds few parts, so
a text full of secrets makes no quadratic join.

Regular expressions give texts, not places, in Spark SQL: matches are marked with two control characters
(which are first replaced in the text by a third that no pattern takes), the text is split at the marks,
and the places follow from the lengths.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, small, stored, table, text_or_empty

#: The base kinds in their order, as given. Group 1 is what stands before the value.
ASSIGN = r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]+)"
HEX = r"()([0-9a-f]{24,}+)"
#: The added kinds.
WEAK_ID = r"""((?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9_.@-]+)"""
WEAK_SECRET = r"()((?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2})"
ENDPOINT = r"()(https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+)"
#: kind, pattern, least characters of the match's value, substrings without all of which the pattern can't
#: match (or, for weak secrets, no complementary part can), so that most texts are spared the search.
BASE = [("assign", ASSIGN, 6, ":="), ("access", ACCESS, 20, ["AKIA"]), ("hex", HEX, 24, [])]
ADDED = [("weak_id", WEAK_ID, 3, ":="), ("weak_secret", WEAK_SECRET, 32, [":", "=", "AKIA"]), ("endpoint", ENDPOINT, 10, ["://"])]
ORDER = [x[0] for x in BASE + ADDED]
#: Code points between two parts of one scope, at most.
SCOPE = 200

_OPEN, _MID = "\x01", "\x02"


#: Items that a running value is carried over at a time.
RUN = 128


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join) -> Column:
    """For each of an array's ints the ``join`` of all before it, from 0 on. Arrays are grown by RUN items at a
    time, blocks of items first and then their totals, so that a long array isn't copied once for each item."""

    def grown(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(items, start, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    count = F.ceil(F.size(values) / RUN).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: grown(F.slice(values, k * RUN + 1, RUN)))).otherwise(F.expr("cast(array() as array<struct<at:int,out:array<int>>>)"))
    return _let(blocks, lambda b: _let(grown(F.transform(b, lambda x: x["at"]))["out"], lambda ahead: F.flatten(F.transform(b, lambda x, k: F.transform(x["out"], lambda y: join(F.get(ahead, k), y))))))


def _spans(text: Column, pattern: str, least: int, kind: int, needs: list[str] | str) -> Column:
    """Array of (start, end, kind): the matches whose value has ``least`` characters or more."""
    has = functools.reduce(operator.or_, (F.contains(text, F.lit(x)) for x in needs), F.lit(not needs))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$1{_MID}$2{_OPEN}"))
    # Odd parts are matches; each is its two groups with a mark between.
    sizes = F.transform(F.split(marked, _OPEN, -1), lambda x, i: F.struct(F.when(i % 2 == 1, F.length(x) - 1).otherwise(F.length(x)).alias("n"), ((i % 2 == 1) & (F.length(x) - F.locate(_MID, x) >= least)).alias("hit")))

    def placed(parts: Column) -> Column:
        starts = _running(F.transform(parts, lambda x: x["n"]), lambda a, b: a + b)
        rows = F.transform(F.arrays_zip(parts.alias("part"), starts.alias("start")), lambda z: F.struct(z["start"].alias("start"), (z["start"] + z["part"]["n"]).alias("end"), F.lit(kind).alias("kind"), z["part"]["hit"].alias("hit")))
        return F.transform(F.filter(rows, lambda r: r["hit"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind")))

    # A text without a match is one part.
    return F.when(has, _let(sizes, lambda parts: F.when(F.size(parts) > 1, placed(parts)).otherwise(none))).otherwise(none)


def _sorted(spans: Column) -> Column:
    """By start, then by kind as listed."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _line(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id_col, key, base, spans): a hash of the text, and arrays of (start, end, kind) for each row of ``docs``; kinds are indexes of ORDER.

    Places are code points, the end exclusive, sorted by start and then by kind. A null or empty text has
    none. ``base`` holds the base kinds; ``spans`` also the weak parts that complementary ones confirm; a weak
    part that overlaps a base span is that span's and isn't reported again. Rows that repeat an id and its
    text get the same spans; a null id is as good as any. An empty table gives none.
    """
    clean = F.translate(text_or_empty(text_col), _OPEN + _MID, "\x03\x03")
    rows = docs.select(id_col, F.xxhash64(text_or_empty(text_col)).alias("key"), clean.alias("text"))
    kinds = {name: i for i, name in enumerate(ORDER)}
    found = rows.select(id_col, "key", *(_spans(F.col("text"), pattern, least, kinds[name], needs).alias(name) for name, pattern, least, needs in BASE + ADDED))
    found = found.select(id_col, "key", _sorted(F.concat(*(F.col(x[0]) for x in BASE))).alias("base"), F.concat(*(F.col(x[0]) for x in ADDED)).alias("weak"))
    found = stored(found, "spans")

    # Complementary parts of the texts that have weak ones.
    some = found.where(F.size("weak") > 0).select(id_col, "key", "base", "weak").distinct()
    parts = some.select(id_col, "key", F.explode(F.concat("base", "weak")).alias("p")).select(id_col, "key", "p.*")
    identifier, secret = [kinds["access"], kinds["weak_id"]], [kinds["assign"], kinds["hex"], kinds["weak_secret"]]
    role = F.when(F.col("kind").isin(identifier), 1).when(F.col("kind").isin(secret), 2).otherwise(4)
    parts = parts.withColumn("role", role)
    weak = parts.where(F.col("kind") >= len(BASE)).withColumn("cell", F.explode(F.expr(f"sequence(greatest(0, start - {scope} - 1) div {scope}, (end + {scope}) div {scope})")))

    def facing(some: DataFrame) -> DataFrame:
        return some.select(F.col(id_col).alias("i2"), F.col("key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2")).withColumn("c2", F.explode(F.expr(f"sequence(s2 div {scope}, (e2 - 1) div {scope})")))

    near = (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope)
    apart = (F.col("s2") >= F.col("end")) | (F.col("start") >= F.col("e2"))
    meets = F.col(id_col).eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")) & (F.col("cell") == F.col("c2")) & near & apart & (F.col("role") != F.col("r2"))
    credentials = stored(weak.where("role <> 4").join(facing(parts.where("role <> 4")), meets, "left_semi").drop("cell").distinct(), "confirmed")
    sure = parts.where(F.col("kind") < len(BASE)).unionByName(credentials)
    confirmed = credentials.unionByName(weak.where("role = 4").join(facing(sure), meets, "left_semi").drop("cell"))
    added = confirmed.select(id_col, "key", F.struct("start", "end", "kind").alias("p")).groupBy(id_col, "key").agg(F.collect_set("p").alias("more"))
    added = added.select(F.col(id_col).alias("i2"), F.col("key").alias("k2"), "more")
    out = found.join(added, F.col(id_col).eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")), "left")
    more = F.filter(F.coalesce(F.col("more"), F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")), lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.select(id_col, "key", "base", F.when(F.size(more) > 0, _sorted(F.concat("base", more))).otherwise(F.col("base")).alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and listing of secret_spans() for each row, repeated rows and rows without id as any. A null or
    empty text has no spans: counts of 0, the digest of an empty line, an empty listing. An empty table gives none."""
    found = secret_spans(docs, id_col, text_col)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(id_col, *(n(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of spans (overlapping ones as one) replaced by ``mark``; all rows stay.

    A null text stays null. A column n_chars, if there is one, is counted anew where the text changed. Other
    columns stay as they are, whatever their names. An empty table gives none.
    """
    own_id, own_key, own_spans, clean = fresh(docs, "secret_id", "secret_key", "secret_spans", "clean_text")
    found = secret_spans(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias(own_id), F.col("key").alias(own_key), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(own_spans)).distinct()
    found = stored(found, "secrets")
    joined = docs.join(small(found, weight=F.size(own_spans) + 1), F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(own_key)), "left")
    # Four bytes a code point, so that a place is found without walking to it.
    letters = F.encode(F.col(text_col), "UTF-32")
    part = lambda whole, a, b: F.decode(whole.substr((4 * a + 1).cast("int"), (4 * F.greatest(b - a, F.lit(0))).cast("int")), "UTF-32")

    def replaced(whole: Column, spans: Column, done: Column) -> Column:
        # ``done`` holds how far the spans before reach; a span that begins there or later begins a stretch.
        rows = F.filter(F.transform(F.arrays_zip(spans.alias("span"), done.alias("done")), lambda z: F.struct(z["span"]["start"].alias("start"), z["done"].alias("done"))), lambda r: r["start"] >= r["done"])
        ahead = F.transform(rows, lambda r: part(whole, r["done"], r["start"]))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(ahead, mark), F.lit(mark), part(whole, last, F.length(F.col(text_col))))

    new = _let(letters, lambda whole: _let(_running(F.transform(own_spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda done: replaced(whole, F.col(own_spans), done)))
    changed = F.col(own_spans).isNotNull()
    out = joined.withColumn(clean, F.when(changed, new).otherwise(F.col(text_col)))
    columns = [F.col(clean).alias(c) if c == text_col else F.when(changed, F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
