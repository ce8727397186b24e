"""Clustered layout (12): a z-order of four coordinates, and how many files each row's query touches and matches.

1. Coordinates. The rows of each value are counted and summed up in the order of the values, in ranges, so that a
   coordinate is exact and no task has all values. As coordinates grow with their values, at most CELLS - 1 cuts a
   column are all that rows need.
2. Positions. Rows are sorted by (z, id) in ranges, and a range starts where the ones before it end.
3. Queries depend on a row's cell alone, of which there are CELLS ** 4 at most. Matching is a separable dilation:
   each file's occupied cells are bit masks over the date, one for each (file, source, lang, length); a sliding OR
   along the length, then along the date, gives all cells whose query the file answers, and each adds 1 there.
   Touched: each file's bounding box, as wide on both sides as a query reaches, adds 1 at its corners with
   alternating signs, and running sums along the four axes count the boxes over each cell.

Only cells, cuts and one number a range (bounded by CELLS and the number of partitions) are broadcast or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

#: Coordinates a column; a mask over one is an int.
CELLS, BITS = 16, 4
#: Rows of a file, and how far a query reaches along length and date.
FILE_ROWS, REACH = 1000, 2
AXES = ["x_source", "x_lang", "x_length", "x_date"]


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, Column]:
    """``df`` sorted in ranges and stored, with ``at``, its part and its place in the part; and the part."""
    ranged = df.repartitionByRange(_parts(df.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("at", F.monotonically_increasing_id()), name), F.shiftright("at", 33)


def _offsets(sizes: DataFrame) -> Column:
    """Where each part starts, of (part, size), which has a row for each partition; as a map from part to start."""
    starts, total = {}, 0
    for r in sorted(sizes.collect()):
        starts[r[0]] = total
        total += r[1]
    if not starts:
        return F.lit(0).cast("long")
    return F.element_at(F.create_map(*(F.lit(x) for p, s in starts.items() for x in (p, s))), F.shiftright("at", 33)).cast("long")


def cuts(values: DataFrame) -> list[list[tuple]]:
    """For each of the four value columns (source and lang as text, length and date as numbers), (coordinate,
    smallest value) in order. Coordinate: floor(CELLS * smaller rows / rows), null smallest."""
    kinds = [F.struct(F.lit(k).alias("kind"), (F.col(c) if k < 2 else F.lit(None).cast("string")).alias("s"), (F.col(c) if k > 1 else F.lit(None).cast("long")).alias("x")) for k, c in enumerate(["v_source", "v_lang", "v_length", "v_date"])]
    counted = values.select(F.explode(F.array(*kinds)).alias("v")).groupBy("v.kind", "v.s", "v.x").agg(F.count("*").alias("n"))
    ranged, part = _numbered(counted, ["kind", "s", "x"], "values")
    before = _offsets(ranged.groupBy(part.alias("part")).agg(F.sum("n").alias("size")))
    n = F.lit((ranged.where("kind = 0").agg(F.sum("n")).first()[0] or 0)).cast("long")
    running = F.sum("n").over(Window.partitionBy(part).orderBy("at")) - F.col("n")
    smaller = before + running - F.col("kind") * n
    coordinate = F.expr(f"({CELLS} * smaller) div n_rows")
    placed = ranged.withColumn("smaller", smaller).withColumn("n_rows", n).withColumn("c", coordinate)
    least = placed.groupBy("kind", "c").agg(F.min(F.struct("at", "s", "x")).alias("v")).collect()
    return [sorted((r.c, r.v.s if k < 2 else r.v.x) for r in least if r.kind == k) for k in range(4)]


def _coordinate(column: str, own: list[tuple]) -> Column:
    out = None
    for c, value in sorted(own, reverse=True):
        if c and value is not None:
            holds = F.col(column) >= F.lit(value)
            out = F.when(holds, c) if out is None else out.when(holds, c)
    return F.lit(0) if out is None else out.otherwise(0)


def z_value(axes: list[Column]) -> Column:
    """The coordinates' binary digits in turn, highest first."""
    z = F.lit(0).cast("long")
    for bit in range(BITS):
        for k, x in enumerate(axes):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(x, bit).bitwiseAND(F.lit(1)).cast("long"), 4 * bit + 3 - k))
    return z


def matching(placed: DataFrame) -> DataFrame:
    """(axes, files_matching) of every cell whose query some file answers; placed has file and axes."""
    source, lang, length, date = AXES
    mask = F.bit_or(F.expr(f"shiftleft(1, {date})"))
    grids = placed.groupBy("file", source, lang, length).agg(mask.alias("m"))
    near = F.sequence(F.greatest(F.col(length) - REACH, F.lit(0)), F.least(F.col(length) + REACH, F.lit(CELLS - 1)))
    wide = grids.withColumn(length, F.explode(near)).groupBy("file", source, lang, length).agg(F.bit_or("m").alias("m"))
    grown = F.col("m")
    for k in range(1, REACH + 1):
        grown = grown.bitwiseOR(F.shiftleft("m", k)).bitwiseOR(F.shiftright("m", k))
    # The cells of one (source, lang, length) are counted in one row, a sum for each date.
    sums = [F.sum(F.shiftright("g", k).bitwiseAND(F.lit(1))).alias(f"n{k}") for k in range(CELLS)]
    counted = wide.withColumn("g", grown).groupBy(source, lang, length).agg(*sums)
    cells = counted.select(source, lang, length, F.posexplode(F.array(*(F.col(f"n{k}") for k in range(CELLS)))).alias(date, "files_matching"))
    return cells.where("files_matching > 0")


def touched(bounds: DataFrame) -> DataFrame:
    """(axes, files_touched) of every cell whose query meets some file's box; bounds has lo_ and hi_ of each axis."""
    sides = []
    for k, a in enumerate(AXES):
        reach = REACH if k > 1 else 0
        low, past = F.greatest(F.col(f"lo_{a}") - reach, F.lit(0)), F.least(F.col(f"hi_{a}") + reach, F.lit(CELLS - 1)) + 1
        sides.append([(low, 1), (past, -1)])
    corners = [F.struct(*(x.cast("int").alias(a) for a, (x, _) in zip(AXES, c, strict=True)), F.lit(c[0][1] * c[1][1] * c[2][1] * c[3][1]).cast("long").alias("d")) for c in ((a, b, c, d) for a in sides[0] for b in sides[1] for c in sides[2] for d in sides[3])]
    at = bounds.select(F.explode(F.array(*corners)).alias("c")).select("c.*").where(" AND ".join(f"{a} < {CELLS}" for a in AXES))
    grid = at.groupBy(*AXES).agg(F.sum("d").alias("d"))
    for a in AXES:
        # A running sum along one axis: a line of the grid, CELLS numbers, lies in one row.
        others = [x for x in AXES if x != a]
        steps = [F.sum(F.when(F.col(a) <= k, F.col("d")).otherwise(0)).alias(f"n{k}") for k in range(CELLS)]
        lines = grid.groupBy(*others).agg(*steps)
        grid = lines.select(*others, F.posexplode(F.array(*(F.col(f"n{k}") for k in range(CELLS)))).alias(a, "d")).where("d <> 0")
    return grid.select(*AXES, F.col("d").alias("files_touched"))


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", file_rows: int = FILE_ROWS) -> DataFrame:
    """(id, z, position, file, files_touched, files_matching, file_bounds): a row for each of ``docs``.

    A null text has length -1, an empty one 0. Null sources and languages are the smallest, a null id has a null
    date, the smallest, and comes first in its cell. Rows that repeat an id get a position each. Texts are only
    measured, whatever their length; other columns of ``docs`` don't matter, whatever their names. An empty table
    gives none.
    """
    date = F.crc32(F.col(id_col).cast("string").cast("binary")) % 365
    length = F.coalesce(F.octet_length(text_col), F.lit(-1)).cast("long")
    values = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("v_source"), F.col(lang_col).alias("v_lang"), length.alias("v_length"), date.alias("v_date"))
    own = cuts(values)
    axes = [_coordinate(c, o) for c, o in zip(["v_source", "v_lang", "v_length", "v_date"], own, strict=True)]
    points = values.select("id", *(x.cast("int").alias(a) for a, x in zip(AXES, axes, strict=True))).withColumn("z", z_value([F.col(a) for a in AXES]))
    ranged, part = _numbered(points, ["z", "id"], "positions")
    position = _offsets(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"))) + F.col("at").bitwiseAND(F.lit(2**33 - 1))
    placed = ranged.withColumn("position", position).withColumn("file", F.expr(f"position div {int(file_rows)}")).drop("at")
    ends = [f(a).alias(f"{p}_{a}") for a in AXES for p, f in (("lo", F.min), ("hi", F.max))]
    cells = matching(placed).join(touched(placed.groupBy("file").agg(*ends)), AXES)
    cells = cells.withColumn("z", z_value([F.col(a) for a in AXES])).select("z", "files_touched", "files_matching")
    file = Window.partitionBy("file")
    bounds = F.concat_ws(",", *(f(a).over(file).cast("string") for a in AXES for f in (F.min, F.max)))
    # Cells with a row: CELLS ** 4 at most, whatever the input.
    held = cells.join(points_of(placed), "z", "left_semi")
    out = placed.withColumn("file_bounds", bounds).join(F.broadcast(held), "z")
    return out.select(F.col("id").alias(id_col), "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def points_of(placed: DataFrame) -> DataFrame:
    """The cells that have a row."""
    return placed.select("z").distinct()


def op12_zorder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(table(spark, sf_dir, "documents"))


#: CRC-32 of a string of ASCII digits, a byte and a bit at a time.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"

_VALUES = [("source", "source"), ("lang", "lang"), ("length", "coalesce(strlen(text), -1)"), ("date", f"{CRC32} % 365")]
ORACLE_SQL = {
    "op12_zorder_layout": f"""
        WITH v AS (SELECT doc_id, {", ".join(f"{e} AS v_{c}" for c, e in _VALUES)} FROM documents),
        x AS (SELECT doc_id, {", ".join(f"(16 * (rank() OVER (ORDER BY v_{c} NULLS FIRST) - 1)) // count(*) OVER () AS {c}" for c, _ in _VALUES)} FROM v),
        z AS (SELECT *, ({" + ".join(f"(({c} >> {b}) & 1) * {2 ** (4 * b + 3 - k)}" for b in range(4) for k, (c, _) in enumerate(_VALUES))})::BIGINT AS z FROM x),
        p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z),
        f AS (SELECT *, position // 1000 AS file FROM p),
        b AS (SELECT file, {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c, _ in _VALUES)} FROM f GROUP BY file),
        q AS (SELECT DISTINCT z, source, lang, length, date FROM f),
        t AS (SELECT q.z, count(*) AS files_touched FROM q JOIN b ON q.source BETWEEN lo_source AND hi_source AND q.lang BETWEEN lo_lang AND hi_lang
            AND q.length BETWEEN lo_length - 2 AND hi_length + 2 AND q.date BETWEEN lo_date - 2 AND hi_date + 2 GROUP BY q.z),
        m AS (SELECT q.z, count(DISTINCT o.file) AS files_matching FROM q JOIN (SELECT DISTINCT file, source, lang, length, date FROM f) o ON q.source = o.source AND q.lang = o.lang
            AND abs(q.length - o.length) <= 2 AND abs(q.date - o.date) <= 2 GROUP BY q.z)
        SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', {", ".join(f"lo_{c}, hi_{c}" for c, _ in _VALUES)}) AS file_bounds
        FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)
    """
}
