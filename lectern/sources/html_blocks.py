"""Raw HTML as positioned blocks, what reading order, page assembly and the contents detector take.

A page is laid out as a simple flow: block elements stand under each other in the width of a sheet, lists and quotes
are indented, the cells of a table's row stand beside each other, and a sheet that is full begins another. A block's
height follows from its text's length and its tag's size. Scripts, styles, comments and the head have no blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.sources.workers import importable

#: A sheet's size and margin in points, the width of a character and the height of a line as shares of its size.
WIDTH, HEIGHT, MARGIN, INDENT, WIDE, TALL = 612.0, 792.0, 36.0, 18.0, 0.5, 1.2
#: Size of a tag's letters; all others have the last.
SIZES = {"h1": 24.0, "h2": 18.0, "h3": 14.0, "h4": 12.0}
SIZE = 10.0
#: Elements whose text is no text of the page; the first two never hold elements.
SKIPPED = {"script", "style", "head", "template", "noscript"}
#: Elements that begin and end a block.
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
INDENTED = {"ul", "ol", "blockquote", "dl"}

#: A character reference that a semicolon ends, or an ampersand alone.
REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")

SCHEMA = "doc string, page int, block_no long, x0 double, y0 double, x1 double, y1 double, text string, page_width double, tag string"


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.text: list[str] = []
        self.cells: list[tuple[str, str]] | None = None
        self.skipped, self.indent, self.tag, self.sheet, self.y = 0, 0, "", 1, MARGIN

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.skipped = 0  # a head that never ends
        if tag in SKIPPED:
            self.flush()
            self.skipped += 1
        elif tag in BREAKS:
            self.flush()
            self.tag = tag if tag != "br" else self.tag
            self.indent += tag in INDENTED
            if tag == "tr":
                self.row()
                self.cells = []

    def handle_startendtag(self, tag, attrs):
        if tag in BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in BREAKS:
            self.flush()
            self.indent = max(0, self.indent - (tag in INDENTED))
            self.tag = ""
            if tag in ("tr", "table"):
                self.row()

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            if self.cells is not None:
                self.cells.append((text, self.tag))
            else:
                self.place([(text, self.tag)])

    def row(self):
        cells, self.cells = self.cells, None
        if cells:
            self.place(cells)

    def place(self, cells: list[tuple[str, str]]):
        """Cells beside each other, each in its share of the width."""
        left = min(MARGIN + INDENT * self.indent, WIDTH / 2)
        room = (WIDTH - MARGIN - left) / len(cells)
        laid = []
        for k, (text, tag) in enumerate(cells):
            size = SIZES.get(tag, SIZE)
            wide = len(text) * size * WIDE
            lines = max(1, -int(-wide // room))
            laid.append((left + k * room, left + k * room + min(wide, room), lines * size * TALL, text, tag))
        tall = max(x[2] for x in laid)
        if self.y + tall > HEIGHT - MARGIN and self.y > MARGIN:
            self.sheet, self.y = self.sheet + 1, MARGIN
        for x0, x1, height, text, tag in laid:
            self.rows.append((self.sheet, len(self.rows), x0, self.y, x1, self.y + height, text, WIDTH, tag))
        self.y += tall + SIZE * (TALL - 1)

    def done(self) -> list[tuple]:
        if self.rawdata.startswith("<"):  # a tag or comment that never ends
            self.rawdata = ""
        self.close()
        self.flush()
        self.row()
        return self.rows


def only_ended(html: str) -> str:
    """``html`` with all ampersands escaped but those of known references that a semicolon ends."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def page_blocks(html: str | None, ended: bool = False) -> list[tuple]:
    """(page, block_no, x0, y0, x1, y1, text, page_width, tag) of one page of HTML, in the order of the source.

    Null and empty HTML has none. Tags that don't match close what they can; text outside of all elements is a block;
    a tag or comment that never ends is dropped with what follows it. Character references are read as browsers do,
    ``&amp`` without its semicolon too; with ``ended`` such a one stays as it is written.
    """
    parser = _Blocks()
    parser.feed(only_ended(html or "") if ended else html or "")
    return parser.done()


def _batch(ids: list, htmls: list, ended: bool = False) -> pa.RecordBatch:
    rows = [(None if i is None else str(i), *b) for i, h in zip(ids, htmls, strict=True) for b in page_blocks(h, ended)]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", ended: bool = False) -> DataFrame:
    """Blocks (SCHEMA) of rows of HTML; ``doc`` is the id as text. Rows that repeat have their blocks again. ``ended`` as
    in page_blocks()."""
    importable(pages.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for at in range(0, f.num_rows, 64):
                part = f.slice(at, 64)
                yield _batch(part.column(0).to_pylist(), part.column(1).to_pylist(), ended)

    return pages.select(id_col, html_col).mapInArrow(run, SCHEMA)


class _Groups(InputPartition):
    """Row groups of one Parquet file."""

    def __init__(self, file: str, groups: list[int]):
        super().__init__((file, tuple(groups)))
        self.file, self.groups = file, groups


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _files(self):
        import pyarrow.fs

        found, path = pyarrow.fs.FileSystem.from_uri(self.options["path"])
        info = found.get_file_info(path)
        selector = pyarrow.fs.FileSelector(path, recursive=True)
        files = [path] if info.type == pyarrow.fs.FileType.File else [f.path for f in found.get_file_info(selector) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(".parquet")]
        return found, sorted(files)

    def partitions(self):
        import pyarrow.parquet as pq

        found, files = self._files()
        each, out = int(self.options.get("rowgroups", "1")), []
        for f in files:
            n = pq.ParquetFile(f, filesystem=found).num_row_groups
            out += [_Groups(f, list(range(a, min(n, a + each)))) for a in range(0, n, each)]
        return out or [_Groups("", [])]

    def read(self, partition):
        import pyarrow.parquet as pq

        if not partition.groups:
            return
        found, _ = self._files()
        ids, html = self.options.get("id", "page_id"), self.options.get("html", "html")
        for b in pq.ParquetFile(partition.file, filesystem=found).iter_batches(64, row_groups=partition.groups, columns=[ids, html]):
            at = {c: b.column(k).to_pylist() for k, c in enumerate(b.schema.names)}
            yield _batch(at[ids], at[html])


class HtmlBlocks(DataSource):
    """spark.read.format("html_blocks").load(path): blocks of a Parquet file or folder of HTML, a partition for each
    ``rowGroups`` row groups; options ``id`` and ``html`` name the columns. For folders that pyarrow can open; a table
    of any other store is read by Spark and given to html_blocks()."""

    @classmethod
    def name(cls):
        return "html_blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    importable(spark).dataSource.register(HtmlBlocks)


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc, page, text, is_toc) of HTML pages, their blocks in reading order."""
    from lectern.operators import layout

    return layout.pages(layout.reading_order(html_blocks(pages.where(F.col(id_col).isNotNull()), id_col, html_col)))
