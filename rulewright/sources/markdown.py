"""Documents as evidence blocks: files, pages, sections and their numbering."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.functions.schemas import bound
from rulewright.functions.text import compatible
from rulewright.operators.prefix import running
from rulewright.session import ship

#: White space as Unicode has it, with the four separators that control characters are.
_SPACE = r"[\s\x1c-\x1f]"
#: Fixed: page breaks, headings and list items.
_PAGE_BREAK = rf"(?U){_SPACE}*<!--{_SPACE}*PAGE_BREAK{_SPACE}*-->{_SPACE}*|\f"
_HEADING = r"(?s)^(#{1,6})[ \t]+(.+?)[ \t]*\z"
_ITEM = r"(?s)^[ \t]*[-*+][ \t]+(.+)\z"
#: Between a line's end and the next line.
_LINES = r"(?<=[\n\x0b\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Columns path, name, stem, format, size, sha256, content of a folder's .md and .pdf files; anything else in it is an error."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    files = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), suffix.alias("format"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    odd = files.filter(~F.col("format").isin("md", "pdf")).limit(1).count()
    if odd:
        raise ValueError(f"{folder} holds files that are neither .md nor .pdf")
    return files


def select_files(files: DataFrame, limit: int = 20_000_000) -> DataFrame:
    """files with a name that repeats kept once; names that differ in content, two files of one stem and format, and more than `limit` bytes in all are errors."""
    clash = files.groupBy(F.lower("name").alias("key")).agg(F.countDistinct("sha256").alias("n")).filter("n > 1").limit(1).count()
    if clash:
        raise ValueError("files of one name differ")
    kept = files.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("path"))).filter("_n = 1").drop("_n")
    if kept.groupBy("stem", "format").count().filter("count > 1").limit(1).count():
        raise ValueError("two files have the same stem and format")
    if (kept.agg(F.sum("size")).first()[0] or 0) > limit:
        raise ValueError(f"the files exceed {limit} bytes")
    return kept


def document_set_hash(files: DataFrame, parser: str = "documents-v1", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (by: one for each value of these columns), hash: of the canonical JSON of parser, sources and pairing; folders don't enter."""
    entry = lambda n: F.concat(F.lit('{"format":"'), n["format"], F.lit('","name":"'), n["name"], F.lit('","sha256":"'), n["sha256"], F.lit('"}'))
    one = files.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("name", "format", "sha256"))).alias("s"), F.array_sort(F.collect_set("stem")).alias("p"))
    text = F.concat(F.lit('{"pairing":["'), F.array_join("p", '","'), F.lit(f'"],"parser":"{parser}","sources":['), F.array_join(F.transform("s", entry), ","), F.lit("]}"))
    return one.select(*by, F.sha2(text, 256).alias("hash"))


def _lines(text: Column) -> Column:
    """Array of page, raw (the line with its end), marks (of a heading), title (of a heading or an item), kind: heading, item, blank or plain."""

    def line(raw: Column, page: Column) -> Column:
        bare = F.regexp_replace(raw, r"[\r\n]+\z", "")
        marks, item = F.regexp_extract(bare, _HEADING, 1), F.regexp_extract(bare, _ITEM, 1)
        kind = F.when(marks != "", "heading").when(item != "", "item").when(strip(bare) == "", "blank").otherwise("plain")
        title = F.when(marks != "", F.regexp_extract(bare, _HEADING, 2)).otherwise(item)
        return F.struct(page.alias("page"), raw.alias("raw"), F.length(marks).alias("level"), strip(title).alias("title"), kind.alias("kind"))

    pages = F.split(F.regexp_replace(text, "^\ufeff", ""), _PAGE_BREAK, -1)
    return F.flatten(F.transform(pages, lambda p, i: F.transform(F.split(p, _LINES, -1), lambda raw: line(raw, i + 1))))


def _pieces(lines: Column) -> Column:
    """Array of page, kind, level, text: runs of plain lines of one page joined, every other line for itself; what has no text but headings is left out."""

    def cut(kinds: Column, pages: Column, raws: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(kinds) - 1)
        begins = F.filter(at, lambda i: (F.get(kinds, i) != "plain") | ~F.equal_null(F.get(kinds, i - 1), F.lit("plain")) | (F.get(pages, i) != F.get(pages, i - 1)))

        def piece(begin: Column, end: Column) -> Column:
            run = strip(F.array_join(F.slice(raws, begin + 1, end - begin), ""))
            first = F.get(lines, begin)
            return F.struct(first["page"].alias("page"), first["kind"].alias("kind"), first["level"].alias("level"), F.when(first["kind"] == "plain", run).otherwise(first["title"]).alias("text"))

        return bound(begins, lambda b: F.transform(b, lambda begin, j: piece(begin, F.coalesce(F.get(b, j + 1), F.size(kinds)))))

    pieces = bound(lines["kind"], lambda k: bound(lines["page"], lambda p: bound(lines["raw"], lambda r: cut(k, p, r))))
    return F.filter(pieces, lambda x: (x["kind"] == "heading") | (x["kind"] != "blank") & (x["text"] != ""))


def _sections(pieces: Column) -> Column:
    """Array of page, section_path, text: the pieces between headings, with the path that the headings before them make."""
    none = F.array().cast("array<string>")

    def paths(headings: Column) -> Column:
        """The path after each heading; one before all."""
        longer = lambda done, h: F.concat(done, F.array(F.concat(F.slice(F.element_at(done, -1), F.lit(1), h["level"] - 1), F.array(h["text"]))))
        return F.aggregate(headings, F.array(none), longer)

    def filled(ends: Column, path: Column) -> Column:
        inside = lambda begin, j: F.slice(pieces, begin + 1, F.get(ends, j + 1) - begin - 1)
        sections = F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda begin, j: F.transform(inside(begin, j), lambda x: F.struct(x["page"].alias("page"), F.get(path, j).alias("section_path"), x["text"].alias("text"))))
        return F.flatten(sections)

    heads = F.filter(F.transform(pieces, lambda x, i: F.when(x["kind"] == "heading", i + 1)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(0)), heads, F.array(F.size(pieces) + 1))
    return bound(ends, lambda e: bound(paths(F.filter(pieces, lambda x: x["kind"] == "heading")), lambda p: filled(e, p)))


def blocks_of(text: Column) -> Column:
    """Array of page, section_path, text of a Markdown text's blocks, by functions on arrays alone: no shuffle, and time in proportion to the text."""
    return bound(_lines(text), lambda lines: bound(_pieces(lines), _sections))


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """Columns of documents but text, then page, section_path, pos, text: the blocks of each Markdown text.

    A heading cuts the section path to its level less one and adds itself, each list item is a block, an
    empty line or a page's end closes a paragraph. The path goes on over page breaks.
    """
    others = [c for c in documents.columns if c != "text"]
    return documents.select(*others, F.posexplode(blocks_of(F.col("text"))).alias("pos", "b")).select(*others, "b.page", "b.section_path", "pos", "b.text")


def without_text(documents: DataFrame) -> DataFrame:
    """The Markdown documents that have no block, which can't be used as evidence."""
    return documents.filter(F.coalesce(F.size(blocks_of(F.col("text"))), F.lit(0)) <= 0)


def number_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (stem, page, section_path, pos, text) with document_id, ordinal and block_id: documents numbered by stem, blocks through each document."""
    stems = running(blocks.select("stem").distinct(), [F.col("stem")], {"before": F.lit(1)}, "stems").select("stem", (F.col("before") + 1).alias("n"))
    own = Window.partitionBy("stem").orderBy("page", "pos")
    numbered = blocks.join(stems, "stem").withColumn("document_id", F.format_string("DOC-%02d", "n")).withColumn("ordinal", F.row_number().over(own))
    return numbered.withColumn("block_id", F.format_string("%s-P%03d-B%03d", "document_id", "page", "ordinal")).drop("n")


def full_context(blocks: DataFrame) -> DataFrame:
    """Columns document_id, context: a document's blocks in order, each after its id."""
    entry = F.struct("ordinal", F.concat(F.lit("["), "block_id", F.lit("] "), "text").alias("t"))
    return blocks.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "\n").alias("context"))


def paired_blocks(blocks: DataFrame, pages: DataFrame, stems: list[str]) -> DataFrame:
    """blocks with those of the given stems (documents that come as Markdown and as PDF) as their extracted pages have them.

    A document without pages or with a blank one, another number of pages than the Markdown has, and a block that its page doesn't hold in order are errors.
    """
    own = pages.filter(F.col("stem").isin(stems))
    if bad := blank_pages(own).limit(1).collect():
        raise ValueError(f"{bad[0]['stem']} has a page without text")
    counts = blocks.filter(F.col("stem").isin(stems)).groupBy("stem").agg(F.max("page").alias("n")).join(own.groupBy("stem").agg(F.max("page").alias("m"), F.countDistinct("page").alias("k")), "stem", "full_outer")
    known = counts.filter("n = m and m = k").select("stem").collect()  # a row for each document of one set
    if other := sorted(set(stems) - {r["stem"] for r in known}):
        raise ValueError(f"{other[0]} has other pages as PDF than as Markdown")
    aligned = align_to_pages(blocks.filter(F.col("stem").isin(stems)).select("stem", "page", "section_path", "pos", "text"), own)
    if lost := aligned.filter("text is null").limit(1).collect():
        raise ValueError(f"{lost[0]['stem']} has a block that page {lost[0]['page']} of its PDF does not hold")
    names = blocks.select("stem", *[c for c in blocks.columns if c not in ("stem", "page", "section_path", "pos", "text")]).distinct()
    return blocks.filter(~F.col("stem").isin(stems)).unionByName(aligned.join(names, "stem"))


def blank_pages(pages: DataFrame) -> DataFrame:
    """Columns stem: documents (stem, page, text of extracted pages) with a page without text, which can't be used."""
    return pages.filter(strip(F.coalesce("text", F.lit(""))) == "").select("stem").distinct()


def _form(character: str) -> str:
    """A character in compatible form without white space."""
    return "".join(unicodedata.normalize("NFKC", character).split())


@functools.lru_cache(1)
def _lengths() -> tuple[np.ndarray, np.ndarray]:
    """For every code point the length of its form, and whether that is another character."""
    forms = [_form(chr(p)) for p in range(sys.maxunicode + 1)]
    return np.array([len(f) for f in forms], np.uint8), np.array([bool(f) and f != chr(p) for p, f in enumerate(forms)])


def _folded(page: str) -> tuple[str, np.ndarray]:
    """The page in compatible form without white space, and for each character of that the one of the page that it comes from."""
    points = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32)
    length, other = (table[points] for table in _lengths())
    if other.any():
        return "".join(map(_form, page)), np.repeat(np.arange(len(points)), length)
    kept = np.flatnonzero(length)
    return points[kept].tobytes().decode("utf-32-le", "surrogatepass"), kept


def _in_order(page: str | None, keys: list[str]) -> list[str | None]:
    """The page's own text of each key, one after the other; None where the rest of the page doesn't hold it from one whole character to another."""
    flat, origin = _folded(page or "")
    out: list[str | None] = []
    rest = 0
    for key in keys:
        at = flat.find(key, rest) if key else -1
        own = page[origin[at] : origin[at + len(key) - 1] + 1] if at >= 0 else None
        if own is not None and _folded(own)[0] != key:
            own = None
        rest = rest if own is None else at + len(key)
        out.append(own)
    return out


def align_to_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Columns stem, page, section_path, pos, text: each Markdown block as its page has it, found in order whatever the layout; text is NULL where it isn't found, or only within what one character stands for.

    blocks: stem, page, section_path, pos, text; pages: stem, page, text (of an extracted PDF). One page is aligned at a time.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [_in_order(page, keys) for page, keys in zip(rows.column("source").to_pylist(), rows.column("keys").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("stem", "page", "poss", "paths")), pa.array(texts, pa.list_(pa.string()))], names=["stem", "page", "poss", "paths", "texts"])

    ship(blocks.sparkSession)
    key = F.regexp_replace(compatible("text"), rf"(?U){_SPACE}+", "")
    keyed = F.array_sort(F.collect_list(F.struct("pos", "key", "section_path")))
    by_page = blocks.withColumn("key", key).groupBy("stem", "page").agg(keyed.alias("b")).join(pages.select("stem", "page", F.col("text").alias("source")), ["stem", "page"], "left")
    found = by_page.select("stem", "page", "source", F.col("b.key").alias("keys"), F.col("b.pos").alias("poss"), F.col("b.section_path").alias("paths")).mapInArrow(align, "stem string, page int, poss array<int>, paths array<array<string>>, texts array<string>")
    return found.select("stem", "page", F.explode(F.arrays_zip("paths", "poss", "texts")).alias("x")).select("stem", "page", F.col("x.paths").alias("section_path"), F.col("x.poss").alias("pos"), F.col("x.texts").alias("text"))
