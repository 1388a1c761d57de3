"""Label documents: sections, typed blocks and plain text out of HTML pages and structured XML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import bounded_batches
from ..storage import stored

#: Section codes whose text is about storage, and about preparation.
STORAGE_CODES, PREPARATION_CODES = ("44425-7", "34069-5", "42229-5"), ("34068-7", "42238-6")
#: Stems of storage and preparation. They end at a word's end, so that other forms of a word don't match.
STORAGE = r"(?i)\b(?:store|storage|refriger|freez|room temperature|protect from light)\b"
PREPARATION = r"(?i)\b(?:reconstitut|dilut|prepar|admix|mix|withdraw|inject|infus)\b"
#: Characters and blocks of a batch of parsed blocks; one page's blocks may be more.
BATCH_CHARACTERS, BATCH_BLOCKS = 1 << 20, 20_000


class _Blocks(HTMLParser):
    """Blocks of a page in order: (section, title, kind, text)."""

    KINDS = {"p": "body", "li": "list_item", "td": "table", "th": "table", "h1": "title", "h2": "subheading", "h3": "subheading", "b": "subheading"}
    SECTIONS = ("nav", "article", "footer", "header", "section", "aside", "main")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections, self.kind, self.text, self.title, self.out, self.skip = [""], None, [], "", [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.SECTIONS:
            self._close()
            self.sections.append(tag)
        elif tag in self.KINDS and not (tag == "b" and self.kind):
            self._close()
            self.kind = self.KINDS[tag]
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in self.SECTIONS:
            self._close()
            if len(self.sections) > 1:
                self.sections.pop()
        elif tag in self.KINDS:
            self._close()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def _close(self):
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        kind, self.kind, self.text = self.kind, None, []
        if text:
            kind = kind or "body"
            if kind == "title":
                self.title = text
            if kind == "body" and re.match(r"(?:step\s*)?[0-9]+[.)]\s", text, re.I):
                kind = "numbered_step"
            elif kind == "body" and re.match(r"(?:caution|warning)\b", text, re.I):
                kind = "caution"
            elif kind == "body" and re.match(r"note\b", text, re.I):
                kind = "note"
            self.out.append((self.sections[-1], self.title, kind, text))

    def close(self):
        super().close()
        self._close()


def html_blocks(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """id, ordinal, section, title, kind, text of each block of each page. Pages are parsed one by one, by what their own text holds, and come and go
    in small batches, so that a worker's memory doesn't grow with their number."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size = [], 0
        for batch in batches:
            for i, html in zip(batch["id"], batch["html"], strict=True):
                parser = _Blocks()
                parser.feed(html.as_py() or "")
                parser.close()
                blocks += [(i.as_py(), n, *block) for n, block in enumerate(parser.out)]
                size += sum(len(block[-1]) for block in parser.out)
                if size > BATCH_CHARACTERS or len(blocks) > BATCH_BLOCKS:
                    yield table(blocks)
                    blocks, size = [], 0
        if blocks:
            yield table(blocks)

    def table(blocks: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), types, strict=True)], ["id", "ordinal", "section", "title", "kind", "text"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).alias("html"))
    return rows.mapInArrow(parse, "id long, ordinal int, section string, title string, kind string, text string")


def xml_sections(labels: DataFrame, id_column: str = "setid", xml_column: str = "xml") -> DataFrame:
    """The sections of the documents that can be read, as of `tried_sections`."""
    return tried_sections(labels, id_column, xml_column).where("error IS NULL AND ordinal IS NOT NULL").drop("error")


def failed_documents(labels: DataFrame, id_column: str = "setid", xml_column: str = "xml") -> DataFrame:
    """id, error of the documents that can't be read, and why."""
    return tried_sections(labels, id_column, xml_column).where("error IS NOT NULL").select("id", "error")


def tried_sections(labels: DataFrame, id_column: str = "setid", xml_column: str = "xml") -> DataFrame:
    """id, error, ordinal, path (codes from the outermost section on), code, title (an untitled one has its nearest titled ancestor's),
    text of each section of a structured label, in document order. A document that is null, blank or broken has one row
    with the reason as error; a sound one without sections has one row of nulls."""
    import xml.etree.ElementTree as ET

    def local(e) -> str:
        return e.tag.rsplit("}", 1)[-1]

    def walk(e, path: list[str], title: str) -> Iterator[tuple[str, str, str, str]]:
        for child in e:
            if local(child) != "section":
                yield from walk(child, path, title)
                continue
            own = {local(x): x for x in child}
            code = own["code"].get("code", "") if "code" in own else ""
            name = " ".join("".join(own["title"].itertext()).split()) if "title" in own else ""
            text = " ".join("".join(own["text"].itertext()).split()) if "text" in own else ""
            yield "/".join([*path, code]), code, name or title, text
            yield from walk(child, [*path, code], name or title)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, xml in zip(batch["id"], batch["xml"], strict=True):
                try:
                    found = list(walk(ET.fromstring(xml), [], "")) if isinstance(xml, str) and xml.strip() else None
                    error = None if found is not None else "no document"
                except (ET.ParseError, ValueError, RecursionError) as e:
                    found, error = None, f"{type(e).__name__}: {e}"
                rows += [(i, error, n, *s) for n, s in enumerate(found)] if found else [(i, error, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["id", "error", "ordinal", "path", "code", "title", "text"]).astype({"ordinal": "Int32"})

    rows = labels.select(F.col(id_column).cast("string").alias("id"), F.col(xml_column).alias("xml"))
    return rows.mapInPandas(parse, "id string, error string, ordinal int, path string, code string, title string, text string")


def write_sections(labels: DataFrame, folder: str, id_column: str = "setid", xml_column: str = "xml") -> DataFrame:
    """Writes one JSON document of sections for each readable label to folder/labels and the others with their reasons to folder/failed,
    and returns the counts (documents, sections, failed, of which each label is in one). A document's sections are gathered by its id; rows
    that share an id are one label. An existing folder is replaced, so a run that stopped can be run again."""
    tried = stored(tried_sections(labels, id_column, xml_column), "sections")
    good = tried.where("error IS NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "path", "code", "title", "text")))).alias("sections"))
    good.write.mode("overwrite").json(f"{folder}/labels")
    tried.where("error IS NOT NULL").select("id", "error").write.mode("overwrite").json(f"{folder}/failed")
    count = lambda c: F.count_distinct(F.when(c, F.col("id")))
    return tried.agg(count(F.col("error").isNull()).alias("documents"), F.count("ordinal").alias("sections"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def tags(text: Column, path: Column | None = None) -> Column:
    """storage and preparation, by words or by a section code on the way."""
    codes = F.split(path, "/") if path is not None else F.array().cast("array<string>")
    under = lambda wanted: F.arrays_overlap(codes, F.array(*map(F.lit, wanted)))
    return F.array_compact(F.array(F.when(text.rlike(STORAGE) | under(STORAGE_CODES), "storage"), F.when(text.rlike(PREPARATION) | under(PREPARATION_CODES), "preparation")))


def regions(blocks: DataFrame) -> DataFrame:
    """id, region, first, last, n, kinds: a region is a subheading with what follows up to the next one; a running count
    of subheadings numbers them."""
    w = Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("region", F.sum(F.col("kind").isin("subheading", "title").cast("int")).over(w))
    return b.groupBy("id", "region").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def plain_text(blocks: DataFrame) -> DataFrame:
    """id, text: a document's blocks in order, one to a line."""
    return blocks.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))
