"""TEI documents: paragraphs with quoted spans, quote and data-set statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import CANONICAL, resolve_source
from ..sources.files import write_dataset
from ..sources.shared import written

TEI = "{http://www.tei-c.org/ns/1.0}"


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _walk(element: ElementTree.Element) -> list:
    """Text pieces and (open or close, quote number, source) marks, depth first; nesting of any depth."""
    pieces: list = []
    todo: list = [element]  # elements to enter, and pieces that follow them
    while todo:
        item = todo.pop()
        if not isinstance(item, ElementTree.Element):
            pieces.append(item)
            continue
        name = _local(item.tag)
        if name == "note" and item.get("type") == "source":
            continue
        source = item.get("source") if name == "quote" else None
        if source is not None:
            number = len(pieces)
            pieces.append(("open", number, source))
            todo.append(("close", number, source))
        pieces.append(item.text or "" if isinstance(item.tag, str) else "")
        for child in reversed(item):
            todo += [child.tail or "", child]
    return pieces


#: What a document is parsed to: a row a paragraph, its text in pieces with the marks where quotes with a source open and close, and one row with
#: ``para_no`` -1 with the sources of all quotes, the error, and the number of paragraphs of the document.
PARSED = "problem_id string, para_no int, pieces array<struct<mark:string,number:int,text:string>>, sources array<string>, error string, paragraphs int"
Parsed = tuple[str, int, list[tuple[str | None, int | None, str]] | None, list[str] | None, str | None, int | None]


def _pieces(element: ElementTree.Element) -> list[tuple[str | None, int | None, str]]:
    out: list[tuple[str | None, int | None, str]] = []
    for text, group in groupby(_walk(element), lambda x: isinstance(x, str)):
        out += [(None, None, "".join(group))] if text else list(group)
    return out


def parse(problem: str, blocks: Iterable[bytes | str]) -> Iterator[Parsed]:
    """The ``PARSED`` rows of one document, given in blocks, in one pass; only the paragraph that is open is held.

    Paragraphs are those of the first body, a paragraph within another one after it. A document that does not parse gives its paragraphs up to
    there and the row with the error.
    """
    parser = ElementTree.XMLPullParser(("start", "end"))
    open_: list[ElementTree.Element] = []
    body, depth, number, sources = None, 0, 0, []
    try:
        for block in chain(blocks, [None]):
            parser.feed(block) if block is not None else parser.close()
            for event, element in parser.read_events():
                if event == "start":
                    if element.tag == f"{TEI}body" and body is None and open_:
                        body = element
                    depth += element.tag == f"{TEI}p" and body is not None and (depth > 0 or body in open_)
                    if element.tag == f"{TEI}quote" and element.get("source") is not None:
                        sources.append(element.get("source"))
                    open_.append(element)
                    continue
                open_.pop()
                if element.tag == f"{TEI}p" and depth:
                    depth -= 1
                    if not depth:
                        for p in element.iter(f"{TEI}p"):
                            yield problem, number, _pieces(p), None, None, None
                            number += 1
                if not depth and open_:
                    open_[-1].remove(element)
    except (ElementTree.ParseError, ValueError) as e:
        yield problem, -1, None, [], str(e), number
        return
    yield problem, -1, None, sources, None, number


def parsed_documents(documents: DataFrame) -> DataFrame:
    """``PARSED`` rows of (problem_id, xml); a document that does not parse, or is null, is its error only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.struct([("mark", pa.string()), ("number", pa.int32()), ("text", pa.string())])
        kinds = (pa.string(), pa.int32(), pa.list_(piece), pa.list_(pa.string()), pa.string(), pa.int32())
        for batch in batches:
            for row in range(batch.num_rows):  # a document may be large
                problem, xml = (batch.column(c)[row].as_py() for c in ("problem_id", "xml"))
                rows = list(parse(problem, [xml])) if xml is not None else [(problem, -1, None, [], "no document", 0)]
                rows = rows if rows[-1][4] is None else rows[-1:]
                columns = list(zip(*rows, strict=True))
                columns[2] = [None if x is None else [dict(zip(("mark", "number", "text"), y, strict=True)) for y in x] for x in columns[2]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["problem_id", "para_no", "pieces", "sources", "error", "paragraphs"])

    return documents.select("problem_id", "xml").mapInArrow(run, PARSED)


def paragraph(pieces: list[dict]) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """(text with white space collapsed, spans with their references). Quotes with references part words and give spans.

    A span starts at the length of the text so far, so the blank that joins it to the text before is inside.
    """
    words, size, open_at, spans, glued = [], 0, {}, [], ""

    def flush(text: str) -> None:
        nonlocal size
        for word in text.split():
            size += len(word) + (1 if words else 0)
            words.append(word)

    for piece in pieces:
        if piece["mark"] is None:
            glued += piece["text"]
        elif piece["references"]:
            flush(glued)
            glued = ""
            if piece["mark"] == "open":
                open_at[piece["number"]] = size
            elif open_at[piece["number"]] < size:
                spans.append((open_at[piece["number"]], size, piece["text"], piece["references"]))
    flush(glued)
    return " ".join(words), [(a, b, refs) for a, b, _, refs in sorted(spans)]


def quote_sources(documents: DataFrame) -> DataFrame:
    """(problem_id, sources, error): the ``source`` of every TEI quote that has one; one row per document."""
    return parsed_documents(documents).where("para_no < 0").select("problem_id", "sources", "error")


def paragraphs(documents: DataFrame, books: dict[str, str], codes: list[str], on_error: str = "fail") -> DataFrame:
    """(problem_id, para_no, text, spans, error) of (problem_id, xml) documents, or of ``PARSED`` rows; spans carry their resolved references. A file
    without paragraphs, or one that does not parse, is one row with ``para_no`` -1 and no text; other files have no such row.

    A document is parsed once: the sources of its quotes are resolved as expressions on the parsed pieces, and text and spans are made of these.
    """
    parsed = parsed_documents(documents) if "xml" in documents.columns else documents
    references = lambda p: F.when(p["mark"].isNotNull(), resolve_source(p["text"], books, codes, on_error)["references"])
    rows = parsed.withColumn("pieces", F.transform("pieces", lambda p: F.struct(p["mark"], p["number"], p["text"], references(p).alias("references"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("references", pa.list_(pa.string()))])
        for batch in batches:
            out = []
            for problem, number, pieces, error, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number >= 0:
                    text, spans = paragraph(pieces)
                    out.append((problem, number, text, [{"start": a, "end": b, "references": r} for a, b, r in spans], None))
                elif error is not None or not count:
                    out.append((problem, -1, None, [], error))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.list_(span), pa.string()), strict=True)],
                                             names=["problem_id", "para_no", "text", "spans", "error"])

    return rows.select("problem_id", "para_no", "pieces", "error", "paragraphs").mapInArrow(
        run, "problem_id string, para_no int, text string, spans array<struct<start:int,end:int,references:array<string>>>, error string")


def paragraph_offsets(rows: DataFrame) -> DataFrame:
    """Add ``offset``: where a paragraph starts when all of a document are joined by a newline."""
    before = Window.partitionBy("problem_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where("para_no >= 0").withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))


def document_spans(rows: DataFrame) -> DataFrame:
    """(problem_id, span_index, span_start, span_end, resolved_references) in document order."""
    spans = paragraph_offsets(rows.where("error IS NULL")).select("problem_id", "para_no", "offset", F.explode("spans").alias("s"))
    order = Window.partitionBy("problem_id").orderBy("para_no", "s.start", "s.end")
    return spans.select("problem_id", (F.row_number().over(order) - 1).cast("int").alias("span_index"),
                        (F.col("offset") + F.col("s.start")).alias("span_start"), (F.col("offset") + F.col("s.end")).alias("span_end"),
                        F.col("s.references").alias("resolved_references"))


def document_texts(rows: DataFrame) -> DataFrame:
    """(problem_id, text) of documents with at least one span."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), "\n")
    texts = rows.where("para_no >= 0").groupBy("problem_id").agg(joined.alias("text"), F.sum(F.size("spans")).alias("n"))
    return texts.where("n > 0").drop("n")


def quote_statistics(documents: DataFrame, books: dict[str, str]) -> DataFrame:
    """(problem_id, quotes, mapped, error) per file: quotes with a source, and those with a token whose part before ``_`` is mapped."""
    edges = " ,;:.()\\[\\]{}<>\"'"
    token = lambda t: F.substring_index(F.regexp_replace(t, f"^[{edges}]+|[{edges}]+$", ""), "_", 1)
    mapped = F.filter("sources", lambda s: F.exists(F.split(s, r"(?U)\s+"), lambda t: token(t).isin(*books)))
    return quote_sources(documents).select("problem_id", F.size("sources").alias("quotes"), F.size(mapped).alias("mapped"), "error")


def quote_totals(documents: DataFrame, books: dict[str, str]) -> DataFrame:
    """One row: files, parse_errors, files_with_quotes, quotes, mapped, files_mapped."""
    return quote_statistics(documents, books).agg(
        F.count("*").alias("files"), F.count("error").alias("parse_errors"), F.count_if(F.col("quotes") > 0).alias("files_with_quotes"),
        F.sum("quotes").alias("quotes"), F.sum("mapped").alias("mapped"), F.count_if(F.col("mapped") > 0).alias("files_mapped"))


def files_by_count(statistics: DataFrame, count: str = "quotes") -> DataFrame:
    """(problem_id, count) of files that have any, most first, then by name."""
    return statistics.where(F.col(count) > 0).select("problem_id", count).orderBy(F.desc(count), "problem_id")


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """One row: files, files_with_spans, spans, verses, books, pairs, parse_errors. Every file that was read counts.

    Summed by document first, so that each distinct count expands one row per document and reference at most.
    """
    files = rows.groupBy("problem_id").agg(F.sum(F.size("spans")).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad")).agg(
        F.count("*").alias("files"), F.count_if(F.col("n") > 0).alias("files_with_spans"), F.coalesce(F.sum("n"), F.lit(0)).alias("spans"),
        F.count_if(F.col("bad") > 0).alias("parse_errors"))
    refs = rows.select("problem_id", F.explode("spans.references").alias("l")).select("problem_id", F.explode("l").alias("reference")).distinct()
    verses = refs.groupBy("reference").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("verses"), F.countDistinct(F.regexp_extract("reference", CANONICAL, 1)).alias("books"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return files.join(F.broadcast(verses)).select("files", "files_with_spans", "spans", "verses", "books", "pairs", "parse_errors")


def build_dataset(documents: DataFrame, books: dict[str, str], codes: list[str], folder: str, on_error: str = "fail") -> DataFrame:
    """The whole job: parse, resolve, write problems and spans, and give the statistics of all files read."""
    rows = written(paragraphs(documents, books, codes, on_error), "tei-paragraphs")
    write_dataset(document_texts(rows), document_spans(rows), folder)
    return dataset_statistics(rows)
