"""Column expressions over verse references, identifiers and offsets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of white space in Unicode, those cut from both ends of a source token, and the patterns of canonical and free-form references.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN_EDGES = r""" ,;:.()\[\]{}<>"'"""
CANONICAL = r"^([1-3]?[a-z]+)_(\d+):(\d+)$"
FREE_FORM = r"^([1-3]?[a-z]+)(?:[_\s-]?)(\d+):(\d+)(?:-(\d+))?$"


def strip(text: Column) -> Column:
    """Cut Unicode white space from both ends (``trim`` alone cuts blanks only)."""
    return F.btrim(text, F.lit(WHITE))


def normalize_reference(ref: Column) -> Column:
    return F.lower(strip(F.coalesce(ref, F.lit(""))))


def build_reference(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(F.lower(strip(book)), F.lit("_"), chapter.cast("string"), F.lit(":"), verse.cast("string"))


def normalize_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_alias(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^0-9a-z]+", "")


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.lit(None).cast("map<string,string>")


def expand_verse_spec(spec: Column) -> Column:
    """Struct (verses: array<int>, error): '7', '7-9'; anything else, or a descending range, is an error."""
    first = F.try_element_at(F.split(spec, "-"), F.lit(1)).try_cast("int")
    last = F.try_element_at(F.split(spec, "-"), F.lit(-1)).try_cast("int")
    good = F.coalesce(spec.rlike("^[0-9]+(-[0-9]+)?$") & (first <= last), F.lit(False))
    return F.struct(
        F.when(good, F.sequence(first, F.when(good, last))).otherwise(F.array().cast("array<int>")).alias("verses"),
        F.when(~good, F.concat(F.lit("bad verses: "), F.coalesce(spec, F.lit("")))).alias("error"))


def resolve_source(source: Column, books: Mapping[str, str], codes: Iterable[str], on_error: str = "fail") -> Column:
    """Struct (references: array<string>, errors: array<string>) of a source attribute.

    ``books`` maps abbreviations (case-sensitive) to book codes, ``codes`` are the known ones. Tokens without a
    mapped book or of another shape are skipped. Bad chapters, verses or codes are errors: with ``on_error="fail"`` they
    end the job, with ``"quarantine"`` they are returned.
    """
    known = F.array(*[F.lit(c) for c in sorted(codes)]).cast("array<string>")
    tokens = F.filter(
        F.transform(F.split(F.coalesce(source, F.lit("")), r"(?U)\s+"),
                    lambda t: F.regexp_replace(t, f"^[{TOKEN_EDGES}]+|[{TOKEN_EDGES}]+$", "")), lambda t: t != "")

    def resolved(token: Column) -> Column:
        token = F.regexp_replace(token, "(?i)^cf_", "")
        parts = F.split(token, "_")
        code = F.try_element_at(literal_map(books), F.get(parts, F.lit(0)))
        two = (F.size(parts) == 2) & F.contains(F.get(parts, F.lit(1)), F.lit(":"))
        chapter = F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).when(two, F.substring_index(F.get(parts, F.lit(1)), ":", 1))
        spec = F.when(F.size(parts) == 3, F.get(parts, F.lit(2))).when(
            two, F.regexp_extract(F.get(parts, F.lit(1)), "^[^:]*:(.*)$", 1))
        book = F.lower(strip(code))
        verses = expand_verse_spec(spec)
        error = (F.when(code.isNull() | chapter.isNull() | ~F.contains(token, F.lit("_")), F.lit(None).cast("string"))
                 .when(~chapter.rlike("^[0-9]+$"), F.concat(F.lit("bad chapter: "), token))
                 .when(book == "", F.concat(F.lit("blank code: "), token))
                 .when(~F.array_contains(known, book), F.concat(F.lit("unknown code: "), token))
                 .otherwise(verses["error"]))
        used = code.isNotNull() & chapter.isNotNull() & error.isNull()
        return F.struct(
            F.when(used, F.transform(verses["verses"], lambda v: build_reference(book, chapter.try_cast("int"), v)))
            .otherwise(F.array().cast("array<string>")).alias("references"), error.alias("error"))

    found = F.transform(tokens, resolved)
    errors = F.filter(F.transform(found, lambda x: x["error"]), lambda e: e.isNotNull())
    if on_error == "fail":
        errors = F.when(F.size(errors) > 0, F.raise_error(F.array_join(errors, "; ")).cast("array<string>")).otherwise(errors)
    return F.struct(F.array_distinct(F.flatten(F.transform(found, lambda x: x["references"]))).alias("references"),
                    errors.alias("errors"))


def split_candidates(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[;,|]\s*"), strip), lambda x: x != "")


def parse_free_form(raw: Column, aliases: Mapping[str, str], allowed: Iterable[str]) -> Column:
    """Struct (book, chapter, verse_start, verse_end) or null; a descending range is swapped."""
    text = F.translate(F.lower(strip(F.coalesce(raw, F.lit("")))), "–—−. ", "---")
    part = lambda i: F.regexp_extract(text, FREE_FORM, i)
    book = F.coalesce(F.try_element_at(literal_map(aliases), normalize_alias(part(1))), part(1))
    first = part(3).try_cast("int")
    last = F.coalesce(F.when(part(4) != "", part(4).try_cast("int")), first)
    good = text.rlike(FREE_FORM) & book.isin(*sorted(allowed)) & first.isNotNull() & last.isNotNull()
    return F.when(good, F.struct(book.alias("book"), part(2).try_cast("int").alias("chapter"),
                                 F.least(first, last).alias("verse_start"), F.greatest(first, last).alias("verse_end")))


def chunk_id(problem: Column, index: Column) -> Column:
    return F.concat(F.lit("task::"), problem, F.lit("::chunk::"), index.cast("string"))


def verse_id(reference: Column) -> Column:
    return F.concat(F.lit("bible::"), reference)


def parse_chunk_id(identifier: Column) -> Column:
    """Struct (problem_id, chunk_index) or null."""
    pattern = r"(?s)^task::(.+?)::chunk::(\d+)$"
    return F.when(identifier.rlike(pattern), F.struct(
        F.regexp_extract(identifier, pattern, 1).alias("problem_id"),
        F.regexp_extract(identifier, pattern, 2).cast("int").alias("chunk_index")))


def parse_verse_id(identifier: Column) -> Column:
    return F.when(F.startswith(identifier, F.lit("bible::")), normalize_reference(F.substring(identifier, 8, 2**31 - 1)))


def aligned_end(begin: Column, aligned: Column) -> Column:
    return begin + F.length(F.replace(aligned, F.lit("-"), F.lit("")))


def absolute_span(chunk_start: Column, start: Column, end: Column) -> Column:
    base = F.coalesce(chunk_start, F.lit(0))
    return F.struct((base + start).alias("span_start"), (base + end).alias("span_end"))


def parse_reference_list(text: Column) -> Column:
    """Sorted distinct normalised references of a list written with commas, semicolons or white space."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)[,;\s]+"), normalize_reference)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def normalize_reference_array(refs: Column) -> Column:
    parts = F.transform(F.coalesce(refs, F.array().cast("array<string>")), normalize_reference)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def collection_name(prefix: Column, provider: Column, model: Column) -> Column:
    def clean(part: Column) -> Column:
        text = F.lower(F.btrim(F.regexp_replace(F.coalesce(part, F.lit("")), "[^a-zA-Z0-9]+", "_"), F.lit("_")))
        return F.when(text == "", "default").otherwise(text)

    name = F.concat_ws("__", clean(prefix), clean(provider), clean(model))
    short = F.concat(F.rtrim(F.left(name, F.lit(51)), F.lit("_-")), F.lit("__"), F.left(F.sha1(name), F.lit(10)))
    return F.when(F.length(name) <= 63, name).otherwise(short)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")
