"""Fields of embedded JSON documents, read through the variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.text import text_or_null

_SCRIPT = r"(?is)<script\b[^>]*?\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def string_field(doc: Column, path: str) -> Column:
    """A field that must be a JSON string."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(kind(value) == "STRING", F.try_variant_get(doc, path, "string"))


def any_field(doc: Column, path: str) -> Column:
    """A scalar field as text; empty, zero and false count as missing."""
    value = F.try_variant_get(doc, path, "string")
    return F.when(~value.isin("", "0", "0.0", "false"), value)


def first_document(html: Column) -> Column:
    """First embedded document that is an object, as a variant.

    A list stands for its first element, an empty list or empty script for an
    empty object; unreadable scripts are passed over.
    """
    def candidate(body: Column) -> Column:
        doc = F.try_parse_json(body)
        shape = kind(doc)
        first = F.try_variant_get(doc, "$[0]", "variant")
        return (
            F.when(body == "", empty)
            .when(shape.startswith("OBJECT"), doc)
            .when(shape == "ARRAY<VOID>", F.coalesce(first, empty))
            .when(shape.startswith("ARRAY") & kind(first).startswith("OBJECT"), first)
        )

    empty = F.parse_json(F.lit("{}"))
    docs = F.transform(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), candidate)
    return F.get(F.array_compact(docs), F.lit(0))


def author_names(doc: Column) -> Column:
    """Author object → its name; author list → all names; anything else → NULL."""
    author = F.try_variant_get(doc, "$.author", "variant")
    people = F.try_variant_get(doc, "$.author", "array<variant>")
    names = F.transform(people, lambda p: F.try_variant_get(p, "$.name", "string"))
    joined = F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ", ")
    return F.when(
        kind(author).startswith("OBJECT"), F.try_variant_get(doc, "$.author.name", "string")
    ).when(kind(author).startswith("ARRAY"), text_or_null(joined))
