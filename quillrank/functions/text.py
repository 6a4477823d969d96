"""Text expressions: folding, whitespace, phrases, markup text, number format."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space to trim, and as a pattern: the plain class of the JVM is ASCII only.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
# One or more white space characters of any script; the separators 1C to 1F count too.
SPACES = r"(?U:[\s\x{1C}-\x{1F}]+)"
# Letters, numbers and underscore of any script; combining marks are not part of a word.
WORD = r"\p{L}\p{N}_"
HIDDEN_MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!doctype[^>]*>"
)
TAG = r"<[^>]*>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it.

    For values read several times inside array lambdas, where Spark does not
    share common subexpressions by itself.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_null(c: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(c, F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def fold(c: Column) -> Column:
    """Caseless form. Covers lower case and sharp s, not every full case fold."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fold_text(value: str) -> str:
    """``fold`` for a settings value on the driver."""
    return value.lower().replace("ß", "ss")


def is_word_char(char: str) -> bool:
    return char.isalnum() or char == "_"


def spaced(value: str) -> str:
    """A term as it looks in ``padded_words`` text: every other character is a blank."""
    return " " + "".join(ch if is_word_char(ch) else " " for ch in value) + " "


def padded_words(c: Column) -> Column:
    """Text whose non-word characters are blanks, so a whole word is ``' word '``."""
    return F.concat(F.lit(" "), F.regexp_replace(c, f"[^{WORD} ]", " "), F.lit(" "))


def phrase_pattern(term: str) -> str:
    return rf"(?<![{WORD}])\Q{term}\E(?![{WORD}])"


def contains_any(c: Column, needles) -> Column:
    """True when the caseless text of ``c`` has any needle as a plain substring."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(fold_text(needle)))
    return found


def joined_fold(*parts: Column) -> Column:
    return fold(F.concat_ws(" ", *[text_or_empty(p) for p in parts]))


def _entity_table() -> Column:
    # One literal, not thousands: it folds to a constant map before the job starts.
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


# Names that count without a closing semicolon, longest first.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def decode_entities(c: Column) -> Column:
    """Decode numeric and named character references, with or without ``;`` as HTML has it."""
    reference = r"^(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)"
    table = _entity_table()

    def with_ref(part: Column, index: Column) -> Column:
        ref = F.when(index > 0, F.regexp_extract(part, reference, 1)).otherwise(F.lit(""))
        # A name that is none as a whole may begin with one that needs no semicolon.
        known = ref.startswith("#") | F.map_contains_key(table, ref)
        bare = F.regexp_extract(ref, f"^({_BARE_NAMES})", 1)
        return F.struct(part.alias("part"), index.alias("index"), F.when(known, ref).otherwise(bare).alias("ref"))

    def with_code(p: Column) -> Column:
        number = F.rtrim(p.ref, F.lit(";"))
        digits = F.when(
            F.lower(number).startswith("#x"), F.conv(F.substring(number, 3, 6), 16, 10)
        ).when(number.startswith("#"), F.substring(number, 2, 7))
        return F.struct(p.part, p["index"].alias("index"), p.ref, digits.try_cast("int").alias("code"))

    def with_char(p: Column) -> Column:
        valid = p.code.between(1, 0xD7FF) | p.code.between(0xE000, 0x10FFFF)
        numeric = F.decode(F.unhex(F.lpad(F.hex(p.code), 8, "0")), "UTF-32")
        named = F.when(~p.ref.startswith("#"), F.try_element_at(table, p.ref))
        char = F.when(p.ref != "", F.when(valid, numeric).otherwise(named))
        return F.struct(p.part, p["index"].alias("index"), p.ref, char.alias("char"))

    def piece(p: Column) -> Column:
        rest = F.substring(p.part, F.length(p.ref) + 1, F.length(p.part))
        return F.when(p["index"] == 0, p.part).otherwise(
            F.coalesce(F.concat(p.char, rest), F.concat(F.lit("&"), p.part))
        )

    pieces = F.transform(F.transform(F.transform(F.split(c, "&"), with_ref), with_code), with_char)
    decoded = F.array_join(F.transform(pieces, piece), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def without_hidden(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN_MARKUP, "")


def visible_pieces(html: Column) -> Column:
    """Stripped, non-empty text nodes in document order."""
    nodes = F.transform(F.split(html, TAG), lambda t: strip(decode_entities(t)))
    return F.filter(nodes, lambda t: t != "")


def visible_text(html: Column) -> Column:
    """Text nodes joined by one blank."""
    return F.array_join(visible_pieces(html), " ")


def short_number(c: Column) -> Column:
    """Shortest form with six significant digits: 18, 18.5, 1e+06."""
    size = F.abs(c)
    fixed = F.lit(None).cast("string")
    for limit, digits in ((1e-3, 9), (1e-2, 8), (1e-1, 7), (1, 6), (10, 5), (1e2, 4), (1e3, 3), (1e4, 2), (1e5, 1), (999999.5, 0)):
        step = F.when(size < limit, c.cast(f"decimal(18,{digits})").cast("string"))
        fixed = F.coalesce(fixed, step)
    fixed = F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1")
    power = F.regexp_replace(F.format_string("%.5e", c), r"\.?0+e", "e")
    text = F.when((size < 1e-4) | (size >= 999999.5), power).otherwise(F.regexp_replace(fixed, r"\.$", ""))
    return F.when(size == 0, F.lit("0")).otherwise(text)
