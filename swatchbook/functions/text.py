"""Text cleaning, pre-tokenising, phrases and sequence framing."""

from __future__ import annotations

import html
import json
import string
import zlib
from collections.abc import Callable
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN_PATTERN = (
    r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
)
CONTEXT_LENGTH = 77
PAD_ID = 0
TEMPLATES = (
    "a {category} made by {brand} {color_pattern} {attribute_pattern} {gender_pattern}. {short_description}",
    "a {category} made by {brand} {attribute_pattern}; {color_pattern} {gender_pattern}. {short_description}",
    "{color} {category} {attribute_pattern} from {brand} {gender_pattern}. {short_description}",
)


# White space as Unicode defines it, and the separator controls
# that only count at the ends of a text.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
END_SPACES = SPACES + "\x1c\x1d\x1e\x1f"


def strip(text: Column) -> Column:
    """Remove white space and separator controls of any script at both ends."""
    return F.btrim(text, F.lit(END_SPACES))


def squeeze(text: Column) -> Column:
    """Every run of white space, of any script, becomes one space."""
    return F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " ")


# A character reference: a number, or up to 32 characters that could be a name.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "\ufffd"
# Parts of the table of references, so that a look-up compares a handful of keys.
SLOTS = 512


def _reference_table() -> Column:
    """The strings of all names, and of the numbers that are not their own code point, as a literal.

    Made from the standard library; a key lies in the slot of its CRC-32.
    """
    odd = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | end for p in range(17) for end in (0xFFFE, 0xFFFF))]
    strings = dict(entities.html5)
    strings |= {f"#{n}": html.unescape(f"&#{n};") for n in odd if html.unescape(f"&#{n};") != chr(n)}
    slots: list[dict[str, str]] = [{} for _ in range(SLOTS)]
    for key, value in strings.items():
        slots[zlib.crc32(key.encode()) % SLOTS][key] = value
    # Constant, so it is parsed once, when the query is planned.
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")


def _in_table(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(SLOTS)).cast("int")), key)


def _character(code: Column) -> Column:
    """The character of a code point; the byte-order mark in front is not part of it."""
    point = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
    return F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT).otherwise(point)


def _code_point(name: Column) -> Column:
    """The number of ``#65;`` or ``#x41;``; above all code points if it has too many digits."""
    digits = lambda start: F.regexp_extract(name, f"^{start}0*([0-9a-fA-F]*)", 1)
    number = lambda d, base: F.when(F.length(d) > 7, F.lit(0x110000).cast("bigint")).otherwise(
        F.conv(F.concat(F.lit("0"), d), base, 10).cast("bigint")
    )
    return F.when(name.rlike("^#[xX]"), number(digits("#[xX]"), 16)).otherwise(number(digits("#"), 10))


def _resolved(reference: Column, table: Column) -> Column:
    """What a reference stands for: by number, by name, or by the longest old name that it begins with."""
    name = F.substr(reference, F.lit(2))
    code = _code_point(name)
    by_number = F.coalesce(_in_table(table, F.concat(F.lit("#"), code.cast("string"))), _character(code))
    # Names that count without their semicolon, longest first.
    old = sorted((n for n in entities.html5 if not n.endswith(";")), key=len, reverse=True)
    begin = F.regexp_extract(name, f"^(?:{'|'.join(old)})", 0)
    by_begin = F.when(begin == "", reference).otherwise(
        F.concat(_in_table(table, begin), F.substr(name, F.length(begin) + 1))
    )
    return F.when(name.startswith("#"), by_number).otherwise(F.coalesce(_in_table(table, name), by_begin))


def unescape(text: Column) -> Column:
    """Resolve HTML character references, twice, as ``html.unescape`` does; null stays null."""
    table = _reference_table()

    def once(t: Column) -> Column:
        between = F.split(t, REFERENCE, -1)
        found = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        pieces = F.zip_with(between, found, lambda b, r: F.concat(b, F.coalesce(_resolved(r, table), F.lit(""))))
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    # An array of one text, so that its pieces come from a value and not from the expression again.
    twice = F.transform(F.transform(F.array(text), once), once)
    return F.when(text.contains("&"), F.element_at(twice, 1)).otherwise(text)


def clean_text(text: Column, repair: Callable[[Column], Column] | None = None) -> Column:
    """Unescape, strip, squeeze white space and lower-case.

    ``repair`` is an optional expression applied first, e.g. an encoding fixer.
    """
    fixed = repair(text) if repair else text
    return F.lower(strip(squeeze(strip(unescape(fixed)))))


def pretokenize(text: Column) -> Column:
    """Split cleaned text into words, contractions, single digits and symbol runs.

    Read without regard to case, no class of the pattern holds U+0345, a mark
    whose upper case is a letter: it is left out and ends a run. The JVM's
    classes say so only when told.
    """
    return F.regexp_extract_all(text, F.lit("(?iU)" + TOKEN_PATTERN.replace(r"[^\s", r"[^\x{345}\s")), F.lit(0))


def frame_ids(ids: Column, start_id: int, end_id: int, length: int = CONTEXT_LENGTH) -> Column:
    """Start id, ids, end id, padded with zeros or cut to ``length``."""
    padding = F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), F.lit(length - 2) - F.size(ids)))
    whole = F.concat(F.array(F.lit(start_id)), ids, F.array(F.lit(end_id)), padding)
    return F.slice(whole, 1, length)


def framed_size(ids: Column) -> Column:
    """Number of ids of the whole text, start and end id included."""
    return F.size(ids) + 2


def loses_end(ids: Column, length: int = CONTEXT_LENGTH) -> Column:
    """Whether the frame is too short, so that the end id is cut off."""
    return framed_size(ids) > length


def end_position(ids: Column) -> Column:
    """Zero-based place of the largest id, i.e. of the end id when it is present."""
    return (F.array_position(ids, F.array_max(ids)) - 1).cast("int")


def list_phrase(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``: lower-cased."""
    size = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), ", ")
    many = F.concat(head, F.lit(" and "), F.try_element_at(items, F.lit(-1)))
    return F.lower(F.when(size == 1, F.try_element_at(items, F.lit(1))).otherwise(many))


def slot_phrase(prefix: str, items: Column) -> Column:
    """``prefix`` and the listed items; empty when there is nothing to list."""
    first = F.try_element_at(items, F.lit(1))
    return F.when(first.isNull(), F.lit("")).otherwise(strip(F.concat(F.lit(prefix + " "), list_phrase(items))))


def fill(template: str, slots: dict[str, Column]) -> Column:
    """A sentence template as one string expression."""
    parts: list[Column] = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot:
            parts.append(slots[slot])
    return F.concat(*parts)


def slot_columns(drop_missing: bool = False) -> dict[str, Column]:
    """The filled slots of a product's sentence, from its facet columns.

    A missing category or brand is written as ``None``; with ``drop_missing``
    it leaves an empty slot.
    """
    missing = F.lit("" if drop_missing else "None")
    return {
        "category": F.coalesce("desc_category", missing),
        "brand": F.coalesce("desc_brand", missing),
        "gender_pattern": slot_phrase("for", F.array("desc_gender")),
        "color_pattern": slot_phrase("color", F.array("desc_color")),
        "color": slot_phrase("", F.array("desc_color")),
        "attribute_pattern": slot_phrase("with", F.col("attribute_values")),
        "short_description": slot_phrase("", F.array("product_short_description")),
    }


def sentence(choice: Column) -> Column:
    """The template number ``choice``, filled from columns named after the slots."""
    slots = {name: F.col(name) for name in slot_columns()}
    picked = F.when(choice == 0, fill(TEMPLATES[0], slots))
    for i, template in enumerate(TEMPLATES[1:], start=1):
        picked = picked.when(choice == i, fill(template, slots))
    return strip(picked)


def template_by_key(key: Column) -> Column:
    return F.pmod(key, F.lit(len(TEMPLATES)))


def template_by_seed(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(TEMPLATES)))
