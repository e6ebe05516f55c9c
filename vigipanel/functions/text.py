"""Text cells: cleaning, unaccenting, codes inside text, composite ids."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import as_col


def clean_text(value) -> Column:
    """Null becomes '', surrounding white space goes."""
    return F.regexp_replace(F.coalesce(as_col(value).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def strip_decimal_tail(value) -> Column:
    """Codes read through a numeric cell end in '.0'; drop that tail."""
    return F.regexp_replace(as_col(value), r"\.0$", "")


def flatten_space(value) -> Column:
    """Every run of white space becomes one blank; null becomes ''."""
    flat = F.regexp_replace(F.coalesce(as_col(value).cast("string"), F.lit("")), r"(?U)\s+", " ")
    return F.trim(flat)


def _latin_tables() -> tuple[str, str, dict[str, str]]:
    """Base letters of accented Latin letters, derived from Unicode decomposition."""
    single_from, single_to, several = [], [], {}
    for low, high in ((0x00A0, 0x024F), (0x1E00, 0x1EFF), (0xFF01, 0xFF5E)):
        for point in range(low, high + 1):
            char = chr(point)
            plain = "".join(
                c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
            )
            if plain == char:
                continue
            if len(plain) == 1:
                single_from.append(char)
                single_to.append(plain)
            else:
                several[char] = plain
    # marks have no counterpart, so ``translate`` drops them
    marks = "".join(chr(p) for p in range(0x0300, sys.maxunicode + 1) if unicodedata.combining(chr(p)))
    return "".join(single_from) + marks, "".join(single_to), several


_ACCENTED, _PLAIN, _EXPANDED = _latin_tables()


def unaccent(value) -> Column:
    """Compatibility decomposition without combining marks, for Latin text.

    Stays JVM-side: plain replacements for the few letters that expand, then one
    ``translate`` for letters with one base letter and for the marks of all
    scripts.  Text without such characters passes both quickly.
    """
    text = as_col(value)
    for char, plain in _EXPANDED.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return F.translate(text, _ACCENTED, _PLAIN)


def normalise_name(value) -> Column:
    """Unaccented, single-spaced, upper case; blank gives null (a quality violation)."""
    return F.nullif(F.upper(flatten_space(unaccent(value))), F.lit(""))


def leading_code(value, digits: int = 6) -> Column:
    """The code in front of ``code name``; '' when there is none."""
    return F.regexp_extract(F.trim(as_col(value)), rf"^(\d{{{digits}}})\s+", 1)


def name_after_code(value, digits: int = 6) -> Column:
    """The name behind ``code name``; the whole text when no code leads it."""
    return F.trim(F.regexp_replace(F.trim(as_col(value)), rf"^\d{{{digits}}}\s+", ""))


def codes_in(value, pattern: str = fv.INFORMATION_CODE_PATTERN) -> Column:
    """All codes in the text, in order, repeats kept."""
    return F.regexp_extract_all(as_col(value), F.lit(pattern), F.lit(0))


def joined_codes(value, pattern: str = fv.INFORMATION_CODE_PATTERN) -> Column:
    """Codes without repeats, first appearance first, joined by '|'."""
    return F.array_join(F.array_distinct(codes_in(value, pattern)), "|")


def correspondence_class(value, pattern: str = fv.INFORMATION_CODE_PATTERN) -> Column:
    """None identified, composed, direct, or for manual review."""
    text = as_col(value)
    found = F.size(codes_in(text, pattern))
    return (
        F.when(F.lower(text) == fv.NOT_IDENTIFIED, fv.CORRESPONDENCE_NONE)
        .when((found > 1) | text.contains("+") | text.contains(" - "), fv.CORRESPONDENCE_COMPOSED)
        .when(found == 1, fv.CORRESPONDENCE_DIRECT)
        .otherwise(fv.CORRESPONDENCE_MANUAL)
    )


def version_label(number) -> Column:
    return F.format_string("v%02d", as_col(number).cast("int"))


def composite_id(*parts) -> Column:
    return F.concat_ws(":", *[as_col(part) for part in parts])


def source_of_path(path) -> Column:
    """Source name by the first rule whose marker the path holds."""
    lowered = F.lower(as_col(path))
    result = None
    for markers, name in fv.SOURCE_RULES:
        test = lowered.contains(markers[0])
        for marker in markers[1:]:
            test = test | lowered.contains(marker)
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise(fv.SOURCE_DEFAULT)
