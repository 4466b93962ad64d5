"""Page HTML → text, as built-in string expressions (no HTML library, no Python).

Text nodes are the pieces between tags; each is stripped of whitespace after its character references
are decoded, dropped when empty, and the pieces are joined by one space — the behaviour of a parser's
`get_text(separator=' ', strip=True)`. Comments are not text. Script and style bodies are
dropped by default (`keep_code=True` keeps them as the reference's parser does).

Character references follow the HTML standard: all named ones (a parameter; by default the standard's
list as Python's own library has it), the longest name that fits where the semicolon is missing, decimal and
hexadecimal numbers, the standard's replacements for numbers that are no characters. A name is
looked up in an array of small maps by its hash, so a reference costs a few comparisons.
"""
from __future__ import annotations

import html as _standard
import json
from collections.abc import Mapping
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lexicons import WS_CLASS, WS_CHARS

MARK = "\u0000"
SLOTS = 256          # maps that the names are spread over
# what follows an ampersand and is a reference: a number, or a name with or without its semicolon
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _slot(name: str) -> int:
    """Polynomial hash of a name, computed alike in Spark (`_slot_of`)."""
    return sum(ord(c) * (31 + 7 * i) for i, c in enumerate(name[:8])) % SLOTS


def _slot_of(name: Column) -> Column:
    total = F.lit(0)
    for i in range(8):
        total = total + F.ascii(F.substring(name, i + 1, 1)) * (31 + 7 * i)
    return total % SLOTS


def _literal(value, kind: str) -> Column:
    """A constant of any size as one literal (its JSON text, parsed once when the plan is optimised)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@lru_cache(4)
def _slots(names: tuple[tuple[str, str], ...]) -> tuple:
    slots: list[dict[str, str]] = [{} for _ in range(SLOTS)]
    for name, text in names:
        slots[_slot(name)][name] = text
    return tuple(tuple(s.items()) for s in slots)


def _numbers() -> dict[int, str]:
    """Numbers of one to five digits that don't stand for the character of that number."""
    found = {n: _standard.unescape(f"&#{n};") for n in (*range(0x00, 0x20), *range(0x7F, 0xA0), 0xFFFE, 0xFFFF, *range(0xFDD0, 0xFDF0))}
    return {n: x for n, x in found.items() if x != chr(n)}


def _character(number: Column) -> Column:
    """The text of a numeric reference."""
    odd = _literal({str(n): x for n, x in _numbers().items()}, "map<string,string>")
    plane_end = number.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE
    utf = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (F.when(number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("�"))
            .when(((number < 0xA0) | number.between(0xFDD0, 0xFDEF) | number.between(0xFFFE, 0xFFFF)) & F.map_contains_key(odd, number.cast("string")),
                  F.element_at(odd, number.cast("string")))
            .when((number > 0xFFFF) & plane_end, F.lit(""))
            .otherwise(utf))


def _named(name: Column, names: Mapping[str, str]) -> Column:
    """The text of a named reference and what follows the part of it that is a name; null if none is."""
    table = _literal([dict(s) for s in _slots(tuple(sorted(names.items())))], "array<map<string,string>>")

    def found(x: Column) -> Column:
        return F.get(table, _slot_of(x))[x]
    lengths = sorted({len(n) for n in names if not n.endswith(";")}, reverse=True)
    shorter = [F.when(F.length(name) > k, F.concat(found(F.substring(name, 1, k)), F.substring(name, F.lit(k + 1), F.length(name)))) for k in lengths]
    return F.coalesce(found(name), *shorter)


def decode_references(text, names: Mapping[str, str] = html5) -> Column:
    """`text` with its character references decoded (once each: `&amp;lt;` gives `&lt;`). A text
    without an ampersand is returned as it is."""
    c = _c(text)
    found = F.regexp_extract_all(c, F.lit(REFERENCE), 1)
    between = F.split(c, REFERENCE)

    def decoded(ref: Column) -> Column:
        digits = F.concat(F.lit("0"), F.ltrim(F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1), F.lit("0")))
        fits = F.length(digits) <= 9        # more digits are beyond any character
        number = F.when(fits & ref.rlike("^#[xX]"), F.conv(F.when(fits, digits), 16, 10).cast("long")).when(fits, digits.try_cast("long"))
        return F.when(ref.startswith("#"), _character(number)).otherwise(F.coalesce(_named(ref, names), F.concat(F.lit("&"), ref)))
    pieces = F.zip_with(between, F.concat(F.transform(found, decoded), F.array(F.lit(""))), lambda b, r: F.concat(b, F.coalesce(r, F.lit(""))))
    return F.when(F.instr(c, "&") > 0, F.array_join(pieces, "")).otherwise(c)


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def page_text(html, keep_code: bool = False, names: Mapping[str, str] = html5) -> Column:
    h = F.regexp_replace(_c(html), r"(?s)<!--.*?-->", MARK)
    if not keep_code:
        h = F.regexp_replace(h, r"(?is)<script\b[^>]*>.*?</script\s*>", MARK)
        h = F.regexp_replace(h, r"(?is)<style\b[^>]*>.*?</style\s*>", MARK)
    h = F.regexp_replace(h, r"(?s)<[^>]*>", MARK)
    pieces = F.transform(F.split(h, MARK), lambda p: strip_ws(decode_references(p, names)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


# FIXED VALUES — the references that the check's SQL knows, stated apart from the operator's table.
SQL_REFERENCES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"),
]


def page_text_sql(html: str) -> str:
    """The same in DuckDB SQL (for oracle checks), for pages with the references above."""
    h = f"regexp_replace({html}, '(?s)<!--.*?-->', chr(0), 'g')"
    h = f"regexp_replace({h}, '(?is)<script\\b[^>]*>.*?</script\\s*>', chr(0), 'g')"
    h = f"regexp_replace({h}, '(?is)<style\\b[^>]*>.*?</style\\s*>', chr(0), 'g')"
    h = f"regexp_replace({h}, '(?s)<[^>]*>', chr(0), 'g')"
    dec = "p"
    for k, v in SQL_REFERENCES:
        vv = v.replace("'", "''")
        if ord(v[0]) > 127:
            vv = f"' || chr({ord(v[0])}) || '"
        dec = f"replace({dec}, '{k}', '{vv}')"
    strip = f"regexp_replace({dec}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')"
    return f"array_to_string([y for y in [{strip} for p in string_split({h}, chr(0))] if y <> ''], ' ')"
