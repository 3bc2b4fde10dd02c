"""HTML columns: anchor and base tags of a page, attribute values, entities.

A page is scanned once by one pattern. All repetitions are possessive, so the
scan is linear and does not grow the stack, whatever the page contains.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.columns import let, strip

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_ATTRIBUTE = rf"""[\s/]*+[^\s=>/]++(?:\s*+=\s*+(?:{_VALUE})?+)?+"""
_OTHER_ATTRIBUTE = rf"""[\s/]*+(?!href[\s=/>])[^\s=>/]++(?:\s*+=\s*+(?:{_VALUE})?+)?+"""
_LINK_TAG = rf"(?:a|base)(?=[\s/>])(?:{_OTHER_ATTRIBUTE})*+[\s/]*+href\s*+=\s*+"

# comment | script | style | link tag up to its href value | any other tag
_TOKEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    rf"|script(?=[\s/>])(?:{_ATTRIBUTE})*+[\s/]*+>.*?(?:</script|\z)"
    rf"|style(?=[\s/>])(?:{_ATTRIBUTE})*+[\s/]*+>.*?(?:</style|\z)"
    rf"|({_LINK_TAG}{_VALUE})(?:{_ATTRIBUTE})*+[\s/]*+>?+"
    rf"|/?[a-z][^\s/>]*+(?:{_ATTRIBUTE})*+[\s/]*+>?+)"
)
_TAG_HREF = rf"(?is)^{_LINK_TAG}({_VALUE})\z"

_REFERENCE = (
    r"(?s)&#[xX][0-9a-fA-F]++;?|&#[0-9]++;?|&[A-Za-z][A-Za-z0-9]*+;|[^&]++|&"
)


def link_tags(html: Column) -> Column:
    """``<a href>`` and ``<base href>`` tags in document order, each cut behind
    its href value. Comments, scripts and styles do not count."""
    return F.filter(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(1)), lambda t: t != "")


def _code_point(digits: Column, base: int) -> Column:
    """Character with the given number; nothing where there is none."""
    number = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("bigint"))
    valid = (
        ((number >= 0x20) | number.isin(0x9, 0xA, 0xD))
        & ~number.between(0xD800, 0xDFFF)
        & ~number.isin(0xFFFE, 0xFFFF)
        & (number <= 0x10FFFF)
    )
    utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit(""))


def _named_characters() -> Column:
    """HTML 4 entity names (from the standard library's table) and ``apos``,
    as a map the optimizer folds to a constant."""
    names = {**name2codepoint, "apos": 0x27}
    pairs = "\x01".join(f"{name}\x02{chr(code)}" for name, code in names.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def decode_entities(text: Column) -> Column:
    """Replace character references; names need their semicolon."""
    named = _named_characters()

    def one(token: Column) -> Column:
        return (
            F.when(~token.startswith("&"), token)
            .when(
                token.rlike("^&#[xX]"),
                _code_point(F.regexp_extract(token, "^&#[xX]0*([0-9a-fA-F]*)", 1), 16),
            )
            .when(
                token.startswith("&#"),
                _code_point(F.regexp_extract(token, "^&#0*([0-9]*)", 1), 10),
            )
            .otherwise(F.coalesce(named[F.regexp_extract(token, "^&(.*);$", 1)], token))
        )

    def decoded(value: Column) -> Column:
        tokens = F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0))
        return F.when(value.contains("&"), F.array_join(F.transform(tokens, one), "")).otherwise(
            value
        )

    return let(text, decoded)


def tag_href(tag: Column) -> Column:
    """Decoded href value of a ``link_tags`` entry."""
    # A tag ends with its value, so in the usual spelling it is a plain slice.
    usual = 'a href="'
    quoted = let(
        F.regexp_extract(tag, _TAG_HREF, 1),
        lambda v: F.when(
            v.startswith('"') | v.startswith("'"),
            F.substr(v, F.lit(2), F.length(v) - 2),
        ).otherwise(v),
    )
    return decode_entities(
        F.when(
            tag.startswith(usual),
            F.substr(tag, F.lit(len(usual) + 1), F.length(tag) - (len(usual) + 1)),
        ).otherwise(quoted)
    )


def _is_base(tag: Column) -> Column:
    return F.lower(F.substr(tag, F.lit(1), F.lit(2))) == "ba"


def anchor_hrefs(tags: Column) -> Column:
    """Stripped, non-empty href values of the anchors, in document order."""
    anchors = F.filter(tags, lambda t: ~_is_base(t))
    return F.filter(F.transform(anchors, lambda t: let(tag_href(t), strip)), lambda h: h != "")


def base_href(tags: Column) -> Column:
    """href of the first base tag as written, or null."""
    first = F.get(F.filter(tags, _is_base), F.lit(0))
    return let(first, lambda tag: F.when(tag.isNotNull(), tag_href(tag)))
