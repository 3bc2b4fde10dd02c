"""Small column helpers shared by the URL, HTML and robots builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Characters that surrounding-whitespace removal takes off (fixed values): the
# Unicode white space class plus the four ASCII information separators.
WHITE = r"\s\x1c-\x1f"


_built: dict[tuple, Column] = {}


def over(builder: Callable[..., Column], *names: str) -> Column:
    """``builder`` applied to named columns.

    Building a long expression takes thousands of calls to the JVM, and the
    result is immutable, so it is kept for the life of the application.
    """
    app = SparkSession.active().sparkContext.applicationId
    key = (app, builder, names)
    if key not in _built:
        _built[key] = builder(*[F.col(n) for n in names])
    return _built[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove all surrounding white space, not only blanks.

    Text that starts and ends with visible ASCII is left as it is, unscanned.
    """
    clean = F.ascii(text).between(0x21, 0x7E) & F.ascii(F.substr(text, F.lit(-1))).between(
        0x21, 0x7E
    )
    return F.when(clean, text).otherwise(
        F.regexp_replace(text, rf"(?U)^[{WHITE}]+|[{WHITE}]+\z", "")
    )


def after(text: Column, mark: str) -> Column:
    """The part behind the first ``mark`` (the caller knows it occurs)."""
    return F.substr(text, F.instr(text, mark) + F.lit(len(mark)))


def percent_decode(text: Column) -> Column:
    """Percent-decode as UTF-8; stray ``%`` stay, ``+`` becomes a blank."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def percent_decode_keep_plus(text: Column) -> Column:
    """Percent-decode as UTF-8; stray ``%`` and ``+`` stay."""
    return percent_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def form_encode(text: Column) -> Column:
    """Form-encode: unreserved characters are ``A-Za-z0-9_.~-``, blank is ``+``."""
    encoded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))
