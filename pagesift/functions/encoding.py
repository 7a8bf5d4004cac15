"""Byte-encoding detection and narrowing on BINARY columns.

Bytes are viewed as ISO-8859-1 text, one character per byte, so that the string built-ins
work on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import bind

# Leading bytes that are removed, and the names of the encodings.
DEFAULT_STRIP = "\\s\t\r\n"
WHITESPACE_STRIP = " \t\r\n\f\x0b"
UNKNOWN = "ENCODE_UNKNOWN"
UTF_16_BE = "ENCODE_UTF_16_BE"
UTF_16_LE = "ENCODE_UTF_16_LE"
UTF_32_BE = "ENCODE_UTF_32_BE"
UTF_32_LE = "ENCODE_UTF_32_LE"

PREFIX_BYTES = 500


def _as_chars(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _stripped(content: Column, strip_set: str) -> Column:
    return F.ltrim(_as_chars(content), F.lit(strip_set))


def strip_leading(content: Column, strip_set: str = DEFAULT_STRIP) -> Column:
    """Content without its leading bytes in `strip_set`."""
    return F.encode(_stripped(content, strip_set), "ISO-8859-1")


def detect_encoding(
    content: Column, strip_set: str = DEFAULT_STRIP, bom: bool = False
) -> Column:
    """Encoding name from the NUL positions in the first bytes; `bom` also trusts byte marks."""
    wide = (
        (r"(?s)^(?:\x00{3}.){3}\x00{3}", UTF_32_BE),
        (r"(?s)^(?:.\x00{3}){4}", UTF_32_LE),
        (r"(?s)^(?:\x00.){3}\x00", UTF_16_BE),
        (r"(?s)^(?:.\x00){4}", UTF_16_LE),
    )

    def by_nuls(head: Column) -> Column:
        chosen = F
        for pattern, name in wide:
            chosen = chosen.when(head.rlike(pattern), F.lit(name))
        return chosen.otherwise(F.lit(UNKNOWN))

    named = bind(_stripped(F.substring(content, 1, PREFIX_BYTES), strip_set), by_nuls)
    if not bom:
        return named

    def by_mark(mark: Column) -> Column:
        return (
            F.when(mark == "FFFE0000", UTF_32_LE)
            .when(mark == "0000FEFF", UTF_32_BE)
            .when(mark.startswith("FFFE"), UTF_16_LE)
            .when(mark.startswith("FEFF"), UTF_16_BE)
        )

    return F.coalesce(bind(F.hex(F.substring(content, 1, 4)), by_mark), named)


def narrow_encoding(
    content: Column, encoding: Column, strip_set: str = DEFAULT_STRIP
) -> Column:
    """One byte per character of wide content; other content is only stripped."""

    def narrowed(chars: Column) -> Column:
        return (
            F.when(encoding == UTF_32_BE, F.regexp_replace(chars, r"(?s).{3}(.)|.{1,3}$", "$1"))
            .when(encoding == UTF_32_LE, F.regexp_replace(chars, r"(?s)(.).{0,3}", "$1"))
            .when(encoding == UTF_16_BE, F.regexp_replace(chars, r"(?s).(.)|.$", "$1"))
            .when(encoding == UTF_16_LE, F.regexp_replace(chars, r"(?s)(.).?", "$1"))
            .otherwise(chars)
        )

    return F.encode(bind(_stripped(content, strip_set), narrowed), "ISO-8859-1")
