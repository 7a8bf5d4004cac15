"""Words and their hashes for many texts at once; see `pagesift.functions.bytewords`."""

from pagesift.functions.bytewords import (  # noqa: F401
    ALPHANUMERIC,
    BYTE_CODES,
    NOT_SPACE,
    SLICE_BYTES,
    byte_set,
    mix,
    ngram_hashes,
    powers,
    prefix_codes,
    slices,
    span_hashes,
    word_bounds,
)
