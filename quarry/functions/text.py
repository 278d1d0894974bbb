"""Column helpers on text: two-character terms, exact trimming, path and case rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a trim removes, and the Han ranges of two-character terms.
SPACE_CODES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACES = "".join(map(chr, SPACE_CODES))
HAN = "㐀-䶿一-鿿"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_spaces(c: Column | str) -> Column:
    """Trim the whole white-space set, not blanks alone."""
    return F.trim(col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(trim_spaces(c), F.lit("")) == ""


def fold_ascii(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngrams(c: Column | str, n: int) -> Column:
    """All runs of n characters, in order; built from the list of characters, so long texts cost in proportion to their length."""
    t = F.coalesce(col(c), F.lit(""))
    chars = F.split(t, "")  # one element for each code point
    size = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    out = F.slice(chars, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, size), lambda a, b: F.concat(a, b))
    return F.when(F.char_length(t) >= n, out).otherwise(F.array().cast("array<string>"))


def han_bigrams(c: Column | str) -> Column:
    """Distinct two-character terms of runs of at least two Han characters, in order."""
    runs = F.regexp_extract_all(col(c), F.lit(f"([{HAN}]{{2,}})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: ngrams(r, 2))))


def char_bigrams(c: Column | str) -> Column:
    """Distinct character pairs after lower-casing and removing white space."""
    return F.array_distinct(ngrams(F.regexp_replace(F.lower(col(c)), r"\s+", ""), 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; an empty side gives 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def slashes(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def dotted_extension(name: Column | str) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(col(name), r"(\.[^./\\]+)$", 1))


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")
