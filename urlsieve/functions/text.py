"""Text functions as Catalyst expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.strip() removes, as a Java regex class body.
SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Literal defanging pairs and what they stand for.
DEFANG_PAIRS = (
    ("[://]", "://"),
    ("[:]", ":"),
    ("[.]", "."),
    ("(.)", "."),
    ("{.}", "."),
    ("[/]", "/"),
    ("[@]", "@"),
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space; without its list of characters, btrim() would remove U+0020 only."""
    return F.btrim(c, F.lit(SPACES))


def undo_pairs(c: Column) -> Column:
    for old, new in DEFANG_PAIRS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, r"(?i)\[dot\]|\(dot\)", ".")


def refang(c: Column) -> Column:
    """TXT of URL-1: strip, then undo hxxp, bracketed separators and [dot]."""
    return undo_pairs(F.regexp_replace(strip(c), "(?i)^hxxp", "http"))


def tokens(c: Column) -> Column:
    """TXT-5: lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def entropy(c: Column) -> Column:
    """TXT-3: Shannon entropy in bits a character; 0.0 for the empty string."""
    chars = F.split(c, "")
    n = F.length(c).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(c == "", F.lit(0.0)).otherwise(total)


def fingerprint(*cols: Column | str) -> tuple[Column, Column]:
    """128 bits of identity as two bigints: equal texts agree, different ones do not in practice."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)
