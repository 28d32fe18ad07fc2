"""Text functions on columns: normalization, keys, words, n-grams and sentences.

The native tier stays in whole-stage code generation. The exact tier (Unicode forms, full case folding, BLAKE2) has no
Spark function and runs as Arrow UDFs.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Typographic characters and their ASCII spelling.
TYPOGRAPHIC_ONE = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "\u00a0": " "}
ELLIPSIS = ("…", "...")

#: What Python's str.strip and str.split take as white space.
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


@dataclass(frozen=True)
class Normalization:
    """Steps of normalize_text. form: NFC, NFKC or none."""

    form: str = "NFC"
    ascii_punctuation: bool = False
    strip_non_ascii: bool = False
    collapse_whitespace: bool = True

    def __post_init__(self):
        if self.form not in ("NFC", "NFKC", "none"):
            raise ValueError(f"form must be NFC, NFKC or none, not {self.form!r}")


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def unicode_form(text: Column, form: str) -> Column:
    """Only texts with characters beyond ASCII go to Python."""
    if form == "none":
        return text
    return F.coalesce({"NFC": _nfc, "NFKC": _nfkc}[form](F.when(F.octet_length(text) > F.char_length(text), text)), text)


def typographic_to_ascii(text: Column) -> Column:
    return F.replace(F.translate(text, "".join(TYPOGRAPHIC_ONE), "".join(TYPOGRAPHIC_ONE.values())), F.lit(ELLIPSIS[0]), F.lit(ELLIPSIS[1]))


def strip_non_ascii(text: Column) -> Column:
    """Deletes all but printable ASCII and line feeds; tabs and carriage returns go too, so words they part are glued."""
    return F.regexp_replace(text, r"[^\x20-\x7E\n]", "")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def normalize_text(text: Column, options: Normalization = Normalization()) -> Column:
    """Form, punctuation, non-ASCII, blanks, strip: always in this order. Null stays null."""
    text = unicode_form(text, options.form)
    if options.ascii_punctuation:
        text = typographic_to_ascii(text)
    if options.strip_non_ascii:
        text = strip_non_ascii(text)
    if options.collapse_whitespace:
        text = collapse_whitespace(text)
    return strip(text)


def dedup_key(text: Column) -> Column:
    """Native key of exact copies: lower case, words joined by one blank. Unlike the exact tier it keeps compatibility
    characters and the German sharp s."""
    return F.trim(F.regexp_replace(F.lower(text), f"{BLANK}+", " "))


def content_hash(text: Column) -> Column:
    """MD5 of the native key, as hexadecimal digits."""
    return F.md5(dedup_key(text))


def bucket(hex_hash: Column, buckets: int = 1_000_000) -> Column:
    """Bucket of a hexadecimal hash, by its first 15 digits."""
    return F.pmod(F.conv(F.substring(hex_hash, 1, 15), 16, 10).cast("long"), F.lit(buckets))


def in_fraction(hex_hash: Column, fraction: float) -> Column:
    """Whether a hash falls into the first `fraction` of a million buckets."""
    return bucket(hex_hash) < F.lit(round(fraction * 1_000_000))


def exact_key(text: str) -> str:
    """Key of exact copies in full: NFKC, case folded, words joined by one blank."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def exact_hash(text: str) -> bytes:
    return hashlib.blake2b(exact_key(text).encode("utf-8", "surrogatepass"), digest_size=8).digest()


@F.arrow_udf(StringType())
def exact_dedup_key(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else exact_key(x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def exact_content_hash(text: pa.Array) -> pa.Array:
    """BLAKE2b of the exact key, 8 bytes, as hexadecimal digits in big-endian order."""
    return pa.array([None if x is None else exact_hash(x).hex() for x in text.to_pylist()], pa.string())


def exact_in_fraction(hex_hash: Column, fraction: float) -> Column:
    """in_fraction of an exact hash, taken as an unsigned number of 64 bits."""
    number = F.conv(hex_hash, 16, 10).cast("decimal(20,0)")
    return (number % F.lit(1_000_000).cast("decimal(20,0)")).cast("long") < F.lit(round(fraction * 1_000_000))


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and apostrophes in the lower-case text; other letters part words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items, joined by blanks; empty where there are fewer."""
    return F.when(
        F.size(items) >= n,
        F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.concat_ws(" ", F.slice(items, i, n))),
    ).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences as their words joined by blanks, those without words left out; a blank after . ! or ? ends one."""
    parts = F.split(strip(text), r"(?<=[.!?])[\t-\r\x1c-\x20\x{85}\p{Z}]+")
    return F.filter(F.transform(parts, lambda s: F.concat_ws(" ", words(s))), lambda s: s != "")


def repeated_fraction(items: Column) -> Column:
    """Share of items that occurred before in the same array; 0 for none."""
    return F.when(F.size(items) > 0, (F.size(items) - F.size(F.array_distinct(items))) / F.size(items)).otherwise(F.lit(0.0))


def once(column: Column) -> Column:
    """The same column as the output of a generator: what uses it later doesn't compute it again, as the optimizer
    would by pulling a costly expression into each use. Stands alone in a select."""
    return F.explode(F.array(column))


def byte_tokens(text: Column) -> Column:
    """Ids of the byte tokenizer: each UTF-8 byte plus 2 (0 ends a document, 1 pads)."""
    digits = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    return F.transform(digits, lambda h: F.conv(h, 16, 10).cast("int") + 2)


def byte_ids(texts: pa.Array) -> Iterator[np.ndarray]:
    """byte_tokens of UTF-8 texts in an Arrow column of type BINARY."""
    return (np.frombuffer(x, np.uint8).astype(np.int32) + 2 for x in texts.to_pylist())


def slug(text: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
