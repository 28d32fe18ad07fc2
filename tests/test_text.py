from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("x")).first()["x"]


def test_normalization_steps(spark):
    raw = "Café “quote” — ok…  extra   spaces\n\n\n\nnext "
    assert one(spark, raw, T.normalize_text) == "Café “quote” — ok… extra spaces\n\nnext"
    ascii_only = T.Normalization("NFC", ascii_punctuation=True, strip_non_ascii=True)
    assert one(spark, raw, lambda c: T.normalize_text(c, ascii_only)) == 'Caf "quote" - ok... extra spaces\n\nnext'
    assert one(spark, "a\tb\rc", lambda c: T.normalize_text(c, ascii_only)) == "abc"
    assert one(spark, None, T.normalize_text) is None
    assert one(spark, "ﬁ", lambda c: T.normalize_text(c, T.Normalization("NFKC"))) == "fi"


def test_keys_ignore_case_and_blanks(spark):
    a, b = "Hello  world", "  HELLO\n\tworld "
    assert one(spark, a, T.content_hash) == one(spark, b, T.content_hash)
    assert one(spark, "Straße", T.exact_dedup_key) == "strasse"
    assert one(spark, "Straße", T.dedup_key) == "straße"
    expected = hashlib.blake2b(" ".join(unicodedata.normalize("NFKC", a).casefold().split()).encode(), digest_size=8).hexdigest()
    assert one(spark, a, T.exact_content_hash) == expected
    held = int(expected, 16) % 1_000_000
    assert one(spark, expected, lambda c: T.exact_in_fraction(c, (held + 1) / 1e6)) is True
    assert one(spark, expected, lambda c: T.exact_in_fraction(c, held / 1e6)) is False
    assert one(spark, "f" * 16, lambda c: T.exact_in_fraction(c, ((2**64 - 1) % 10**6 + 1) / 1e6)) is True


def test_words_and_ngrams(spark):
    assert one(spark, "Don't café 42!", T.words) == ["don't", "caf", "42"]
    assert one(spark, "a b c", lambda c: T.ngrams(T.words(c), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.ngrams(T.words(c), 2)) == []
    assert one(spark, "She smiled. He ran. She smiled.", T.sentences) == ["she smiled", "he ran", "she smiled"]
    assert one(spark, "one two three four one two three four", lambda c: T.repeated_fraction(T.ngrams(T.words(c), 4))) == 1 / 5
    assert one(spark, "", lambda c: T.repeated_fraction(T.ngrams(T.words(c), 4))) == 0.0


def test_byte_tokens(spark):
    assert one(spark, "é😀", T.byte_tokens) == [b + 2 for b in "é😀".encode()]
    assert one(spark, "", T.byte_tokens) == []


def test_slug(spark):
    assert one(spark, "NVIDIA GeForce (4 GB)", T.slug) == "nvidia-geforce-4-gb"
