"""Visually identical texts, brought to one form with a vocabulary trie."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import expand, join_groups
from .charforms import count_letters_and_digits, is_ignorable, is_odd, letters_and_digits, one_form, plain_character

#: A token: letters, digits, combining marks and the characters between them that show nothing.
_TOKEN = re.compile("(?:[^\\W_]|[̀-ͯ­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿])+")
# Characters that may stand for more than one letter.
SEVERAL_READINGS = {"ӏ": "lI", "Ӏ": "lI", "ו": "l", "ı": "i", "Ɩ": "lI"}


class LookalikeTrie:
    """Vocabulary trie with a weighted edit automaton.

    Reading a look-alike as a letter, joining an accent to its letter and skipping a character that shows nothing cost
    0; reading any other letter costs 1. spelling(token) gives the word of the vocabulary reached at the least cost of
    at most max_cost (0 unless said otherwise: what a reader can see stays), the most frequent one first, then the
    first by code points; None if there is none.
    """

    def __init__(self, vocabulary: dict[str, int], max_cost: int = 0):
        self.root: dict = {}
        self.max_cost = max_cost
        for word, count in vocabulary.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = count

    @staticmethod
    def readings(ch: str) -> str:
        plain = plain_character(ch)
        return "".join(dict.fromkeys(([plain] if len(plain) == 1 else []) + list(SEVERAL_READINGS.get(ch, "")) + [ch]))

    def spelling(self, token: str) -> str | None:
        best: tuple[int, int, str] | None = None
        states = [(self.root, 0, 0, "")]
        seen = set()
        while states:
            node, at, cost, word = states.pop()
            if (id(node), at, cost) in seen:
                continue
            seen.add((id(node), at, cost))
            if at == len(token):
                if "" in node and (best is None or (cost, -node[""], word) < best):
                    best = (cost, -node[""], word)
                continue
            ch = token[at]
            if is_ignorable(ch):
                states.append((node, at + 1, cost, word))
                continue
            marks = at + 1
            while marks < len(token) and (unicodedata.combining(token[marks]) or is_ignorable(token[marks])):
                marks += 1
            accents = "".join(x for x in token[at + 1 : marks] if not is_ignorable(x))
            free = [unicodedata.normalize("NFC", r + accents) for r in self.readings(ch)]
            for letter in free:
                step = node
                for x in letter:
                    step = step.get(x)
                    if step is None:
                        break
                if step is not None:
                    states.append((step, marks, cost, word + letter))
            if cost < self.max_cost:
                states += [(child, marks, cost + 1, word + x) for x, child in node.items() if x and x not in free]
        return best[2] if best else None


def canonical(text: str, trie: LookalikeTrie, memo: dict[str, str]) -> str:
    """The one form of a text: tokens with unusual characters take the vocabulary's spelling, others the table's."""
    if not is_odd(text):
        return text

    def spelled(m: re.Match) -> str:
        token = m.group()
        if not is_odd(token):
            return token
        if token not in memo:
            if len(memo) > 500_000:
                memo.clear()
            memo[token] = trie.spelling(token) or one_form(token)
        return memo[token]

    return one_form(_TOKEN.sub(spelled, text))


def outline(token: str) -> str:
    """Equal for a token and all words that it may be read as: the one form without case, i and l as one."""
    return one_form(token).lower().translate(_OUTLINE)


#: The characters of SEVERAL_READINGS with all their readings.
_OUTLINE = str.maketrans({"i": "l", **{ch: "l" for ch in SEVERAL_READINGS}})


def _vocabulary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        odd = [is_odd(t) for t in count]
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(map(outline, count), pa.string()), pa.array(odd, pa.bool_()), pa.array(count.values(), pa.int64())], names=["token", "outline", "odd", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            count.update(_TOKEN.findall(text))
        if len(count) > 300_000:
            yield rows()
            count.clear()
    yield rows()


def vocabulary(docs: DataFrame, text_col: str, size: int = 50_000) -> DataFrame:
    """(token, n): the words in ordinary characters that some token of the texts with other characters may be read as,
    counted over all texts; the `size` most frequent of them, ties by token."""
    counts = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(_vocabulary_rows, "token string, outline string, odd boolean, n long").groupBy("token", "outline", "odd").agg(F.sum("n").alias("n")).persist()
    usual = counts.where(~F.col("odd") & F.col("token").rlike("^[0-9A-Za-zÀ-ÖØ-öø-ÿ]+$"))
    return usual.join(counts.where("odd").select("outline").distinct(), "outline", "left_semi").select("token", "n").orderBy(F.desc("n"), "token").limit(size)


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_TRIES: dict[int, tuple[LookalikeTrie, dict[str, str]]] = {}


def _trie(words) -> tuple[LookalikeTrie, dict[str, str]]:
    """The worker's trie of a broadcast vocabulary with the spellings found so far; the last one is kept."""
    key = hash(tuple(words.value.items()))
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = LookalikeTrie(words.value), {}
    return _TRIES[key]


def _form_rows(words, min_letters: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = _trie(words)
        for batch in batches:
            ids, forms, texts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = canonical(text, trie, memo)
                if count_letters_and_digits(letters_and_digits(form)) < min_letters:
                    continue
                ids.append(i)
                forms.append(_digest(form))
                texts.append(forms[-1] if form == text else _digest(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["id", "form", "variant"])

    return rows


def form_table(docs: DataFrame, id_col: str, text_col: str, min_letters: int = 40, vocabulary_size: int = 50_000) -> DataFrame:
    """(id, form, variant): digests of the one form and of the text itself. The vocabulary, counted over all texts, holds
    only words that a token with other characters may stand for. It is sent to the executors; its size is bounded by
    vocabulary_size, and tokens of rarer words are read by the table and their context."""
    words = docs.sparkSession.sparkContext.broadcast({r["token"]: r["n"] for r in vocabulary(docs, text_col, vocabulary_size).collect()})
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(_form_rows(words, min_letters), "id long, form binary, variant binary")


def lookalike_pairs(docs: DataFrame, id_col: str = "story_id", text_col: str = "text", min_letters: int = 40, vocabulary_size: int = 50_000, hot: int = 4096) -> DataFrame:
    """(id_lo, id_hi) of texts that are different strings with the same one form.

    Variants (distinct strings) of a form are paired first, then each pair of variants with its rows, so copies of one
    string never meet each other, however many there are. A form with more than `hot` variants and a variant with more
    than `hot` rows are cut into parts, each pair of which is joined on a key of its own. Null ids, null texts and texts
    with fewer than min_letters letters and digits are no case. Other columns are ignored. An empty table gives no rows.
    """
    table = form_table(docs, id_col, text_col, min_letters, vocabulary_size).distinct().persist()
    total = table.count()
    variants = table.groupBy("form", "variant").agg(F.count("*").alias("rows"))
    forms = variants.groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    several = join_groups(variants, forms, ["form"], "n", total).persist()
    members = several.select(F.col("form").alias("rep"), "n", F.col("variant").alias("id"))
    pairs = expand(forms.select(F.col("form").alias("lo"), F.col("form").alias("hi")), members, members, hot).where("x < y").select(F.col("x").alias("lo"), F.col("y").alias("hi"))
    rows = join_groups(table.select("variant", "id"), several.select("variant", "rows"), ["variant"], "rows", total).select(F.col("variant").alias("rep"), F.col("rows").alias("n"), "id").persist()
    return expand(pairs, rows, rows, hot).where("x <> y").select(F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi")).distinct()
