"""Keyword-stuffed and link-list pages, by rank-frequency curves and divergence from prose."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordhash import WordHashes, chunks
from ..session import checkpoint
from .charforms import one_form, word_text


@dataclass(frozen=True)
class SpamOptions:
    """min_words: shorter pages are not judged, as their curve has too few points. min_pages: distinct texts that a language
    needs for a model. floor: least share of a word in a model; a language has at most 1 / floor words above it, and all
    rarer words count as this rare, so a model has a bounded size. limit: a page is extreme when its divergence lies so
    many median deviations above prose of its language and length, or its slope or residual so many away from it
    (12 median deviations are 8 standard deviations of a normal distribution). prose: pages within so many median deviations
    of the language's usual cross entropy are the prose that the others are compared with. usual: pages within so many are not
    flagged by divergence. many: pages for which the trend
    over length is fitted; fewer have a constant. least: floors of the deviations of divergence, slope and residual.
    broadcast_rows: larger models and norms are joined with a shuffle."""

    min_words: int = 20
    min_pages: int = 5
    floor: float = 1e-4
    limit: float = 12.0
    prose: float = 6.0
    usual: float = 4.0
    many: int = 30
    least: tuple[float, float, float] = (0.05, 0.02, 0.01)
    broadcast_rows: int = 1_000_000


def _counted(texts: list[str], options: SpamOptions) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of raw texts: where the range begins, and for each distinct word of each judged text the text's index
    in the range, the word's hash, how often it stands there, and the text's words."""
    plain = [word_text(one_form(t)) for t in texts]
    for begin, end in chunks(plain):
        found = WordHashes(plain[begin:end])
        total = np.diff(found.first)
        long = total[found.doc] >= options.min_words
        word, doc = found.hashes[long], found.doc[long]
        if not len(word):
            continue
        order = np.lexsort((word, doc))
        word, doc = word[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]))
        yield begin, doc[first], word[first].view(np.int64), np.diff(np.concatenate([first, [len(word)]])), total[doc[first]]


def _language_rows(options: SpamOptions):
    """For each batch and language: the share that each word has of its pages, summed; and in rows without a word the
    language's pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code = np.unique(np.array(batch.column(2).to_pylist(), object).astype(str), return_inverse=True)
            for begin, doc, word, n, total in _counted(batch.column(3).to_pylist(), options):
                lang = code[begin + doc]
                order = np.lexsort((word, lang))
                lang, word, share = lang[order], word[order], (n / total)[order]
                first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (lang[1:] != lang[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(names[lang[first]].tolist(), pa.string()), pa.array(word[first]), pa.array(np.add.reduceat(share, first))], names=["lang", "word", "share"])
                pages = np.bincount(code[begin + np.unique(doc)], minlength=len(names)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.nulls(len(names), pa.int64()), pa.array(pages)], names=["lang", "word", "share"])

    return rows


def _page_rows(options: SpamOptions, models):
    """(hash, page, declared, text) -> (hash, page, declared, lang, words, cross, divergence, n, ties): for each number of
    times n that a word stands on the page, how many words stand there so often. lang: the language whose model gives
    the page the least cross entropy; divergence: the relative entropy of the page's words to that model, in bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, first, lang, share_of, pages_of = models.value
        most, place = -np.log2(options.floor), {x: k for k, x in enumerate(names)}
        for batch in batches:
            for begin, doc, word, n, total in _counted(batch.column(3).to_pylist(), options):
                pages, row = np.unique(doc, return_inverse=True)
                share = n / total
                entropy = -np.bincount(row, share * np.log2(share))
                if len(names):
                    at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
                    hit = np.flatnonzero(known[at] == word) if len(known) else np.zeros(0, np.int64)
                    each = first[at[hit] + 1] - first[at[hit]]
                    entry = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[at[hit]], each)
                    hit = np.repeat(hit, each)
                    # a page is compared with the other pages of its declared language
                    own = np.array([place.get(x, -1) for x in batch.column(2).take(pa.array(begin + pages)).to_pylist()])[row[hit]] == lang[entry]
                    n_pages = pages_of[lang[entry]]
                    others = np.where(own, (share_of[entry] * n_pages - share[hit]) / (n_pages - 1), share_of[entry])
                    gain = np.log2(np.maximum(others, options.floor) / options.floor)
                    saved = np.bincount(row[hit] * len(names) + lang[entry], share[hit] * gain, len(pages) * len(names)).reshape(len(pages), len(names))
                    best = saved.argmax(1)
                    cross = most - saved[np.arange(len(pages)), best]
                    language = pa.array([names[k] for k in best], pa.string())
                else:
                    cross, language = np.full(len(pages), most), pa.nulls(len(pages), pa.string())
                order = np.lexsort((n, row))
                r, c = row[order], n[order]
                new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])]))
                ties, r, c = np.diff(np.concatenate([new, [len(r)]])), r[new], c[new]
                source, of = pa.array(begin + pages[r]), pa.array(r)
                words = np.bincount(row, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(source) for k in range(3)), language.take(of), pa.array(words[r]), pa.array(cross[r]), pa.array((cross - entropy)[r]), pa.array(c.astype(np.int64)), pa.array(ties)],
                    names=["hash", "page", "declared", "lang", "words", "cross", "divergence", "n", "ties"],
                )

    return rows


_PAGE = "hash long, page long, declared string, lang string, words long, cross double, divergence double, n long, ties long"


def _pages(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, hash, page, lang, text); lang is empty where it is null or und; hash and page together identify the text."""
    lang = F.coalesce(F.nullif(F.lower(F.trim(F.col(lang_col))), F.lit("und")), F.lit("")).alias("lang")
    return docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.xxhash64(F.md5(text_col)).alias("page"), lang, F.col(text_col).alias("text"))


def distinct_texts(pages: DataFrame) -> DataFrame:
    """(hash, page, lang, text): one row for each text and declared language, however many copies there are."""
    return pages.groupBy("hash", "page", "lang").agg(F.first("text").alias("text"))


def language_models(pages: DataFrame, options: SpamOptions) -> DataFrame:
    """(lang, word, share): the share of words in each language's pages, learned from all distinct texts of that declared
    language, for words above options.floor. Each batch sends its sums only."""
    sums = pages.mapInArrow(_language_rows(options), "lang string, word long, share double").where("lang <> ''").groupBy("lang", "word").agg(F.sum("share").alias("share")).persist()
    known = sums.where("word is null").select("lang", F.col("share").alias("pages")).where(F.col("pages") >= options.min_pages)
    models = sums.where("word is not null").join(known, "lang").select("lang", "word", (F.col("share") / F.col("pages")).alias("share"), "pages")
    return models.where(F.col("share") > options.floor)


def _gathered(models: DataFrame):
    """All models as sorted arrays: their words, where the entries of each begin, each entry's language and share, and the
    languages' pages. At most 1 / options.floor entries a language."""
    rows = models.toArrow()
    names, lang = np.unique(np.array(rows["lang"].to_pylist(), object).astype(str), return_inverse=True)
    word, pages = rows["word"].to_numpy(), np.zeros(len(names))
    pages[lang] = rows["pages"].to_numpy()
    order = np.argsort(word, kind="stable")
    known, first = np.unique(word[order], return_index=True)
    return names.tolist(), known, np.append(first, len(word)), lang[order], rows["share"].to_numpy()[order], pages


def text_curves(pages: DataFrame, options: SpamOptions) -> DataFrame:
    """(hash, page, declared, lang, words, slope, residual, cross, divergence): page_curves for each distinct text of pages
    and declared language."""
    pages = distinct_texts(pages).persist()
    models = pages.sparkSession.sparkContext.broadcast(_gathered(language_models(pages, options)))
    counts = pages.mapInArrow(_page_rows(options, models), _PAGE)
    keys = ["hash", "page", "declared"]
    # words that stand on a page equally often share the middle of their ranks
    last = F.sum("ties").over(Window.partitionBy(*keys).orderBy(F.desc("n")))
    points = counts.withColumn("x", F.log(last - (F.col("ties") - 1) / 2)).withColumn("y", F.log("n"))
    mean = lambda v: F.sum(F.col("ties") * v) / F.sum("ties")
    x, y = F.col("x"), F.col("y")
    fit = points.groupBy(*keys, "lang", "words", "cross", "divergence").agg(mean(x).alias("mx"), mean(y).alias("my"), mean(x * x).alias("mxx"), mean(x * y).alias("mxy"), mean(y * y).alias("myy"))
    # least squares from the moments; a page whose words all stand there equally often has slope 0
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) for a, b, c in (("mxx", "mx", "mx"), ("mxy", "mx", "my"), ("myy", "my", "my")))
    fit = fit.withColumn("slope", F.when(sxx > 1e-12, sxy / sxx).otherwise(F.lit(0.0))).withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), syy - F.col("slope") * sxy)))
    return fit.select(*keys, "lang", "words", "slope", "residual", "cross", "divergence")


def page_curves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", options: SpamOptions = SpamOptions()) -> DataFrame:
    """(id, lang, words, slope, residual, cross, divergence): for each page the language whose model fits best, the slope
    and residual of log frequency over log rank, and the cross entropy and divergence from that language."""
    pages = _pages(docs, id_col, text_col, lang_col)
    keys = pages.select("id", "hash", "page", F.col("lang").alias("declared"))
    return keys.join(text_curves(pages, options), ["hash", "page", "declared"]).drop("hash", "page", "declared")


_MEASURES = ("divergence", "slope", "residual")


def _trend(y: str) -> list[Column]:
    """Coefficients of the least-squares parabola of y over the column x, by Cramer's rule from the moments."""
    m = [F.avg(F.pow("x", F.lit(k))) for k in range(5)]
    v = [F.avg(F.pow("x", F.lit(k)) * F.col(y)) for k in range(3)]

    def det(a: list[list[Column]]) -> Column:
        return sum((a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(1, 3)), a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]))

    base = [[m[i + j] for j in range(3)] for i in range(3)]
    whole = det(base)
    parts = [det([[v[i] if j == k else base[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    flat = [F.percentile_approx(y, 0.5, 10_000), F.lit(0.0), F.lit(0.0)]
    return [F.when(whole > 1e-6, p / whole).otherwise(f) for p, f in zip(parts, flat)]


def _judged(texts: DataFrame, group: str, options: SpamOptions) -> DataFrame:
    """texts with as_usual, whether their cross entropy is usual in their group (a column), and off_divergence, off_slope and
    off_residual: how far each is from the prose of the group at its length, in median deviations."""
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    small = texts.select(group).distinct().limit(options.broadcast_rows + 1).count() <= options.broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    # tables of a row for each group, written down so that plans stay small
    usual = checkpoint(texts.groupBy(group).agg(middle("cross").alias("usual")))
    spread = checkpoint(texts.join(hint(usual), group).groupBy(group, "usual").agg(middle(F.abs(F.col("cross") - F.col("usual"))).alias("spread")))
    rows = texts.join(hint(spread), group).withColumn("x", F.log2("words") - 7)
    off = F.abs(F.col("cross") - F.col("usual")) / F.greatest("spread", F.lit(options.least[0]))
    rows = rows.withColumn("prose", off <= options.prose).withColumn("as_usual", off <= options.usual)
    # a parabola over the logarithm of the length where there are pages enough, else a constant
    fits = []
    for y in _MEASURES:
        a = [F.when(F.count("*") >= options.many, c).otherwise(f) for c, f in zip(_trend(y), (middle(y), F.lit(0.0), F.lit(0.0)))]
        fits += [c.alias(f"{y}_{k}") for k, c in enumerate(a)]
    rows = rows.join(hint(checkpoint(rows.where("prose").groupBy(group).agg(*fits, F.count("*").alias("pages")))), group)
    for y in _MEASURES:
        rows = rows.withColumn(f"off_{y}", F.col(y) - (F.col(f"{y}_0") + F.col("x") * (F.col(f"{y}_1") + F.col("x") * F.col(f"{y}_2"))))
    # few pages say little about the spread
    doubt = F.sqrt(1 + F.lit(float(options.many)) / F.col("pages"))
    deviation = rows.where("prose").groupBy(group).agg(*((F.greatest(middle(F.abs(F.col(f"off_{y}"))), F.lit(least)) * F.max(doubt)).alias(f"dev_{y}") for y, least in zip(_MEASURES, options.least)))
    rows = rows.join(hint(checkpoint(deviation)), group)
    return rows.select(*texts.columns, "as_usual", *((F.col(f"off_{y}") / F.col(f"dev_{y}")).alias(f"off_{y}") for y in _MEASURES))


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", options: SpamOptions = SpamOptions()) -> DataFrame:
    """(id_col): pages that are lists of keywords, links, hashtags or product tags instead of sentences.

    A page's rank-frequency curve is fitted with SQL windows. Slope, residual and the divergence of the page's words from
    those of its language are compared with prose of the same language at the same length: a parabola over log length,
    fitted to all pages of usual cross entropy, and the median deviation from it. Each of the three flags a page for itself
    when it is more than options.limit median deviations off: lists lack the words that sentences are made of
    (divergence), repeat phrases (slope, residual) or repeat nothing at all (slope). Divergence flags only pages whose cross
    entropy is unusual too, as whole sentences may be repeated in an honest page.

    The language is the one whose model fits best, so a wrong or missing lang does no harm. A page of a declared language
    that has too few pages for a model may be foreign prose; it is judged by its curve alone, against all pages. Any number
    of languages has a model. Models and norms are learned from distinct texts, so copies don't make a page usual.

    Null ids and texts and pages with fewer than options.min_words words are never flagged. Repeated rows give one row.
    An empty table gives no rows.
    """
    rows = _pages(docs, id_col, text_col, lang_col)
    # numbers of each distinct text, the result of the costly stages
    texts = checkpoint(text_curves(rows, options))
    known = texts.where("lang is not null").select(F.col("lang").alias("declared"), F.lit(True).alias("_known")).distinct()
    texts = texts.join(known, "declared", "left").withColumn("judged", (F.col("declared") == "") | F.coalesce("_known", F.lit(False))).drop("_known").persist()
    far = lambda y: F.abs(F.col(f"off_{y}")) > options.limit
    strays = ~F.col("as_usual") & (F.col("off_divergence") > options.limit)
    found = _judged(texts.where("lang is not null"), "lang", options).where("judged").where(strays | far("slope") | far("residual")).select("hash", "page", "declared")
    if texts.where("not judged").limit(1).count():
        strange = _judged(texts.withColumn("all", F.lit(1)), "all", options).where("not judged").where(far("slope") | far("residual"))
        found = found.union(strange.select("hash", "page", "declared"))
    return rows.select("id", "hash", "page", F.col("lang").alias("declared")).join(found, ["hash", "page", "declared"]).select(F.col("id").alias(id_col)).distinct()
