"""n-gram membership of query texts in a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import linear_percentile
from ..functions.wordhash import ASCII_WORDS, WordHashes, chunks
from .bitmap import contains, membership_bitmap


def ngram_hashes(texts: DataFrame, id_col: str, text_col: str, ns: tuple[int, ...], once: bool = False, bits: np.ndarray | None = None) -> DataFrame:
    """(id_col, n, gram BIGINT, times): 64-bit hashes of the runs of n words (of a-z, 0-9 and apostrophes, in lower
    case) of each text with their number; with once each hash once for each batch, without id. With bits, a membership
    bitmap, only hashes that may be in it. Hashes in place of words keep what is shuffled small; two different runs get
    the same one with probability 2**-64."""
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = [t.lower() for t in batch.column(1).to_pylist()]
            for begin, end in chunks(lower):
                words = WordHashes(lower[begin:end], ASCII_WORDS)
                for n in ns:
                    gram, where = words.grams(n)
                    doc = words.doc[where]
                    if shared is not None:
                        keep = contains(shared.value, gram)
                        gram, doc = gram[keep], doc[keep]
                    if once:
                        gram = np.unique(gram)
                        doc, times = np.zeros(len(gram), np.int64), np.ones(len(gram), np.int64)
                    elif len(gram):
                        order = np.lexsort((gram, doc))
                        gram, doc = gram[order], doc[order]
                        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]))
                        times = np.diff(np.concatenate([first, [len(gram)]]))
                        gram, doc = gram[first], doc[first]
                    else:
                        times = np.zeros(0, np.int64)
                    if len(gram):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + doc)), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram.view(np.int64)), pa.array(times)], names=[id_col, "n", "gram", "times"])

    used = texts.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    return used.mapInArrow(rows, f"{id_col} {used.dtypes[0][1]}, n int, gram long, times long")


def containment(corpus: DataFrame, queries: DataFrame, corpus_id: str, query_id: str, text_col: str = "text", ns: tuple[int, ...] = (13,)) -> DataFrame:
    """(query_id, n, grams, matched, containment): for each query and n the occurrences of n-grams and the share of them
    that the corpus has; 0 for queries shorter than n. Grams of all n come from one pass over each side; the corpus
    sends only hashes that some query may have, by a membership bitmap of bounded size."""
    wanted = ngram_hashes(queries, query_id, text_col, ns).persist()
    distinct = wanted.select("n", "gram").distinct().persist()
    bits = membership_bitmap(distinct.select("gram"), distinct.count())
    known = ngram_hashes(corpus, corpus_id, text_col, ns, once=True, bits=bits).select("n", "gram").distinct()
    hits = wanted.join(known.withColumn("hit", F.lit(1)), ["n", "gram"], "left")
    found = hits.groupBy(query_id, "n").agg(F.sum("times").alias("grams"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("times"))), F.lit(0)).alias("matched"))
    every = queries.select(query_id, F.explode(F.array(*map(F.lit, ns))).alias("n"))
    grams, matched = F.coalesce("grams", F.lit(0)), F.coalesce("matched", F.lit(0))
    share = F.when(grams > 0, F.round(matched / grams, 9)).otherwise(F.lit(0.0))
    return every.join(found, [query_id, "n"], "left").select(query_id, "n", grams.alias("grams"), matched.alias("matched"), share.alias("containment"))


def containment_summary(values: DataFrame, by: tuple[str, ...] = ("n",), thresholds: tuple[float, ...] = (0.5, 0.8, 1.0)) -> DataFrame:
    """Count, mean, median and shares at least as high as each threshold."""
    share = lambda t: F.round(F.avg((F.col("containment") >= t).cast("double")), 9).alias(f"share_ge_{str(t).replace('.', '_')}")
    return values.groupBy(*by).agg(F.count("*").alias("documents"), F.round(F.avg("containment"), 9).alias("mean"), F.round(linear_percentile("containment", 0.5), 9).alias("median"), *map(share, thresholds))
