"""Okapi BM25 statistics of a corpus of chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.sources.storage import checkpointed, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Bm25Index:
    """terms: (t, df, raw_idf), a written table; and the corpus' figures. A negative idf becomes epsilon times the mean of all."""

    terms: DataFrame
    n_docs: int
    n_tokens: int
    mean_idf: float
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


def build(chunks: DataFrame, text_col: str = "raw_chunk", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> Bm25Index:
    """Statistics of all chunks; null text is an empty chunk that counts.

    A chunk is one row, so its words are counted there; the one shuffle is that of the words' chunk
    counts, which are summed before it.
    """
    tokens = spread(chunks.select(F.coalesce(text_col, F.lit("")).alias("text"))).select(words(F.col("text")).alias("tokens"))
    sizes = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total")).first()
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(sizes["n"])
    terms = checkpointed(df.select("t", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf")))
    mean = terms.agg(F.avg("raw_idf")).first()[0]
    return Bm25Index(terms, sizes["n"], sizes["total"], mean or 0.0, k1, b, epsilon)
