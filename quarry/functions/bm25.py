"""Okapi BM25 as columns; lower is better, as with the reference engine's ranking function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def idf(n_docs: Column, n_hits: Column) -> Column:
    return F.greatest(F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)), F.lit(LEAST_IDF))


def term_score(frequency: Column, weight: Column, length: Column, mean_length: Column) -> Column:
    return weight * (frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / mean_length)))
