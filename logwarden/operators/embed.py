"""Vectors of message templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.operators.joins import attach
from logwarden.session import settle

Encoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed_templates(templates: DataFrame, settings: Settings = DEFAULTS, encode: Encoder | None = None) -> DataFrame:
    """``(template, embedding)`` for distinct templates.

    The default is a normalised bag of hashed words. ``encode`` plugs in another
    model: it receives batches of texts and yields batches of float arrays, and
    may load its model once per task before the first batch.
    """
    texts = templates.select(F.coalesce("template", F.lit("")).alias("template")).distinct()
    if encode is not None:
        @F.pandas_udf("array<float>")
        def encoder(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from encode(batches)

        return texts.withColumn("embedding", encoder("template"))
    words = RegexTokenizer(inputCol="template", outputCol="_words", pattern=r"[^\p{L}\p{N}_<>]+", minTokenLength=1)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=settings.vector_size)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    vectors = unit.transform(counts.transform(words.transform(texts)))
    return vectors.select("template", vector_to_array("_unit", "float32").alias("embedding"))


def attach_embeddings(events: DataFrame, settings: Settings = DEFAULTS, encode: Encoder | None = None) -> DataFrame:
    """Give every event the vector of its template; each template is encoded once."""
    filled = events.withColumn("template", F.coalesce("template", F.lit("")))
    counts = filled.groupBy("template").agg(F.count("*").alias("_rows"))
    vectors = embed_templates(counts, settings, encode).join(counts, "template")
    return attach(filled, vectors, ["template"], how="inner", rows="_rows", settings=settings)


def settled_embeddings(templates: DataFrame, settings: Settings = DEFAULTS, encode: Encoder | None = None) -> DataFrame:
    return settle(embed_templates(templates, settings, encode))
