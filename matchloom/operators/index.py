"""Sub-word inverted index over class labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, word_tokens


def label_tokens(labels: DataFrame, tokenizer: Tokenizer = word_tokens, cut: int = 0) -> DataFrame:
    """(onto, iri, token), a row per occurrence; tokens of up to ``cut`` characters go."""
    return labels.select("onto", "iri", F.explode(tokenizer(F.col("label"))).alias("token")).where(F.length("token") > cut)


def postings(labels: DataFrame, tokenizer: Tokenizer = word_tokens, cut: int = 0) -> DataFrame:
    """(onto, token, iri, dtf): how often a token is in a class's labels."""
    return label_tokens(labels, tokenizer, cut).groupBy("onto", "token", "iri").agg(F.count("*").alias("dtf"))


def token_weights(posting: DataFrame, n_classes: DataFrame, idf: str = "cf") -> DataFrame:
    """(onto, token, cf, df, weight): log10(classes / cf) per token, or / df.

    ``n_classes`` is (onto, n), classes without labels included. With ``cf``, the number of
    occurrences, the weight of a token more frequent than there are classes is negative.
    """
    per = posting.groupBy("onto", "token").agg(F.sum("dtf").alias("cf"), F.count("*").alias("df"))
    return per.join(F.broadcast(n_classes), "onto").select("onto", "token", "cf", "df", F.log10(F.col("n") / F.col(idf)).alias("weight"))  # a row per hierarchy
