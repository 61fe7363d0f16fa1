"""Fixed token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

WINDOW_TOKENS, STRIDE = 400, 350


def fixed_windows(docs: DataFrame, width: int = WINDOW_TOKENS, stride: int = STRIDE, text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, n_tokens, chunk): a window starts at every stride below the text's length, the last ones overlap-only."""
    split = docs.select("doc_id", tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    starts = split.select("doc_id", "_t", F.posexplode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(stride))).alias("chunk_index", "_s"))
    cut = starts.withColumn("_c", F.slice("_t", F.col("_s") + 1, width))
    return cut.select("doc_id", "chunk_index", F.size("_c").alias("n_tokens"), F.array_join("_c", " ").alias("chunk"))


def token_windows(counted: DataFrame, width: int = WINDOW_TOKENS, stride: int = STRIDE) -> DataFrame:
    """(doc_id, chunk_index, n_tokens, start, end, chunk) of windows over ``counted`` (doc_id, text, tokens), tokens being places in the text; the text itself is cut."""
    starts = counted.where(F.size("tokens") > 0).select("doc_id", "text", "tokens", F.posexplode(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(stride))).alias("chunk_index", "_s"))
    n = F.least(F.lit(width), F.size("tokens") - F.col("_s"))
    start, end = F.get("tokens", F.col("_s"))["start"], F.get("tokens", F.col("_s") + n - 1)["end"]
    return starts.select("doc_id", "chunk_index", n.alias("n_tokens"), start.alias("start"), end.alias("end"), F.substr("text", start + 1, end - start).alias("chunk"))
