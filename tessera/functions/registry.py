"""Named extension points: token counters, encoders, URL rules, normal forms, parsers; and the library's functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .batches import bound_batches

KINDS = ("tokenizer", "encoder", "url", "normal_form", "parser", "veto")
_HELD: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """A name is given once; another function under it is refused."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
    if _HELD.setdefault((kind, name), function) is not function:
        raise ValueError(f"{kind} {name!r} is another function already")


def resolve(kind: str, name: str) -> Callable:
    if (kind, name) not in _HELD:
        raise ValueError(f"no {kind} is named {name!r}")
    return _HELD[kind, name]


def vetoes(row: Callable[[str], Column] = F.col, names: tuple[str, ...] | None = None) -> Column:
    """Whether any registered veto (all, or those of ``names``) speaks against a row, as one expression; none is registered by default.

    A veto takes a function from a column's name to the column and gives a condition; null is no veto.
    """
    found = F.lit(False)
    for (kind, name), rule in sorted(_HELD.items(), key=lambda x: x[0]):
        if kind == "veto" and (names is None or name in names):
            found = found | F.coalesce(rule(row), F.lit(False))
    return found


@udtf
class MergeIntervals:
    """Table function: an argument table with columns s and e, partitioned and ordered by s, e, merged to rows of the partition's
    columns of ``keep`` and s, e, n. Touching intervals become one. One interval is held at a time.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, keep: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"s", "e"} - set(rows.dataType.fieldNames()):
            raise ValueError("the first argument is a table with columns s and e")
        names = [c.strip() for c in keep.value.split(",") if c.strip()]
        fields = [rows.dataType[c] for c in names]
        return AnalyzeResult(T.StructType([*fields, T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("n", T.LongType())]))

    def __init__(self):
        self.held = None

    def eval(self, row, keep):
        if row["s"] is None or row["e"] is None:
            return
        names = tuple(row[c.strip()] for c in keep.split(",") if c.strip())
        if self.held and row["s"] <= self.held[2]:
            self.held = (names, self.held[1], max(self.held[2], row["e"]), self.held[3] + 1)
            return
        done, self.held = self.held, (names, row["s"], row["e"], 1)
        if done:
            yield (*done[0], *done[1:])

    def terminate(self):
        if self.held:
            yield (*self.held[0], *self.held[1:])


def _spread(values: pd.Series) -> float:
    """Median distance from the median; null without values."""
    values = values.dropna()
    return float((values - values.median()).abs().median()) if len(values) else None


def for_sql(spark: SparkSession) -> list[str]:
    """Register the Python functions of the library under their SQL names: scalars, the table function ``tessera_merge_intervals`` and the aggregate ``tessera_spread``."""
    from . import jsontext, text, urls

    named = {"tessera_nfc": text.nfc, "tessera_ascii_name": urls.ascii_name, "tessera_json_array": jsontext.json_array, "tessera_uuid5": jsontext.uuid5}
    # A group's values come together in one task, as for any exact median.
    named["tessera_spread"] = F.pandas_udf("double")(_spread)
    for name, function in named.items():
        spark.udf.register(name, function)
    spark.udtf.register("tessera_merge_intervals", MergeIntervals)
    return sorted([*named, "tessera_merge_intervals"])


def token_counter(name: str):
    """A column function that counts with a registered tokenizer (text to number), one text at a time."""
    count = resolve("tokenizer", name)

    bound_batches(SparkSession.getActiveSession())

    @F.arrow_udf(T.IntegerType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([count(t.as_py() or "") for t in texts], pa.int32())

    return counted


#: Fixed value: the pre-token pattern of byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_counter(path: str, pattern: str = BYTE_PATTERN) -> Callable[[str], int]:
    """A token counter from a file of ranks (a token in base64 and its rank on each line), read once here and built once in each worker."""
    import base64

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    built: list = []

    def count(text: str) -> int:
        if not built:
            import tiktoken

            built.append(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return len(built[0].encode_ordinary(text))

    return count
