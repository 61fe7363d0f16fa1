"""Places of tokens of public vocabularies, worked out once and used by all that counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .batches import bound_batches

_LOADED: dict[str, object] = {}
#: Characters given to the library at a time: what it returns is some hundred times as large.
AT_ONCE = 1 << 17
_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in order, in runs of ``AT_ONCE`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > AT_ONCE:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def _placed(encode: Callable[[list[str]], list], texts: pa.Array) -> pa.Array:
    """The places of each text's tokens as one Arrow list; numbers are packed run by run."""
    ends, flat = [0], []
    for run in _runs([t or "" for t in texts.to_pylist()]):
        for e in encode(run):
            offsets = e.offsets
            flat.append(np.fromiter(chain.from_iterable(offsets), np.int32, 2 * len(offsets)))
            ends.append(ends[-1] + len(offsets))
    pairs = np.concatenate(flat).reshape(-1, 2) if flat else np.zeros((0, 2), np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], fields=list(_PLACE))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def token_places(path: str) -> Callable[[Column], Column]:
    """A column function from text to the (start, end) of its tokens in code points, without added ones; null has none.

    The vocabulary file is read here and sent with the plan, so executors need no path;
    each worker builds it once, known by its content, and tokenizes a bounded number of characters at a time.
    """
    with open(path, "rb") as file:
        data = file.read()
    name = hashlib.sha256(data).hexdigest()

    bound_batches(SparkSession.getActiveSession())

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _LOADED:
            from tokenizers import Tokenizer

            built = Tokenizer.from_str(data.decode())
            built.no_truncation()
            built.no_padding()
            _LOADED[name] = built
        for texts in batches:
            yield _placed(lambda run: _LOADED[name].encode_batch(run, add_special_tokens=False), texts)

    # Else the optimizer writes the call into filters over its result too, and texts are tokenized twice.
    return placed.asNondeterministic()


def tokens_within(places: Column, start: Column, end: Column) -> Column:
    """How many tokens begin in [start, end): parts that meet at a token's start add up."""
    return F.size(F.filter(places, lambda p: (p["start"] >= start) & (p["start"] < end)))
