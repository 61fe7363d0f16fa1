"""Text expressions: tokens, canonical text, identities, occurrences, clips."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"[\x20\x09-\x0D]+"


#: White space of any script, no-break spaces included.
ANY_SPACES = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def tokens(text: Column) -> Column:
    """Lower-cased pieces between white space of any kind, without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ANY_SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a plain reference within another lambda might be evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_count(text: Column) -> Column:
    """Stand-in for a model tokenizer: white-space tokens. Budgets are parameters everywhere."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def canonical(text: Column) -> Column:
    return collapse(nfc(text))


def claim_id(canonical_text: Column) -> Column:
    return F.concat(F.lit("clm-"), F.substring(F.sha2(canonical_text, 256), 1, 16))


def identity(kind: str, payload: Column) -> Column:
    """``ca:<kind>:<sha256>`` over canonical JSON of a struct whose fields are in name order."""
    return F.concat(F.lit(f"ca:{kind}:"), F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256))


def occurrences(text: Column, quote: Column) -> Column:
    """Zero-based starts of ``quote``, overlapping ones included; none for an empty quote.

    The text is split before every place by a look ahead; cutting at every place would read it once per place.
    """
    from .arrays import running_sum

    ahead = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))

    def starts(sizes: Column) -> Column:
        # a place at 0 doesn't split
        inner = F.slice(running_sum(sizes), F.lit(1), F.size(sizes) - 1)
        return F.when(F.startswith(text, quote), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)

    return F.when((F.length(quote) > 0) & F.contains(text, quote), let(F.transform(F.split(text, ahead, -1), F.length), starts)).otherwise(F.array().cast("array<int>"))


def anchor_validity(n_occurrences: Column, claim_is_anchor: Column) -> Column:
    return (
        F.when(n_occurrences == 0, "ANCHOR_FAILED")
        .when(n_occurrences == 1, "bound")
        .when(claim_is_anchor, "bound_multiple")
        .otherwise("ANCHOR_AMBIGUOUS")
    )


def bind_quote(n_occurrences: Column, quote: Column) -> Column:
    """Null if the quote binds to one place, else the reason."""
    return F.when(F.length(quote) == 0, "empty_quote").when(n_occurrences == 0, "quote_not_found").when(n_occurrences > 1, "ambiguous_quote")


def slug(title: Column, most: int = 80) -> Column:
    low = F.regexp_replace(F.lower(title), "&", "and")
    return F.substring(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def excerpt(text: Column, most: int = 220) -> Column:
    """Markdown signs off, white space collapsed, cut at a word with an ellipsis."""
    plain = collapse(F.regexp_replace(text, r"[#*_`>\[\]]", ""))
    cut = F.regexp_replace(F.substring(plain, 1, most), r"\s+\S*$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("…")))


def context_window(text: Column, start: Column, end: Column, around: int = 180) -> Column:
    left = F.greatest(start - around, F.lit(0))
    return F.substr(text, left + 1, F.least(end + around, F.length(text)) - left)


def ratio(numerator: Column, denominator: Column, reason: str) -> Column:
    """Struct (value, undefined, reason): value is null and a reason given where the denominator is 0."""
    empty = F.coalesce(denominator, F.lit(0)) == 0
    return F.struct(
        F.when(~empty, numerator / denominator).alias("value"),
        empty.alias("undefined"),
        F.when(empty, F.lit(reason)).alias("reason"),
    )


def byte_offset(text: Column, char_offset: Column) -> Column:
    return F.octet_length(F.substr(text, F.lit(1), char_offset))


def line_number(text: Column, char_offset: Column) -> Column:
    """One-based; \\r\\n, \\r and \\n each end a line."""
    return F.regexp_count(F.substr(text, F.lit(1), char_offset), F.lit(r"\r\n|\r|\n")) + 1
