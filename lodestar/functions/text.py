"""Column builders for text: blanks, words, keyword scores, shard hashes, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, as in trimming and splitting.
SPACE = r"(?U)\s+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(trimmed(text)) == 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def keyword_score(text: Column, query: Column | str, fold_query: bool = False) -> Column:
    """Share of the query's words that lower-cased text contains. The query's case counts unless fold_query."""
    q = F.lit(query) if isinstance(query, str) else query
    q = F.lower(q) if fold_query else q
    low = F.lower(text)
    asked = words(q)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.filter(asked, lambda w: F.contains(low, w))) / F.size(asked).cast("double"))


def length_boost(score: Column, text: Column) -> Column:
    """The stub reranker: a thousandth more for each byte, 1 at most."""
    return F.least(F.lit(1.0), score + F.octet_length(text) / F.lit(1000.0))


def shard_of(name: Column, shards: int) -> Column:
    """Base-31 polynomial of the UTF-8 bytes in 64 unsigned bits, modulo shards; decimals, so nothing overflows."""
    if shards < 1:
        raise ValueError("at least one shard")
    digits = F.hex(F.encode(name, "UTF-8"))
    count = F.length(digits) / 2
    codes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("decimal(38,0)"))).otherwise(F.array().cast("array<decimal(38,0)>"))
    wrap = F.lit("18446744073709551616").cast("decimal(38,0)")
    fold = F.aggregate(codes, F.lit(0).cast("decimal(38,0)"), lambda h, b: F.pmod((h * F.lit(31) + b).cast("decimal(38,0)"), wrap).cast("decimal(38,0)"))
    return F.pmod(fold, F.lit(shards)).cast("int")


def replica_shards(primary: Column, shards: int, replicas: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(max(1, replicas) - 1)), lambda i: F.pmod(primary + i, F.lit(shards)))


def fill(template: str, context: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{context}"), context)


def shortened(text: Column, n: int = 80) -> Column:
    """At most n characters, then dots."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def without_end(value: Column, end: str) -> Column:
    """value without any number of ``end`` (one character) at its end."""
    return F.rtrim(value, F.lit(end))


def first_of(value: Column, separator: str = ",") -> Column:
    """What stands before the first separator, without white space around it."""
    return trimmed(F.split_part(value, F.lit(separator), F.lit(1)))
