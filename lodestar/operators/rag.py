"""Retrieval-augmented prompts: the last user turn, routing, context lines, templates, system message."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.functions import text

TOP_K = 5


@dataclass(frozen=True)
class Preset:
    """How texts become a system message: each line, what joins them, and the templates around {context}."""

    line: str
    joiner: str
    context: str
    system: str
    trim_query: bool = True


# The wordings of the server, the standalone adapter and the example adapter.
SERVER = Preset(
    "- [{n}]: {text}",
    "\n",
    "Context:\n{context}",
    "You are a helpful assistant with access to the following private knowledge base. Use the context below to answer accurately. If the answer is not in the context, say so.\n\n{context}",
)
ADAPTER = Preset("{text}", "\n- ", "{context}", "Use this context for the answer:\n- {context}\n\n", trim_query=False)
EXAMPLE = Preset("{text}", "\n", "{context}", "Use this context:\n{context}\n\nAnswer the question.", trim_query=False)
PRESETS = {"server": SERVER, "adapter": ADAPTER, "example": EXAMPLE}


def last_user(turns: DataFrame, trim: bool = True) -> DataFrame:
    """conv_id and query: the last user turn, empty if there is none."""
    said = F.max(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"]
    query = F.coalesce(text.trimmed(said) if trim else said, F.lit(""))
    return turns.groupBy("conv_id").agg(query.alias("query"))


def route(queries: DataFrame) -> DataFrame:
    """queries with route: 'none' for an empty query, 'hybrid' for more than three words, else 'vector'."""
    n = text.word_count(F.col("query"))
    return queries.withColumn("route", F.when(F.col("query") == "", "none").when(n > 3, "hybrid").otherwise("vector"))


def context(results: DataFrame, preset: Preset = SERVER, by: str | None = None, key: str = "id") -> DataFrame:
    """context and citations of the results (rank, key, text), for each value of by; at most top-k rows a group."""
    before, _, after = preset.line.partition("{text}")
    pieces = before.split("{n}")
    number = [F.lit(pieces[0])] if len(pieces) == 1 else [F.lit(pieces[0]), F.col("rank").cast("string"), F.lit(pieces[1])]
    rows = results.withColumn("__line", F.concat(*number, F.col("text"), F.lit(after)))
    rows = rows.withColumn("__cite", F.concat(F.lit("Source "), F.col("rank").cast("string"), F.lit(": "), F.col(key).cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "__line", "__cite")))
    grouped = (rows.groupBy(by) if by else rows.groupBy()).agg(ordered.alias("r"))
    out = [F.array_join(F.transform("r", lambda x: x["__line"]), preset.joiner).alias("context"), F.transform("r", lambda x: x["__cite"]).alias("citations")]
    return grouped.select(*([by] if by else []), *out)


def system_text(context_text: Column, preset: Preset = SERVER) -> Column:
    return text.fill(preset.system, text.fill(preset.context, context_text))


def messages(turns: DataFrame) -> DataFrame:
    """conv_id and messages: the turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def augment(chats: DataFrame, preset: Preset = SERVER) -> DataFrame:
    """chats (messages, context) with the context in the system message; a null or empty context changes nothing.

    An existing first system message keeps its words after the new ones.
    """
    said = system_text(F.col("context"), preset)
    first = F.try_element_at(F.col("messages"), F.lit(1))
    pair = lambda content: F.struct(F.lit("system").alias("role"), content.alias("content"))
    rest = F.slice("messages", 2, F.greatest(F.lit(1), F.size("messages")))
    merged = F.concat(F.array(pair(F.concat(said, F.lit("\n\n"), first["content"]))), rest)
    fresh = F.concat(F.array(pair(said)), F.col("messages"))
    has = F.col("context").isNotNull() & (F.col("context") != "")
    out = F.when(~has, F.col("messages")).when(first["role"] == "system", merged).otherwise(fresh)
    return chats.withColumn("messages", out.cast(S.MESSAGE))


def forward(chats: DataFrame, call: Callable[[list[dict]], str], key: str = "conv_id") -> DataFrame:
    """key, answer and error: each row's messages sent by the caller's function; one that raises gives its error."""
    kind = dict(chats.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for messages in frame["messages"]:
                try:
                    answers.append(call([dict(m.asDict() if hasattr(m, "asDict") else m) for m in messages]))
                    errors.append(None)
                except Exception as e:  # the model's failure is a result
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: frame[key], "answer": answers, "error": errors})

    return chats.select(key, "messages").mapInPandas(run, f"`{key}` {kind}, answer string, error string")


def token_usage(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row: texts and their white-space tokens."""
    return texts.agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum(text.word_count(F.col(column)).cast("long")), F.lit(0)).alias("n_tokens"))
