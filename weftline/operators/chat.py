"""Conversation history and batch chat: last turns, transcripts, prompts, pluggable generators, message rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST, KEPT = 10, 50


def last_turns(messages: DataFrame, n: int = LAST, *, key: str = "conversation_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The last n rows of every conversation; null times are oldest. Spark prunes each partition to n rows a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return messages.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).withColumn("back", F.col("_n").cast("bigint")).drop("_n")


def speaker_line(role: Column, content: Column) -> Column:
    """``Human: `` for users, ``Assistant: `` for everyone else."""
    return F.concat(F.when(F.lower(F.trim(role)) == "user", "Human: ").otherwise("Assistant: "), F.coalesce(content, F.lit("")))


def transcript(messages: DataFrame, n: int = LAST, *, key: str = "conversation_id", separator: str = "\n") -> DataFrame:
    """(key, transcript): the last n rows of each conversation in order."""
    rows = last_turns(messages, n, key=key).select(key, "back", speaker_line(F.col("role"), F.col("content")).alias("line"))
    lines = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), separator).alias("transcript"))


Generator = Callable[[list[str], int, float], list[dict]]


def echo_generator(prompts: list[str], max_tokens: int, temperature: float) -> list[dict]:
    """The offline stand-in: gives back the question's first words."""
    out = []
    for p in prompts:
        words = p.rsplit("User Question: ", 1)[-1].split("\n", 1)[0].split()[:max_tokens]
        out.append({"content": " ".join(words), "tokens_used": len(words), "error": None})
    return out


def generate(prompts: DataFrame, *, prompt: str = "prompt", generator: Generator = echo_generator, model: str = "echo", max_tokens: int = 500, temperature: float = 0.7) -> DataFrame:
    """Adds content, model, tokens_used and error; other columns, as one that keeps the order, stay.

    A generator that fails is asked again prompt by prompt, so that a bad prompt gives one error row and no more.
    """
    schema = "content string, tokens_used bigint, error string"

    def answers(texts: list[str]) -> list[dict]:
        try:
            return generator(texts, max_tokens, temperature)
        except Exception as e:  # noqa: BLE001
            if len(texts) == 1:
                return [{"content": None, "tokens_used": None, "error": str(e)}]
            return [answers([t])[0] for t in texts]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(answers([x or "" for x in s]) if len(s) else [], columns=["content", "tokens_used", "error"])

    return prompts.withColumn("_g", run(F.col(prompt))).select("*", "_g.*", F.lit(model).alias("model")).drop("_g")


def best_model(models: DataFrame, requested: str | None = None) -> DataFrame:
    """One row: the requested model if available, else the available one of least rank. ``models``: name, rank, available."""
    order = F.when(F.col("name") == F.lit(requested), -1).otherwise(F.col("rank"))
    return models.filter("available").agg(F.min_by("name", F.struct(order, "name")).alias("name"))


def message_rows(answered: DataFrame, at: Column) -> DataFrame:
    """Two message rows per answered question (conversation_id, user_id, question, content, model): the user's and the assistant's."""
    sides = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("string").alias("model_used"), F.lit(0).alias("o")),
        F.struct(F.lit("assistant").alias("role"), F.col("content").alias("text"), F.col("model").alias("model_used"), F.lit(1).alias("o")))
    rows = answered.select("conversation_id", "user_id", F.explode(sides).alias("s"), at.alias("created_at"))
    ident = F.sha2(F.concat_ws("|", "conversation_id", "s.role", F.coalesce("s.text", F.lit("")), F.col("created_at").cast("string")), 256)
    return rows.select(ident.alias("id"), "conversation_id", "user_id", F.col("s.text").alias("content"), "s.role", "s.model_used", "created_at")


def best_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """(request_id, requested, name): for each request the model asked for if available, else the available one of least rank.

    ``requests``: request_id, requested; ``models``: name, rank, available. The registry is a few rows; its best is one.
    """
    free = models.filter("available").select("name", "rank")
    asked = requests.join(F.broadcast(free.select(F.col("name").alias("requested"), F.col("name").alias("_own"))), "requested", "left")
    best = free.agg(F.min_by("name", F.struct("rank", "name")).alias("_best"))
    return asked.crossJoin(F.broadcast(best)).select("request_id", "requested", F.coalesce("_own", "_best").alias("name"))


def rag_prompt(question: Column, context: Column, history: Column, system: str) -> Column:
    """The prompt of ``functions.text.prompt``; a context that says that nothing was found is left out."""
    from weftline.functions.text import prompt
    from weftline.operators.retrieval import NOTHING_FOUND

    return prompt(question, F.when(~F.contains(context, F.lit(NOTHING_FOUND)), context), history, system)
