"""Model-assisted extraction as a batched job; the caller brings the scoring function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import text as tx
from pagelake.functions.jsonpath import quoted
from pagelake.session import spread

# How much of a text each kind of prompt may hold.
EXTRACT_LENGTH, CLASSIFY_LENGTH, NORMALIZE_LENGTH = 8000, 5000, 3000

Scorer = Callable[[pd.DataFrame], pd.Series]


def source_text(df: DataFrame, source: str = "") -> Column:
    """The named column, or the whole row as JSON."""
    return F.coalesce(F.col(source), F.lit("")) if source else F.to_json(F.struct(*df.columns))


def _with_note(prompt: str, label: str, note: str) -> str:
    return f"{prompt}\n{label}: {note}" if note else prompt


def extract_prompt(text: Column, fields: Iterable[str], note: str = "") -> Column:
    system = _with_note(
        "Read the fields below from the text and answer with one JSON object and nothing else."
        f" Fields: {', '.join(fields)}", "Note", note,
    )
    return F.struct(
        F.lit(system).alias("system"),
        F.concat(F.lit("Text:\n"), F.substring(text, 1, EXTRACT_LENGTH)).alias("user"),
    )


def classify_prompt(text: Column, categories: Iterable[str], note: str = "") -> Column:
    system = _with_note(
        f"Answer with the one category that fits the text. Categories: {', '.join(categories)}", "Note", note
    )
    return F.struct(F.lit(system).alias("system"), F.substring(text, 1, CLASSIFY_LENGTH).alias("user"))


def normalize_prompt(text: Column, target_format: str = "") -> Column:
    system = _with_note("Normalise the text and answer with the result only.", "Format", target_format)
    return F.struct(F.lit(system).alias("system"), F.substring(text, 1, NORMALIZE_LENGTH).alias("user"))


def score(df: DataFrame, prompt: Column, scorer: Scorer | None, reply: str = "reply") -> DataFrame:
    """Add the scorer's reply, asked in Arrow batches; no scorer or no text gives null.

    The scorer gets a frame with ``system`` and ``user``. Only rows with text are sent on.
    """
    if scorer is None:
        return df.withColumn(reply, F.lit(None).cast("string"))
    ready = df.withColumn("_prompt", prompt)
    schema = T.StructType([*df.schema.fields, T.StructField(reply, T.StringType())])
    columns = df.columns

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            asked = batch["_user"].fillna("").str.len() > 0
            if asked.any():
                part = batch[asked]
                answers[asked] = list(
                    scorer(pd.DataFrame({"system": part["_system"], "user": part["_user"]}))
                )
            yield batch[columns].assign(**{reply: answers})

    flat = ready.select("*", F.col("_prompt.system").alias("_system"), F.col("_prompt.user").alias("_user"))
    return spread(flat.drop("_prompt")).mapInPandas(ask, schema)


def parse_reply(reply: Column | str) -> Column:
    """A reply as VARIANT: all of it, else a fenced block, else from the first { to the last }."""
    reply = tx.col(reply)
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    span = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(
        F.try_parse_json(F.nullif(reply, F.lit(""))),
        F.try_parse_json(F.nullif(fenced, F.lit(""))),
        F.try_parse_json(F.nullif(span, F.lit(""))),
        F.parse_json(F.lit("{}")),
    )


def snap_category(reply: Column | str, categories: list[str]) -> Column:
    """The first category the reply contains, else the reply without quotes around it."""
    bare = tx.strip(tx.col(reply))
    for quote in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{quote}+|{quote}+$", "")
    names = F.array(*[F.lit(c) for c in categories])
    return F.coalesce(F.get(F.filter(names, lambda c: F.contains(bare, c)), 0), bare)


def merge_extracted(df: DataFrame, parsed: str, fields: Iterable[str]) -> DataFrame:
    """Put the extracted fields over the row; what the reply lacks stays as it is."""
    out = {}
    for name in fields:
        new = F.try_variant_get(F.col(parsed), "$" + quoted(name), "string")
        out[name] = F.coalesce(new, F.col(name).cast("string")) if name in df.columns else new
    return df.withColumns(out)


def extract_fields(df: DataFrame, fields: list[str], scorer: Scorer | None, source: str = "", note: str = "") -> DataFrame:
    """Prompt, score, parse and merge; without a scorer the rows stay unchanged."""
    if scorer is None:
        return df
    prompt = F.when(source_text(df, source) != "", extract_prompt(source_text(df, source), fields, note))
    asked = score(df, prompt, scorer, "_reply")
    parsed = asked.withColumn("_parsed", F.when(F.col("_reply").isNotNull(), parse_reply("_reply")))
    return merge_extracted(parsed, "_parsed", fields).drop("_reply", "_parsed")


def classify(df: DataFrame, categories: list[str], scorer: Scorer | None, source: str = "",
             target: str = "category", note: str = "") -> DataFrame:
    """Add or overwrite ``target`` where the scorer gave a category."""
    if scorer is None:
        return df
    prompt = F.when(source_text(df, source) != "", classify_prompt(source_text(df, source), categories, note))
    new = F.nullif(snap_category("_reply", categories), F.lit(""))
    asked = score(df, prompt, scorer, "_reply")
    value = F.coalesce(new, F.col(target).cast("string")) if target in df.columns else new
    return asked.withColumn(target, value).drop("_reply")


def normalize(df: DataFrame, column: str, scorer: Scorer | None, target_format: str = "") -> DataFrame:
    """Replace a text by its normalised form where the scorer gave one."""
    if scorer is None:
        return df
    prompt = F.when(F.col(column) != "", normalize_prompt(F.col(column), target_format))
    asked = score(df, prompt, scorer, "_reply")
    return asked.withColumn(column, F.coalesce(tx.strip("_reply"), F.col(column))).drop("_reply")
