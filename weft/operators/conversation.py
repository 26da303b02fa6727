"""Conversations as nested rows: assembly, adapters to the canonical row, validation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as X
from weft.functions.tokenizers import Tokenizer

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(PART))])
IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
#: The canonical row. A key is (source_dataset_id, source_split, row_id); a token length of
#: 0, below or null is unknown.
CANONICAL = T.StructType(
    [
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        *(T.StructField(c, T.StringType()) for c in ("source_dataset_id", "split", "row_id", "render_config", "modality_label", "preprocessing_version")),
        T.StructField("original_token_length", T.LongType()),
        T.StructField("source_split", T.StringType()),
    ]
)
BASE_COLUMNS = CANONICAL.fieldNames()
VERSION = "1"
ROLES = ("user", "assistant")


class AdapterError(ValueError):
    """A source whose columns or rows an adapter cannot read."""


def find_column(df: DataFrame, *candidates: str) -> str:
    """The first of the candidates that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise AdapterError(f"none of {list(candidates)} among {df.columns}")


def row_id(df: DataFrame, ordinal: Column, *candidates: str) -> Column:
    """The id as text, unless it is null, empty or missing: then the ordinal."""
    found = next((F.col(c).cast("string") for c in candidates if c in df.columns), F.lit(None).cast("string"))
    return F.when(found.isNull() | (found == ""), ordinal.cast("string")).otherwise(found)


def config_json(**values: object) -> Column:
    return F.lit(json.dumps(values, sort_keys=True))


def gather(turns: DataFrame, conversation: str, order: str) -> DataFrame:
    """One row for each conversation: its turns (role, text) in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), "role", "text")))
    return turns.groupBy(conversation).agg(F.transform(pairs, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def normalise_turns(df: DataFrame) -> DataFrame:
    """turns from a column messages or conversations with role or from, and content or value;
    human and gpt are user and assistant."""
    column = find_column(df, "turns", "messages", "conversations")
    names = df.schema[column].dataType.elementType.fieldNames()
    pick = lambda t, *options: F.coalesce(*(t[c] for c in options if c in names), F.lit(""))
    role = lambda t: F.lower(pick(t, "role", "from"))
    known = lambda t: F.when(role(t).isin("human", "user"), "user").when(role(t).isin("assistant", "gpt"), "assistant").otherwise(role(t))
    return df.withColumn("turns", F.transform(column, lambda t: F.struct(known(t).alias("role"), pick(t, "value", "content", "text").alias("text"))))


def instruction_pairs(df: DataFrame, on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Rows with instruction and response, and those without either ('fail' raises if there are any)."""
    if any(c in df.columns for c in ("turns", "messages", "conversations")):
        found = normalise_turns(df)
        found = found.withColumn("instruction", X.instruction_of(F.col("turns"))).withColumn("response", X.response_of(F.col("turns")))
    else:
        found = df.withColumn("instruction", F.col(find_column(df, "instruction", "prompt", "question"))).withColumn("response", F.col(find_column(df, "response", "answer", "output")))
    bad = F.col("instruction").isNull() | F.col("response").isNull()
    if on_error == "fail" and (n := found.where(bad).count()):
        raise AdapterError(f"{n} rows without an instruction and a response")
    return found.where(~bad), found.where(bad)


def message(role: str, text: Column, images: int = 0) -> Column:
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"))
    return F.struct(F.lit(role).alias("role"), F.array(*[part("image", F.lit(None))] * images, part("text", text)).alias("content"))


def canonical(df: DataFrame, *, source: str, split: str, instruction: Column, target: Column, identity: Column, modality: str = "text", config: Column | None = None, tokens: Column | None = None, images: Column | None = None, n_images: int = 0) -> DataFrame:
    """The canonical row from columns of a source."""
    columns = {
        "images": images if images is not None else F.array().cast(T.ArrayType(IMAGE)), "messages": F.array(message("user", instruction, n_images), message("assistant", target)), "source_dataset_id": F.lit(source),
        "split": F.lit(split), "row_id": identity, "render_config": config if config is not None else config_json(), "modality_label": F.lit(modality), "preprocessing_version": F.lit(VERSION),
        "original_token_length": (tokens if tokens is not None else X.token_length(target)).cast("long"), "source_split": F.lit(split),
    }
    return df.select(*(c.alias(n) for n, c in columns.items())).to(CANONICAL)


def text_rows(df: DataFrame, source: str, split: str, ordinal: Column, instruction: str, limit: int | None = None, tokenizer: str = "char") -> DataFrame:
    """Raw text as transcription targets."""
    text = F.col(find_column(df, "text", "content", "document"))
    return canonical(df, source=source, split=split, instruction=F.lit(instruction), target=X.truncate_tokens(text, limit, tokenizer), identity=row_id(df, ordinal, "id", "doc_id"), tokens=X.token_length(text, tokenizer))


def choice_rows(df: DataFrame, source: str, split: str, ordinal: Column) -> DataFrame:
    """Multiple choice: a question with lettered options, and the letter."""
    if "options" in df.columns:
        options = F.col("options")
    else:
        options = F.array(*(F.coalesce(F.col(f"option_{x}"), F.lit("")) if f"option_{x}" in df.columns else F.lit("") for x in "abcd"))
        options = F.when(F.exists(options, lambda o: o != ""), options)
    column = lambda *names: next((F.col(c) for c in names if c in df.columns), F.lit(None))
    answer = X.answer_letter(column("correct_answer_idx").cast("int"), column("answer", "label", "correct_answer").cast("string"))
    return canonical(df, source=source, split=split, instruction=X.question_text(F.col(find_column(df, "question", "query", "prompt")), options), target=answer, identity=row_id(df, ordinal, "id"))


def fill_token_length(df: DataFrame, tokenizer: str | Tokenizer = "char") -> DataFrame:
    """Lengths that are null or -1, from target_text if there is one, else from the first assistant message."""
    parts = F.get(F.filter("messages", lambda m: m["role"] == "assistant"), 0)["content"]
    first = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    target = F.coalesce(F.col("target_text"), first) if "target_text" in df.columns else first
    length = F.col("original_token_length")
    return df.withColumn("original_token_length", F.when(length.isNull() | (length == -1), X.token_length(target, tokenizer)).otherwise(length))


def retarget(df: DataFrame, split: str) -> DataFrame:
    """A new split; source_split keeps the one before."""
    return df.withColumns({"source_split": F.coalesce("source_split", "split"), "split": F.lit(split)})


def placeholders(messages: Column) -> Column:
    parts = F.flatten(F.transform(messages, lambda m: m["content"]))
    return F.size(F.filter(parts, lambda p: p["type"] == "image"))


def schema_errors(messages: Column, images: Column, metadata: list[Column] | None = None) -> Column:
    """What is wrong with a row, as an array of messages; empty if nothing is."""
    role = lambda k: F.get(messages, k)["role"]
    n = F.coalesce(F.size(messages), F.lit(0))
    kinds = F.transform(F.flatten(F.transform(messages, lambda m: m["content"])), lambda p: p["type"])
    found = [
        F.when(role(F.lit(0)) != "user", F.concat(F.lit("first role "), role(F.lit(0)))), F.when(role(n - 1) != "assistant", F.concat(F.lit("last role "), role(n - 1))),
        F.when(F.exists(messages, lambda m: ~F.coalesce(m["role"], F.lit("")).isin(*ROLES)), F.lit("unexpected role")), F.when(F.exists(kinds, lambda k: ~F.coalesce(k, F.lit("")).isin("image", "text")), F.lit("invalid content type")),
        F.when(placeholders(messages) != F.coalesce(F.size(images), F.lit(0)), F.lit("image count")), *(F.when(c.isNull(), F.lit("missing metadata")) for c in metadata or []),
    ]
    return F.when(n < 2, F.array(F.lit("fewer than 2 messages"))).otherwise(F.array_compact(F.array(*found)))


def validation_summary(df: DataFrame, errors: Column, by: str, most: int | None = None) -> DataFrame:
    """Raw, valid and failed rows of each subset; `most` bounds the raw count."""
    counted = df.withColumn("__bad", F.size(errors) > 0)
    if most is not None:
        counted = counted.limit(most)
    return counted.groupBy(by).agg(F.count("*").alias("raw_rows"), F.count_if(~F.col("__bad")).alias("valid_rows"), F.count_if("__bad").alias("failed_rows"))
