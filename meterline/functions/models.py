"""Text models as pluggable batch functions, and a built-in embedding by feature hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.responses import decode_completion
from meterline.functions.text import SYSTEM_TEXT, default_text

EmbedFunction = Callable[[list[str]], Sequence[Sequence[float]]]
ChatFunction = Callable[[list[list[dict[str, str]]], float], Sequence[str]]

HASHED_DIMENSIONS = 256
TEMPERATURE = 0.2


def embed_texts(
    df: DataFrame,
    text: str,
    embed: EmbedFunction | None = None,
    output: str = "embedding",
    dimensions: int = HASHED_DIMENSIONS,
) -> DataFrame:
    """Add one vector per text.

    ``embed`` takes a list of texts and returns one vector for each; it runs in the tasks,
    once per Arrow batch. Without it words are hashed into ``dimensions`` counts of unit
    length, row by row in the JVM and without a shuffle.
    """
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise TypeError(f"column {text} must hold text")
    if embed is None:
        return _hashed(df, text, output, dimensions)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed_batch(texts: pd.Series) -> pd.Series:
        vectors = list(embed(texts.tolist())) if len(texts) else []
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
        return pd.Series(vectors, index=texts.index, dtype=object)

    return df.withColumn(output, embed_batch(default_text(F.col(text))))


def _hashed(df: DataFrame, text: str, output: str, dimensions: int) -> DataFrame:
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit")
    staged = df.withColumn("_text", default_text(F.col(text)))
    for stage in (words, counts, unit):
        staged = stage.transform(staged)
    vector = vector_to_array("_unit", "float32").alias(output)
    return staged.select(*[F.col(name) for name in df.columns if name != output], vector)


def generate(
    prompts: DataFrame,
    chat: ChatFunction,
    prompt: str = "prompt",
    output: str = "answer",
    temperature: float = TEMPERATURE,
    system_text: str = SYSTEM_TEXT,
) -> DataFrame:
    """Add the answer to each prompt.

    ``chat`` takes a batch of message lists and the temperature and returns one JSON
    response body for each; it runs in the tasks, once per Arrow batch.
    """

    @F.pandas_udf(T.StringType())
    def chat_batch(batch: pd.Series) -> pd.Series:
        talks = [
            [{"role": "system", "content": system_text}, {"role": "user", "content": one}]
            for one in batch
        ]
        bodies = list(chat(talks, temperature)) if talks else []
        if len(bodies) != len(talks):
            raise ValueError(f"{len(talks)} prompts gave {len(bodies)} responses")
        return pd.Series(bodies, index=batch.index, dtype=object)

    answered = prompts.withColumn("_response", chat_batch(F.col(prompt)))
    return decode_completion(answered, "_response", output)
