"""Training rows: token ids of prompt and response with the prompt masked in the labels. Training itself is elsewhere."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encode = Callable[[list[str]], list[list[int]]]
MASK = -100


def utf8_bytes(texts: list[str]) -> list[list[int]]:
    """The simplest encoder: the bytes of the text."""
    return [list(t.encode()) for t in texts]


def token_rows(prompt: Column, response: Column, encode: Encode, max_length: int) -> Column:
    """Struct (input_ids, labels, n_prompt) cut at ``max_length``; labels of the prompt are -100. Nulls are empty texts."""
    kind = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("n_prompt", T.IntegerType())])

    @F.arrow_udf(kind)
    def rows(p: pa.Array, r: pa.Array) -> pa.Array:
        ids, labels, n_prompt, ends = array("i"), array("i"), [], [0]
        for a, b in zip(encode([t or "" for t in p.to_pylist()]), encode([t or "" for t in r.to_pylist()])):
            whole, k = (list(a) + list(b))[:max_length], min(len(a), max_length)
            ids.extend(whole)
            labels.extend([MASK] * k + whole[k:])
            n_prompt.append(k)
            ends.append(len(ids))
        offs = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offs, pa.array(np.array(x, np.int32))) for x in (ids, labels)]
        return pa.StructArray.from_arrays([*lists, pa.array(n_prompt, pa.int32())], ["input_ids", "labels", "n_prompt"])

    return rows(prompt, response)


def training_table(df: DataFrame, key: str, prompt: Column, response: Column, encode: Encode, max_length: int, score: Column | None = None) -> DataFrame:
    """(key, input_ids, labels, constraint_score) of the rows that keep a label; rows masked in full are dropped."""
    out = df.select(key, (F.lit(1.0) if score is None else score).alias("constraint_score"), token_rows(prompt, response, encode, max_length).alias("t"))
    return out.select(key, "t.input_ids", "t.labels", "constraint_score", "t.n_prompt").where(F.col("n_prompt") < F.size("input_ids")).drop("n_prompt")
