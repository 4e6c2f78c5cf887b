"""Byte-pair encoding of prompts with a given vocabulary file; needs the optional `tokenizers` library."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalar import clean_lower


def encode(texts: DataFrame, vocabulary: str, column: str = "text", context: int = 32, start: str = "<|startoftext|>", end: str = "<|endoftext|>") -> DataFrame:
    """Adds `ids`: the cleaned text's tokens between start and end, cut to `context` (the end stays) and padded with 0."""
    names = texts.columns

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        first, last = t.token_to_id(start), t.token_to_id(end)
        for b in batches:
            out = []
            for e in t.encode_batch(b.column(len(names)).to_pylist(), add_special_tokens=False):
                ids = [first, *e.ids, last]
                ids = ids if len(ids) <= context else [*ids[: context - 1], last]
                out.append(ids + [0] * (context - len(ids)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.list_(pa.int32()))], names=[*names, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    cleaned = texts.withColumn("_clean", F.coalesce(clean_lower(F.col(column)), F.lit("")))
    return cleaned.mapInArrow(run, StructType([*texts.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(ids: list[int], vocabulary: str) -> str:
    """The text of token ids, without padding and special tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    special = {t.token_to_id(x) for x in ("<|startoftext|>", "<|endoftext|>")}
    while ids and ids[-1] == 0:
        ids = ids[:-1]
    words = [t.id_to_token(i) for i in ids if i not in special]
    return "".join(words).replace("</w>", " ").strip()
