"""Byte-level BPE from a given tokenizer file: vocabulary, pre-tokens, encoding and decoding."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokenizer's pattern; (?U) gives its classes their Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The base special tokens; speakers' follow, sorted.
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>", "<agent>", "<usr>", "<system>"]
#: So many bytes of text, or ids, are given to the library at once, as it takes over a hundred bytes for each token (a longer row goes alone).
AT_ONCE = 1 << 19


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs at the same time
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): pre-tokens of all texts, counted where they are read before they are shuffled."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    return df.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a tokenizer file, which is of fixed size."""
    found = spark.read.text(path, wholetext=True).select(F.from_json("value", "model struct<vocab: map<string, int>>").alias("j"))
    return found.select(F.explode("j.model.vocab").alias("piece", "id")).select("id", "piece")


def _portions(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, count) of the rows to take at once, by what each holds (null: nothing)."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(ends):
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")), low + 1)
        yield low, high - low
        low = high


def encode(text: Column, path: str, bos: int | None = None, eos: int | None = None) -> Column:
    """Token ids of a text, by Arrow batches, a portion of a batch at a time; bos and eos are put around where given. A null text counts as an empty one: only bos and eos."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        tokenizer, found = _load(path), [np.empty(0, np.int32)]
        for low, n in _portions(pc.binary_length(texts)):
            part = texts.slice(low, n).fill_null("").to_pylist()
            found += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in found]), pa.int32()), pa.array(np.concatenate(found)))

    out = ids(text)
    parts = [F.array(F.lit(bos))] if bos is not None else []
    parts += [out] + ([F.array(F.lit(eos))] if eos is not None else [])
    return F.concat(*parts) if len(parts) > 1 else out


def decode(ids: Column, path: str, drop: list[int] | None = None) -> Column:
    """The text of token ids, without those to drop."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        tokenizer, found = _load(path), []
        for low, n in _portions(pc.list_value_length(rows)):
            part = [r or [] for r in rows.slice(low, n).to_pylist()]
            found.append(pa.array(tokenizer.decode_batch(part, skip_special_tokens=False), pa.string()))
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    kept = F.filter(ids, lambda i: ~i.isin(*drop)) if drop else ids
    return text(kept)


def trim_at(ids: Column, stops: list[int]) -> Column:
    """Ids before the first stop id."""
    first = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(x.isin(*stops), i)), F.isnotnull))
    return F.when(F.isnull(first), ids).otherwise(F.slice(ids, F.lit(1), F.coalesce(first, F.lit(0))))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def decoded_shards(samples: DataFrame, path: str, most: int | None = None, drop: list[int] | None = None) -> DataFrame:
    """(name, sample_index, text) of token shards' samples, the ``most`` first by name and sample."""
    rows = samples if most is None else samples.orderBy("name", "sample_index").limit(most)
    return rows.select("name", "sample_index", decode(F.col("tokens"), path, drop).alias("text"))


def text_ids(texts: DataFrame, path: str, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """Texts of files (path, ordinal, text) with their ids."""
    return texts.withColumn("ids", encode(F.col("text"), path, bos, eos))


def speaker_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """(token): the distinct speakers of Markdown texts (`name`: at a line's start), white space taken out, as <name>, sorted."""
    names = F.regexp_extract_all(F.col(text), F.lit(r"`([^`\n]+)`\s*[:：]"), F.lit(1))
    token = F.concat(F.lit("<"), F.regexp_replace(F.col("name"), r"\s+", ""), F.lit(">"))
    return df.select(F.explode(names).alias("name")).select(token.alias("token")).distinct().orderBy("token")


def fingerprint(df: DataFrame, content: str = "content") -> Column:
    """SHA-256 of a file's bytes in hex."""
    return F.sha2(F.col(content), 256)


def special_list(path: str, speakers: list[str]) -> list[str]:
    """Specials of a tokenizer file, then base specials and speakers that it lacks; the file isn't changed."""
    with open(path, encoding="utf-8") as f:
        known = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return known + [t for t in [*SPECIALS, *sorted(speakers)] if t not in known]
