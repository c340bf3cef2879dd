"""Byte-level BPE: text to token ids and back, with the tiktoken library and a local rank file.

``encode`` adds ``ids`` (array<int>), exactly the ids the library gives for the whole text without special
tokens.  Long texts are cut at safe boundaries first, so that no call into the library holds more than about
``piece_chars`` characters: a boundary is safe where the split pattern ends a match whatever follows, which is
between a character that is no white space and one that is.  Each match is encoded by itself, so the pieces' ids
joined are the whole text's ids.  (A stretch without any such boundary stays whole.)  ``decode`` turns ids back
into raw bytes, which need not be valid UTF-8 for a part of a text.

The rank file's bytes are read on the driver (a vocabulary, below MAX_RANK_BYTES) and travel with the function,
so executors need no file.  Defined cases: null text counts as empty and gives no ids, null ids give null;
an unknown id is an error; repeated rows and extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PIECE_CHARS = 20_000
SLICE_BYTES = 1_000_000
MAX_RANK_BYTES = 32_000_000
#: The library counts U+001C to U+001F as no white space, Python does.
_BOUNDARY = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
_CODERS: dict[int, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file (one line per token: base64 of its bytes, rank)."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has over {MAX_RANK_BYTES} bytes; it is no vocabulary file")
    return data


def coder(ranks: bytes, pattern: str):
    """The library's encoding of these ranks; built once per Python worker."""
    k = hash((ranks, pattern))
    if k not in _CODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _CODERS[k] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _CODERS[k]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of ``size`` characters or little more."""
    start = 0
    while len(text) - start > size:
        m = _BOUNDARY.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str | None, size: int = PIECE_CHARS) -> np.ndarray:
    """Token ids (int32) of a whole text."""
    if not text:
        return np.zeros(0, np.int32)
    parts = [text] if len(text) <= size else pieces(text, size)
    # without special tokens in the encoding nothing is allowed or refused
    got = [enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in parts]
    return (got[0] if len(got) == 1 else np.concatenate(got)).astype(np.int32)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about SLICE_BYTES, so that results stay small."""
    values = batch.column(batch.schema.get_field_index(column))
    width = 4 if pa.types.is_list(values.type) else 1
    lens = pc.list_value_length(values) if width == 4 else pc.binary_length(values)
    run = np.cumsum(pc.fill_null(lens, 0).to_numpy(zero_copy_only=False).astype(np.int64) * width + 64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def _mapped(df: DataFrame, source: str, column: str, kind: T.DataType, fn) -> DataFrame:
    """``df`` with ``column`` from ``fn(values of source) -> arrow array``, a few rows at a time."""
    rest = [c for c in df.columns if c != column]
    work = df.select(*rest, *([F.col(source).alias("__in")] if source not in rest else []))
    given = source if source in rest else "__in"

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, given):
                new = fn(batch.column(batch.schema.get_field_index(given)))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in rest] + [new], [*rest, column])

    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(column, kind)])
    return work.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``df`` with ``ids``: the token ids of the whole text, in order."""

    def fn(texts):
        enc = coder(ranks, pattern)
        got = [encode_text(enc, t.as_py(), piece_chars) for t in texts]
        ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))

    return _mapped(df, text, ids, T.ArrayType(T.IntegerType()), fn)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with ``raw``: the bytes of the token ids; null for null."""

    def fn(lists):
        enc = coder(ranks, pattern)
        return pa.array([enc.decode_bytes(x.as_py()) if x.is_valid else None for x in lists], pa.binary())

    return _mapped(df, ids, raw, T.BinaryType(), fn)


def digests(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) by ``encode`` and then ``decode``."""
    coded = decode(encode(df.select(key, text), ranks, pattern, text), ranks, pattern)
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("raw"), 256).alias("decoded_sha256"),
    )


def local_vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The rank file's bytes and the split pattern; ``path`` defaults to the installed public vocabulary."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    """op8: token count and digests of the ids and of the bytes they decode to, per document."""
    ranks, pattern = local_vocabulary()
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, pattern)
