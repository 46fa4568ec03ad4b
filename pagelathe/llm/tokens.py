"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelathe.session import written

#: Folder of the tokenizers' files, and the vocabulary used unless another is named (byte-level BPE as ranks).
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once; longer texts are cut at such places (see ``count``).
PIECE = 100_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of the file, loaded once per Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count(text: str, enc) -> int:
    """Tokens of a text. Very long texts are encoded in pieces, cut where a letter follows a space: there the pattern splits in any case."""
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total, start = 0, 0
    while start < len(text):
        end = min(start + PIECE, len(text))
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        total += len(enc.encode_ordinary(text[start:end]))
        start = end
    return total


def token_counts(documents: DataFrame, keep: tuple[str, ...] = (), path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """Written: ``doc_id``, the columns ``keep``, and ``tokens bigint``. One pass; texts don't move. A null or empty text has 0."""

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = np.fromiter((count(t.encode("utf-8", "replace").decode(), enc) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "tokens"])

    rows = documents.select("doc_id", *keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return written(rows.mapInArrow(run, f"{schema}, tokens bigint"), "tokens")
