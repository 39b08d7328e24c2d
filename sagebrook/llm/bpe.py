"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Texts are cut into parts of about so many characters before the regex runs.
PART_CHARS = 100_000
#: White space runs from this length on are encoded as the pieces that they are.
LONG_RUN = 500
#: Unicode white space, which the pattern's \s stands for.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


@functools.cache
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """``text`` in parts that encode separately; True marks a part that is one piece of white space.

    The pattern lets no match go from a character that isn't white space to one
    that is, so each such place is a safe boundary. A long run of white space is
    one match but for its last character, which the next match may begin with;
    at the end of the text it is one match altogether.
    """
    start = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in _cut(text[start : run.start()], part_chars):
            yield part, False
        yield text[run.start() : end], True
        start = end
    for part in _cut(text[start:], part_chars):
        yield part, False


def _cut(text: str, part_chars: int) -> Iterator[str]:
    start = 0
    while len(text) - start > part_chars:
        at = start + part_chars
        while at < len(text) and not (text[at] in _SPACE and text[at - 1] not in _SPACE):
            at += 1
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


def encode_text(enc, text: str, part_chars: int = PART_CHARS) -> list[int]:
    """The ids of the whole text, special tokens as ordinary text."""
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, one_piece in safe_parts(text, part_chars):
        ids += enc._encode_single_piece(part) if one_piece else enc.encode_ordinary(part)
    return ids


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row. A null or empty text has no ids; ids and rows may repeat."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode_text(enc, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of the ids, valid UTF-8 or not. Null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256, in one pass over the texts.

    The ids go straight from the encoder to the decoder in the same task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t in batch.column(1):
                ids = encode_text(enc, t.as_py())
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                out[2].append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(
        digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
