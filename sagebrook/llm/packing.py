"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, stored, text_of

SEQUENCE = 2048
END_ID = 0
#: Pieces that one task packs, on average.
PIECES_PER_TASK = 1 << 17
#: Words and pieces kept with their ids, twice at most, in each worker.
CACHE_WORDS = 1 << 18

_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Unicode white space; Python's split() also takes \x1c to \x1f, which the tokenizer doesn't.
_WORD = re.compile("[^\t\n\x0b\x0c\r \x85\xa0  -     　]+")

#: Words that lower-case and normalise letter by letter, and the tokenizer's pieces of them.
_LATIN = re.compile("[!-~\u00a1-\u024f]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: The same for whole texts of such words and blanks, without three letters whose lower case is none of these.
_LATIN_TEXT = re.compile("[\t-\r -~\xa0-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾"
_LATIN_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^\t-\r \xa0{_LETTERS}{_NUMBERS}]+")


def _byte_chars() -> dict[int, int]:
    """Byte-level letters: printable bytes stand for themselves, the others for 256 and on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_CHARS = _byte_chars()


def _byte_level(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)


class WordIds:
    """Ids of texts as little-endian 32-bit integers, by a tokenizer that never joins across white space.

    Ids of recent words are kept, in two generations, so that memory is bounded.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, word: str) -> list[str]:
        """What the model gets: the tokenizer's own steps, or the same in short for words of Latin letters."""
        if not _LATIN.fullmatch(word):
            plain = self.tokenizer.normalizer.normalize_str(word)
            return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        plain = word.lower()
        pieces = [plain] if plain.isalpha() else _PIECES.findall(plain)
        return [_byte_level(p) for p in pieces]

    def __call__(self, text: str) -> bytes:
        latin = _LATIN_TEXT.fullmatch(text)
        if latin:  # pieces, which words share; their ids don't depend on what is beside them
            parts = _LATIN_PIECES.findall(text.lower())
        else:
            parts = _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()
        ids = [*map(self.young.get, parts)]
        if None in ids:
            if len(self.young) > CACHE_WORDS:
                self.old, self.young, ids = self.young, {}, [None] * len(parts)
            known, old, tokenize = self.young, self.old, self.tokenizer.model.tokenize
            for at, part in enumerate(parts):
                if ids[at] is None:
                    found = known.get(part) or old.get(part)
                    if not found:
                        found = [t.id for p in ([_byte_level(part)] if latin else self._pieces(part)) for t in tokenize(p)]
                        found = struct.pack(f"<{len(found)}I", *found)
                    known[part] = ids[at] = found
        return b"".join(ids)


@functools.cache
def word_ids(file: str) -> WordIds:
    return WordIds(file)


def token_pieces(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, sequence: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only where it is too long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_file)
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    source.append(row), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(
        work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each size, placed in the given order.

    Each size goes where the sum over gaps of (open bins with that gap) squared
    becomes smallest; a full bin counts no more. Of equal changes the smallest gap wins.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        gap, bin_ = capacity, -1
        if s < capacity:
            have = count[s:capacity]
            gaps = np.flatnonzero(have)
            if len(gaps):
                change = np.where(gaps > 0, 2 * count[gaps] + 1, 0) - 2 * have[gaps] + 1  # a bin filled up adds no square
                best = int(change.argmin())
                if change[best] <= 2 * count[capacity - s] + 1:
                    gap = s + int(gaps[best])
                    bin_ = open_bins[gap].pop()
                    count[gap] -= 1
        if bin_ < 0:
            bin_, made = made, made + 1
        bins[k], offsets[k] = bin_, capacity - gap
        if gap > s:
            open_bins[gap - s].append(bin_)
            count[gap - s] += 1
    return bins, offsets


def pack_documents(
    docs: DataFrame, tokenizer_file: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", pieces_per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its words and one end id; only one that is longer
    than ``sequence`` is cut. Pieces are dealt by hash to tasks of about
    ``pieces_per_task`` rows (numbers only, no texts) and packed there, largest
    first; each task leaves a few sequences unfilled. A null or empty text is
    its end id alone. Rows that repeat are packed as often; null ids are
    packed like others. An empty table gives no rows; other columns are ignored.
    """
    pieces = stored(token_pieces(docs, tokenizer_file, id_col, text_col, sequence), "pieces")
    tasks = max(1, -(-pieces.count() // pieces_per_task))

    @giving_back
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        task = table["task"][0].as_py()
        bins, offsets = sum_of_squares(table["length"].to_numpy(), sequence)
        out = table.drop(["task"]).append_column("sequence_id", pa.array(bins + (task << 40)))
        yield from out.append_column("offset", pa.array(offsets)).to_batches()

    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return (
        dealt.repartitionById(tasks, F.col("task").cast("int"))
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
        .mapInArrow(pack, f"{schema}, sequence_id long, offset long")
    )
