"""Token ids of a public tokenizer for whole texts, and back (problem 8).

Arrow batches go to the ``tokenizers`` library; nothing is shuffled. Texts of natural language repeat their words, so the
chunks between plain spaces are encoded once each and remembered in a bounded table per task: the ids are those of
encoding the text in one piece, as byte-level BPE never merges across the start of a word. The driver sends no data: every
worker reads the tokenizer file, which is named by a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import tokenizer_folder

DEFAULT = "byte_bpe_50k"
#: Chunks remembered per task; beyond that the table starts again.
REMEMBERED = 300_000
#: Characters of a chunk that is remembered beyond its batch, so that the table has a bounded size in bytes too.
LONGEST = 64
#: A space between two characters that are no white space. The published split of the byte-level tokenizers begins a new
#: word at every such space, so the chunks between them can be encoded apart.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space is no such boundary.
_UNEVEN = re.compile(r" (?:\s|(?<=\s ))")


def chunks(text: str) -> list[str]:
    """The text cut at its boundary spaces, which are dropped."""
    return _BOUNDARY.split(text) if text[0] == " " or text[-1] == " " or _UNEVEN.search(text) else text.split(" ")


@lru_cache(maxsize=None)
def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Codec:
    """Encodes and decodes with one tokenizer file of the byte-level kind."""

    def __init__(self, name: str = DEFAULT, folder: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{folder or tokenizer_folder()}/{name}.json")
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: Ids, as 32-bit bytes, of chunks after a boundary space and of chunks at the start of a text.
        self.later: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        #: Long chunks of the batch at hand.
        self.passing: list[tuple[dict[str, bytes], str]] = []
        back = {c: b for b, c in byte_characters().items()}
        self.pieces = {i: bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode() for piece, i in self.tokenizer.get_vocab().items()}

    def _remember(self, known: dict[str, bytes], wanted: set[str], prefix: str) -> None:
        new = list(wanted.difference(known))
        if not new:
            return
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(wanted)
        for chunk, encoded in zip(new, self.tokenizer.encode_batch([prefix + c for c in new], add_special_tokens=False)):
            known[chunk] = np.array(encoded.ids, dtype=np.int32).tobytes()
            if len(chunk) > LONGEST:
                self.passing.append((known, chunk))

    def _cut(self, texts: list[str | None]) -> list[list[str]]:
        """Chunks of each text, all of them remembered; long ones for this batch only."""
        for known, chunk in self.passing:
            known.pop(chunk, None)
        self.passing.clear()
        cut = [chunks(t) if t else [] for t in texts]
        self._remember(self.first, {c[0] for c in cut if c}, "")
        self._remember(self.later, set(chain.from_iterable(cut)), " ")
        return cut

    def encode_array(self, texts: list[str | None]) -> pa.Array:
        """LIST<INT>; null and empty texts give empty lists."""
        out, offsets, place = [], [0], 0
        later = self.later.__getitem__
        for cut in self._cut(texts):
            if cut:
                ids = self.first[cut[0]] + b"".join(map(later, islice(cut, 1, None)))
                place += len(ids) // 4
                out.append(ids)
            offsets.append(place)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(out), dtype=np.int32)))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return self.encode_array(texts).to_pylist()

    def lengths(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens."""
        later = self.later.__getitem__
        return [(len(self.first[cut[0]]) + sum(map(len, map(later, islice(cut, 1, None))))) // 4 if cut else 0 for cut in self._cut(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids. Characters split between tokens are joined again; bytes that are no character (of a
        cut list of ids) become U+FFFD."""
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", errors="replace")

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character range of each token. A token that holds a part of a character covers the whole character."""
        spans, place, raw = [], 0, text.encode("utf-8")
        starts = np.cumsum([0] + [(b & 0xC0) != 0x80 for b in raw])  # characters begun before each byte
        for i in self.encode_many([text])[0]:
            end = place + len(self.pieces[i])
            first = int(starts[place + 1]) - 1 if place < len(raw) else len(text)
            spans.append((first, int(starts[end])))
            place = end
        return spans


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """(id, ids): ids of every text, an empty list for null and empty texts. Whole texts, any length; ids may repeat."""
    path = folder or tokenizer_folder()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(name, path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), codec.encode_array(batch.column(1).to_pylist())], names=[id_column, "ids"])

    kind = dict(df.dtypes)[id_column]
    return df.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).mapInArrow(encode, f"`{id_column}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id_column: str = "doc_id", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """(id, text) of (id, ids): the reverse of :func:`encode_corpus`; empty lists give empty texts, null ids null."""
    path = folder or tokenizer_folder()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(name, path)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = dict(df.dtypes)[id_column]
    return df.select(f"`{id_column}`", "ids").mapInArrow(decode, f"`{id_column}` {kind}, text string")


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """(id, tokens) of every text; null and empty texts have none."""
    path = folder or tokenizer_folder()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(name, path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.lengths(batch.column(1).to_pylist()), pa.int32())], names=[id_column, "tokens"])

    kind = dict(df.dtypes)[id_column]
    return df.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).mapInArrow(count, f"`{id_column}` {kind}, tokens int")
