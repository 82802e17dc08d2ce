"""Public tokenizers on workers: encoding, counting and decoding.

Vocabulary files are read from a path given as a parameter and sent to the
workers as one broadcast of fixed size; they are never copied elsewhere.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as Unicode defines it (and as the pattern's \s does).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: No alternative of the pattern runs from a non-blank into a blank, so a cut
#: before a blank that follows a non-blank never changes the tokens.  There is
#: no cut before a carriage return, which other vocabularies join to a mark.
PIECES = re.compile(f"[{_BLANK}]*[^{_BLANK}]+(?:\r[{_BLANK}]*[^{_BLANK}]*)*|[{_BLANK}]+")

#: A letter before a character that is no letter, digit or blank is such a place too.
_LETTER_END = re.compile(rf"(?<=[^\W\d_])(?=[^\w{_BLANK}])")

_MEMO_PIECES, _MEMO_CHARS, _LONG = 1 << 18, 32, 4096


def safe_pieces(text: str) -> list[str]:
    """``text`` cut at safe boundaries; pieces that are still long are cut where a letter run ends."""
    pieces = PIECES.findall(text)
    if len(text) > _LONG and max(map(len, pieces)) > _LONG:
        return list(chain.from_iterable(_LETTER_END.split(p) if len(p) > _LONG else (p,) for p in pieces))
    return pieces


class _Memo(dict):
    """Piece -> result; short pieces are kept, and all are dropped when the memo is full (memory stays bounded)."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(piece) <= _MEMO_CHARS:
            if len(self) >= _MEMO_PIECES:
                self.clear()
            self[piece] = made
        return made


def load_tiktoken(rank_file: bytes):
    """A tiktoken encoding from the bytes of a local rank file, without special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteLevelCounter:
    """Numbers of tokens by a byte-level rank file."""

    def __init__(self, vocabulary: bytes):
        self.encoding = load_tiktoken(vocabulary)

    def middle(self, piece: str) -> int:
        """Tokens of a piece of ``PIECES`` within a text."""
        return len(self.encoding.encode_ordinary(piece))

    def first(self, piece: str) -> int:
        """Tokens of the piece that begins a text."""
        return self.middle(piece)


class SentencePieceCounter:
    """Numbers of tokens by a sentencepiece model, which puts a blank before every text.

    No token of the model holds a blank after another character, so the tokens
    of a text are those of its pieces.
    """

    def __init__(self, vocabulary: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        names = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        blank = _BLANK.replace("\t-\r", "\t-\x0c")  # no cut is made before a carriage return
        inner = re.compile(f"[^\u2581].*[\u2581{blank}]|\u2581+[{blank}]", re.S)
        if any(inner.search(n) for n in names if not n.startswith("<0x")):
            raise ValueError("a token of this model reaches over a blank")

    def middle(self, piece: str) -> int:
        if piece[0] == " ":
            return len(self.model.encode(piece[1:])) if len(piece) > 1 else 1
        return len(self.model.encode(piece)) - 1  # without the blank put before it

    def first(self, piece: str) -> int:
        return len(self.model.encode(piece))


def load_counter(path: str, vocabulary: bytes):
    """The counter for a vocabulary file, by the ending of its name."""
    return (ByteLevelCounter if path.endswith(".tiktoken") else SentencePieceCounter)(vocabulary)


def count_tokens(counter, text: str | None) -> int:
    """Tokens of a whole text; 0 for null and empty."""
    if not text:
        return 0
    pieces = PIECES.findall(text)
    return counter.first(pieces[0]) + sum(map(counter.middle, pieces[1:]))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_READY: dict[str, object] = {}


def _once(key: str, make: Callable[[], object]):
    """One object per Python worker, made when first used."""
    if key not in _READY:
        _READY[key] = make()
    return _READY[key]


def encode(docs: DataFrame, id_col: str, text_col: str, rank_path: str) -> DataFrame:
    """(id, ids array<int>): the ids of every text by the byte-level vocabulary in ``rank_path``.

    Null and empty texts have an empty list.  Texts are cut at safe
    boundaries, and the ids of a short piece are kept by the worker, as natural
    text repeats its words; the result is that of encoding the whole text.
    There is no shuffle: each task encodes the rows it reads.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(rank_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            encoding = load_tiktoken(ranks.value)
            return _Memo(encoding.encode_ordinary)

        get = _once(f"encode {rank_path}", make).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = [list(chain.from_iterable(map(get, safe_pieces(t)))) if t else [] for t in part.column(1).to_pylist()]
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum()))
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, ids array<int>")


def token_sizes(docs: DataFrame, id_col: str, text_col: str, vocabulary_path: str) -> DataFrame:
    """(id, size int): tokens of each text by either kind of vocabulary, each text given whole to the library; 0 for null and empty."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _once(f"size {vocabulary_path}", lambda: load_counter(vocabulary_path, vocabulary.value))
        for batch in batches:
            sizes = [counter.first(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [id_col, "size"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, size int")


def decode(encoded: DataFrame, id_col: str, ids_col: str, rank_path: str) -> DataFrame:
    """(id, bytes): the raw bytes that the ids stand for; null ids give null, an empty list no bytes.

    The bytes of ids that end within a character are kept as they are.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(rank_path))
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _once(f"decode {rank_path}", lambda: load_tiktoken(ranks.value))
        for batch in batches:
            out = [None if ids is None else encoding.decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {id_type}, bytes binary")
