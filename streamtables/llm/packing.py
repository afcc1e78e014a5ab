"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own.

The token ids of a document are split into pieces of the largest allowed length and then by the
binary digits of the rest. All piece lengths are powers of two, so equal lengths form buckets
whose sequences need no padding and never cross documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtables.llm.common import whole_text

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"

#: Entries a worker remembers: pieces of text between spaces, with their ids.
REMEMBERED = 400_000
#: Bytes of the texts that are encoded at once (a longer text is encoded alone).
ENCODED_AT_ONCE = 8_000_000
#: Pieces of text that the tokenizer gets as one text.
_JOINED = 1000


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    A space before a character that is not white space always begins a new pre-token. So texts
    are split at spaces, the distinct pieces of many texts are encoded once, and those seen
    before are looked up. ``spaced`` tells that the tokenizer works this way; otherwise, and for
    texts with a space that does not begin a word or with the string of an added token (which the
    tokenizer finds anywhere in a text), whole texts are encoded.
    """

    def __init__(self, path: str, spaced: bool = True, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.remembered = spaced, remembered
        self.known = pa.array([], pa.large_string())
        self.known_ids: tuple[np.ndarray, np.ndarray] = (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, and how many each part has."""
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        ids = [np.array(e.ids, dtype="<u4") for e in found]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with a space before each, of which none begins with white space.

        Many are encoded as one text. An id that begins with the mark of a space begins a word.
        """
        listed = words.to_pylist()
        texts = [" " + " ".join(listed[i : i + _JOINED]) for i in range(0, len(listed), _JOINED)]
        ids, _ = self._encode(texts)
        begins = np.flatnonzero(self._begins_word()[ids])
        if len(begins) != len(listed):  # a tokenizer with other marks
            return self._encode([" " + w for w in listed])
        return ids, np.diff(np.append(begins, len(ids)))

    def _begins_word(self) -> np.ndarray:
        if not hasattr(self, "_marked"):
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self._marked = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            self._marked[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        return self._marked

    def _words(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, from memory where it has them. Words seen twice are remembered."""
        if not len(words):
            return self._encode([])
        place = pc.index_in(words, value_set=self.known)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        fresh = words.filter(pa.array(new))
        fresh_ids, fresh_sizes = self._encode_words(fresh)
        ids, sizes = np.concatenate([self.known_ids[0], fresh_ids]), np.concatenate([self.known_ids[1], fresh_sizes])
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.known) + np.arange(len(fresh))
        again = counts[new] > 1
        if len(self.known) + again.sum() > self.remembered:  # begin anew, with what is in use
            keep = np.flatnonzero(counts > 1)[: self.remembered]
            self.known, self.known_ids = words.take(pa.array(keep)), _gather(ids, sizes, at[keep])
        elif again.any():
            added = _gather(fresh_ids, fresh_sizes, np.flatnonzero(again))
            self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(again))])
            self.known_ids = tuple(np.concatenate(x) for x in zip(self.known_ids, added, strict=True))
        return _gather(ids, sizes, at)

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        texts = texts.cast(pa.large_string())
        if not self.spaced:
            return [self._encode([t])[0].tobytes() for t in texts.to_pylist()]
        parts = pc.split_pattern(texts, " ")
        values, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = values.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        begins_so = np.array([not w or w[0].isspace() for w in words.to_pylist()], dtype=bool)
        first = np.zeros(len(codes), dtype=bool)
        first[offsets[:-1]] = True
        runs = np.add.reduceat(begins_so[codes] & ~first, offsets[:-1]) > 0 if len(codes) else np.zeros(0, dtype=bool)
        for token in self.added:
            runs = runs | pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        usual = ~first & ~np.repeat(runs, np.diff(offsets))
        counts = np.bincount(codes[usual], minlength=len(words))
        used = np.flatnonzero(counts)
        number = np.zeros(len(words), dtype=np.int64)
        number[used] = np.arange(len(used))
        ids, sizes = self._words(words.take(pa.array(used)), counts[used])
        # Texts with other spaces as a whole, and the first words of the others.
        alone = [t if whole else t.split(" ", 1)[0] for t, whole in zip(texts.to_pylist(), runs.tolist(), strict=True)]
        alone_ids, alone_sizes = self._encode(alone)
        ids, sizes = np.concatenate([ids, alone_ids]), np.concatenate([sizes, alone_sizes])
        wanted = number[codes]
        wanted[first] = len(used) + np.arange(len(alone))
        text = np.repeat(np.arange(len(alone)), np.diff(offsets))
        taken = first | usual
        out, lengths = _gather(ids, sizes, wanted[taken])
        ends = np.cumsum(np.bincount(text[taken], weights=lengths, minlength=len(alone)).astype(np.int64)) * 4
        raw = memoryview(out.tobytes())
        return [bytes(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.large_string()))[0]


def _gather(ids: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``wanted`` of ``ids`` one after the other, and their sizes."""
    length = sizes[wanted]
    begin = (np.cumsum(sizes) - sizes)[wanted]
    ahead = np.cumsum(length) - length
    return ids[np.repeat(begin - ahead, length) + np.arange(length.sum())], length


@cache
def _encoder(path: str, spaced: bool) -> TokenIds:
    """One for a worker, so that it is kept from task to task. Spark's tasks are the parallel work."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TokenIds(path, spaced)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batch in turn, with ``most`` bytes of text together, or a single row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, until - at)
        at = until


def power_of_two_pieces(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the longest first, then the binary digits."""
    pieces = [(start, longest) for start in range(0, tokens - longest + 1, longest)]
    start = len(pieces) * longest
    length = longest // 2
    while start < tokens:
        if tokens - start >= length:
            pieces.append((start, length))
            start += length
        length //= 2
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, spaced: bool = True) -> DataFrame:
    """Cut every document of ``docs`` (``doc_id``, ``text``) into sequences without padding.

    ``longest`` is a power of two. Returns a row per piece: ``doc_id``, ``start`` (ids of the
    document before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (with ``end_id``, which closes every document), ``sequence_id`` and ``offset`` (always 0, as
    a sequence is one piece). Sequences of one length have consecutive ranges of ids, the
    buckets; ids are unique, not dense. A null or empty text is the single id ``end_id``. Rows
    that repeat a ``doc_id`` are packed each.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    closing = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, spaced)
        for batch in batches:
            for part in slices(batch, 1, ENCODED_AT_ONCE):  # ids are several times their texts
                columns: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, found in zip(part.column(0).to_pylist(), encode.batch(part.column(1)), strict=True):
                    ids = found + closing
                    for start, length in power_of_two_pieces(len(ids) // 4, longest):
                        row = (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    pieces = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, PIECES)
    bucket = F.log2("length").cast("long")
    # Partition and row numbers take 58 bits: 25 and 33.
    number = F.shiftleft(bucket, 58) + F.monotonically_increasing_id() if longest <= 2**30 else F.monotonically_increasing_id()
    return pieces.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences, one folder per length."""
    pieces.write.partitionBy("length").parquet(path)
