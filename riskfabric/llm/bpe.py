"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text sets chunk ends where its value, not the place, says so; copied passages are cut
alike wherever they stand. A chunk that a worker has met before is not encoded again. Ends fall anywhere, also within a
word, so a chunk gives its ids only from its first to its last space, where the encodings of both sides are
independent of each other. What lies around a join, from the last space on the left to the first on the right, is put
together and encoded anew; a chunk without a space goes into the join as a whole and the search goes on, until both ends
of the repaired piece stand at spaces and the ids agree exactly with those of the whole text.

Words of new chunks are remembered too. Texts of common characters are lowered and signs behind words set off by a space, which
leaves their ids as they are and makes more words equal; a new word is cut into pieces as the tokenizer cuts it, each for its
model. Words of other texts, of texts that hold an added token, and of all texts of tokenizers that cut otherwise, are encoded by
the whole tokenizer. Decoded texts follow from the ids.

Reuse spans the documents that one worker sees, in memories of fixed size. Texts are not shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.common import bound_batches
from riskfabric.llm.worker import Remembered, WordMemory, byte_letters, give_back, kept_in_worker, load_tokenizer

WINDOW = 32
CHUNK_BITS = 10
BASE = 0x9E3779B97F4A7C15 | 1
MEMORY_BYTES = 12 << 20
#: Texts whose new words are encoded together.
BLOCK_CHARS = 4 << 20
POWERS = "bpe_powers"
#: Words of common characters that are remembered, in two generations.
KNOWN_WORDS = 600_000
#: How a tokenizer must treat texts so that its words may be cut here.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Texts of these characters are in NFC, and all Unicode versions agree on their classes and small letters.
COMMON = re.compile("[\\t\\n\\r -~¡-ɏ‐-‧‰-›€]*").fullmatch
LETTERS = re.compile("[a-zßà-öø-ÿ]+").fullmatch
#: ASCII signs between a letter and a space or line end.
SIGNS = re.compile(r"[!-/:-@\[-`{-~](?<=[a-zßà-öø-ÿ].)[!-/:-@\[-`{-~]*(?=[ \n])")


def chunk_ends(data: bytes, window: int = WINDOW, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of chunks of about 2^bits bytes: after bytes whose window of bytes hashes to zero, never within a character."""
    if len(data) <= window:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    # sum of byte * base^-i, so that a window's sum times base^i is a polynomial in the window alone
    powers, inverse = kept_in_worker(POWERS, lambda: [np.ones(0, np.uint64)] * 2)
    if len(powers) < len(raw):
        size = 1 << (len(raw) - 1).bit_length()
        for at, base in ((0, BASE), (1, pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            kept_in_worker(POWERS, list)[at] = np.multiply.accumulate(table)
        powers, inverse = kept_in_worker(POWERS, list)
    sums = np.cumsum((raw + np.uint64(1)) * inverse[:len(raw)])
    spans = sums[window:] - sums[:-window]
    hashes = spans * powers[window:len(raw)]
    ends = np.flatnonzero(hashes >> np.uint64(64 - bits) == 0) + window + 1
    ends = ends[(ends < len(raw))]
    ends = ends[(raw[ends] & 0xC0) != 0x80]
    return [*ends.tolist(), len(data)]


class ChunkCodec:
    """Encodes and decodes whole texts; chunks and words are remembered up to a bound."""

    def __init__(self, definition: str):
        self.tokenizer = load_tokenizer(definition)
        if self.tokenizer.decoder is not None:
            raise ValueError("the tokenizer must join decoded tokens by spaces")
        rules = json.loads(definition)
        added = rules.get("added_tokens") or []
        self.by_piece = rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER and not any(token["normalized"] for token in added)
        # Tokens that stand for themselves are found before anything is lowered or cut.
        self.added = re.compile("|".join([re.escape(token["content"]) for token in added]) or "(?!)", re.IGNORECASE).search
        self.split, self.model = regex.compile(PIECES).findall, self.tokenizer.model
        plain = {i: t.encode() + b" " for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.plain = pa.array([plain.get(i, b"") for i in range(max(plain, default=-1) + 1)], pa.large_binary())
        self.whole = WordMemory(self.tokenizer, lambda word, ids: self._bytes(ids))
        self.words = Remembered(self._word, KNOWN_WORDS)
        self.chunks: dict[bytes, tuple[str, bytes | None, str]] = {}
        self.held = 0

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, letters: str) -> bytes:
        return self._bytes([token.id for token in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._piece(word)
        pieces = [word] if LETTERS(word) else self.split(word)
        return b"".join([self._piece(letters) for letters in byte_letters(pieces)])

    def _joined(self, text: str) -> bytes:
        if self.by_piece and COMMON(text) and not self.added(text):
            words = SIGNS.sub(r" \g<0>", text.lower()).replace("\n", " ").split(" ")
            known = self.words
        else:
            words = text.replace("\n", " ").split(" ")
            known = self.whole.learn(words)
        return b"".join([known[w] for w in words])

    def _split(self, part: bytes) -> tuple[str, bytes | None, str]:
        """What goes into the join before a chunk, the ids up to its last space, what goes into the join behind it."""
        first, last = _spaces(part)
        if first < 0:
            return part.decode("utf-8", "replace"), None, ""
        return part[:first].decode(), self._joined(part[first:last + 1].decode()), part[last + 1:].decode()

    def block(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and the decoded text of each, UTF-8."""
        for text in texts:
            if self.held > MEMORY_BYTES:
                self.chunks, self.held = {}, 0
            data = (text or "").encode("utf-8", "replace")
            ends = chunk_ends(data)
            ids, pending = [], ""
            for a, b in zip([0, *ends], ends, strict=False):
                part = data[a:b]
                split = self.chunks.get(part)
                if split is None:
                    split = self.chunks[part] = self._split(part)
                    self.held += 2 * len(part) + len(split[1] or b"")
                if split[1] is None:
                    pending += split[0]
                else:
                    ids += [self._joined(pending + split[0]), split[1]]
                    pending = split[2]
            found = b"".join([*ids, self._joined(pending)])
            yield found, self._decoded(found)

    def _decoded(self, ids: bytes) -> bytes:
        tokens = self.plain.take(pa.array(np.frombuffer(ids, "<u4")))
        data = tokens.buffers()[2]
        return data.to_pybytes()[:-1] if data else b""


def _spaces(part: bytes) -> tuple[int, int]:
    """First and last place of a space or line end, or -1."""
    first = [i for i in (part.find(b" "), part.find(b"\n")) if i >= 0]
    return (min(first), max(part.rfind(b" "), part.rfind(b"\n"))) if first else (-1, -1)


def blocks(column: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[list[str | None]]:
    block, size = [], 0
    for value in column:
        text = value.as_py()
        block.append(text)
        size += len(text or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """id, `n_tokens`, `ids_sha256`, `decoded_sha256` and, if asked for, the `ids` (binary, little-endian 32 bits) of whole texts.

    definition: the tokenizer's JSON, of a tokenizer that ends words at spaces, drops white space and joins decoded tokens by
    spaces. Null texts count as empty and have no ids. One row per input row, no shuffle; only the two columns are read.
    """
    key = ("chunk_codec", hashlib.sha256(definition.encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(key, lambda: ChunkCodec(definition))
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1)):
                for found, decoded in codec.block(block):
                    rows.append((len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256(decoded).hexdigest(), found if ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            out = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out, names = [*out, pa.array(columns[3], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(give_back(run, key, POWERS), schema + (", ids binary" if ids else ""))
