"""Token ids on disk: Arrow IPC files whose batches hold equal-length sequences and masks as fixed-size lists.

Documents are laid out in ascending id order over shards, one file for each range of ids. Within a shard the ids of all
documents, each with the end id behind it, form one stream that is cut into sequences of equal length; the mask of the last one
says where the stream ends. All batches but the last hold the same number of sequences, so sequence s is row s % rows of
batch s // rows, and a memory-mapped file gives it as a view without a copy. A second file holds the id, start and length
of each document in the shard's stream.

A shard's file is written beside its place and moved there, and its content follows from the range alone, so a repeated or
second attempt of a task replaces it by the same bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm.bpe import blocks
from riskfabric.llm.worker import MEMORY_PIECES, MEMORY_SPACED, Memory, Remembered, byte_letters, give_back, kept_in_worker, load_tokenizer

SEQUENCE = 2048
BATCH_ROWS = 256


#: Where a byte-level BPE cuts a text before it encodes the pieces, each by itself. A fixed value of that pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs between a letter and a space or line end are a piece, and so is a line end between two characters that are no white space.
SIGNS = re.compile(r"[!-/:-@\[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ɏ].)[!-/:-@\[-`{-~]*(?=[ \n])")
LINE_END = re.compile(r"\n(?<=[!-~¡-ɏ]\n)(?=[!-~¡-ɏ])")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: Stands before a word that has no space before it.
MARK = "\x01"


class PieceCodec:
    """Ids of whole texts under a byte-level BPE, which encodes pieces of a text one by one.

    Texts are split at spaces; a space starts a piece unless white space follows it, so what a word with the space before it gives does not
    depend on its neighbours. Signs behind words and line ends are set off as words without a space before them. Words are remembered, and the pieces
    of words that have several. Texts with a space before white space or the end are cut into pieces as a whole; texts that hold an added token or
    the mark, and all texts of tokenizers that cut otherwise, are encoded as they are.
    """

    def __init__(self, definition: str, kind: str):
        self.tokenizer, self.kind = load_tokenizer(definition), kind
        self.code = {"<u2": "H", "<u4": "I"}[kind]  # as on all machines that Spark's Arrow exchange runs on
        rules = json.loads(definition)
        cut = rules.get("pre_tokenizer") or {}
        self.by_piece = not rules.get("normalizer") and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex", True)) and not cut.get("add_prefix_space")
        self.added = [token["content"] for token in rules.get("added_tokens") or []]
        self.split, self.model = regex.compile(PIECES).findall, self.tokenizer.model
        self.pieces = Memory(self._encoded, MEMORY_PIECES)
        self.words = Remembered(self._word, MEMORY_SPACED)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, letters: str) -> bytes:
        """By the tokenizer's model alone: what stands before it has cut the text and written bytes as characters."""
        return self._bytes([token.id for token in self.model.tokenize(letters)])

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        return {p: self._piece(letters) for p, letters in zip(new, byte_letters(new), strict=True)}

    def _word(self, word: str) -> bytes | None:
        """Of a word after a space, or of what follows the mark; None where the space starts no piece."""
        if LETTERS(word):
            return self._piece(byte_letters([" " + word])[0])
        if not word or word[0].isspace():
            return None
        return self._pieces(word[1:] if word[0] == MARK else " " + word)

    def _pieces(self, text: str) -> bytes:
        pieces = self.split(text)
        known = self.pieces.learn(set(pieces))
        return b"".join([known[p] for p in pieces])

    def _plain(self, text: str) -> bool:
        return self.by_piece and MARK not in text and not any(token in text for token in self.added)

    def block(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text. The first word of a text has no space before it."""
        known = self.words
        for text in texts:
            text = text or ""
            if self._plain(text):
                parted = LINE_END.sub(f" {MARK}\n {MARK}", SIGNS.sub(rf" {MARK}\g<0>", text))
                found = [known[w] for w in (MARK + parted).split(" ")]
                yield self._pieces(text) if None in found else b"".join(found)
            else:
                yield self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; a path without a scheme is local."""
    folder = re.sub("^file:/+", "/", folder)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Writes one shard; `add` takes the little-endian ids of one document."""

    def __init__(self, folder: str, shard: int, kind: str, sequence: int, rows: int):
        self.store, base = filesystem(folder)
        self.path, self.kind, self.sequence, self.rows = f"{base}/shard-{shard:06d}", np.dtype(kind), sequence, rows
        value = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.store.create_dir(base, recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.store.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.file, self.schema)
        self.pending, self.waiting, self.tokens, self.docs = [], 0, 0, ([], [], [])

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        for column, value in zip(self.docs, (doc_id, self.tokens, n), strict=True):
            column.append(value)
        self.pending.append(ids)
        self.waiting += n
        self.tokens += n
        full = self.sequence * self.rows
        if self.waiting >= full:
            stream = np.frombuffer(b"".join(self.pending), self.kind)
            for at in range(0, len(stream) - full + 1, full):
                self._write(stream[at:at + full], full)
            rest = stream[len(stream) // full * full:]
            self.pending, self.waiting = [rest.tobytes()], len(rest)

    def _write(self, stream: np.ndarray, used: int) -> None:
        mask = np.arange(len(stream)) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in (stream, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> dict:
        if self.waiting:
            stream = np.frombuffer(b"".join(self.pending), self.kind)
            self._write(np.pad(stream, (0, -len(stream) % self.sequence)), len(stream))
        self.writer.close()
        self.file.close()
        self.store.move(self.part, f"{self.path}.arrow")
        index = pa.table({"doc_id": pa.array(self.docs[0], pa.int64()), "start": pa.array(self.docs[1], pa.int64()), "n_tokens": pa.array(self.docs[2], pa.int64())})
        with self.store.open_output_stream(f"{self.part}.docs") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index)
        self.store.move(f"{self.part}.docs", f"{self.path}.docs.arrow")
        return {"docs": len(self.docs[0]), "tokens": self.tokens}


class Shard:
    """Random access to one shard: sequences, masks, and the ids of a document."""

    def __init__(self, folder: str, shard: int):
        store, base = filesystem(folder)
        path = f"{base}/shard-{shard:06d}"
        local = isinstance(store, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(f"{path}.arrow") if local else store.open_input_file(f"{path}.arrow"))
        self.docs = pa.ipc.open_file(pa.memory_map(f"{path}.docs.arrow") if local else store.open_input_file(f"{path}.docs.arrow")).read_all()
        self.sequence = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.held = (-1, None)

    def _batch(self, number: int) -> pa.RecordBatch:
        if self.held[0] != number:
            self.held = (number, self.file.get_batch(number))
        return self.held[1]

    def sequence_at(self, s: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, both views of the mapped file."""
        batch, row = self._batch(s // self.rows), s % self.rows
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the stream from start, one for each batch."""
        size = self.sequence * self.rows
        while n > 0:
            values = self._batch(start // size).column("ids").flatten().to_numpy()
            piece = values[start % size:start % size + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def write_tokens(docs: DataFrame, definition: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 sequence: int = SEQUENCE, rows: int = BATCH_ROWS) -> list[tuple[int, int]]:
    """Writes the shards beneath folder and returns (shard, tokens) in id order, a pair for each range of ids.

    Every executor must reach the folder. Null texts count as empty; each document ends with end_id. Rows with a null id come
    first; repeated ids stand together. Ids take 16 bits if the vocabulary allows. No shards for an empty table.
    """
    key = ("piece_codec", hashlib.sha256(definition.encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> PieceCodec:
            kind = "<u2" if load_tokenizer(definition).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
            return PieceCodec(definition, kind)

        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            codec = kept_in_worker(key, make)
            end = codec._bytes([end_id])
            ids = iter(batch.column(0).to_pylist())
            for block in blocks(batch.column(1)):
                for found in codec.block(block):
                    writer = writer or ShardWriter(folder, shard, codec.kind, sequence, rows)
                    writer.add(next(ids), found + end)
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "tokens": pa.array([done["tokens"]], pa.int64())})

    ordered = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text"))
    return sorted((r["shard"], r["tokens"]) for r in ordered.mapInArrow(give_back(run, key), "shard int, tokens long").collect())


def read_documents(spark: SparkSession, folder: str, shards: list[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """id, `start` (ids of all documents before it), `n_tokens` and `ids_crc32` (over little-endian 32-bit ids), from the files."""
    before = {shard: sum(n for _, n in shards[:i]) for i, (shard, _) in enumerate(shards)}
    numbers = [shard for shard, _ in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                shard = Shard(folder, numbers[place])
                starts, sizes = (shard.docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                sums = []
                for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                    value = 0
                    for piece in shard.pieces(start, n):
                        value = zlib.crc32(piece.astype("<u4").tobytes(), value)
                    sums.append(value)
                yield pa.RecordBatch.from_arrays([shard.docs.column("doc_id").combine_chunks(), pa.array(starts + before[numbers[place]]),
                                                  pa.array(sizes), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    places = spark.range(0, len(shards), 1, max(1, len(shards)))
    return places.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
