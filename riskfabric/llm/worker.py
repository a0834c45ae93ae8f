"""What Python workers share between tasks: tokenizers and bounded memories of encoded words."""

from __future__ import annotations

import codecs
import ctypes
import os
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa

#: Words a memory holds before it starts anew.
MEMORY_WORDS = 150_000
#: Words and pieces in two generations, where words stand beside the pieces they are made of.
MEMORY_SPACED, MEMORY_PIECES = 1_000_000, 600_000
#: Words that are encoded in one call; what the tokenizer returns for each is many times larger than its ids.
WORDS_AT_ONCE = 4_096
#: Characters of the longest text that is remembered where it is looked up; longer ones are made each time.
LONGEST = 128
#: The characters by which byte-level tokenizers write the bytes: printable ones stand for themselves, the others follow from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = "".join(chr(b) if b in PRINTABLE else chr(0x100 + b - sum(p < b for p in PRINTABLE)) for b in range(0x100))


def kept_in_worker(key, make: Callable[[], object]):
    """One object per key, until a task that does not name the key begins in the Python worker; functions arrive anew with each task, their results stay here."""
    store = _kept()
    if key not in store:
        store[key] = make()
    return store[key]


def _kept() -> dict:
    return sys.modules.setdefault("_riskfabric_worker", types.ModuleType("_riskfabric_worker")).__dict__.setdefault("kept", {})


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def give_back(run: Callable[[Iterator], Iterator], *keys) -> Callable[[Iterator], Iterator]:
    """`run` for one task, with the kept objects of `keys`; those of other jobs are forgotten first, since Spark hands workers on from stage to stage.

    Memory that the task has freed goes back to the system at its end, since an idle worker would keep it beside those of later stages.
    """
    def whole(batches: Iterator) -> Iterator:
        store = _kept()
        if others := store.keys() - set(keys):
            for key in others:
                del store[key]
            _trim()
        yield from run(batches)
        _trim()

    return whole


def load_tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters(texts: list[str]) -> list[str]:
    """Texts as a byte-level tokenizer's model gets them."""
    found = codecs.charmap_decode("\0".join(texts).encode(), "strict", BYTE_LETTERS)[0].split(BYTE_LETTERS[0])
    # more if a text holds the separator
    return found if len(found) == len(texts) else [codecs.charmap_decode(t.encode(), "strict", BYTE_LETTERS)[0] for t in texts]


class WordMemory:
    """What `of` makes of the ids of a word, each word encoded once while it is remembered."""

    def __init__(self, tokenizer, of: Callable[[str, list[int]], object], prefix: str = "", most: int = MEMORY_WORDS):
        self.tokenizer, self.of, self.prefix, self.most, self.known = tokenizer, of, prefix, most, {}

    def learn(self, words: Iterable[str]) -> dict[str, object]:
        words = set(words)
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {w: self.known[w] for w in words - new}
        for some in batched(new, WORDS_AT_ONCE):
            for word, encoded in zip(some, self.tokenizer.encode_batch_fast([self.prefix + w for w in some], add_special_tokens=False), strict=True):
                self.known[word] = self.of(word, encoded.ids)
        return self.known


class Memory:
    """What `make` gives for texts, each made once while it is remembered: in one of two generations of `most` // 2 texts at most, or of those
    asked for last. A text that is met moves to the younger; when that is full the older is forgotten."""

    def __init__(self, make: Callable[[list[str]], dict[str, object]], most: int):
        self.make, self.most, self.known, self.older = make, most // 2, {}, {}

    def learn(self, texts: set[str]) -> dict[str, object]:
        """Holds at least the given texts afterwards."""
        missing = texts.difference(self.known)
        if len(self.known) + len(missing) > self.most:
            self.older, self.known, missing = self.known, {}, texts
        new = []
        for text in missing:
            if text in self.older:
                self.known[text] = self.older[text]
            else:
                new.append(text)
        self.known.update(self.make(new))
        return self.known


class Remembered(dict):
    """What `make` gives for a text, made where it is looked up; remembered as in `Memory` if it is not long."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, text: str):
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= LONGEST:
            self[text] = found
        return found
