"""Token ids of whole texts, by a public tokenizer, with each distinct word encoded once."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa

#: Beyond these, cached chunks and their ids are dropped but for the first, which hold the frequent ones, so that a
#: worker's memory stays bounded.
CACHE_CHUNKS, CACHE_IDS, CACHE_KEEPS = 800_000, 8_000_000, 200_000
#: Characters that are encoded together.
BATCH_CHARS = 1_000_000


class _Seen(dict):
    """Chunk to number; new chunks are numbered in the order in which they are met."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, chunk):
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at


def _key(chunk: str) -> str | bytes:
    """A chunk that begins with a newline as it is, one with a single space before it without that, any other as bytes."""
    if chunk[0] == " ":
        return chunk[1:] if chunk[1:2].strip(" \n") else chunk.encode()
    return chunk if chunk[0] == "\n" else chunk.encode()


def _chunk(key: str | bytes) -> str:
    """The chunk of a _key."""
    if isinstance(key, bytes):
        return key.decode()
    return key if key[0] == "\n" else " " + key


class ChunkEncoder:
    """Encodes texts as the tokenizer does, by chunks that its pre-tokenizer surely keeps apart.

    "drop": white space only separates, so chunks are runs without ASCII white space. "lead": byte-level splitting,
    where spaces and newlines belong to what follows them, so a chunk is such a run and the next run without them;
    texts with other white space are encoded whole. Any other kind of tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        first = parts[0]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "lead"
        elif first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", ""):
            self.kind = "drop"
        else:
            self.kind = "whole"
        self.chunks = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
        self.odd = re.compile(r"[^\S \n]").search
        self.widths = self._token_bytes() if self.kind == "lead" else None
        self.seen = _Seen()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def _forget(self) -> None:
        """Keep the first chunks, whose ids are among the first in the arrays; none if they alone are too large."""
        old, self.seen = self.seen, _Seen()
        self.known = min(CACHE_KEEPS, len(old))
        self.used = int(np.max(self.start[: self.known] + self.size[: self.known]))
        if self.used > CACHE_IDS // 2:
            self.known = self.used = 0
        self.seen.update(zip(islice(old, self.known), range(self.known)))

    def _words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the words, which are encoded as one text and told apart by where their tokens begin."""
        texts = [x.decode() for x in words]
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        at = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
        return np.split(np.array(got.ids, np.uint32), np.searchsorted(at, begins[1:-1]))

    def _token_bytes(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for: a letter of a byte-level token is a byte, an added token is as it is."""
        vocab, added = self.tokenizer.get_vocab(with_added_tokens=True), self.tokenizer.get_added_tokens_decoder()
        widths = np.zeros(1 + max(vocab.values(), default=0), np.int64)
        for token, i in vocab.items():
            widths[i] = len(token.encode()) if i in added else len(token)
        return widths

    def _runs(self, keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The order in which chunks were encoded, all their ids, and how many each has. Chunks that begin with a space or
        newline and go on are encoded as one text, in which they are the same chunks, and told apart by the bytes that
        their ids stand for. None if these don't add up."""
        alone = np.fromiter((isinstance(x, bytes) or x[-1] in " \n" for x in keys), bool, len(keys))
        text = [_chunk(x) for x, other in zip(keys, alone.tolist()) if not other]
        joint = "".join(text)
        ids = np.array(self.tokenizer.encode_batch_fast([joint], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, text if joint.isascii() else map(str.encode, text)), np.int64, len(text)))
        reached = np.cumsum(self.widths[ids])
        cuts = np.searchsorted(reached, ends) + 1
        if len(text) and (cuts[-1] != len(ids) or not np.array_equal(reached[cuts - 1], ends)):
            return None
        others = self._whole([_chunk(keys[i]) for i in np.flatnonzero(alone)])
        sizes = np.concatenate([np.diff(cuts, prepend=0), np.fromiter(map(len, others), np.int64, len(others))])
        return np.argsort(alone, kind="stable"), np.concatenate([ids, *others]), sizes

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, text: str) -> list:
        if self.kind == "drop":
            return text.encode().split()
        if self.kind == "lead":
            return self._keys(text)
        return [text] if text else []

    def _keys(self, text: str) -> list:
        """Chunks, for speed without the space that most begin with: see _chunk."""
        if self.odd(text):
            return [text.encode()]
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n " in spaced or spaced[-1:] == " ":
            return [_key(x) for x in self.chunks(text)]
        keys = spaced.split(" ")
        if keys[0]:
            keys[0] = keys[0].encode()
        else:
            del keys[0]
        return keys

    def _learn(self) -> None:
        """Encode what is new."""
        new, self.seen.new = self.seen.new, []
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            runs = self._runs(some) if self.kind == "lead" else None
            if runs is None:
                got = self._words(some) if self.kind == "drop" else self._whole([_chunk(x) for x in some] if self.kind == "lead" else some)
                runs = np.arange(len(got)), np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
            order, ids, n = runs
            end, last = self.used + len(ids), self.known + len(n)
            while end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while last > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.ids[self.used : end] = ids
            self.size[self.known + order], self.start[self.known + order] = n, self.used + np.cumsum(n) - n
            self.used, self.known = end, last

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the places where each text's begin and the last one's end."""
        if len(self.seen) > CACHE_CHUNKS or self.used > CACHE_IDS:
            self._forget()
        parts = [self._split(x) for x in texts]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]).astype(np.int64)
        number = self.seen.__getitem__
        at = np.fromiter(map(number, chain.from_iterable(parts)), np.int64, int(bounds[-1]))
        self._learn()
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[bounds]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One a worker and tokenizer; it lives as long as the worker."""
    return ChunkEncoder(path)


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_CHARS bytes of the column, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = (np.cumsum(size) - size) // BATCH_CHARS
        cuts = [0, *np.flatnonzero(np.diff(group)) + 1, len(size)] if len(size) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text's ids."""
    out = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
    return out, bounds + np.arange(len(bounds))


def crc32s(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
