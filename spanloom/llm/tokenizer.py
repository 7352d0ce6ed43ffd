"""Encoding by a public byte-level BPE vocabulary.

Text is cut into pre-tokens. A minimal perfect hash over the vocabulary answers every pre-token that is a token itself;
the others are merged by a heap over a linked list of their bytes, pair ranks coming from the same hash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import spread

#: Where the public vocabulary files lie.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern published with the vocabulary, by which text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash from byte strings to ids: hash, displace, compare.

    Keys fall into buckets of about two and a half; from the largest bucket on, each gets the first displacement that sends its
    keys to free slots, and buckets of one key take a free slot directly. As many slots as keys; a key that is not in
    the vocabulary is recognised by comparing it with the one stored in its slot.
    """

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.slots = len(ids)
        self.buckets = max(1, self.slots * 2 // 5)
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ids:
            both = xxhash.xxh3_128_intdigest(key)
            members[(both >> 64) % self.buckets].append((both & 0xFFFFFFFFFFFFFFFF, key))
        shift = np.zeros(self.buckets, np.int32)
        keys: list[bytes | None] = [None] * self.slots
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = 0
        for bucket in order:
            own = members[bucket]
            if len(own) == 1:
                while keys[free] is not None:
                    free += 1
                shift[bucket], keys[free] = -free - 1, own[0][1]
                continue
            move = 0
            while own:
                at = [self._slot(low, move) for low, _ in own]
                if len(set(at)) == len(at) and all(keys[x] is None for x in at):
                    shift[bucket] = move
                    for x, (_, key) in zip(at, own):
                        keys[x] = key
                    break
                move += 1
        self.shift = shift.tolist()
        self.keys = keys
        self.ids = [ids[key] for key in keys]

    def _slot(self, low: int, move: int) -> int:
        return ((low ^ (move * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF) % self.slots

    def get(self, key: bytes) -> int:
        """The id of ``key``, -1 if it is not in the vocabulary."""
        both = xxhash.xxh3_128_intdigest(key)
        move = self.shift[(both >> 64) % self.buckets]
        slot = -move - 1 if move < 0 else self._slot(both & 0xFFFFFFFFFFFFFFFF, move)
        return self.ids[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, get: Callable[[bytes], int]) -> list[int]:
    """Ids of a piece that is no token: always the pair of lowest rank, leftmost first, is merged."""
    size = len(piece)
    end = list(range(1, size + 1))  # of the part that begins here; 0 once it was taken up
    before = list(range(-1, size - 1))
    heap = []
    for at in range(size - 1):
        rank = get(piece[at : at + 2])
        if rank >= 0:
            heap.append((rank, at, at + 2))
    heapq.heapify(heap)
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= size or end[middle] != stop or middle == stop:
            continue
        end[at], end[middle] = stop, 0
        if stop < size:
            before[stop] = at
            rank = get(piece[at : end[stop]])
            if rank >= 0:
                heapq.heappush(heap, (rank, at, end[stop]))
        first = before[at]
        if first >= 0:
            rank = get(piece[first:stop])
            if rank >= 0:
                heapq.heappush(heap, (rank, first, stop))
    ids, at = [], 0
    while at < size:
        ids.append(get(piece[at : end[at]]))
        at = end[at]
    return ids


class Encoder:
    """Texts to ids; without special tokens, whose strings are ordinary text."""

    def __init__(self, table: PerfectHash) -> None:
        self.table = table
        self.cut = regex.compile(PATTERN).findall
        self.memory: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        found = self.table.get(raw)
        return [found] if found >= 0 else merge_bytes(raw, self.table.get)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        ids: list[int] = []
        if not text:
            return ids
        memory = self.memory
        for piece in self.cut(text):
            known = memory.get(piece)
            if known is None:
                known = self.piece(piece)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                if len(piece) < 64:
                    memory[piece] = known
            ids += known
        return ids


def encode_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, counts_only: bool = False
) -> DataFrame:
    """``(key, ids)`` of every row, or ``(key, n_tokens)``; a narrow pass over two columns.

    ``vocabulary`` is a rank file the driver can read; its hash table (a fixed size, about a megabyte) is broadcast.
    A null or empty text has an empty list (0 tokens); repeated rows are encoded each; texts of any length are encoded
    whole; an empty table gives no rows; other columns do not take part.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(PerfectHash(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            flat: list[np.ndarray] = []
            ends = [0]
            for value in batch.column(1):
                ids = encoder.encode(value.as_py())
                if not counts_only:
                    flat.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            if counts_only:
                result = pa.array(np.diff(ends), pa.int64())
            else:
                values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                result = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), result], names=[key, name])

    name, kind = ("n_tokens", "bigint") if counts_only else ("ids", "array<int>")
    narrow = documents.select(F.col(key), F.col(text))
    return spread(narrow).mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, {name} {kind}")
