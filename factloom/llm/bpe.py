"""Byte-level BPE encoding and decoding with a published rank file.

Two tiers. A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash (hash and displace: one
slot per vocabulary entry, and the entry is compared before it counts). Any other is merged from single bytes: linked
neighbours, and a heap that gives the pair of lowest rank, leftmost first.

A worker remembers the ids of pre-tokens it has met, in a table that is emptied when it holds MEMO entries. The
vocabulary is of fixed size, and so is its broadcast. Null text is empty text: no ids. Any code point is encoded, since
all 256 bytes are in the vocabulary. A very long text is encoded whole, pre-token by pre-token; a very long pre-token is
merged by its heap, in time that grows with its length and the logarithm of it. Repeated rows are encoded each for
itself. An empty table gives no rows. Further columns are dropped by `digests` and kept by `encode` (a clashing `ids`
column is replaced).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm import common as c

MEMO = 300_000
PIECE = 1 << 22
PRIME, MASK = (1 << 61) - 1, (1 << 60) - 1


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: buckets take, largest first, the displacement that fits."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for value, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h >> 68, h >> 8 & MASK, value))
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        spare = 0
        for bucket, own in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:  # any slot will do: a negative displacement names it
                while self.slots[spare] >= 0:
                    spare += 1
                self.slots[spare], self.shift[bucket] = own[0][2], -spare - 1
                continue
            for d in range(1 << 30):
                at = [(a + d * b) % PRIME % n for a, b, _ in own]
                if len({*at}) == len(at) and all(self.slots[x] < 0 for x in at):
                    break
            self.shift[bucket] = d
            for x, (_, _, value) in zip(at, own):
                self.slots[x] = value

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            return self.slots[-d - 1]
        return self.slots[((h >> 68) + d * (h >> 8 & MASK)) % PRIME % self.n]


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.entries = sorted(ranks)
        self.ids = [ranks[k] for k in self.entries]
        self.ranks = ranks
        self.hash = PerfectHash(self.entries)
        self.pattern = pattern
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for key, value in ranks.items():
            self.bytes_of[value] = key
        self._memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "_find")}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_memo": {}}

    def whole(self, token: bytes) -> int:
        """The id of a pre-token that is in the vocabulary, or -1."""
        at = self.hash.slot(token)
        return self.ids[at] if self.entries[at] == token else -1

    def merged(self, token: bytes) -> list[int]:
        """Ids of a pre-token by merges of linked bytes, the lowest rank first."""
        rank = self.ranks.get
        n = len(token)
        part = [token[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank(token[i : i + 2])) is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            own = part[i]
            j = after[i]
            if own is None or j >= n or len(own) + len(part[j]) != size:
                continue  # one of the two has merged since
            own = part[i] = own + part[j]
            part[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(own + part[k])) is not None:
                    push(heap, (r, i, size + len(part[k])))
            h = before[i]
            if h >= 0 and (r := rank(part[h] + own)) is not None:
                push(heap, (r, h, len(part[h]) + size))
        return [self.ranks[p] for p in part if p is not None]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        find = self.__dict__.get("_find")
        if find is None:
            find = self._find = regex.compile(self.pattern).findall
        memo, out = self._memo, []
        for token in find(text):
            got = memo.get(token)
            if got is None:
                raw = token.encode()
                one = self.whole(raw)
                got = np.array([one] if one >= 0 else self.merged(raw), "<u4").tobytes()
                if len(memo) >= MEMO:
                    memo.clear()
                memo[token] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def public(name: str = "byte_bpe_50k.tiktoken", path: str | None = None, pattern: str | None = None) -> Tokenizer:
    import public_tokenizers

    return Tokenizer.load(path or public_tokenizers.path(name), pattern or public_tokenizers.PATTERN)


_held: dict = {}


def _here(shared, key) -> Tokenizer:
    """The tokenizer and its memo live as long as the worker."""
    if key not in _held:
        _held.clear()
        _held[key] = shared.value
    return _held[key]


def digests(docs: DataFrame, tokenizer: Tokenizer, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of what the ids decode to; with_ids: and the ids, little-endian unsigned 32-bit."""
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizer), hashlib.sha256(b"".join(tokenizer.entries) + tokenizer.pattern.encode()).hexdigest()

    def run(batches):
        t = _here(shared, key)
        for piece in c.pieces(batches, most=PIECE):
            ids = [t.encode_bytes(x or "") for x in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.decode(x)).hexdigest() for x in ids], pa.string()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""))


def encode(docs: DataFrame, tokenizer: Tokenizer, column: str = "ids") -> DataFrame:
    """The documents with their token ids (array<int>) in `column`; `decode` gives the text back."""
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizer), hashlib.sha256(b"".join(tokenizer.entries) + tokenizer.pattern.encode()).hexdigest()
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])

    def run(batches):
        t = _here(shared, key)
        for piece in c.pieces(batches, most=PIECE):
            ids = [np.frombuffer(t.encode_bytes(x or ""), "<u4").astype(np.int32) for x in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids, pa.list_(pa.int32()))], [*piece.schema.names, column])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: Tokenizer, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that the ids in `column` stand for (null ids: empty text)."""
    shared, key = rows.sparkSession.sparkContext.broadcast(tokenizer), hashlib.sha256(b"".join(tokenizer.entries) + tokenizer.pattern.encode()).hexdigest()
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        t = _here(shared, key)
        for batch in batches:
            texts = [t.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return rows.mapInArrow(run, schema)
