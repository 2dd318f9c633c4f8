"""LM scoring by prediction by partial matching, pretrained on the training split.

A trie of byte contexts up to ORDER bytes predicts each byte and the end of the text. A context that lacks the byte
escapes to the context one byte shorter (method D: each distinct byte after the context gives half a count to the
escape), where the bytes already ruled out are excluded; the last resort is equal shares of the bytes never seen. So
the score is the log10 probability of the text under a model that sums to one over all texts. Like the base model, it
takes a text as its tokens: lower-cased words, spelled with one space between, then the end. Texts that differ only in
the case of A-Z or in white space therefore score alike.

All n-grams of all training texts count, whatever the size of the corpus. Texts are packed into blocks of about
PACK_CHARS characters, compressed and written once. Blocks send their distinct codes (a byte and the ORDER bytes before),
with counts, to shards by the LOW bytes before the last: so a shard has all longer contexts of its codes, adds up the
counts, builds the trie of its part and answers each block with a score a code. Only the n-grams of LOW bytes or fewer
are broadcast: 2 ** 24 at most, in whatever corpus. `learn` makes one trie of the whole, on the driver, for small corpora.

A unigram word model is the base of comparison. Its counts are exact over all training tokens: blocks of documents send
their distinct tokens (64-bit hashes, with counts) to shards of the hash space, which add them up and answer each block.

Null text is empty text: the end alone. A null doc_id counts as empty text in the split. Repeated rows count and are
scored each for itself. A very long text is a block of its own, read in pieces. An empty training set gives equal shares
to all bytes; an empty table gives no rows. Only doc_id and text are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm import common as c
from factloom.llm.blocks import packed, shards, unpacked

ORDER = 6
LOW = 3
DISCOUNT = 0.5
HOLD = 2_000_000
END = 0xFF  # in no UTF-8 text
END_TOKEN = c.U64(0xE4D0E4D0E4D0E4D1)
PACK_CHARS = 20_000_000
SHARD_CHARS = 24_000_000
CODE_CHARS = 8_000_000
LOW_MASK = c.U64((1 << 8 * LOW) - 1)
U8 = c.U64(8)


def coded(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each text's end: the code of it and the `order` bytes before; and each text's offsets into them."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    own = np.ones(len(data) + n, bool)
    own[at[1:] - 1] = False
    line = np.full(order + len(own), END, np.uint8)
    line[order:][own] = data
    wide = line.astype(c.U64)
    code = wide[: len(own)].copy()
    for k in range(1, order + 1):
        code <<= U8
        code |= wide[k : len(own) + k]
    sizes = np.diff(at)
    for k in range(order):  # before a text there are only ends
        first = at[:-1][sizes > k] + k
        code[first] |= c.U64(((1 << 8 * (order - k)) - 1) << 8 * (k + 1))
    return code, at


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as their tokens are spelled: lower-cased words, one space between."""
    word = c.NOT_SPACE[data]
    gap = np.zeros(len(word), bool)
    gap[1:] = word[:-1] & ~word[1:]
    gap[offsets[:-1][offsets[:-1] < len(word)]] = False
    places = np.flatnonzero(word)
    ends = np.searchsorted(places, offsets)
    behind = places[ends[1:][ends[1:] > ends[:-1]] - 1] + 1  # nothing follows the last word
    gap[behind[behind < len(gap)]] = False
    out = c.LOWER[data]
    out[gap] = 32
    keep = word | gap
    return out[keep], np.append(0, np.cumsum(keep))[offsets]


def ngrams(docs: DataFrame) -> DataFrame:
    """Counts of all n-grams of 1 to ORDER + 1 bytes: size, code, n."""

    def count(batches):
        held, total = [], 0

        def merged():
            codes, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([y for _, y in held])).astype(np.int64)

        for piece in c.pieces(batches):
            codes, _ = coded(*spelled(*c.flat(piece.column("text"))))
            held.append(np.unique(codes, return_counts=True))
            total += len(held[-1][0])
            if total > HOLD:
                held = [merged()]
                total = len(held[0][0])
                if total > HOLD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], ["code", "n"])
                    held, total = [], 0
        if held:
            codes, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

    full = docs.select(F.col("text").cast("string")).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    sizes = F.array(*(F.struct(F.lit(m).alias("size"), F.col("code").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("code")) for m in range(1, ORDER + 2)))
    return full.select("n", F.explode(sizes).alias("x")).groupBy("x.size", "x.code").agg(F.sum("n").alias("n"))


class Table:
    """A hash table from codes to their places, for whole arrays of codes."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.key = np.full(1 << self.bits, ~c.U64(0), c.U64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several the last one stays
            there = self.at[slot] == left
            self.key[slot[there]] = keys[left[there]]
            slot, left = (slot[~there] + 1) & ((1 << self.bits) - 1), left[~there]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * c.U64(0x9E3779B97F4A7C15) >> c.U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each code, or -1."""
        slot = self._slot(keys)
        out = self.at[slot]
        open_ = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            at = self.at[slot]
            out[open_] = at
            more = (self.key[slot] != keys[open_]) & (at >= 0)
            open_, slot = open_[more], slot[more]
        return out


class Trie:
    """n-grams (size, code, n) and contexts (size, code, total, distinct) of one count threshold."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray, np.ndarray], contexts: tuple[np.ndarray, ...]):
        size, code, n = grams
        self.unseen = 256 - int((size == 1).sum())
        self.grams = Table(code.astype(c.U64) | size.astype(c.U64) << c.U64(56))
        c_size, c_code, total, distinct = contexts
        c_key = c_code.astype(c.U64) | c_size.astype(c.U64) << c.U64(56)
        self.contexts = Table(c_key)
        n = n.astype(float)
        own = self.contexts.find(code.astype(c.U64) >> U8 | (size.astype(c.U64) - c.U64(1)) << c.U64(56))
        bytes_kept = np.bincount(own, minlength=len(c_key))
        cut = total - np.bincount(own, n, len(c_key))
        n = n - DISCOUNT
        kept = np.bincount(own, n, len(c_key))
        escape = DISCOUNT * distinct + cut
        whole = kept + escape
        # what is left in the next shorter context without the bytes of this one
        mask = (c.U64(1) << U8 * np.maximum(c_size.astype(np.int64) - 1, 0).astype(c.U64)) - c.U64(1)
        shorter = self.contexts.find((c_code.astype(c.U64) & mask) | (np.maximum(c_size.astype(np.int64), 1) - 1).astype(c.U64) << c.U64(56))
        g_mask = (c.U64(1) << U8 * np.maximum(size.astype(np.int64) - 1, 0).astype(c.U64)) - c.U64(1)
        twin = self.grams.find((code.astype(c.U64) & g_mask) | (np.maximum(size.astype(np.int64), 2) - 1).astype(c.U64) << c.U64(56))
        ruled = np.bincount(own, np.where(size > 1, n[twin], 0.0), len(c_key))
        left = np.maximum(0.0, kept[shorter] - ruled)
        left_escape = np.maximum(DISCOUNT, DISCOUNT * np.maximum(0, distinct[shorter] - bytes_kept) + cut[shorter])
        self.count = np.log10(n)
        self.whole, self.escape = np.log10(whole), np.log10(escape / whole)
        self.rest = np.log10(left + left_escape)
        self.rest_escape = np.where(left > DISCOUNT / 2, np.log10(left_escape) - self.rest, 0.0)
        self.plain = self.count - self.whole[own]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code, given those before it."""
        out = np.zeros(len(codes))
        at, up = np.arange(len(codes)), np.full(len(codes), -1, np.int32)
        for size in range(ORDER + 1, 0, -1):
            own = codes[at] if size <= ORDER else codes
            node = self.grams.find(own & c.U64((1 << 8 * size) - 1) | c.U64(size << 56))
            hit = node >= 0
            ruled = up >= 0
            some = hit & ~ruled
            out[at[some]] += self.plain[node[some]]
            some = hit & ruled
            out[at[some]] += self.count[node[some]] - self.rest[up[some]]
            miss = ~hit
            at, up, own = at[miss], up[miss], own[miss]
            context = self.contexts.find(own >> U8 & c.U64((1 << 8 * (size - 1)) - 1) | c.U64(size - 1 << 56))
            ruled = up >= 0
            out[at[ruled]] += self.rest_escape[up[ruled]]
            some = ~ruled & (context >= 0)
            out[at[some]] += self.escape[context[some]]
            up = context
        out[at] -= np.log10(self.unseen or 1)
        return out


def learn(docs: DataFrame, nodes: int = 1 << 62) -> Trie:
    """The trie of all n-grams, or of those above the least threshold that leaves `nodes` or fewer, on the driver."""
    grams = c.written(ngrams(docs), "ngrams")
    bins = grams.groupBy(F.floor(F.log2("n") * 8).alias("bin")).count().collect()
    total, least = 0, 1
    for b, n in sorted(map(tuple, bins), reverse=True):
        total += n
        if total > nodes:
            least = int(np.ceil(2 ** ((b + 1) / 8)))
            break
    kept = grams.where(F.col("n") >= max(1, least))
    own = F.shiftright("code", 8)
    contexts = grams.groupBy((F.col("size") - 1).alias("size"), own.alias("code")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.max("n").alias("most")).where(F.col("most") >= max(1, least)).drop("most")
    a, b = kept.select("size", "code", "n").toArrow(), contexts.toArrow()
    return Trie(tuple(x.to_numpy() for x in a.columns), tuple(x.to_numpy() for x in b.columns))


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = c.distinct(codes)
    return keys, np.bincount(Table(keys).find(codes), n, len(keys)).astype(np.int64)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of distinct codes with counts, as one."""
    keys = c.distinct(np.concatenate([x for x, _ in found])) if found else np.zeros(0, c.U64)
    n = np.zeros(len(keys), np.int64)
    for own, m in found:
        n[np.searchsorted(keys, own)] += m
    return keys, n


def part(codes: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> Trie:
    """The trie of a shard's codes, and of all n-grams of LOW bytes or fewer."""
    grams, contexts = [], []
    of, m = codes, n
    for size in range(ORDER + 1, 0, -1):
        if size == LOW:
            of, m = low
        of, m = _summed(of & c.U64((1 << 8 * size) - 1), m)
        grams.append((np.full(len(of), size), of, m))
        first = np.flatnonzero(np.append(True, np.diff(of >> U8) != 0)) if len(of) else np.zeros(0, np.int64)
        total = np.add.reduceat(m, first) if len(of) else m
        contexts.append((np.full(len(first), size - 1), of[first] >> U8, total, np.diff(np.append(first, len(of)))))
    return Trie(tuple(map(np.concatenate, zip(*grams))), tuple(map(np.concatenate, zip(*contexts))))


def _dealt(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted codes by shard, and where the shards begin in it."""
    shard = c.mixed(codes >> U8 & LOW_MASK) >> c.U64(64 - bits)
    order = np.argsort(shard.astype(np.uint16), kind="stable") if bits <= 16 else np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange((1 << bits) + 1, dtype=c.U64))


def _small(values: np.ndarray) -> bytes:
    """Eight-byte values, all first bytes first, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _whole(payload: bytes, kind=c.U64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(8, -1).T.copy().view(kind)[:, 0]


def _listed(values: np.ndarray) -> bytes:
    """Floats as the distinct ones and their places: scores are those of few counts."""
    distinct, back = np.unique(values, return_inverse=True)
    return _small(np.concatenate([np.array([len(distinct)], np.int64), distinct.view(np.int64), back.astype(np.int64)]))


def _unlisted(payload: bytes) -> np.ndarray:
    values = _whole(payload, np.int64)
    return values[1 : values[0] + 1].view(np.float64)[values[values[0] + 1 :]]


def _tokens(data: np.ndarray, offsets: np.ndarray):
    low = c.LOWER[data]
    starts, ends, own = c.runs(c.NOT_SPACE[low], offsets)
    return c.span_hashes(low, starts, ends), own


def _held(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 5 == 1 for x in ids], bool)


PACKS = "block bigint, chars bigint, doc_ids array<bigint>, sizes binary, text binary, low binary, low_counts binary, tokens binary, token_counts binary"
PACKED = pa.schema([("block", pa.int64()), ("chars", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("sizes", "text", "low", "low_counts", "tokens", "token_counts"))])


def packs(docs: DataFrame, chars: int = PACK_CHARS) -> DataFrame:
    """Blocks of documents: ids, sizes and compressed text; what their training texts have of n-grams of LOW bytes, and their tokens."""

    def packed_up(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            texts, lows, tokens = [], [], []
            for piece in held:
                data, offsets = c.flat(piece.column("text"))
                out = _held(piece.column("doc_id").to_pylist())
                texts.append((data, np.diff(offsets)))
                codes, at = coded(*spelled(data, offsets), LOW - 1)
                lows.append(np.unique(codes[np.repeat(~out, np.diff(at))], return_counts=True))
                words, own = _tokens(data, offsets)
                learned = np.repeat(~out, np.diff(own))
                tokens += [np.unique(words[learned], return_counts=True), (c.distinct(words[~learned]), 0), (np.array([END_TOKEN]), int((~out).sum()))]
            data = np.concatenate([x for x, _ in texts])
            low, low_counts = _merged(lows)
            words, counts = _merged(tokens)
            row = {"block": task << 32 | n, "chars": len(data), "doc_ids": [x for piece in held for x in piece.column("doc_id").to_pylist()]}
            row |= {"sizes": np.concatenate([x for _, x in texts]).tobytes(), "text": zstandard.compress(data.tobytes(), 3)}
            row |= {"low": _small(low), "low_counts": _small(low_counts), "tokens": packed(words), "token_counts": _small(counts)}
            return pa.RecordBatch.from_pylist([row], PACKED)

        for piece in c.pieces(batches):
            held.append(piece)
            size += piece.column("text").nbytes + 8 * piece.num_rows
            if size >= chars:
                yield block()
                n, held, size = n + 1, [], 0
        if held:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed_up, PACKS)


class Pack:
    """A block's documents, in pieces of bytes and offsets."""

    def __init__(self, rows: pa.Table):
        self.name = rows.column("block")[0].as_py()
        self.ids = rows.column("doc_ids")[0].as_py()
        self.held = _held(self.ids)
        self.sizes = np.frombuffer(rows.column("sizes")[0].as_py(), np.int64)
        self.data = np.frombuffer(zstandard.decompress(rows.column("text")[0].as_py()), np.uint8)

    def pieces(self):
        """(first document, one after the last, bytes, offsets)"""
        ends = np.cumsum(self.sizes)
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + c.PIECE_BYTES, "right")))
            yield at, to, self.data[before : int(ends[to - 1])], np.append(0, ends[at:to] - before)
            at = to


def _low(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of LOW bytes of all blocks, and their counts."""

    def add_up(batches):
        found = [(np.zeros(0, c.U64), np.zeros(0, np.int64))]
        for batch in batches:
            for own, m in zip(batch.column("low").to_pylist(), batch.column("low_counts").to_pylist()):
                found = [_merged([*found, (_whole(own), _whole(m, np.int64))])]
        yield pa.RecordBatch.from_arrays([pa.array(found[0][0].astype(np.int64)), pa.array(found[0][1])], ["code", "n"])

    found = table.select("low", "low_counts").mapInArrow(add_up, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return found.column("code").to_numpy().astype(c.U64), found.column("n").to_numpy()


SENT = "shard int, block bigint, payload binary, counts binary"
ANSWERS = "block bigint, of_codes boolean, shard int, answer binary"


def _split(name: int, cut: np.ndarray, columns) -> pa.Table:
    full = [k for k in range(len(cut) - 1) if cut[k] < cut[k + 1]]
    payload, counts = zip(*(columns(cut[k], cut[k + 1]) for k in full)) if full else ((), ())
    return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([name] * len(full), pa.int64()), "payload": pa.array(payload, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _send_codes(rows: pa.Table, bits: int) -> pa.Table:
    """A block's distinct codes, with their counts in training texts, for the shards."""
    pack, found = Pack(rows), []
    for a, b, data, offsets in pack.pieces():
        codes, at = coded(*spelled(data, offsets))
        learned = np.repeat(~pack.held[a:b], np.diff(at))
        found += [np.unique(codes[learned], return_counts=True), (c.distinct(codes[~learned]), 0)]
        if len(found) > 16:
            found = [_merged(found)]
    keys, counts = _merged(found)
    order, cut = _dealt(keys, bits)
    keys, counts = keys[order], counts[order]
    return _split(pack.name, cut, lambda x, y: (_small(np.diff(keys[x:y], prepend=c.U64(0))), _small(counts[x:y])))


def _send_tokens(batches, bits: int):
    for batch in batches:
        for name, tokens, counts in zip(*(batch.column(x).to_pylist() for x in ("block", "tokens", "token_counts"))):
            words, n = unpacked(tokens), _whole(counts, np.int64)
            yield from _split(name, shards(words, bits), lambda x, y: (packed(words[x:y]), _small(n[x:y]))).to_batches()


def _together(rows: pa.Table, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys that blocks have sent, the sums of their counts, and each block's places in them."""
    keys = c.distinct(np.concatenate(lists))
    n, places = np.zeros(len(keys), np.int64), []
    for own, counts in zip(lists, rows.column("counts").to_pylist()):
        places.append(np.searchsorted(keys, own))
        n[places[-1]] += _whole(counts, np.int64)
    return keys, n, places


def _answered(rows: pa.Table, of_codes: bool, answers: list[bytes], **more) -> pa.Table:
    return pa.table({"block": rows.column("block"), "of_codes": pa.array([of_codes] * len(answers)), "shard": rows.column("shard"), "answer": pa.array(answers, pa.binary()), **more})


def _rate(rows: pa.Table, low: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """A shard's scores of each block's codes."""
    keys, n, places = _together(rows, [np.cumsum(_whole(x), dtype=c.U64) for x in rows.column("payload").to_pylist()])
    value = part(keys[n > 0], n[n > 0], low).scores(keys)
    return _answered(rows, True, [_listed(value[x]) for x in places])


def _count(rows: pa.Table) -> pa.Table:
    """A shard's counts of each block's tokens; and the shard's sums, once."""
    _, n, places = _together(rows, [unpacked(x) for x in rows.column("payload").to_pylist()])
    rest = [0] * (len(places) - 1)
    return _answered(rows, False, [_small(n[x]) for x in places], n=pa.array([int(n.sum()), *rest], pa.int64()), v=pa.array([int((n > 0).sum()), *rest], pa.int64()))


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(rows: pa.Table, answers: pa.Table, bits: int, code_bits: int, n_all: int, base: float) -> pa.Table:
    if not rows.num_rows:
        return SCORED.empty_table()
    pack = Pack(rows)
    by_shard = {(x, y): z for x, y, z in zip(*(answers.column(k).to_pylist() for k in ("of_codes", "shard", "answer")))}
    found, tokens = [], [np.array([END_TOKEN])]
    for _, _, data, offsets in pack.pieces():
        found.append(c.distinct(coded(*spelled(data, offsets))[0]))
        tokens.append(c.distinct(_tokens(data, offsets)[0]))
        if len(found) > 8:
            found = [c.distinct(np.concatenate(found))]
    keys, words = c.distinct(np.concatenate(found)), c.distinct(np.concatenate(tokens))
    order, cut = _dealt(keys, code_bits)
    rated = np.zeros(len(keys))
    for k in range(1 << code_bits):
        if cut[k] < cut[k + 1]:
            rated[order[cut[k] : cut[k + 1]]] = _unlisted(by_shard[True, k])
    cut = shards(words, bits)
    known = np.concatenate([_whole(by_shard[False, k], np.int64) for k in range(1 << bits) if cut[k] < cut[k + 1]])
    value, end = np.log10(known + 0.5), int(np.searchsorted(words, END_TOKEN))
    of_code, of_word = Table(keys), Table(words)
    out = []
    for a, b, data, offsets in pack.pieces():
        codes, at = coded(*spelled(data, offsets))
        own_words, own = _tokens(data, offsets)
        place, n_tokens = of_word.find(own_words), np.diff(own) + 1

        def per_doc(values):
            sums = np.zeros(len(values) + 1, values.dtype)
            np.cumsum(values, out=sums[1:])
            return sums[own[1:]] - sums[own[:-1]]

        columns = [
            pa.array(pack.ids[a:b], pa.int64()), pa.array(pack.held[a:b]), pa.array(n_tokens), pa.array(per_doc((known[place] > 0).astype(np.int64)) + int(known[end] > 0)),
            pa.array([n_all] * (b - a), pa.int64()), pa.array(per_doc(value[place]) + value[end] - n_tokens * base), pa.array(np.add.reduceat(rated[of_code.find(codes)], at[:-1])),
        ]
        out.append(pa.table(columns, SCORED))
    return pa.concat_tables(out)


def report(docs: DataFrame, chars: int = PACK_CHARS) -> DataFrame:
    """Each document's score under the trie, and its base score, as SCHEMA."""
    spark = docs.sparkSession
    table = c.written(packs(docs, chars), "packs")
    total = table.agg(F.sum("chars")).first()[0] or 0
    low = spark.sparkContext.broadcast(_low(table))
    bits, code_bits = max(4, (total // SHARD_CHARS).bit_length()), max(4, (total // CODE_CHARS).bit_length())
    tokens = table.select("block", "tokens", "token_counts").mapInArrow(lambda batches: _send_tokens(batches, bits), SENT)
    counts = c.written(tokens.groupBy("shard").applyInArrow(lambda rows: _count(rows), ANSWERS + ", n bigint, v bigint"), "tokens")
    n_all, v_all = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v")).first())
    base = float(np.log10(n_all + 0.5 * (v_all + 1)))
    every = table.select("block", "doc_ids", "sizes", "text").repartition(c.spread(spark), "block")
    codes = every.groupBy("block").applyInArrow(lambda rows: _send_codes(rows, code_bits), SENT)
    answers = codes.groupBy("shard").applyInArrow(lambda rows: _rate(rows, low.value), ANSWERS).union(counts.drop("n", "v"))
    return every.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda rows, own: _score(rows, own, bits, code_bits, n_all, base), SCHEMA)
