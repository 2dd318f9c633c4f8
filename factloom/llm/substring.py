"""Substring deduplication: recurring passages, located by sharded Aho-Corasick automata.

A window is SIZE consecutive words (split at ASCII white space, unchanged) of one document. A word goes if some window
over it also starts in a document with a smaller doc_id.

1. Documents are dealt into blocks, which are ranges of doc_id. A block sends the hashes of its distinct windows, sorted
   and delta-coded, to the shards of the hash space.
2. A shard confirms the windows that several blocks have, and for each block but the least of them asks the next lower
   one for the passage. So a window that all blocks have is asked of each of them once, and no block serves many.
3. The asked block writes these passages, runs of consecutive windows, as words, from its document with the least doc_id.
4. A block compiles automata from the passages it is sent, and from those that recur inside it: anchors of half a window,
   such that each window holds one, dealt by their hashes, PATTERNS to an automaton. It streams all its documents through
   all of them. Where an automaton finds an anchor, the text is compared with the passage, and windows in which all words
   agree are reported; nothing else goes. Letters of the automata are words that were compared byte by byte.

Hashes only say where to look. A window whose hash recurs but that isn't reported has a hash in common with other
words (as many as the width of hashes allows for: it grows with the text); such windows are grouped by their words
and judged by themselves. So no collision removes or keeps a word that it shouldn't.

A window counts once a block, so a passage that all documents share costs one hash and one copy for each block. Blocks
and shards grow in number with the text, not in size; a block has a row for a shard only where it has a window for it.

Null or empty texts have no words. A null doc_id is larger than any other. Rows with one doc_id are one document to the
rule (neither is smaller), each judged and returned by itself. Windows are judged on the input alone. A very long text
is a block of its own. An empty table gives no rows. `report` takes doc_id and text alone; `remove` keeps all columns,
whatever their names, but for BLOCK, which is reserved.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm import common as c
from factloom.llm.blocks import BLOCK, CHARS, LAST, blocks, dealt, packed, present, unpacked

SIZE = 13
SHARD_CHARS = 12_000_000
PATTERNS = 50_000
SPARE_BITS = 16


class Words:
    """The words of some texts: bytes, borders, each text's offsets into them, and their hashes."""

    def __init__(self, texts):
        self.data, self.offsets = c.flat(texts)
        self.starts, self.ends, self.own = c.runs(c.NOT_SPACE[self.data], self.offsets)
        self.hashes = c.span_hashes(self.data, self.starts, self.ends)

    def windows(self, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows, and the upper `width` bits of their hashes."""
        at, hashes = c.windows(self.hashes, self.own, size)
        return at, hashes >> c.U64(64 - width)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text that each of the words stands in."""
        return np.searchsorted(self.own, at, "right") - 1


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word: equal for equal bytes, different for different bytes, also where hashes collide."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    model, long = first[ids], ends - starts
    other = long != long[model]
    check = np.flatnonzero(~other & (model != np.arange(len(ids))))
    sizes = long[check]
    stops = np.cumsum(sizes)
    step = np.arange(int(stops[-1]) if len(stops) else 0)
    shift = stops - sizes
    differ = data[step + np.repeat(starts[check] - shift, sizes)] != data[step + np.repeat(starts[model[check]] - shift, sizes)]
    if differ.any():
        other[check[np.unique(np.searchsorted(stops, np.flatnonzero(differ), "right"))]] = True
    named: dict[bytes, int] = {}
    for k in np.flatnonzero(other).tolist():
        ids[k] = named.setdefault(data[starts[k] : ends[k]].tobytes(), len(distinct) + len(named))
    return ids


def _bordered(ids: np.ndarray, own: np.ndarray, border: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words with borders between texts and at both ends, and where each word stands there."""
    place = np.arange(len(ids)) + np.repeat(np.arange(len(own) - 1), np.diff(own)) + size
    line = np.full(len(ids) + len(own) + 2 * size, border, np.int64)
    line[place] = ids
    return line, place


def _anchors(line: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all distinct windows of the passages, their groups by words, and the windows of crowded ones."""
    long, step = (size + 1) // 2, size - (size + 1) // 2 + 1
    at, hashes = c.windows(c.mixed(line.astype(c.U64)), own, size)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    model, spread = at[first][back], np.arange(size)
    again = (model != at) & (line[at[:, None] + spread] == line[model[:, None] + spread]).all(axis=1)
    at = at[~again]
    begin = own[np.searchsorted(own, at, "right") - 1]
    place = begin - (begin - at) // step * step
    places, back = np.unique(place, return_inverse=True)
    _, group = np.unique(line[places[:, None] + np.arange(long)], axis=0, return_inverse=True)
    group = group.ravel()
    crowded = np.bincount(group, minlength=1)[group] > CROWD
    return places[~crowded], group[~crowded], at[crowded[back]]


def reported(ids: np.ndarray, own: np.ndarray, ranks: np.ndarray, line: np.ndarray, cuts: np.ndarray, limits: np.ndarray, size: int, most: int = PATTERNS) -> np.ndarray:
    """First words of the windows, in texts that rank above a passage's limit, that stand in the passage too.

    ids: words of all texts; own: texts' offsets into them; line: words of all passages; cuts: passages' offsets into them.
    Each window of a passage holds one of its anchors, which are runs of about half as many words, one every other half.
    Automata find the anchors; from there texts and passages are compared word by word. The windows of anchors that more
    than CROWD places have are patterns themselves.
    """
    out = np.zeros(len(ids) + 1, bool)
    places, group, whole = _anchors(line, cuts, size) if len(line) >= size else (np.zeros(0, np.int64),) * 3
    long, step = (size + 1) // 2, size - (size + 1) // 2 + 1
    order = np.argsort(group, kind="stable")
    places, group = places[order], group[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    begins = np.append(first, len(group))
    # patterns, dealt to automata by their hashes: anchors by the number of their group, then windows
    at, n = np.concatenate([places[first], whole]), np.append(np.full(len(first), long), np.full(len(whole), size))
    deal = np.argsort(c.mixed(c.span_hashes(line, at, at + n)), kind="stable")
    texts, text_at = _bordered(ids, own, -1, size)
    passages, passage_at = _bordered(line, cuts, -2, size)
    rank_of = np.repeat(ranks, np.diff(own))
    limit_of = np.repeat(limits, np.diff(cuts))
    word_of = np.full(len(texts), -1, np.int64)
    word_of[text_at] = np.arange(len(ids))
    around = np.arange(1 - step, size)
    for k in range(0, len(deal), most):
        now = deal[k : k + most]
        stops = np.cumsum(n[now])
        own_words = line[np.arange(int(stops[-1])) + np.repeat(at[now] - (stops - n[now]), n[now])]
        letters = c.distinct(own_words)
        place = np.minimum(np.searchsorted(letters, texts), len(letters) - 1)
        place[letters[place] != texts] = -1
        keep = place >= 0
        keep[1:] |= keep[:-1]  # of words that no pattern has one stays, as a border
        keys = _spelled(np.searchsorted(letters, own_words), len(letters))
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, a, b in zip(now.tolist(), ((stops - n[now]) * SYMBOLS).tolist(), (stops * SYMBOLS).tolist()):
            machine.add_word(keys[a:b], i)
        machine.make_automaton()
        found = np.array(list(machine.iter(_spelled(place[keep], len(letters)))), np.int64).reshape(-1, 2)
        start = word_of[np.flatnonzero(keep)[found[:, 0] // SYMBOLS]] - n[found[:, 1]] + 1
        is_whole = found[:, 1] >= len(first)
        good, of = start[is_whole], at[found[is_whole, 1]]
        out[good[limit_of[of] < rank_of[good]]] = True
        start, of = start[~is_whole], found[~is_whole, 1]
        many = begins[of + 1] - begins[of]
        ends = np.cumsum(many)
        there = places[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[of] - (ends - many), many)]
        start = np.repeat(start, many)
        above = limit_of[there] < rank_of[start]
        start, there = start[above], there[above]
        for x in range(0, len(start), COMPARED):
            t, p = start[x : x + COMPARED], there[x : x + COMPARED]
            same = texts[text_at[t][:, None] + around] == passages[passage_at[p][:, None] + around]
            sums = np.cumsum(same, axis=1, dtype=np.int16)
            sums[:, size:] -= sums[:, :-size].copy()
            row, shift = np.nonzero(sums[:, size - 1 :] == size)
            out[t[row] + 1 - step + shift] = True
    return np.flatnonzero(out)


CROWD = 8
COMPARED = 100_000
SYMBOLS = 2


def _spelled(letters: np.ndarray, n: int) -> str:
    """Letters of an alphabet of n as SYMBOLS symbols each, so that no state has many ways on; -1 is a border.

    Each place has symbols of its own, so a word is found only where one begins.
    """
    side = int(np.ceil(n ** (1 / SYMBOLS))) + 1
    symbols = np.stack([letters // side ** (SYMBOLS - 1 - j) % side + j * side + 1 for j in range(SYMBOLS)], axis=1)
    symbols[letters < 0] = 0
    return symbols.astype("<u4").tobytes().decode("utf-32-le")


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words the windows that begin at `at` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by doc_id, and their ranks: rows of one doc_id share a rank."""
    ids = rows.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return rows.take(pa.array(order)), np.unique(ids, return_inverse=True)[1][order]


def _least(hashes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the place of each window's hash in them, and the least and greatest rank of each."""
    distinct, back = np.unique(hashes, return_inverse=True)
    low, high = np.full(len(distinct), LAST), np.full(len(distinct), -1)
    np.minimum.at(low, back, ranks)
    np.maximum.at(high, back, ranks)
    return distinct, back, low, high


def _confirm(rows: pa.Table) -> pa.Table:
    """What a shard asks of blocks: for each, pairs of a place in the list it has sent and the block that needs it."""
    rows = rows.sort_by("block")
    names = rows.column("block").to_numpy()
    sent = [unpacked(x) for x in rows.column("payload").to_pylist()]
    every = np.concatenate(sent)
    starts = np.append(0, np.cumsum([len(x) for x in sent]))
    by = np.argsort(every, kind="stable")
    new = np.append(True, every[by[1:]] != every[by[:-1]])
    again = np.flatnonzero(~new)
    source, target = by[again - 1], by[again]  # the entry of the same hash in the next lower block that has it
    order = np.argsort(source, kind="stable")
    source, target = source[order], names[np.searchsorted(starts, target[order], "right") - 1].astype("<i4")
    cut = np.searchsorted(source, starts)
    some = [k for k in range(len(names)) if cut[k] < cut[k + 1]]
    return pa.table(
        {
            "block": pa.array(names[some], pa.int32()), "shard": pa.array([rows.column("shard")[0].as_py()] * len(some), pa.int32()),
            "at": pa.array([(source[cut[k] : cut[k + 1]] - starts[k]).astype("<u4").tobytes() for k in some], pa.binary()),
            "targets": pa.array([target[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
        }
    )


PASSAGES = "block int, passages array<binary>"


def _passages(rows: pa.Table, asked: pa.Table, size: int, bits: int, width: int) -> pa.Table:
    """The asked windows of a block, as runs of words, for each block that needs some."""
    names, lists = [], []
    if asked.num_rows and rows.num_rows:
        rows, ranks = _ordered(rows)
        words = Words(rows.column("text"))
        at, hashes = words.windows(size, width)
        own_ranks = ranks[words.text_of(at)]
        distinct, back, low, _ = _least(hashes, own_ranks)
        known, begin = present(distinct, bits, width)
        begin = begin[np.searchsorted(known, asked.column("shard").to_numpy())].tolist()
        place = np.concatenate([at_ + np.frombuffer(x, "<u4") for at_, x in zip(begin, asked.column("at").to_pylist())])
        target = np.concatenate([np.frombuffer(x, "<i4") for x in asked.column("targets").to_pylist()])
        first = np.flatnonzero(own_ranks == low[back])  # windows in the least document that has them
        first = first[np.argsort(back[first], kind="stable")]
        begins = np.searchsorted(back[first], np.arange(len(distinct) + 1))
        order = np.argsort(target, kind="stable")
        target, place = target[order], place[order]
        text_of = words.text_of(at)
        raw = words.data.tobytes()
        edges = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(target)]):
            sizes = begins[place[a:b] + 1] - begins[place[a:b]]
            stops = np.cumsum(sizes)
            need = np.sort(first[np.repeat(begins[place[a:b]] - (stops - sizes), sizes) + np.arange(int(stops[-1]))])
            new = np.flatnonzero(np.append(True, (np.diff(at[need]) != 1) | (np.diff(text_of[need]) != 0)))
            last = np.append(new[1:], len(need)) - 1
            names.append(int(target[a]))
            lists.append([raw[x:y] for x, y in zip(words.starts[at[need[new]]].tolist(), words.ends[at[need[last]] + size - 1].tolist())])
    return pa.table({"block": pa.array(names, pa.int32()), "passages": pa.array(lists, pa.list_(pa.binary()))})


def _located(rows: pa.Table, ranks: np.ndarray, passages: list, size: int, width: int, patterns: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The block's words, the first words of windows that automata report, and of those that only their hashes speak of."""
    words = Words(rows.column("text"))
    at, hashes = words.windows(size, width)
    own_ranks = ranks[words.text_of(at)]
    distinct, back, low, high = _least(hashes, own_ranks)
    foreign = Words(pa.array(passages, pa.binary()))
    f_at, f_hashes = foreign.windows(size, width)
    elsewhere = np.zeros(len(distinct), bool)
    if len(f_hashes) and len(distinct):
        place = np.minimum(np.searchsorted(distinct, f_hashes), len(distinct) - 1)
        elsewhere[place[distinct[place] == f_hashes]] = True
    expected = elsewhere[back] | (own_ranks > low[back])
    own_at = np.flatnonzero((own_ranks == low[back]) & (high > low)[back] & ~elsewhere[back])
    shift = len(words.data)
    ids = word_ids(
        np.concatenate([words.data, foreign.data]), np.concatenate([words.starts, foreign.starts + shift]), np.concatenate([words.ends, foreign.ends + shift]),
        np.concatenate([words.hashes, foreign.hashes]),
    )
    # passages inside the block: runs of windows in the least document that has them
    begin = at[own_at[np.append(True, (np.diff(at[own_at]) != 1) | (np.diff(words.text_of(at[own_at])) != 0))]] if len(own_at) else at[:0]
    stop = at[own_at[np.append((np.diff(at[own_at]) != 1) | (np.diff(words.text_of(at[own_at])) != 0), True)]] + size if len(own_at) else at[:0]
    long = stop - begin
    ends = np.cumsum(long)
    mine = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - long), long)]
    line = np.concatenate([ids[len(words.starts) :], mine])
    cuts = np.concatenate([foreign.own, len(foreign.starts) + ends])
    limits = np.concatenate([np.full(len(foreign.own) - 1, -1), ranks[words.text_of(begin)]])
    hits = reported(ids[: len(words.starts)], words.own, ranks, line, cuts, limits, size, patterns)
    return words, hits, np.setdiff1d(at[expected], hits, assume_unique=True)


def _removed(docs: DataFrame, emit, schema: str | T.StructType, size: int, width: int | None, chars: int, patterns: int) -> DataFrame:
    """emit(rows, words, gone) -> table of `schema`, for some documents at once: `gone` says which words go."""
    every, total = blocks(docs, chars)
    every = every.select(BLOCK, *docs.columns).repartition(c.spread(docs.sparkSession), BLOCK)
    bits = max(4, (total // SHARD_CHARS).bit_length())
    width = width or min(64, max(bits + 16, int(total).bit_length() + SPARE_BITS))
    bits = min(bits, width)
    rest = docs.columns

    def send(key, rows):
        hashes = c.distinct(Words(rows.column("text")).windows(size, width)[1])
        return dealt(key[0].as_py(), lambda a, b: packed(hashes[a:b]), *present(hashes, bits, width))

    def write(rows, asked):
        return _passages(rows, asked, size, bits, width)

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = T.StructType([T.StructField("done", schema), T.StructField("rest", docs.schema), T.StructField("row", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType()))])
    found = found.add("open", T.ArrayType(T.StructType.fromDDL("at int, words binary")))
    arrow = to_arrow_schema(found)

    def locate(rows, sent):
        if not rows.num_rows:
            return arrow.empty_table()
        name = rows.column(BLOCK)[0].as_py()
        rows, ranks = _ordered(rows.select(rest))
        words, hits, more = _located(rows, ranks, [x for list_ in sent.column("passages").to_pylist() for x in list_], size, width, patterns)
        done = emit(rows, words, covered(hits, len(words.starts), size)).cast(to_arrow_schema(schema))
        later = np.zeros(rows.num_rows, bool)
        later[words.text_of(more)] = True
        hit_of, open_of = ([x[a:b] for a, b in zip(np.searchsorted(x, words.own), np.searchsorted(x, words.own[1:]))] if later.any() else [] for x in (hits, more))
        raw, first = words.data.tobytes(), words.own.tolist()

        def spelled(at, i):
            words_ = [raw[a:b] for a, b in zip(words.starts[at : at + size].tolist(), words.ends[at : at + size].tolist())]
            return {"at": at - first[i], "words": b" ".join(words_)}

        columns = {
            "done": pa.StructArray.from_arrays([x.combine_chunks() for x in done.columns], fields=list(done.schema), mask=pa.array(later)),
            "rest": pa.StructArray.from_arrays([x.combine_chunks() for x in rows.columns], fields=list(rows.schema), mask=pa.array(~later)),
            "row": pa.array([name << 32 | i for i in range(rows.num_rows)], pa.int64()),
            "hits": pa.array([(hit_of[i] - first[i]).tolist() if x else None for i, x in enumerate(later)], pa.list_(pa.int32())),
            "open": pa.array([[spelled(at, i) for at in open_of[i].tolist()] if x else None for i, x in enumerate(later)], arrow.field("open").type),
        }
        return pa.table(columns).cast(arrow)

    asked = every.groupBy(BLOCK).applyInArrow(send, "shard int, block int, payload binary").groupBy("shard").applyInArrow(_confirm, "block int, shard int, at binary, targets binary")
    sent = every.groupBy(BLOCK).cogroup(asked.groupBy("block")).applyInArrow(write, PASSAGES)
    located = c.written(every.groupBy(BLOCK).cogroup(sent.groupBy("block")).applyInArrow(locate, found), "located")
    done = located.where("rest IS NULL").select("done.*")
    if not located.where("rest IS NOT NULL").limit(1).count():
        return done
    return done.union(_compared(located.where("rest IS NOT NULL"), emit, schema, rest, size))


def _compared(waiting: DataFrame, emit, schema: T.StructType, columns: list[str], size: int) -> DataFrame:
    """Documents with windows whose hashes collide: these windows are grouped by their words."""
    doc_id = F.coalesce(F.col("rest.doc_id").cast("long"), F.lit(LAST))
    opened = waiting.select("row", doc_id.alias("doc_id"), F.explode("open").alias("x")).select("row", "doc_id", "x.at", "x.words")
    first = opened.groupBy("words").agg(F.min("doc_id").alias("first"))
    late = opened.join(first, "words").where("first < doc_id").groupBy("row").agg(F.collect_list("at").alias("late"))

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                fields = batch.column("rest").flatten()
                rows = pa.table(fields, columns)
                words = Words(rows.column("text"))
                at = [words.own[i] + np.array([*(x or []), *(y or [])], np.int64) for i, (x, y) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("late").to_pylist()))]
                yield from emit(rows, words, covered(np.concatenate(at), len(words.starts), size)).cast(to_arrow_schema(schema)).to_batches()

    return waiting.join(late, "row", "left").select("rest", "hits", "late").mapInArrow(finish, schema)


def report(docs: DataFrame, size: int = SIZE, width: int | None = None, chars: int = CHARS, patterns: int = PATTERNS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and kept_sha256 of the words kept, joined by single spaces."""

    def emit(rows, words, gone):
        kept = ~gone
        long = (words.ends - words.starts + 1)[kept]  # with a space behind
        stops = np.cumsum(long)
        line = np.append(words.data, np.uint8(32))[np.repeat(words.starts[kept] - (stops - long), long) + np.arange(int(stops[-1]) if len(stops) else 0)]
        line[stops - 1] = 32
        line = line.tobytes()
        sizes = np.zeros(len(words.starts) + 1, np.int64)
        np.cumsum(np.where(kept, words.ends - words.starts + 1, 0), out=sizes[1:])
        cut = sizes[words.own].tolist()
        n = np.zeros(len(words.starts) + 1, np.int64)
        np.cumsum(gone, out=n[1:])
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(words.own)), "n_removed": pa.array(n[words.own[1:]] - n[words.own[:-1]]),
                "kept_sha256": pa.array([hashlib.sha256(line[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()),
            }
        )

    return _removed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), emit, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", size, width, chars, patterns)


def remove(docs: DataFrame, size: int = SIZE, width: int | None = None, chars: int = CHARS, patterns: int = PATTERNS) -> DataFrame:
    """The documents without their recurring passages: each run of words goes, with the white space after it. All columns stay."""

    def emit(rows, words, gone):
        data, offsets, own = words.data, words.offsets, words.own
        step = np.zeros(len(data) + 1, np.int8)
        step[words.starts[gone]] += 1
        # up to the next word of the document, or its end
        after = np.append(words.starts[1:], len(data))
        full = own[1:] > own[:-1]
        after[own[1:][full] - 1] = offsets[1:][full]
        np.add.at(step, after[: len(gone)][gone], -1)
        keep = np.cumsum(step[:-1], dtype=np.int64) <= 0
        n = np.append(0, np.cumsum(keep))[offsets].tolist()
        line = data[keep].tobytes()
        nulls = rows.column("text").is_null().to_pylist()
        texts = [None if null else line[a:b].decode() for a, b, null in zip(n, n[1:], nulls)]
        k = rows.schema.get_field_index("text")
        return rows.set_column(k, rows.schema.field(k), pa.array(texts, rows.schema.field(k).type))

    return _removed(docs, emit, docs.schema, size, width, chars, patterns)
