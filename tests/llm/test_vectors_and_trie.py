"""Near vectors, vector codes and the prefix trie against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from factloom.llm import cells, codes, prefixtrie, registry

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
BAD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]


def near_by_hand(rows, least=0.95):
    out = {}
    good = [(i, k, np.array(e, float)) for i, (k, e) in enumerate(rows) if e is not None and None not in e and np.isfinite(e).all() and np.any(np.array(e, float))]
    links = {i: set() for i, _ in enumerate(rows)}
    for i, _, a in good:
        for j, _, b in good:
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i].add(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (rows[i][0], len(links[i]), min(ids) if ids else None)
    return sorted(map(repr, out.values()))


def clusters(seed, size=16):
    """Tight and loose groups, a chain, copies, multiples, and vectors of no group."""
    r = np.random.default_rng(seed)
    out = [v for _ in range(60) for v in [r.normal(size=size)]]
    for noise, n in ((0.02, 40), (0.1, 40), (0.25, 60), (0.4, 60)):
        middle = r.normal(size=size)
        out += [middle + noise * r.normal(size=size) for _ in range(n)]
    a, b = r.normal(size=size), r.normal(size=size)
    out += [a * np.cos(t) + b * np.sin(t) for t in np.linspace(0, 2, 25)]
    out += [out[70], out[70], out[70] * 3, out[0] * 1e-30, out[1] * 1e30]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize(("cell", "part"), [(256, 1024), (20, 1024), (7, 3), (1000, 5)])
def test_near_vectors(spark, cell, part):
    rows = list(enumerate(clusters(cell)))
    rows += [(1000 + i, e) for i, e in enumerate(BAD)] + [(5, rows[90][1]), (None, rows[91][1]), (None, None), (2000, [1.0, 2.0]), (2001, [2.0, 4.1])]
    random.Random(part).shuffle(rows)
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], VECTORS).repartition(3)
    got = cells.linked(df, cell=cell, part=part).select("vec_id", "n_links", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == near_by_hand(rows)


def test_near_vectors_of_nothing_and_clashing_names(spark):
    assert cells.report(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [1.0, 0.0], 7, "x"), (2, [1.0, 0.1], 8, "y"), (3, [0.0, 1.0], 9, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, node int, Label string")
    assert sorted(tuple(r) for r in cells.keep_one(df).collect()) == [rows[0], rows[2]]
    assert sorted(tuple(r) for r in cells.report(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_near_vectors_make_no_pairs_of_a_group(spark):
    """A tight group of any size is compared with nothing: its rows reach their cell once."""
    r = np.random.default_rng(1)
    middle = r.normal(size=16)
    many = [(i, [float(x) for x in middle + 0.01 * r.normal(size=16)], 0) for i in range(2000)]
    nodes = cells.named(spark.createDataFrame(many, VECTORS)).withColumn("weight", cells.F.lit(1).cast("long"))
    out = cells.links(nodes, 16, cell=100).collect()
    assert len(out) < 3 * len(many)
    assert {x.n for x in out if x.b is None} == {1999}


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] is not None and len(r[1]) and None not in r[1] and np.isfinite(r[1]).all()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(256 * float(x))) for x in e] for _, e, _ in kept]
    size = len(whole[0]) // parts
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    best = lambda p, x: min((far(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for row in cut:
                own.setdefault(best(p, row[p])[1], []).append(row[p])
            for i, xs in own.items():
                new[p][i] = [sum(x[j] for x in xs) // len(xs) for j in range(size)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(p, row[p]) for p in range(parts)] for row in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(repr((k, "".join(f"{i:02x}" for _, i in f), e, by_label[label], sha)) for (k, _, label), f, e in zip(kept, found, errors))


@pytest.mark.parametrize(("size", "n"), [(16, 40), (64, 300), (48, 150), (80, 100)])
def test_vector_codes(spark, size, n):
    r = np.random.default_rng(size)
    vectors = [[float(np.float32(x)) for x in r.normal(size=size) * 0.3] for _ in range(n)]
    rows = [(i * 7 % 1000, v, i % 5 or None) for i, v in enumerate(vectors)]
    rows += [(3, vectors[0], 1), (3, vectors[1], None), (None, vectors[2], 2), (2000, vectors[3], 2), (2001, vectors[3], 2)]
    rows += [(5000 + i, None if e is None else (e * 5)[:size] if len(e) else e, 1) for i, e in enumerate(BAD) if i != 2]
    random.Random(size).shuffle(rows)
    got = codes.report(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(repr(tuple(x)) for x in got) == codes_by_hand(rows)


def test_bounds_lose_no_nearest_entry():
    """Ties, equal entries and very unequal sizes; and the bounds spare most exact distances."""
    r = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 7, 12):
        for scale in (2, 300, 1 << 24):
            entries = r.integers(-scale, scale, (64, size))
            entries[10] = entries[3]
            parts = np.concatenate([r.integers(-scale, scale, (500, size)), entries])
            book = codes.Book(entries)
            entry, distance = book.nearest(parts)
            full = ((parts[:, None] - entries) ** 2).sum(axis=2)
            assert (entry == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    book = codes.Book((r.normal(size=(64, 4)) * 30).astype(np.int64))
    book.nearest((r.normal(size=(5000, 4)) * 30).astype(np.int64))
    assert book.exact < 0.5 * book.all


def test_vector_codes_of_odd_tables(spark):
    assert codes.report(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.report(spark.createDataFrame([(1, [1.0] * 15, 0), (2, None, 0)], VECTORS)).count() == 0
    rows = [(1, [0.5] * 16, 1), (2, [1e30] * 16, 1), (3, [0.25] * 32, 1)]  # held at the bound; another length
    got = {r.vec_id: r for r in codes.report(spark.createDataFrame(rows, VECTORS)).collect()}
    assert set(got) == {1, 2} and got[2].error == 0
    df = spark.createDataFrame([(1, [0.5] * 16, 1, "a", 2)], VECTORS + ", code string, Error int")
    assert codes.encoded(df, codes.learn(df)).columns == ["vec_id", "embedding", "label", "code", "Error", codes.CODE, codes.ERROR]


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, p in path.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(y[:-1] == x for y in members if y)
        ends = ",".join(map(str, sorted(c for c in m if path[c] == node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split() if x else []) for x in below)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(x[:-1] == node for x in members if x), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_prefix_trie(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(0, 45), 100, 101, 103, 127]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hello there", "yes", "no\tway  at all", "", None])))
    rows += [(200, t, "user", f"turn {t}") for t in range(300)]  # one that many ranges share
    rows += [(205, 1, "user", "x"), (205, None, "user", "first"), (205, 1, "user", "x"), (205, 1, "assistant", "x"), (None, 0, "user", "x")]
    r.shuffle(rows)
    got = prefixtrie.report(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted(repr(tuple(x)) for x in got) == trie_by_hand(rows)


def test_prefix_trie_of_odd_tables(spark):
    assert prefixtrie.report(spark.createDataFrame([], TURNS)).count() == 0
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)  # without a base, and no turn of its own is left
    rows = [(alone, 0, "user", "a b"), (alone, 1, "user", "c")]
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], TURNS + ", Node string, words int")
    got = [tuple(x) for x in prefixtrie.report(df).collect()]
    assert list(map(repr, got)) == trie_by_hand(rows) and len(got) == 1


def test_registered():
    assert {"op11_near_vectors", "op12_prefix_trie", "op13_vector_codes"} <= set(registry.QUERIES) & set(registry.ORACLE_SQL)
