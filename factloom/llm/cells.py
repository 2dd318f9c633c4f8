"""Near copies of embeddings: all pairs of a cosine of LEAST or more, counted and linked without making pairs of a group.

Equal vectors are one node with a weight. Spherical k-means (ROUNDS passes over all nodes) gives cells of about CELL
nodes; a node's home is its nearest centroid. Products are computed in blocks, a cell's members against its visitors:

* A node within half the angle t = acos(LEAST) of its centroid is in the cell's core, the others are loose. All of a core
  link with each other, so a core of any size is counted by its weight, and nothing of it is compared.
* A node x visits a cell only if something there may link with it: its angle to the centroid is within t of the angles
  there (least to greatest, of the core or of the loose ones), and it is no further than sin(t) from the hyperplane
  between its own centroid and that one. Both follow from the triangle inequality, so no link is lost whatever the
  centroids are. A core that lies within t of x as a whole links as a whole: it adds its weight, x adds its own to all of it.
* Of two cells only one visits the other, and both sides are counted there.

Members and visitors are sorted by cell and streamed: a task holds one part of a cell, PART nodes at most, and a batch of
visitors. Links inside a part are joined as they are found, so a node gives one edge, not one a link. Vectors without
structure prune badly (in 64 dimensions a node visits some sixth of 250 cells, a hundredth of 10 000); that costs copies
of vectors, never links. Centroids and what is known of each cell are broadcast: MOST_BYTES at most, by the choice of
their number.

A vector that is null, empty, zero or has a null or non-finite component links with nothing. Vectors of different length
aren't compared; each length goes through the steps on its own. Nodes are named by a 64-bit hash of the vector. Repeated
vec_ids are rows like any others; a null vec_id names no component unless no other is there. Empty table: no rows. All
columns stay in `keep_one`, whatever their names, but for those that begin with factloom_, which are reserved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm import common as c
from factloom.llm.graph import components
from factloom.llm.vectors import matrix, whole

LEAST = 0.95
CELL = 256
PART = 1024
ROUNDS = 2
MOST_BYTES = 32 << 20
#: More than rounding can add to an angle or a product of unit vectors.
SLACK = 1e-6
BLOCK = 1 << 19
NODE = "factloom_node"
HOME, WHOLE, VISIT, EDGE = range(4)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is scaled first, so that no square is lost."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def named(rows: DataFrame) -> DataFrame:
    """vec_id, embedding and NODE: null for a vector that links with nothing."""
    some = whole("embedding") & F.exists("embedding", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.when(some, F.xxhash64("embedding")).alias(NODE))


class Cells:
    """Centroids, and of each cell its core (weight, radius, least node, nodes) and its loose ones (least and greatest angle, nodes)."""

    def __init__(self, centroids: np.ndarray, least: float = LEAST):
        self.centroids, self.angle = centroids, math.acos(least)
        self.core_angle = self.angle / 2 - SLACK

    def homes(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dots = own @ self.centroids.T
        return dots, dots.argmax(axis=1)

    def known(self, stats: dict[int, tuple], part: int = PART) -> Cells:
        n = len(self.centroids)
        self.weight, self.rep, self.core, self.loose = (np.zeros(n, np.int64) for _ in range(4))
        self.radius, self.low, self.high = np.zeros(n), np.full(n, 9.0), np.full(n, -9.0)
        for k, (weight, radius, rep, core, low, high, loose) in stats.items():
            self.core[k], self.loose[k] = core, loose
            if core:
                self.weight[k], self.radius[k], self.rep[k] = weight, radius, rep
            if loose:
                self.low[k], self.high[k] = low, high
        self.parts = np.maximum(1, -(-np.stack([self.core, self.loose], axis=1) // part))
        return self

    def forward(self, home: np.ndarray) -> np.ndarray:
        """True for the cells that a node of `home` visits, of the two directions one."""
        n = len(self.centroids)
        steps = (np.arange(n) - home[:, None]) % n
        return (steps > 0) & ((2 * steps < n) | (2 * steps == n) & (home[:, None] < np.arange(n)))


def _decoded(column: pa.Array, size: int, kind) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size).astype(np.float64))


def _chunks(batches, size: int, cells: int):
    """(batch, unit vectors), few enough rows for BLOCK products. Vectors are whole here."""
    rows = max(1, BLOCK // cells)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece, unit(matrix(piece.column("embedding"), size)[0])


def trained(nodes: DataFrame, size: int, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by spherical k-means: they start as the `count` nodes of least hash; a round is one pass over all nodes."""
    first = nodes.orderBy(NODE).select("embedding").limit(count).collect()  # MOST_BYTES at most
    centroids = unit(np.array([r.embedding for r in first], np.float64))

    def add(batches):
        kept, sums, seen = Cells(centroids), np.zeros(centroids.shape), np.zeros(len(centroids), bool)
        for _, own in _chunks(batches, size, len(centroids)):
            home = kept.homes(own)[1]
            order = np.argsort(home, kind="stable")
            begins = np.flatnonzero(np.append(True, home[order][1:] != home[order][:-1]))
            sums[home[order][begins]] += np.add.reduceat(own[order], begins, axis=0)
            seen[home] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([sums[k].tobytes() for k in at], pa.binary())], ["cell", "total"])

    def merge(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("total"))
        return pa.table({"cell": rows.column("cell").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    for _ in range(rounds):
        sums = nodes.select("embedding").mapInArrow(add, "cell int, total binary").groupBy("cell").applyInArrow(merge, "cell int, total binary")
        centroids = centroids.copy()
        for r in sums.collect():  # MOST_BYTES at most
            total = np.frombuffer(r.total)
            if np.abs(total).max() > 0:
                centroids[r.cell] = unit(total[None])[0]
    return centroids


def measured(nodes: DataFrame, size: int, cells: Cells, part: int = PART) -> Cells:
    def measure(batches):
        for piece, own in _chunks(batches, size, len(cells.centroids)):
            dots, home = cells.homes(own)
            angle = np.arccos(np.clip(dots[np.arange(len(home)), home], -1, 1))
            core = angle <= cells.core_angle
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(core), pa.array(angle), piece.column("weight"), piece.column(NODE)], ["cell", "core", "angle", "weight", "node"])

    rows = nodes.select("embedding", "weight", NODE).mapInArrow(measure, "cell int, core boolean, angle double, weight bigint, node bigint")
    of = lambda f, x, core=True: f(F.when(F.col("core") == core, F.col(x)))
    stats = rows.groupBy("cell").agg(of(F.sum, "weight"), of(F.max, "angle"), of(F.min, "node"), of(F.count, "node"), of(F.min, "angle", False), of(F.max, "angle", False), of(F.count, "node", False))
    return cells.known({r[0]: tuple(r)[1:] for r in stats.collect()}, part)  # a row a cell


class _Joined:
    """Cells that are known to be connected, as labels; `join` tells which edges that adds."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, some: np.ndarray) -> np.ndarray:
        """One of each group among `some` besides the first one's."""
        own = self.label[some]
        least = own.min()
        if own.max() == least:
            return some[:0]
        groups, first = np.unique(own, return_index=True)
        self.label[np.isin(self.label, groups)] = least
        return some[first[first > 0]]


SENT = "cell int, core boolean, part int, role int, node bigint, weight bigint, known bigint, rep bigint, vec binary"


def _sender(size: int, cells: Cells, kind):
    """What each node sends to the cells: itself as a member, itself as a visitor, its weight to cores that it links with as a whole."""
    n = len(cells.centroids)

    def send(batches):
        joined = _Joined(n)
        for piece, own in _chunks(batches, size, n):
            node, weight = piece.column(NODE).to_numpy(), piece.column("weight").to_numpy()
            vec = [x.tobytes() for x in matrix(piece.column("embedding"), size)[0].astype(kind)]
            dots, home = cells.homes(own)
            rows = np.arange(len(home))
            angles = np.arccos(np.clip(dots, -1, 1))
            core = angles[rows, home] <= cells.core_angle
            to = cells.forward(home)
            to_core = to.copy()
            to_core[rows, home] = ~core  # of its own cell, a loose node meets the core
            to_core &= cells.core > 0
            near = to_core & (angles + cells.radius <= cells.angle - SLACK)
            meets = to_core & ~near & (angles - cells.radius <= cells.angle + SLACK)
            to_loose = to & (cells.loose > 0) & (angles - cells.high <= cells.angle + SLACK) & (cells.low - angles <= cells.angle + SLACK)

            def within(mask):
                """Pairs (row, cell) of the mask that the hyperplane between the centroids doesn't rule out."""
                row, cell = np.nonzero(mask)
                away = np.sqrt(((cells.centroids[home[row]] - cells.centroids[cell]) ** 2).sum(axis=1))
                keep = dots[row, home[row]] - dots[row, cell] <= math.sin(cells.angle) * away + SLACK
                return row[keep], cell[keep]

            known = near @ cells.weight + weight - 1 + np.where(core, cells.weight[home] - weight, 0)
            rep = np.where(core, cells.rep[home], node)
            edges = []
            for i in np.flatnonzero(near.any(axis=1)):
                all_ = np.flatnonzero(near[i])
                if core[i]:
                    all_ = np.append(home[i], all_)
                else:
                    rep[i] = cells.rep[all_[0]]
                edges += [(cells.rep[all_[0]], cells.rep[k]) for k in joined.join(all_)]

            out = {k: [] for k in ("cell", "core", "part", "role", "node", "weight", "known", "rep", "at")}

            def add(cell, core, part, role, node, weight, known=0, rep=0, at=-1):
                for k, v in zip(out, (cell, core, part, role, node, weight, known, rep, at)):
                    out[k].append(np.broadcast_to(np.asarray(v), np.shape(cell)))

            own_part = (node.view(np.uint64) % cells.parts[home, (~core).astype(int)].astype(np.uint64)).astype(np.int64)
            add(home, core, own_part, HOME, node, weight, known, rep, rows)
            whole_ = weight @ near
            for k in np.flatnonzero(whole_):
                parts = np.arange(cells.parts[k, 0])
                add(np.full(len(parts), k), True, parts, WHOLE, 0, whole_[k])
            for is_core, mask in ((True, meets), (False, to_loose)):
                row, cell = within(mask)
                times = cells.parts[cell, int(not is_core)]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                add(cell, is_core, part, VISIT, node[row], weight[row], at=row)
            # parts of the own cell's loose nodes: of two, one visits the other
            for k in np.unique(home[~core & (cells.parts[home, 1] > 1)]):
                i, n_parts = np.flatnonzero(~core & (home == k)), cells.parts[k, 1]
                steps = (np.arange(n_parts) - own_part[i, None]) % n_parts
                row, part = np.nonzero((steps > 0) & ((2 * steps < n_parts) | (2 * steps == n_parts) & (own_part[i, None] < np.arange(n_parts))))
                add(np.full(len(part), k), False, part, VISIT, node[i[row]], weight[i[row]], at=i[row])
            if edges:
                a, b = np.array(edges, np.int64).T
                add(np.zeros(len(a), np.int64), True, 0, EDGE, a, 0, rep=b)
            flat = {k: np.concatenate(v) for k, v in out.items()}
            at = flat.pop("at")
            kinds = dict(cell=np.int32, core=bool, part=np.int32, role=np.int32)
            for begin in range(0, len(at), 20_000):
                cut = slice(begin, begin + 20_000)
                arrays = [pa.array(v[cut].astype(kinds.get(k, np.int64))) for k, v in flat.items()]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([vec[i] if i >= 0 else None for i in at[cut]], pa.binary())], [*flat, "vec"])

    return send


class _Part:
    """The members of one part of a cell, what they link with so far."""

    def __init__(self, core: bool, size: int, kind, least: float):
        self.core, self.size, self.kind, self.least = core, size, kind, least
        self.rows: list[pa.RecordBatch] = []
        self.own = None

    def begin(self):
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        self.node, self.weight, self.count, self.rep = (rows.column(k).to_numpy().copy() for k in ("node", "weight", "known", "rep"))
        self.own = _decoded(rows.column("vec").combine_chunks(), self.size, self.kind) if len(self.node) else np.zeros((0, self.size))
        self.joined = _Joined(max(1, len(self.node)))
        if self.core:
            self.joined.label[:] = 0
        else:
            links = self.own @ self.own.T >= self.least
            np.fill_diagonal(links, False)
            self.count += links @ self.weight
            for i in np.flatnonzero(links.any(axis=1)):
                self.joined.join(np.append(i, np.flatnonzero(links[i])))

    def meet(self, rows: pa.RecordBatch):
        """The visitors' counts and edges."""
        node, weight = (rows.column(k).to_numpy() for k in ("node", "weight"))
        links = _decoded(rows.column("vec"), self.size, self.kind) @ self.own.T >= self.least
        self.count += weight @ links
        some = np.flatnonzero(links.any(axis=1))
        first = links[some].argmax(axis=1) if len(some) else some
        for i in some:
            self.joined.join(np.flatnonzero(links[i]))
        return node[some], self.node[first], (links[some] @ self.weight)

    def end(self):
        counts = self.count > 0
        if self.core:  # its members all link with its least node, which is their rep
            return self.node[counts], self.count[counts], self.node, self.rep
        root = self.node[self.joined.label[: len(self.node)]]
        return self.node[counts], self.count[counts], np.append(self.node, self.node), np.append(self.rep, root)


def _meeter(size: int, kind, least: float):
    def rows_of(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def counted(node, n):
        return rows_of(node, pa.nulls(len(node), pa.int64()), n)

    def linked(a, b):
        keep = a != b
        return rows_of(a[keep], b[keep], np.zeros(int(keep.sum()), np.int64))

    def meet(batches):
        key, part = None, None

        def ended():
            if part is not None:
                if part.own is None:
                    part.begin()
                node, n, a, b = part.end()
                yield counted(node, n)
                yield linked(a, b)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("cell", "core", "part", "role")])
            cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), batch.num_rows)
            for begin, end in zip(cuts, cuts[1:]):
                rows, (*own, role) = batch.slice(begin, end - begin), keys[:, begin].tolist()
                if role == EDGE:
                    yield linked(rows.column("node").to_numpy(), rows.column("rep").to_numpy())
                    continue
                if own != key:
                    yield from ended()
                    key, part = own, _Part(bool(own[1]), size, kind, least)
                if role == HOME:
                    part.rows.append(rows)
                    continue
                if part.own is None:
                    if not part.rows:
                        part.rows.append(rows.slice(0, 0))
                    part.begin()
                if role == WHOLE:
                    part.count += rows.column("weight").to_numpy().sum()
                    continue
                for at in range(0, rows.num_rows, 2048):
                    node, first, n = part.meet(rows.slice(at, 2048))
                    yield counted(node, n)
                    yield linked(node, first)
        yield from ended()

    return meet


def links(nodes: DataFrame, size: int, least: float = LEAST, cell: int = CELL, part: int = PART) -> DataFrame:
    """nodes (NODE, embedding, weight) of one length -> rows (a, null, n): n rows link with node a, to be summed; and (a, b, 0): edges with the components of all links."""
    count = max(1, min(nodes.count() // cell, MOST_BYTES // (8 * size)))
    cells = measured(nodes, size, Cells(trained(nodes, size, count), least), part)
    kind = np.float32 if nodes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    sent = nodes.select("embedding", "weight", NODE).mapInArrow(_sender(size, cells, kind), SENT)
    keys = ("cell", "core", "part")
    dealt = sent.repartition(c.spread(nodes.sparkSession), *keys).sortWithinPartitions(*keys, "role")
    return dealt.mapInArrow(_meeter(size, kind, least), "a bigint, b bigint, n bigint")


def linked(rows: DataFrame, least: float = LEAST, cell: int = CELL, part: int = PART) -> DataFrame:
    """vec_id, NODE, n_links and component_id of all rows (vec_id, embedding)."""
    spark = rows.sparkSession
    own = c.written(named(rows), "vectors")
    some = own.where(F.col(NODE).isNotNull())
    nodes = c.written(some.groupBy(NODE).agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("vec_id")), "nodes")
    found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    for size, in nodes.select(F.size("embedding")).distinct().collect():  # lengths of vectors: one, as a rule
        found = found.union(links(nodes.where(F.size("embedding") == size), size, least, cell, part))
    found = c.written(found, "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias(NODE)).agg(F.sum("n").alias("n_links"))
    labels = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", NODE)
    every = nodes.select(NODE, "vec_id").join(counts, NODE, "left").join(labels, NODE, "left")
    every = c.written(every.select(NODE, "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("label", NODE).alias("label")), "labelled")
    group = every.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    told = c.looked_up(every.drop("vec_id"), group, "label").select(NODE, "n_links", "component_id")
    out = c.looked_up(own.where(F.col(NODE).isNotNull()).select("vec_id", NODE), told, NODE).select("vec_id", NODE, "n_links", "component_id")
    alone = own.where(F.col(NODE).isNull()).select("vec_id", NODE, F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone)


def report(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, and kept: whether the row represents its component."""
    return linked(rows).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows that represent their components, with all columns."""
    keep = linked(rows, least).where(F.col("vec_id").eqNullSafe(F.col("component_id"))).select(F.col("vec_id").alias("factloom_id")).distinct()
    return rows.join(keep, F.col("vec_id").cast("long").eqNullSafe(F.col("factloom_id")), "left_semi")
