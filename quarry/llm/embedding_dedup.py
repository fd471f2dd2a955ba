"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors with equal labels and equal components form a class at once; one
member stands for it.  A label of more than ``SHARD`` representatives is cut
into cells by the closest of as many pivots as it has ``SHARD``s, and a dense
cell into parts by hash; every such shard builds a graph once, which is stored.
Each node gets a level drawn from its place, searches descend from the entry
node greedily and, on the level at hand, keep a beam of the best nodes; new
nodes are linked to neighbours picked so that each is closer to the node than
to the neighbours already picked.  Nodes are added in batches that search the
graph built so far, and searches of a batch run in step, so that NumPy does the
distance work.

A shard is queried by its own representatives, by those of other parts of its
cell, and by those of other cells that lie near enough to the plane between the
two pivots: of two linked vectors in different cells, one at least does.  A
brute-force audit over a stated sample of the vectors counts the links between
different representatives that a task should have found and did find.  Both are
pooled over all shards of a label, and labels whose recall is below ``AUDIT``
run again with a beam twice as wide, up to the shard's size, where the search
is exhaustive.  Without a sampled link the recall is 1.  The recall of each
round is logged.  A link needs a cosine of at least ``least`` in double
precision.  Tasks return, for each representative, the number of vectors linked
to it, and a spanning forest of the links' components, so no list of pairs
leaves a task.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null label, link with nothing.  Rows with the same id count as one
vertex; vectors of different length never link; rows with a null id are
returned, unlinked and kept; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import U64, cut, mix, read, release
from quarry.llm.components import connected_components

SHARD = 8192
M = 12  # links a node keeps on upper levels; twice as many on the lowest
BUILD_BEAM = 48
BEAM = 64
BLOCK = 4 * SHARD  # vectors searched in a shard by one task
OPEN = 8  # nodes of a beam opened in a step
SLACK = 1e-4  # of cosines in single precision
AUDIT = 0.995
AUDIT_QUERIES = 256


class Graph:
    """Navigable small-world graph over unit vectors; distance is 1 - cosine, in single precision while searching."""

    def __init__(self, x: np.ndarray, stored: bytes | None = None):
        self.x, self.y = x, x.astype(np.float32)
        n = len(x)
        draw = (mix(np.arange(n, dtype=U64)) >> U64(11)).astype(float) / 2.0 ** 53
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-300)) / np.log(M)).astype(int), 6)
        self.links = [np.full((n, 2 * M if not k else M), -1, np.int32) for k in range(int(self.level.max()) + 1 if n else 1)]
        order = np.argsort(-self.level, kind="stable")  # upper levels first
        self.entry, self.top = (int(order[0]), int(self.level[order[0]])) if n else (0, 0)
        if stored is None:
            self._build(order)
            return
        at = 0
        for k, links in enumerate(self.links):
            nodes = np.flatnonzero(self.level >= k)
            part = np.frombuffer(stored, np.int32, len(nodes) * links.shape[1], at)
            links[nodes], at = part.reshape(len(nodes), -1), at + part.nbytes

    def stored(self) -> bytes:
        """The links; of a level, those of the nodes that are on it."""
        return b"".join(links[self.level >= k].tobytes() for k, links in enumerate(self.links))

    def _build(self, order: np.ndarray) -> None:
        done, size = 1, 1
        while done < len(order):
            batch = order[done: done + size]
            batch = batch[self.level[batch] == self.level[batch[0]]]
            self._add(batch)
            done += len(batch)
            size = min(512, max(1, done // 2))

    def _add(self, batch: np.ndarray) -> None:
        level = int(self.level[batch[0]])
        at = np.full((len(batch), 1), self.entry)
        for k in range(self.top, -1, -1):
            ids, near = self._beam(self.y[batch], at, k, 1 if k > level else BUILD_BEAM)
            at = ids[:, : 1 if k > level else 4]
            if k <= level:
                self._connect(batch, ids, near, k)

    def _pick(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Neighbours of some nodes from candidates in order of closeness (-1: none): those closer to the node than to any
        picked before, then the closest left over."""
        some = ids >= 0
        v = self.y[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        blocked = np.full(ids.shape, -np.inf, np.float32)  # greatest cosine with one picked before
        picked, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for k in range(ids.shape[1]):
            ok = some[:, k] & (blocked[:, k] <= near[:, k]) & (count < most)
            picked[:, k] = ok
            count += ok
            r = np.flatnonzero(ok)
            blocked[r] = np.maximum(blocked[r], between[r, k])
        first = np.argsort(np.where(picked, 0, np.where(some, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.full((len(ids), most), -1, np.int32)
        out[:, : first.shape[1]] = np.take_along_axis(ids, first, 1)
        return out

    def _connect(self, batch: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> None:
        links, room = self.links[k], self.links[k].shape[1]
        within = self.y[batch] @ self.y[batch].T
        np.fill_diagonal(within, -np.inf)
        peers = np.argsort(-within, axis=1)[:, :M]
        cand = np.concatenate([ids, np.where(np.take_along_axis(within, peers, 1) > -np.inf, batch[peers], -1)], axis=1)
        sims = np.concatenate([near, np.take_along_axis(within, peers, 1)], axis=1)
        cand, sims = _sorted(np.where(cand == batch[:, None], -1, cand), sims, cand.shape[1])
        mine = self._pick(cand, sims, M)
        links[batch, :M] = mine
        # and back: the closest new ones of each node join its links, picked anew where there are too many
        r, c = np.nonzero(mine >= 0)
        other, node = mine[r, c], batch[r]
        fresh = ~(links[other] == node[:, None]).any(axis=1)
        other, node = other[fresh], node[fresh]
        s = np.einsum("kd,kd->k", self.y[other], self.y[node])
        o = np.lexsort((-s, other))
        other, node = other[o], node[o]
        first = np.flatnonzero(np.diff(other, prepend=-1))
        many = np.diff(np.append(first, len(other)))
        place = np.arange(len(other)) - np.repeat(first, many)
        group, nodes = np.repeat(np.arange(len(first)), many)[place < room], other[first]
        new = np.full((len(first), min(room, int(many.max(initial=0)))), -1)
        new[group, place[place < room]] = node[place < room]
        total = (links[nodes] >= 0).sum(axis=1) + (new >= 0).sum(axis=1)
        by = np.argsort(total)
        for a in range(0, len(by), 1024):
            g = by[a: a + 1024]
            cand = np.concatenate([links[nodes[g]], new[g]], axis=1)
            sims = np.einsum("gd,gcd->gc", self.y[nodes[g]], self.y[np.maximum(cand, 0)])
            cand, sims = _sorted(cand, sims, int(total[g].max()))
            links[nodes[g]] = -1
            if cand.shape[1] > room:
                cand = self._pick(cand, sims, room)
            links[nodes[g], : cand.shape[1]] = cand

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``width`` best nodes found for each query, best first; ``OPEN`` nodes are opened in a step."""
        n, size, links = len(q), len(self.x), self.links[k]
        w = min(width, start.shape[1])
        ids, sims = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32)
        ids[:, :w] = start[:, :w]
        sims[:, :w] = np.einsum("qd,qwd->qw", q, self.y[np.maximum(ids[:, :w], 0)])
        ids, sims = _sorted(ids, sims, width)
        opened = np.zeros((n, width), bool)
        seen, claim = np.zeros(n * size, bool), np.empty(n * size, np.int32)
        r, c = np.nonzero(ids >= 0)
        seen[r * size + ids[r, c]] = True
        active = np.arange(n)
        while True:
            open_ = ~opened[active] & (ids[active] >= 0)
            open_ &= np.cumsum(open_, axis=1) <= OPEN
            go = open_.any(axis=1)
            active, open_ = active[go], open_[go]
            if not len(active):
                return ids, sims
            r, c = np.nonzero(open_)
            opened[active[r], c] = True
            found = links[ids[active[r], c]]
            r, found = np.repeat(r, found.shape[1]), found.ravel()
            code = active[r] * size + found
            k = np.flatnonzero((found >= 0) & ~seen[np.maximum(code, 0)])
            claim[code[k]] = np.arange(len(k), dtype=np.int32)
            k = k[claim[code[k]] == np.arange(len(k))]  # a node found twice in this step counts once
            r, found = r[k], found[k]
            seen[code[k]] = True
            many = np.bincount(r, minlength=len(active))
            place = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            more = int(many.max(initial=0))
            all_ids = np.concatenate([ids[active], np.full((len(active), more), -1)], axis=1)
            all_sims = np.concatenate([sims[active], np.full((len(active), more), -np.inf, np.float32)], axis=1)
            all_open = np.concatenate([opened[active], np.zeros((len(active), more), bool)], axis=1)
            all_ids[r, width + place] = found
            all_sims[r, width + place] = np.einsum("kd,kd->k", q[active[r]], self.y[found])
            o = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[active], sims[active] = np.take_along_axis(all_ids, o, 1), np.take_along_axis(all_sims, o, 1)
            opened[active] = np.take_along_axis(all_open, o, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``width`` best nodes for each query (-1: none)."""
        at = np.full((len(q), 1), self.entry)
        for k in range(self.top, 0, -1):
            at = self._beam(q, at, k, 1)[0]
        return self._beam(q, at, 0, width)

    def around(self, q: np.ndarray, ids: np.ndarray, bound: float) -> np.ndarray:
        """Which nodes have a cosine of ``bound`` or more, for each query, among those linked to ``ids`` through such nodes."""
        out = np.zeros((len(q), len(self.x)), bool)
        seen, claim = np.zeros(out.size, bool), np.empty(out.size, np.int32)
        r, c = np.nonzero(ids >= 0)
        ahead = [(r, ids[r, c])]
        seen[r * len(self.x) + ids[r, c]] = True
        out[r, ids[r, c]] = True
        while ahead:
            r, nodes = ahead.pop()
            if len(r) > 1 << 15:
                ahead.append((r[1 << 15:], nodes[1 << 15:]))
                r, nodes = r[: 1 << 15], nodes[: 1 << 15]
            found = self.links[0][nodes]
            r, found = np.repeat(r, found.shape[1]), found.ravel()
            code = r * len(self.x) + found
            k = np.flatnonzero((found >= 0) & ~seen[np.maximum(code, 0)])
            claim[code[k]] = np.arange(len(k), dtype=np.int32)
            k = k[claim[code[k]] == np.arange(len(k))]
            r, found = r[k], found[k]
            seen[code[k]] = True
            near = np.einsum("kd,kd->k", q[r], self.y[found]) >= bound
            r, found = r[near], found[near]
            out[r, found] = True
            if len(r):
                ahead.append((r, found))
        return out


def _sorted(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` closest of each row, in order; places without a node (-1) last."""
    sims = np.where(ids >= 0, sims, np.float32(-np.inf))
    o = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)


def _links(graph: Graph, q: np.ndarray, least: float, width: int, own: bool = False) -> np.ndarray:
    """Which nodes have cosine >= least with each query (a matrix), among the ``width`` best nodes found and, where all of
    them are links, the nodes that more links lead to.  ``own``: the queries are the nodes; they are searched from themselves."""
    found = np.zeros((len(q), len(graph.x)), bool)
    if width >= len(graph.x):
        for a in range(0, len(q), 1024):
            found[a: a + 1024] = q[a: a + 1024] @ graph.x.T >= least
        return found
    single = q.astype(np.float32)
    for a in range(0, len(q), 512):
        part = single[a: a + 512]
        ids, sims = graph._beam(part, np.arange(a, a + len(part))[:, None], 0, width) if own else graph.search(part, width)
        maybe = (ids >= 0) & (sims >= least - SLACK)
        r, c = np.nonzero(maybe)
        found[a + r, ids[r, c]] = True
        full = np.flatnonzero(maybe.all(axis=1))
        for b in range(0, len(full), 128):
            some = full[b: b + 128]
            found[a + some] = graph.around(part[some], ids[some], least - SLACK)
    for a in range(0, len(q), 256):
        r, c = np.nonzero(found[a: a + 256])
        for b in range(0, len(r), 1 << 15):
            i, j = a + r[b: b + (1 << 15)], c[b: b + (1 << 15)]
            found[i, j] = np.einsum("kd,kd->k", q[i], graph.x[j]) >= least
    return found


def _audit(xa: np.ndarray, xb: np.ndarray, within: bool, pairs: np.ndarray, least: float) -> tuple[int, int]:
    """Links of a sample of both sides that are among ``pairs`` (row * len(xb) + column, or a matrix), and how many there are."""
    n, true = len(xb), []
    for side, x in ((0, xa), (1, xb))[: 1 if within else 2]:
        sample = np.unique(np.linspace(0, len(x) - 1, min(len(x), AUDIT_QUERIES)).astype(int))
        # a little above the bound, where the order of summation does not decide
        cosines = xa[sample] @ xb.T if side == 0 else xa @ xb[sample].T
        r, c = np.nonzero(cosines >= least + 1e-12)
        true.append(sample[r] * n + c if side == 0 else r * n + sample[c])
    codes = np.concatenate(true)
    if within:
        r, c = codes // n, codes % n
        codes = (np.minimum(r, c) * n + np.maximum(r, c))[r != c]
    codes = np.unique(codes)
    return int((pairs.ravel()[codes] if pairs.dtype == bool else np.isin(codes, pairs)).sum()), len(codes)


def _roots(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``parent`` (least known node of each node's component) after some links more."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _searched(key, shard: dict, queries: pa.Table, least: float, width: int) -> list[dict]:
    """What is found in a shard: matrices of links by rows (of the queries, or of the nodes themselves), and the audit."""
    n = len(shard["reps"]) // 8
    x = np.frombuffer(shard["x"], np.float64).reshape(n, -1)
    graph, out = Graph(x, shard["links"]), []
    if key["block"] == 0:
        found = _links(graph, x, least, width, own=True)
        found |= found.T.copy()
        np.fill_diagonal(found, False)
        audit = _audit(x, x, True, found, least)
        out.append({"found": np.triu(found), "from": 0, "audit": audit})
    node, cell = np.frombuffer(shard["probe_node"], np.int32), np.frombuffer(shard["probe_cell"], np.int32)
    for a in range(0, queries.num_rows, SHARD):
        some = queries.slice(a, SHARD)
        q, homes = _matrix(some["unit"]), some["home"].to_numpy()
        found = _links(graph, q, least, width)
        audit = _audit(q, x, False, found, least)
        # pairs whose nodes ask for each other's cell are counted where the query comes from the lower one
        for h in np.unique(homes[homes > key["cell"]]):
            found[np.ix_(homes == h, np.isin(np.arange(n), node[cell == h]))] = False
        out.append({"found": found, "from": n + a, "audit": audit})
    return out


def _pair_task(least: float, width: int):
    """Links within a shard and to the vectors searched in it: counts per representative, a spanning forest and the audit."""
    def run(key, shards, queries):
        key = dict(zip(("label", "size", "cell", "part", "block"), (x.as_py() for x in key)))
        shard = shards.to_pylist()[0]
        nodes, of = (np.concatenate([np.frombuffer(shard[c], np.int64), queries[d].to_numpy()]) for c, d in (("reps", "rep"), ("copies", "copies")))
        extra, parent, hits, truth = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), 0, 0
        for part in _searched(key, shard, queries, least, width):
            hits, truth = hits + part["audit"][0], truth + part["audit"][1]
            for a in range(0, len(part["found"]), 256):
                p, c = np.nonzero(part["found"][a: a + 256])
                p += a + part["from"]
                extra += np.bincount(p, weights=of[c], minlength=len(nodes)).astype(np.int64) + np.bincount(c, weights=of[p], minlength=len(nodes)).astype(np.int64)
                parent = _roots(parent, p, c)
        some, tree = np.flatnonzero(extra), np.flatnonzero(parent != np.arange(len(nodes)))
        k, f = len(some), len(tree)
        columns = {"rep": [*nodes[some].tolist(), *[None] * (f + 1)], "linked": [*extra[some].tolist(), *[None] * (f + 1)],
                   "u": [*[None] * k, *nodes[tree].tolist(), None], "v": [*[None] * k, *nodes[parent[tree]].tolist(), None]}
        for c, value in (("hits", hits), ("truth", truth), ("nodes", len(shard["reps"]) // 8)):
            columns[c] = [*[None] * (k + f), value]
        rows = k + f + 1
        return pa.table({"label": pa.array([key["label"]] * rows, pa.string()), "size": pa.array([key["size"]] * rows, pa.int32()),
                         **{c: pa.array(x, pa.int64()) for c, x in columns.items()}})
    return run


def _found(shards: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """Rows of ``_pair_task`` for all shards, each label with the first beam whose pooled recall is enough."""
    width, whole, keys = BEAM, None, ["label", "size", "cell", "part", "block"]
    while True:
        found = cut(shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
            _pair_task(least, width), "label string, size int, rep long, linked long, u long, v long, hits long, truth long, nodes long"))
        audit = cut(found.where("truth is not null").groupBy("label", "size")
                    .agg(F.sum("hits").alias("hits"), F.sum("truth").alias("truth"), F.max("nodes").alias("nodes"))
                    .withColumn("recall", F.when(F.col("truth") > 0, F.col("hits") / F.col("truth")).otherwise(1.0)))
        bad = audit.where((F.col("recall") < AUDIT) & (F.col("nodes") > width)).select("label", "size")
        t = audit.agg(F.sum("hits").alias("hits"), F.sum("truth").alias("truth"), F.min("recall").alias("least")).first()
        again = bad.count()
        logging.getLogger(__name__).info("beam %d: %s of %s sampled links found, least recall of a label %s, %d labels again",
                                         width, t["hits"], t["truth"], t["least"], again)
        good = found.join(bad, ["label", "size"], "left_anti") if again else found
        whole = good if whole is None else whole.unionByName(good)
        if not again:
            return whole
        shards, asked, width = shards.join(bad, ["label", "size"], "left_semi"), asked.join(bad, ["label", "size"], "left_semi"), 2 * width


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _homes(pivots, least: float):
    """The cell of each vector, that of the closest pivot of its label, and the other cells it must be searched in.

    Of two vectors on different sides of the plane between two pivots, one is
    no farther from it than half their distance.  So it is enough that a vector
    is searched in the cells whose plane with its own is that near.
    """
    half = (2 - 2 * least) ** 0.5 / 2 + 1e-9 if least < 1 else 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size = batch.column("label").to_pylist(), batch.column("size").to_pylist()
            home, probes = np.zeros(len(label), np.int32), [[]] * len(label)
            places: dict = {}
            for i, key in enumerate(zip(label, size)):
                if key in pivots.value:
                    places.setdefault(key, []).append(i)
            for key, at in places.items():
                points = pivots.value[key]
                apart = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))
                for a in range(0, len(at), 1024):
                    some = at[a: a + 1024]
                    near = _matrix(batch.column("unit").take(pa.array(some))) @ points.T
                    own = near.argmax(axis=1)
                    ask = near[np.arange(len(some)), own][:, None] - near <= half * apart[own] + 1e-9
                    ask[np.arange(len(some)), own] = False
                    home[some] = own
                    for i, x in zip(some, ask):
                        probes[i] = np.flatnonzero(x).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(probes, pa.list_(pa.int32()))], [*batch.schema.names, "home", "probes"])
    return run


def _shard_rows(table):
    """One row of packed arrays for a shard, with its graph."""
    x = _matrix(table["unit"])
    probes = table["probes"].to_pylist()
    node = np.repeat(np.arange(len(probes), dtype=np.int32), [len(p) for p in probes])
    cell = np.array([c for p in probes for c in p], np.int32)
    return pa.table({**{c: table[c].slice(0, 1) for c in ("label", "size", "cell", "part")}, 
                     **{c: pa.array([v], pa.binary()) for c, v in (("reps", table["rep"].to_numpy().astype(np.int64).tobytes()), ("copies", table["copies"].to_numpy().astype(np.int64).tobytes()), ("x", x.tobytes()), ("links", Graph(x).stored()), ("probe_node", node.tobytes()), ("probe_cell", cell.tobytes()))}})


_SHARD = "label string, size int, cell int, part int, reps binary, copies binary, x binary, links binary, probe_node binary, probe_cell binary"


def _shards(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The shards, and the vectors of other shards to be searched in each; both by block of such vectors."""
    spark, key = classes.sparkSession, ["label", "size"]
    rows = classes.select("label", F.size("unit").alias("size"), "rep", "copies", "unit")
    sized = (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("cells")).where("cells > 1"))
    drawn = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 40))
    few = rows.join(F.broadcast(sized), key).where(drawn < (2 * F.col("cells") + 20) * F.lit(float(1 << 40)) / F.col("n"))
    chosen = (few.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("rep", F.lit(4)), "rep")))
              .where("k <= cells").select(*key, "unit").collect())  # a vector for each SHARD
    points: dict = {}
    for r in chosen:
        points.setdefault((r["label"], r["size"]), []).append(r["unit"])
    pivots = spark.sparkContext.broadcast({k: np.array(v) for k, v in points.items()})
    rows = rows.mapInArrow(_homes(pivots, least), "label string, size int, rep long, copies long, unit array<double>, home int, probes array<int>")
    parts = cut(rows.groupBy(*key, F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts")))  # dense cells are cut by hash
    rows = (rows.withColumn("cell", F.col("home")).join(F.broadcast(parts), [*key, "cell"])
            .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts"))
    shards = cut(rows.groupBy(*key, "cell", "part").applyInArrow(_shard_rows, _SHARD))
    asked = (rows.withColumn("cell", F.explode(F.concat(F.array("home"), "probes"))).join(F.broadcast(parts), [*key, "cell"])
             .withColumn("of", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .where("cell <> home or part > of").select(*key, "cell", "part", "rep", "copies", "unit", "home"))
    if not points:
        return shards.withColumn("block", F.lit(0)), asked.where(F.lit(False)).withColumn("block", F.lit(0))
    release(spark)
    blocks = cut(asked.groupBy(*key, "cell", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    shards = (shards.join(F.broadcast(blocks), [*key, "cell", "part"], "left")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks"))
    return shards, (asked.join(F.broadcast(blocks), [*key, "cell", "part"])
                    .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")).drop("blocks"))


def embedding_duplicates(vectors: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding",
                         label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"),
                       F.col(vector_column).cast("array<double>").alias("x"))
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  the value is computed once a vector, not once a component
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    fine = (F.col("x").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
            & F.coalesce(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists("x", lambda e: e != 0), F.lit(False)))
    # divided by the largest component: squares stay finite, and equal vectors stay equal
    scaled = once(F.array_max(F.transform("x", lambda y: F.abs(y))), lambda top: F.transform("x", lambda e: (e + 0.0) / top))
    v = v.withColumn("x", F.when(fine, scaled)).withColumn("key", F.when(fine, F.xxhash64("label", "x"))).withColumn("key2", F.when(fine, F.xxhash64("x", "label", F.lit(7))))
    classes = cut(v.where("key is not null").groupBy("label", "key", "key2")
                  .agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("x").alias("x"))
                  .withColumn("unit", once(norm, lambda n: F.transform("x", lambda e: e / n))).drop("x"))
    found = _found(*_shards(classes, least), least)
    linked = found.where("rep is not null").groupBy("rep").agg(F.sum("linked").alias("linked"))
    comps = connected_components(found.where("u is not null").select("u", "v"))
    by_class = cut(classes.select("label", "key", "key2", "rep", "copies").join(linked, "rep", "left")
                   .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
                   .select("key", "key2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")))
    out = v.select("vec_id", "key", "key2").join(by_class, ["key", "key2"], "left")
    out = out.withColumn("component_id", F.coalesce("c", "vec_id"))
    return out.select(F.col("vec_id").alias(id_column), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(read(spark, sf_dir, "embeddings"))
