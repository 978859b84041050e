"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards.

Equal vectors are collapsed first. Centroids are fitted on a bounded sample (``sample_rows``), and vectors are dealt to
regions: a row goes to its own and to every region before it whose border is nearer than a margin, so that the two
ends of a link meet in the first of their own regions. Centroids nearer than a spacing are thinned to one, so that a
group of near copies is not cut up, and of some spacings the one is taken at which the sample has the fewest searches.
A region's graph holds its own rows; those that come from other regions are searched for in it, and not compared with each other, as each
pair has an end that is at home where it meets. Regions with more than ``block`` rows of their own have a graph for each block, which the rows
of later blocks come to, and rows come to a graph in parts of ``PARTS`` blocks, so that a group that holds a third of all rows never
meets in one task.

Within a block rows are shared out to shards, each to its ``OVERLAP`` nearest of them. A shard's graph starts at random
and grows by search and prune: every node is searched for from medoids over the graph so far, what the search met
is thinned by robust pruning to the node's new edges, and edges are made mutual. The adjacency lists of all shards are
united to one flat graph, over which each vector is searched for from the medoids nearest to it and its own node: a
greedy beam first, then the range expands through every node within the threshold until none is new. Each region audits itself: exact
neighbours of some nodes are compared with what was found, and the graph is grown again by a longer search while
its recall is short of ``RECALL``; every link is verified by the cosine in double precision. A region whose audit
promises more than ``DENSE_PAIRS`` links is compared exhaustively, row by row, and its pairs are never held at once.

The margin is a part of the chord of the threshold: the ends of a link part by that chord at most, and of it, in any
one direction, by about its share 1/sqrt(dimension); the margin is ``SPREAD`` times that. The result is then audited as a
whole: the exact links of ``audit_rows`` rows against all rows, in blocks, beside those found; while the recall is short
of ``RECALL``, margins are doubled and the search is done again, at last with the whole chord, which no link can exceed.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components link with nothing;
vectors of different length are never compared; rows that share an id but not a vector are vectors of their own; a
component bears the smallest id that is not null of its rows; repeated rows count as copies of each other; an empty
table gives an empty result; labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import table
from tidewire.llm.graph import components

THRESHOLD = 0.95
SAMPLE_ROWS = 20_000
CELL_ROWS = 4000
BLOCK = 8000
#: Rows that come to a graph at once, in blocks, and what a row costs to build in, in searches.
PARTS, BUILD = 4, 4.0
SHARD_ROWS, OVERLAP = 1000, 2
#: Centroids are thinned to spacings of these multiples of the reach of a link.
SPACINGS = (1.0, 1.5, 2.0, 3.0)
DENSE_PAIRS = 2_000_000
DEGREE, POOL, ALPHA, PASSES = 16, 32, 1.2, 2
BEAM, HOPS = 12, 8
#: Rows for each medoid, and the medoids that a search enters at.
MEDOID_ROWS, ENTRIES = 48, 3
RECALL = 0.98
#: Standard deviations of a link's part along one direction that the margin covers at first.
SPREAD = 3.0
#: Rows whose exact links the whole result is audited by.
AUDIT_ROWS = 1000
_SLACK = 1e-4


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, h1, h2, v): v the vector in doubles, scaled to length 1; null where it links with nothing."""
    from tidewire.llm._text import span_hashes

    for batch in batches:
        column = batch.column("v")
        n = len(column)
        flat = column.flatten()
        holes = np.asarray(flat.is_null())
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        usable = np.zeros(n, dtype=bool)
        blobs: list = [None] * n
        some = np.flatnonzero(sizes > 0)
        if len(some):
            at = first[some]
            with np.errstate(invalid="ignore", over="ignore"):
                top = np.maximum.reduceat(np.abs(values), at)
                whole = np.isfinite(top) & (top > 0) & (np.add.reduceat(holes.astype(np.int64), at) == 0)
                scaled = values / np.repeat(np.where(whole, top, 1.0), sizes[some])
                unit = scaled / np.repeat(np.sqrt(np.where(whole, np.add.reduceat(scaled * scaled, at), 1.0)), sizes[some]) + 0.0
            usable[some[whole]] = True
            for i in some[whole]:
                blobs[i] = unit[first[i] : first[i + 1]].tobytes()
        dims = np.where(usable, sizes, 0)
        ends = np.cumsum(dims * 8)
        starts = ends - dims * 8
        joined = np.frombuffer(b"".join(b for b in blobs if b), dtype=np.uint8)
        h1 = span_hashes(joined, starts, ends)
        h2 = span_hashes(joined ^ np.uint8(0x5A), starts, ends) if len(joined) else h1
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dims), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(blobs, pa.binary())], ["id", "dim", "h1", "h2", "v"])


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means of a sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = max(1, min(k, len(x)))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


def _reach(threshold: float) -> float:
    """The chord between unit vectors at the threshold, and a little for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9


def _cells_of(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each row, and (rows x cells) its own cell and those before it whose border is within reach."""
    norms = (c * c).sum(axis=1)
    d = norms - 2 * x @ c.T
    home = np.argmin(d, axis=1)
    gap = np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * c @ c.T, 0))
    excess = d - d[np.arange(len(x)), home][:, None]
    near = (excess <= 2 * reach * gap[home] + 1e-9) & (np.arange(len(c)) <= home[:, None])
    near[np.arange(len(x)), home] = True
    return home, near


def _thin(c: np.ndarray, weight: np.ndarray, spacing: float) -> np.ndarray:
    """Centroids further apart than the spacing, heaviest first."""
    kept: list[int] = []
    for k in np.argsort(-weight, kind="stable"):
        if not kept or (((c[kept] - c[k]) ** 2).sum(axis=1) > spacing * spacing).all():
            kept.append(int(k))
    return c[kept]


def choose_cells(x: np.ndarray, c: np.ndarray, n: int, reach: float, block: int) -> np.ndarray:
    """Of the centroids thinned to some spacings, and of one alone, those by which the n rows that ``x`` is a sample of are searched for least."""
    weight = np.bincount(_cells_of(x, c, 0.0)[0], minlength=len(c))
    options = [_thin(c, weight, k * reach) for k in SPACINGS] + [x.mean(axis=0)[None]]
    probe = x[:4000]

    def searches(cells: np.ndarray) -> float:
        home, near = _cells_of(probe, cells, reach)
        placed, own = near.sum(axis=0) * (n / len(probe)), np.bincount(home, minlength=len(cells)) * (n / len(probe))
        blocks, parts = np.maximum(1, np.ceil(own / block)), np.maximum(1, np.ceil(placed / (PARTS * block)))
        return float((own * (1 + BUILD * parts + (blocks - 1) / 2) + (placed - own) * blocks).sum())

    return min(options, key=searches)


def _route(centroids: dict[int, np.ndarray], reach: dict[int, float]):
    """Rows to their own cell and to the cells before it whose border is within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, blobs = batch.column("id").to_numpy(), batch.column("copies").to_numpy(), batch.column("v").to_pylist()
            dims = np.array([len(b) // 8 for b in blobs])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                c = centroids[int(dim)]
                for part in np.array_split(rows, max(1, len(rows) * len(c) // 2_000_000)):
                    x = np.frombuffer(b"".join(blobs[i] for i in part), dtype=np.float64).reshape(len(part), dim)
                    home, near = _cells_of(x, c, reach[int(dim)])
                    every, cells = np.nonzero(near)
                    for a in range(0, len(every), 20_000):
                        r, cell = every[a : a + 20_000], cells[a : a + 20_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[part][r]), pa.array(copies[part][r]), pa.array(np.full(len(r), dim)), pa.array(cell), pa.array(home[r]), pa.array([blobs[part[k]] for k in r], pa.binary())],
                            ["id", "copies", "dim", "cell", "home", "v"],
                        )

    return run


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, keep: int, alpha: float = ALPHA) -> np.ndarray:
    """For each node, at most ``keep`` of its pool (nearest first): a candidate goes when a kept one is nearer to it by ``alpha``. -1 where none is left."""
    out = np.full((len(nodes), keep), -1, dtype=np.int64)
    near = x[pool]
    to = 1 - np.matmul(near, x[nodes][:, :, None])[:, :, 0]
    between = 1 - np.matmul(near, near.transpose(0, 2, 1))
    alive = pool != nodes[:, None]
    rows = np.arange(len(nodes))
    for j in range(keep):
        cost = np.where(alive, to, np.inf)
        pick = np.argmin(cost, axis=1)
        some = np.isfinite(cost[rows, pick])
        if not some.any():
            break
        out[some, j] = pool[rows, pick][some]
        gone = alpha * between[rows, pick] <= to
        alive &= ~((gone | (pool == pool[rows, pick][:, None])) & some[:, None])
    return out


def _beam(x: np.ndarray, graph: np.ndarray, y: np.ndarray, entry: np.ndarray, beam: int, hops: int, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Greedy search for the vectors ``y`` from their entries (a row each): after every hop, the best nodes so far and their similarities."""
    rows = np.arange(len(y))
    ids = entry
    sims = np.matmul(x[entry], y[:, :, None])[:, :, 0]
    seen[rows[:, None], entry] = True
    opened = np.zeros(ids.shape, dtype=bool)
    yield ids, sims
    for _ in range(hops):
        pick = np.argmax(np.where(opened, -3, sims), axis=1)
        opened[rows, pick] = True
        cand = graph[ids[rows, pick]]
        cand_sims = np.matmul(x[cand], y[:, :, None])[:, :, 0]
        cand_sims[seen[rows[:, None], cand]] = -2
        seen[rows[:, None], cand] = True
        yield cand, cand_sims
        ids, sims, opened = np.concatenate([ids, cand], axis=1), np.concatenate([sims, cand_sims], axis=1), np.concatenate([opened, cand_sims <= -2], axis=1)
        if ids.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, opened = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), np.take_along_axis(opened, top, 1)
    yield ids, np.where(sims <= -2, -2, sims)


def _medoids(x: np.ndarray, rows_of_each: int = MEDOID_ROWS) -> np.ndarray:
    """Rows nearest to the centres of small clusters, where searches enter."""
    c = fit_centroids(x, max(1, len(x) // rows_of_each), rounds=2)
    return np.unique(np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=0))


def _entries(x: np.ndarray, y: np.ndarray, medoids: np.ndarray) -> np.ndarray:
    """For each of the vectors ``y`` the medoids nearest to it."""
    s = y @ x[medoids].T
    return medoids[np.argpartition(-s, ENTRIES - 1, axis=1)[:, :ENTRIES]] if len(medoids) > ENTRIES else np.repeat(medoids[None], len(y), axis=0)


def grow_graph(x: np.ndarray, hops: int = HOPS, pool: int = POOL, degree: int = DEGREE, passes: int = PASSES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists (padded with the node itself) and the medoids of unit vectors, by search and prune from a random graph."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    medoids = _medoids(x)
    own = np.arange(n)[:, None]
    out = np.repeat(own, 2 * degree, axis=1)
    if n < 2:
        return out, medoids
    out[:, :degree] = rng.integers(0, n, (n, degree))
    for _ in range(passes):
        picked = np.empty((n, degree), dtype=np.int64)
        for a in range(0, n, 256):
            nodes = np.arange(a, min(n, a + 256))
            seen = np.zeros((len(nodes), n), dtype=bool)
            seen[np.arange(len(nodes)), nodes] = True
            for found, sims in _beam(x, out, x[nodes], _entries(x, x[nodes], medoids), pool, hops, seen):  # noqa: B007
                pass
            met = np.where(sims > -2, found, nodes[:, None])
            picked[nodes] = robust_prune(x, nodes, np.concatenate([met, out[nodes, :degree]], axis=1), degree)
        src, slot = np.nonzero(picked >= 0)
        dst = picked[src, slot]
        out = np.repeat(own, 2 * degree, axis=1)
        out[:, :degree] = np.where(picked >= 0, picked, own)
        # Mutual edges, nearest first, as many as there is room for.
        order = np.lexsort((-np.einsum("ed,ed->e", x[src], x[dst]), dst))
        src, dst = src[order], dst[order]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        ok = rank < degree
        out[dst[ok], degree + rank[ok]] = src[ok]
    return out, medoids


def build_graph(x: np.ndarray, hops: int = HOPS, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """The united adjacency lists of overlapping shards, and the medoids of all."""
    n = len(x)
    k = -(-n // shard_rows)
    overlap = min(overlap, k)
    c = fit_centroids(x[:: max(1, n // (32 * k))], k, rounds=4) if k > 1 else x[:1]
    near = np.argsort((c * c).sum(axis=1) - 2 * x @ c.T, axis=1, kind="stable")[:, :overlap]
    graph = np.repeat(np.arange(n)[:, None], 2 * DEGREE * overlap, axis=1)
    medoids = []
    for shard in range(len(c)):
        rows, place = np.nonzero(near == shard)
        if len(rows):
            lists, inner = grow_graph(np.ascontiguousarray(x[rows]), hops)
            graph[rows[:, None], 2 * DEGREE * place[:, None] + np.arange(2 * DEGREE)] = rows[lists]
            medoids.append(rows[inner])
    return graph, np.unique(np.concatenate(medoids))


def range_search(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, hops: int = HOPS, vectors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query position, node) within ``least``: greedy beam from the medoids and the query's own node, then expansion of the range.

    With ``vectors``, queries are rows of these, which are no nodes of the graph.
    """
    n = len(x)
    found_q, found_v = [], []
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        y = (x if vectors is None else vectors)[q]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        entry, own = _entries(x, y, medoids), np.zeros(0, dtype=np.int64)
        if vectors is None:
            entry, own = np.concatenate([entry, q[:, None]], axis=1), rows * n + q
        met = [own]
        for ids, sims in _beam(x, graph, y, entry, beam, hops, seen):
            r, k = np.nonzero(sims >= least)
            met.append(r * n + ids[r, k])
        fresh = np.unique(np.concatenate(met))
        inside = [fresh]
        while len(fresh):
            new = []
            for b in range(0, len(fresh), 8192):
                r, v = fresh[b : b + 8192] // n, fresh[b : b + 8192] % n
                key = (r[:, None] * n + graph[v]).ravel()
                key = np.unique(key[~seen.ravel()[key]])
                seen.ravel()[key] = True
                rr, cc = key // n, key % n
                new.append(key[np.einsum("ed,ed->e", y[rr], x[cc]) >= least])
            fresh = np.concatenate(new)
            inside.append(fresh)
        key = np.concatenate(inside)
        if vectors is None:
            key = key[key % n != q[key // n]]
        found_q.append(key // n + a)
        found_v.append(key % n)
    return (np.concatenate(found_q), np.concatenate(found_v)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def region_links(v: np.ndarray, threshold: float, recall: float = RECALL, audit: int = 64, heads: int | None = None, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All found pairs (i, j), both ways, with cosine in double precision at or above the threshold.

    With ``heads``, the graph is made of that many first rows, and the others are searched for in it, but not among each
    other; ``within``: whether the heads are searched for as well.
    """
    n = len(v)
    heads = n if heads is None else heads
    first = 0 if within else heads
    if n < 2 or not heads or first == n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = v.astype(np.float32)
    test = np.unique(np.linspace(first, n - 1, min(n - first, audit)).astype(np.int64))
    exact = v[test] @ v[:heads].T >= threshold
    inner = np.flatnonzero(test < heads)
    exact[inner, test[inner]] = False
    hops = HOPS
    while True:
        graph, medoids = build_graph(x[:heads], hops)
        keys = []
        if within:
            i, j = range_search(x[:heads], graph, medoids, np.arange(heads), threshold - _SLACK, hops=hops)
            keys.append(i * n + j)
        if heads < n:
            i, j = range_search(x[:heads], graph, medoids, np.arange(n - heads), threshold - _SLACK, hops=hops, vectors=x[heads:])
            keys.append((i + heads) * n + j)
        one = np.concatenate(keys)
        one = np.unique(np.concatenate([one, one % n * n + one // n]))
        keep = np.concatenate([np.einsum("ed,ed->e", v[part // n], v[part % n]) >= threshold for part in np.array_split(one, len(one) // 200_000 + 1)])
        one = one[keep]
        i, j = one // n, one % n
        got = np.zeros_like(exact)
        place = np.full(n, -1)
        place[test] = np.arange(len(test))
        hit = (place[i] >= 0) & (j < heads)
        got[place[i[hit]], j[hit]] = True
        if not exact.any() or (got & exact).sum() >= recall * exact.sum():
            return i, j
        hops *= 2
        if hops * DEGREE >= SHARD_ROWS:  # a search as wide as its shard: compare all
            pairs = [np.nonzero(v[a : a + 256] @ v[:heads].T >= threshold) for a in range(first, n, 256)]
            i, j = np.concatenate([p[0] + 256 * k + first for k, p in enumerate(pairs)]), np.concatenate([p[1] for p in pairs])
            one = np.unique(np.concatenate([i * n + j, j * n + i])[np.tile(i != j, 2)])
            return one // n, one % n


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _dense(v: np.ndarray, threshold: float, audit: int = 64, heads: int | None = None) -> bool:
    """Whether the rows have so many links with the first ``heads`` that comparing all is cheaper than expanding ranges."""
    n = len(v)
    test = np.unique(np.linspace(0, n - 1, min(n, audit)).astype(np.int64))
    return n * ((v[test] @ v[:heads].T >= threshold).sum() / len(test) - 1) > DENSE_PAIRS


def exact_links(v: np.ndarray, threshold: float, counted, copies: np.ndarray, rows: int = 256, heads: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The copies that each row links with in counted pairs, and the smallest position reachable from it, by comparing all.

    With ``heads``, that many first rows are compared with all, and the others not among each other.
    """
    n = len(v)
    heads = n if heads is None else heads
    links, root = np.zeros(n), np.arange(n)
    weight = copies.astype(np.float64)
    for a in range(0, heads, rows):
        i = np.arange(a, min(heads, a + rows))
        s = v[i] @ v.T >= threshold
        s[np.arange(len(i)), i] = False
        valid = s & counted(i[:, None], np.arange(n)[None])
        links[i] = valid @ weight
        links[heads:] += weight[i] @ valid[:, heads:]
        while True:
            apart = s & (root[i][:, None] != root[None])
            some = np.flatnonzero(apart.any(axis=1))
            if not len(some):
                break
            p, q = root[i[some]], root[apart[some].argmax(axis=1)]
            root = _forest(n, np.concatenate([p, q]), np.concatenate([q, p]))[root]
    return links, root


def _search_group(threshold: float):
    """Links of a block of a region's own rows (side 0) with each other, in its first part, and with the rows that come to it (side 1)."""

    def run(group: pa.Table) -> pa.Table:
        ids, copies, side = (group.column(c).to_numpy() for c in ("id", "copies", "side"))
        part, dim = (group.column(c)[0].as_py() for c in ("part", "dim"))
        v = np.frombuffer(b"".join(group.column("v").to_pylist()), dtype=np.float64).reshape(-1, dim)
        order = np.lexsort((ids, side))
        ids, copies, side, v = ids[order], copies[order], side[order], v[order]
        heads, within = int((side == 0).sum()), part == 0
        if _dense(v, threshold, heads=heads):
            links, root = exact_links(v, threshold, lambda i, j: (side[i] != side[j]) | within, copies, heads=heads)
        else:
            i, j = region_links(v, threshold, heads=heads, within=within)
            root = _forest(len(ids), i, j)
            links = np.bincount(i, weights=copies[j], minlength=len(ids))
        links = links.astype(np.int64)
        some = (links > 0) | (root != np.arange(len(ids)))
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(ids[root[some]])})

    return run


def _find(reps: DataFrame, sizes: dict[int, int], sample_rows: int, cell_rows: int, block: int, threshold: float, spread: float) -> DataFrame:
    """(id, links, root): for each row of a region, the copies it links with there, and the smallest row it reaches there."""
    centroids, margins = {}, {}
    for dim, n in sizes.items():
        rows = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column("v").to_pylist()
        x = np.frombuffer(b"".join(rows), dtype=np.float64).reshape(-1, dim)
        margins[dim] = _reach(threshold) * min(1.0, spread / dim**0.5)
        centroids[dim] = choose_cells(x, fit_centroids(x, min(n // cell_rows, len(x) // 8)), n, margins[dim], block)
    routed = table(reps.select("id", "copies", "v").mapInArrow(_route(centroids, margins), "id bigint, copies bigint, dim bigint, cell bigint, home bigint, v binary"), "routed")
    # As many rows as there are cells, which the sample bounds.
    own = F.col("home") == F.col("cell")
    counts = routed.groupBy("dim", "cell").agg(F.ceil(F.greatest(F.lit(1), F.count(F.when(own, 1))) / block).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / (PARTS * block)).cast("int").alias("parts"))
    counts = table(counts, "cell-blocks")
    dealt = routed.join(F.broadcast(counts), ["dim", "cell"]).withColumns({"block": F.when(own, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(F.col("blocks")), "mine": F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")})
    # A row belongs to the graph of its block, in all parts, and comes to each block before it (a visitor to all) in one part.
    place = lambda a, part, side: F.struct(a.alias("a"), part.alias("part"), F.lit(side).alias("side"))
    member = F.when(own, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: place(F.col("block"), k, 0))).otherwise(F.array().cast("array<struct<a:int,part:int,side:int>>"))
    comes = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k < F.col("block")), lambda k: place(k, F.col("mine"), 1))
    paired = dealt.select("id", "copies", "dim", "cell", "v", F.inline(F.concat(member, comes)))
    return table(paired.groupBy("dim", "cell", "a", "part").applyInArrow(_search_group(threshold), "id bigint, links bigint, root bigint"), "vector-links")


def _recall(reps: DataFrame, found: DataFrame, threshold: float, rows: int, blocks: int = 16) -> float:
    """Of the exact links of ``rows`` rows with all rows, the share that was found."""
    asked = reps.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(rows).select("id", "dim", "v", "copies")
    asked = table(asked, "audit-rows", rows=rows)
    data = asked.toArrow()  # at most `rows` vectors
    ids, dims, blobs = data.column("id").to_numpy(), data.column("dim").to_numpy(), data.column("v").to_pylist()
    by_dim = {int(d): (ids[dims == d], np.frombuffer(b"".join(b for b, e in zip(blobs, dims, strict=True) if e == d), dtype=np.float64).reshape(-1, int(d))) for d in np.unique(dims)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(i), dtype=np.int64) for d, (i, _) in by_dim.items()}
        for batch in batches:
            dim, who, copies, v = batch.column("dim").to_numpy(), batch.column("id").to_numpy(), batch.column("copies").to_numpy(), batch.column("v").to_pylist()
            for d, (own, x) in by_dim.items():
                at = np.flatnonzero(dim == d)
                for part in np.array_split(at, len(at) // 4000 + 1):
                    y = np.frombuffer(b"".join(v[k] for k in part), dtype=np.float64).reshape(-1, d)
                    total[d] += ((x @ y.T >= threshold) & (own[:, None] != who[part][None])) @ copies[part]
        for d, (own, _) in by_dim.items():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[d])], ["id", "n"])

    exact = reps.select("id", "dim", "copies", "v").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("exact"))
    got = found.groupBy("id").agg(F.sum("links").alias("links"))
    sums = exact.join(got, "id", "left").agg(F.sum("exact").alias("exact"), F.sum(F.least("exact", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return 1.0 if not sums["exact"] else sums["found"] / sums["exact"]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, block: int = BLOCK, spread: float = SPREAD, audit_rows: int = AUDIT_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Inside, a vector is its row, not its id."""
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ready = plain.mapInArrow(_usable, "id bigint, dim bigint, h1 bigint, h2 bigint, v binary")
    ready = table(ready.withColumn("key", F.monotonically_increasing_id()), "vectors")
    groups = table(ready.where("v is not null").groupBy("dim", "h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "equal-vectors")
    members = table(ready.select("id", "dim", "h1", "h2").join(groups, ["dim", "h1", "h2"], "left").select("id", "rep", "copies"), "vector-members")
    first = ready.where("v is not null").select(F.col("key").alias("id"), "dim", "v")
    reps = table(first.join(groups.select(F.col("rep").alias("id"), "copies"), "id"), "vector-representatives")

    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()}
    while True:
        found = _find(reps, sizes, sample_rows, cell_rows, block, threshold, spread)
        # With the whole chord as margin no link is out of reach.
        if not sizes or spread >= max(sizes) ** 0.5 or _recall(reps, found, threshold, audit_rows) >= RECALL:
            break
        spread *= 2
    roots = table(components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))), "vector-roots")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_rep = table(links.withColumnRenamed("id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "full"), "vector-results")
    placed = table(members.join(per_rep, "rep", "left").withColumn("part", F.coalesce("root", "rep")), "vectors-placed")
    smallest = table(placed.where("part is not null").groupBy("part").agg(F.min("id").alias("least")), "vector-components")
    component = F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("least"))
    return placed.join(smallest, "part", "left").select(
        F.col("id").alias("vec_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def audit(vectors: DataFrame, links: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 50, threshold: float = THRESHOLD, block: int = 512) -> DataFrame:
    """Exact link counts of the rows whose id is divisible by ``every``, in blocks against all rows, beside those found: vec_id, exact, found."""
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ready = table(plain.mapInArrow(_usable, "id bigint, dim bigint, h1 bigint, h2 bigint, v binary").where("v is not null"), "audit-vectors")
    asked = ready.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    facing = ready.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64)))

    def count(key, a: pa.Table, b: pa.Table) -> pa.Table:
        dims = a.column("dim").to_numpy() if len(a) else np.zeros(0, dtype=np.int64)
        ids, n = [], []
        for dim in np.unique(dims):
            x = np.frombuffer(b"".join(v for v, d in zip(a.column("v").to_pylist(), dims, strict=True) if d == dim), dtype=np.float64).reshape(-1, dim)
            y = [v for v, d in zip(b.column("v").to_pylist(), b.column("dim").to_pylist(), strict=True) if d == dim]
            y = np.frombuffer(b"".join(y), dtype=np.float64).reshape(-1, dim)
            ids += [i for i, d in zip(a.column("id").to_pylist(), dims, strict=True) if d == dim]
            n += (x @ y.T >= threshold).sum(axis=1).tolist() if len(y) else [0] * len(x)
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("part", F.col("part").cast("bigint"))
    counted = asked.withColumn("block", F.col("block").cast("bigint")).groupBy("block", "part").cogroup(facing.withColumn("block", F.col("block").cast("bigint")).groupBy("block", "part")).applyInArrow(count, "id bigint, n bigint")
    exact = counted.groupBy("id").agg((F.sum("n") - 1).alias("exact"))  # without itself
    return exact.join(links.select(F.col("vec_id").alias("id"), F.col("n_links").alias("found")), "id").withColumnRenamed("id", "vec_id")
