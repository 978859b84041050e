"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its distinct word shingles; two documents are linked when their Jaccard similarity is
at least the threshold. Equal sets are collapsed first, by a 128-bit hash of the set, to the smallest id.

Each remaining set gets a signature of minwise tokens. In each of ``trees`` independent trees a document
starts at the root; a node selects, by a hash of its path, one coordinate of the signature and with probability
1/threshold - 1 a second one, and the document moves to the child named by its token there. Two documents of
similarity s share s/threshold children of a common node on average, so that pairs at or above the threshold
survive to any depth with a fair chance while others die out; independent trees lift the recall to ``recall``. The
deeper a node, the fewer such pairs are left in one tree: documents of nodes that branch on are planted in as many
more trees as a pair at the threshold needs at the next depth (``trees_for``).
Paths need no other document, so whole levels are computed at once and only (node, id) rows are shuffled.

Nodes of at most ``small`` documents are compared exhaustively. A larger node compares everyone with one pivot;
if it then still holds documents of different components, it is settled in cells where the pairs that could join
them are at most ``settle_pairs``, and branches on where they are more. A node whose documents are connected
already has nothing left to find and is dropped: a group of near copies, however large, is settled by its pivots
and not by its pairs. Nodes left at ``max_depth`` are settled in cells whatever their size.

Settling compares all documents of a node that are in different components, but no pair leaves the task that looks
at it. A node is dealt in blocks, bounded by documents and by bytes of their sets, and a cell holds two of them. A
first pass over the sketches names the documents that may have a partner; only their sets are read. A cell then
joins its components by links that it has confirmed on the full sets, and returns those that joined some, fewer
than it has documents. Texts just below the threshold, however many, thus cost comparisons and no rows.

Pairs whose sizes rule out the similarity are never formed. Candidates pass a test on one byte of each coordinate
with a slack of four standard deviations, and are confirmed on the full sets of hashed shingles. Nothing is capped.

Inside, a document is its row (``key``), not its id. Sets count as equal, and as one document of the join, when two
64-bit sums over all of their hashed shingles and their sizes agree; sets that differ do so with a probability
of about 2^-128 a pair.

Defined results: null or empty texts have no shingles and link with nothing; with fewer words than a shingle
the whole sequence is one shingle; rows that share an id but not a text are documents of their own; a component
bears the smallest id that is not null of its rows, so a row of null id bears that of the rows it is linked with, or
null; repeated rows are linked to each other by their equal sets; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import settings, table
from tidewire.llm._text import lower, mix64, span_hashes, text_chunks, words
from tidewire.llm.graph import components

THRESHOLD = 0.8
SHINGLE = 5
#: Trees that all documents are in, and the share of pairs at the threshold that must share a node at any depth.
TREES, RECALL = 12, 0.99
COORDINATES = 128
SKETCH = COORDINATES
SLACK = 0.145
SMALL = 16
#: A larger node branches on while more of its pairs than these could join different components.
SETTLE_PAIRS = 200_000_000
#: Rows of an Arrow batch that holds full sets.
BATCH_ROWS = 64
#: Documents, and bytes of their sets, of one of the two blocks of a cell. A document goes to as many cells as its node has
#: blocks, so a block is as large as a task's memory and time allow: 16 MB of sets, some seconds of comparisons.
BLOCK_DOCS, BLOCK_BYTES = 6000, 8_000_000
#: Rows of a file, and so of a task, that cells are compared in.
CELL_ROWS = 5_000
#: Bytes of a cell's table of which document holds which shared shingle, beyond which shingles are counted one by one.
BIT_BYTES = 32_000_000
#: Ids that are broadcast at most to pick the texts whose sets are wanted.
BROADCAST_IDS = 1_000_000
CONFIRM_ROWS = 20_000
#: Rows of a file of signatures, and of full sets.
FILE_DOCS, SET_ROWS = 10_000, 2_000
FIRST_DEPTH = 4
STEP_DEPTH = 6
MAX_DEPTH = 28

FRONT, FRONT_SCHEMA = ["node", "id", "n"], "node bigint, id bigint, n bigint"

_MULT = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, concatenated, and where each text's begin."""
    data = lower(data)
    starts, ends, per_text = words(data, offsets)
    h = span_hashes(data, starts, ends)
    n_words = np.diff(per_text)
    acc = h.copy()
    for j in range(1, k):  # the hash of words i..i+k-1, stored at i
        acc[: len(h) - j] = mix64(acc[: len(h) - j] * _u(0x9E3779B97F4A7C15) + h[j:])
    sets = []
    for i in range(len(n_words)):
        a, b = per_text[i], per_text[i + 1]
        if b - a >= k:
            sets.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            v = np.array([0x5851F42D4C957F2D + int(b - a)], dtype=np.uint64)  # a short sequence is one shingle, unlike any of k words
            for j in range(a, b):
                v = mix64(v * _u(0x9E3779B97F4A7C15) + h[j : j + 1])
            sets.append(v)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def signatures(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minwise tokens of each nonempty set, one row each, 32 bits a coordinate."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), COORDINATES), dtype=np.uint32)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat(flat * _MULT[j], starts) >> np.uint64(32)
    return out


def _set_hashes(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the items of each nonempty set."""
    return np.add.reduceat(mix64(flat), starts), np.bitwise_xor.reduceat(mix64(flat + _u(0xA24BAED4963EE407)), starts)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "body"):
                flat, first = shingle_sets(data, offsets, k)
                sizes = np.diff(first)
                some = sizes > 0
                starts = first[:-1][some]
                blobs: list = [None] * len(sizes)
                short: list = [None] * len(sizes)
                h1, h2 = np.zeros(len(sizes), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)
                if len(starts):
                    rows = signatures(flat, first)
                    for r, i in enumerate(np.flatnonzero(some)):
                        blobs[i] = rows[r].tobytes()
                        short[i] = rows[r].astype(np.uint8).tobytes()
                    h1[some], h2[some] = _set_hashes(flat, starts)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(blobs, pa.binary()), pa.array(short, pa.binary())], ["doc", "n", "h1", "h2", "sig", "sk"])

    return run


def _walk(rows: np.ndarray, node: np.ndarray, sig: np.ndarray, levels: int, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Move documents (rows into ``sig``) from their nodes down some levels."""
    bound = _u(int(branch * 2**64) - 1) if branch < 1 else _u(2**64 - 1)
    for _ in range(levels):
        f1 = (mix64(node ^ _u(0x1F83D9ABFB41BD6B)) % _u(COORDINATES)).astype(np.int64)
        second = mix64(node ^ _u(0x5BE0CD19137E2179)) < bound
        f2 = (mix64(node ^ _u(0x3C6EF372FE94F82B)) % _u(COORDINATES)).astype(np.int64)
        second &= f2 != f1
        child = lambda n, f, r: mix64(mix64(n * _u(0x9E3779B97F4A7C15) + f.astype(np.uint64)) ^ sig[r, f].astype(np.uint64))
        a = child(node, f1, rows)
        b = child(node[second], f2[second], rows[second])
        rows, node = np.concatenate([rows, rows[second]]), np.concatenate([a, b])
    return rows, node


def trees_for(depth: int, threshold: float, recall: float) -> int:
    """Trees in which a pair at the threshold shares a node of this depth with probability ``recall``.

    The pair agrees in a binomial number of coordinates; given that, its shared nodes are a branching process.
    """
    k = np.arange(COORDINATES + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, COORDINATES + 1)))))
    weight = np.exp(logs[-1] - logs[k] - logs[COORDINATES - k] + k * np.log(threshold) + (COORDINATES - k) * np.log(max(1e-12, 1 - threshold)))
    s, branch = k / COORDINATES, 1 / threshold - 1
    gone = np.zeros(len(k))
    for _ in range(depth):
        gone = (1 - s + s * gone) * (1 - branch * s + branch * s * gone)
    trees = 1
    while (weight * gone**trees).sum() > 1 - recall:
        trees += 1
    return trees


def _sig_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _sketch_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places rows of sketches agree."""
    return np.bitwise_count((a == b).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _plant(trees: int, levels: int, branch: float, first: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, ids, n = _sig_rows(batch.column("sig")), batch.column("id").to_numpy(), batch.column("n").to_numpy()
            for t in range(first, trees):
                root = mix64(np.array([t + 1], dtype=np.uint64) * _u(0xD1B54A32D192ED03))
                rows, node = _walk(np.arange(len(ids)), np.repeat(root, len(ids)), sig, levels, branch)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[rows]), pa.array(n[rows])], FRONT)

    return run


def _branch(levels: int, branch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, ids, n = _sig_rows(batch.column("sig")), batch.column("id").to_numpy(), batch.column("n").to_numpy()
            rows, node = _walk(np.arange(len(ids)), batch.column("node").to_numpy().view(np.uint64), sig, levels, branch)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[rows]), pa.array(n[rows])], FRONT)

    return run


def _similar_sketch(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_agreeing(_sketch_rows(batch.column("sa")), _sketch_rows(batch.column("sb"))) >= least * SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "body"):
                flat, first = shingle_sets(data, offsets, k)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    h1, h2 = _set_hashes(flat, first[some])
                    blobs = [flat[first[i] : first[i + 1]].tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at).take(pa.array(some)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(blobs, pa.binary())], ["doc", "h1", "h2", "items"])

    return run


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers."""
    if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
        return False
    small, large = (u, v) if len(u) <= len(v) else (v, u)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def _confirm(threshold: float):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("xa"), batch.column("xb"), strict=True)
            keep = pa.array([_linked(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


class _Cell:
    """Documents of one node in up to two blocks: which pairs could join different components."""

    def __init__(self, group: pa.Table, least: float, percent: int):
        self.ids, self.n, self.label = (group.column(c).to_numpy() for c in ("id", "n", "root"))
        self.label = self.label.copy()
        self.sk = _sketch_rows(group.column("sk"))
        self.odd = self.label != group.column("main")[0].as_py()
        self.side = group.column("side").to_numpy() if group.column("a")[0].as_py() != group.column("b")[0].as_py() else None
        self.least, self.percent = least * SKETCH, percent

    def partners(self, x: int) -> np.ndarray:
        """Rows that x may be similar to, of other components; of two rows outside the main component, the first names the second."""
        near = self.label != self.label[x]
        near[: x + 1] &= ~self.odd[: x + 1]
        if self.side is not None:
            near &= self.side != self.side[x]
        near &= 100 * np.minimum(self.n, self.n[x]) >= self.percent * np.maximum(self.n, self.n[x])
        at = np.flatnonzero(near)
        return at[_agreeing(self.sk[at], self.sk[x]) >= self.least] if len(at) else at


def _hopeful(least: float, percent: int):
    """(node, id) of the rows of a cell that may be similar to one of another component."""

    def run(group: pa.Table) -> pa.Table:
        cell = _Cell(group, least, percent)
        some = np.zeros(len(cell.ids), dtype=bool)
        for x in np.flatnonzero(cell.odd):
            near = cell.partners(int(x))
            some[near] = True
            some[x] |= len(near) > 0
        return pa.table({"node": group.column("node").filter(pa.array(some)), "id": pa.array(cell.ids[some])})

    return run


class _Overlap:
    """Sizes of the intersections of a set with others of a cell."""

    def __init__(self, items: pa.ChunkedArray):
        blobs = items.to_pylist()
        self.first = np.concatenate(([0], np.cumsum([len(b) // 8 for b in blobs])))
        self.flat = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        self.columns = None

    def _index(self) -> None:
        """Number the items that several sets hold; the others are in no intersection."""
        unique, inverse, counts = np.unique(self.flat, return_inverse=True, return_counts=True)
        number = np.where(counts > 1, np.cumsum(counts > 1), 0)
        self.columns, self.width = number[inverse].astype(np.int32), int((counts > 1).sum()) + 1
        words = -(-self.width // 64)
        self.bits = None
        if words * 8 * (len(self.first) - 1) <= BIT_BYTES:
            self.bits = np.zeros((len(self.first) - 1, words), dtype=np.uint64)
            for x in range(len(self.bits)):
                self.bits[x] = np.packbits(self._row(x, words * 64)).view(np.uint64)

    def _row(self, x: int, width: int) -> np.ndarray:
        row = np.zeros(width, dtype=np.uint8)
        row[self.columns[self.first[x] : self.first[x + 1]]] = 1
        row[0] = 0
        return row

    def __call__(self, x: int, others: np.ndarray) -> np.ndarray:
        if len(others) <= 4:
            own = self.flat[self.first[x] : self.first[x + 1]]
            return np.array([np.isin(self.flat[self.first[y] : self.first[y + 1]], own, assume_unique=True).sum() for y in others])
        if self.columns is None:
            self._index()
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[x]).sum(axis=1, dtype=np.int64)
        return np.add.reduceat(self._row(x, self.width)[self.columns], self.first[:-1], dtype=np.int64)[others]


def _bridge(least: float, percent: int):
    """Links, confirmed on the full sets, that join all components of a cell that have links between them: one for each joining."""

    def run(group: pa.Table) -> pa.Table:
        cell, overlap = _Cell(group, least, percent), _Overlap(group.column("items"))
        found = []
        for x in np.flatnonzero(cell.odd):
            near = cell.partners(int(x))
            if not len(near):
                continue
            both = overlap(int(x), near)
            near = near[100 * both >= percent * (cell.n[x] + cell.n[near] - both)]
            labels, first = np.unique(cell.label[near], return_index=True)
            found += [(cell.ids[x], cell.ids[y]) for y in near[first]]
            if len(labels):
                cell.label[np.isin(cell.label, labels)] = cell.label[x]
        a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


class _Join:
    """The state of one join: signatures, sets fetched so far, confirmed links and the components they make."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, threshold: float):
        self.docs, self.reps, self.k, self.threshold = docs, reps, k, threshold
        self.percent = round(threshold * 100)
        self.sketches = reps.select("id", "n", "sk")
        self.tested: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.n_links = 0

    def root_of(self, df: DataFrame, col: str, out: str) -> DataFrame:
        if self.roots is None:
            return df.withColumn(out, F.col(col))
        roots = self.roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return df.join(roots, F.col(col) == F.col("_n"), "left").withColumn(out, F.coalesce("_r", col)).drop("_n", "_r")

    def apart(self, pairs: DataFrame, rows: int | None) -> DataFrame:
        """The pairs whose ends are not connected yet."""
        if self.roots is None:
            return pairs
        half = table(self.root_of(pairs, "a", "ra"), "pair-roots", rows=rows)
        return self.root_of(half, "b", "rb").where(F.col("ra") != F.col("rb")).select("a", "b")

    def add(self, found: DataFrame) -> None:
        """Join the components of confirmed links (a, b): components of the roots, not of all links so far."""
        n = found.count()
        if not n:
            return
        self.n_links += n
        if self.roots is None:
            self.roots = table(components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")), n), "roots", rows=2 * n)
            return
        half = table(self.root_of(found, "a", "src"), "link-roots", rows=n)
        joined = table(components(self.root_of(half, "b", "dst").select("src", "dst"), n), "root-components", rows=2 * n)
        up = joined.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
        old = self.roots.join(up, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
        self.roots = table(old.unionByName(joined.join(self.roots.select("node"), "node", "left_anti")), "roots", rows=2 * self.n_links)

    def fetch(self, who: DataFrame, n_docs: int) -> DataFrame:
        """Full sets (id, items) of documents (and of others asked for before); only texts of new ones are read."""
        missing = who if self.sets is None else who.join(self.sets.select("id"), "id", "left_anti")
        missing = table(missing.join(self.reps.select("id", "doc", "h1", "h2"), "id"), "missing", rows=n_docs)
        n = missing.count()
        if n:
            docs = missing.select(F.col("doc").alias("asked")).distinct()
            docs = F.broadcast(docs) if n <= BROADCAST_IDS else docs
            keys = missing.select("id", F.col("doc").alias("of"), F.col("h1").alias("of1"), F.col("h2").alias("of2"))
            # Sets can be large: few of them travel in an Arrow batch.
            with settings(who.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
                texts = self.docs.join(docs, F.col("id").eqNullSafe(F.col("asked")), "left_semi")
                sets = texts.mapInArrow(_sets(self.k), "doc bigint, h1 bigint, h2 bigint, items binary")
                own = sets.join(F.broadcast(keys) if n <= BROADCAST_IDS else keys, F.col("doc").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")))
                new = table(own.select("id", "items").dropDuplicates(["id"]), "sets", rows=n, file_rows=SET_ROWS)
            self.sets = new if self.sets is None else self.sets.unionByName(new)
        return self.sets.join(who, "id", "left_semi")

    def verify(self, pairs: DataFrame, n_pairs: int) -> DataFrame:
        """Confirmed pairs, on the full sets."""
        who = table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates", rows=2 * n_pairs)
        sets = self.fetch(who, who.count())
        with settings(pairs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
            left = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa")), "a")
            both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")), "b")
            return table(both.select("a", "b", "xa", "xb").mapInArrow(_confirm(self.threshold), "a bigint, b bigint"), "confirmed", rows=n_pairs, file_rows=CONFIRM_ROWS)

    def consider(self, pairs: DataFrame, rows: int) -> None:
        """Sift candidate pairs (a < b), confirm what is needed, and update the components. No pair is tested twice."""
        pairs = table(self.apart(pairs.distinct(), rows), "pairs", rows=rows)
        n = pairs.count()
        if self.tested is not None:
            pairs = table(pairs.join(self.tested, ["a", "b"], "left_anti"), "new-pairs", rows=n)
            n = pairs.count()
        if not n:
            return
        left = pairs.join(self.sketches.select(F.col("id").alias("a"), F.col("sk").alias("sa")), "a")
        both = left.join(self.sketches.select(F.col("id").alias("b"), F.col("sk").alias("sb")), "b")
        likely = table(both.select("a", "b", "sa", "sb").mapInArrow(_similar_sketch(self.threshold - SLACK), "a bigint, b bigint"), "likely", rows=n)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        n = likely.count()
        if not n:
            return
        first = table(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first", rows=n)
        self.add(self.verify(first, first.count()))
        rest = table(self.apart(likely.join(first, ["a", "b"], "left_anti"), n), "rest", rows=n)
        n = rest.count()
        if n:
            self.add(self.verify(rest, n))

    def _cells(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """Rows (node, id, n, root, main, ...) dealt to the cells of their node: with a, b, the blocks of a cell, and the row's side."""
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
        sized = rows.join(table(rows.groupBy("node").agg(blocks.alias("blocks")), "cell-blocks", rows=n_rows), "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
        dealt = sized.select(*rows.columns, "block", F.explode(every).alias("cell"))
        return dealt.select(*rows.columns, "cell.a", "cell.b", (F.col("block") == F.col("cell.b")).cast("int").alias("side"))

    def settle(self, rows: DataFrame, n_rows: int) -> None:
        """Find what joins different components within nodes. rows: node, id, root, main."""
        least = self.threshold - SLACK
        rows = table(rows.select("node", "id", "root", "main").join(self.sketches, "id"), "settled", rows=n_rows)
        hopeful = self._cells(rows, n_rows).groupBy("node", "a", "b").applyInArrow(_hopeful(least, self.percent), "node bigint, id bigint")
        hopeful = table(hopeful, "hopeful-cells", rows=n_rows, file_rows=CELL_ROWS)
        hopeful = table(hopeful.distinct(), "hopeful", rows=n_rows)
        n = hopeful.count()
        if not n:
            return
        who = table(hopeful.select("id").distinct(), "hopeful-ids", rows=n)
        sets = self.fetch(who, n)
        with settings(rows.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
            some = table(rows.join(hopeful, ["node", "id"], "left_semi"), "hopeful-rows", rows=n)
            dealt = self._cells(some, n).join(sets, "id")
            found = table(dealt.groupBy("node", "a", "b").applyInArrow(_bridge(least, self.percent), "a bigint, b bigint"), "bridges", rows=n, file_rows=CELL_ROWS)
        self.add(found.distinct())


def link(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, small: int = SMALL, settle_pairs: int = SETTLE_PAIRS, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> DataFrame:
    """docs: id, body -> id, n (size of the set), component (smallest id reachable by links)."""
    branch, percent = 1 / threshold - 1, round(threshold * 100)
    signed = docs.mapInArrow(_sign(shingle), "doc bigint, n bigint, h1 bigint, h2 bigint, sig binary, sk binary")
    signed = table(signed.withColumn("key", F.monotonically_increasing_id()), "signatures")
    n_docs = signed.count()
    groups = table(signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("rep")), "equal-sets", rows=n_docs)
    members = table(signed.select(F.col("doc").alias("id"), "n", "h1", "h2").join(groups, ["h1", "h2", "n"], "left").select("id", "n", "rep"), "members", rows=n_docs)
    reps = signed.join(groups.select(F.col("rep").alias("key")), "key", "left_semi").withColumnRenamed("key", "id")
    reps = table(reps, "representatives", rows=n_docs, file_rows=FILE_DOCS)
    state = _Join(docs, reps, shingle, threshold)

    trees = max(trees, trees_for(FIRST_DEPTH, threshold, recall))
    front = reps.select("id", "n", "sig").mapInArrow(_plant(trees, FIRST_DEPTH, branch), FRONT_SCHEMA)
    depth, n_front = FIRST_DEPTH, int(n_docs * trees * (1 / threshold) ** FIRST_DEPTH)
    while True:
        sizes = front.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("pivot")).where("size > 1")
        sizes = table(sizes.select("node", "size", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "nodes", rows=n_front)
        active = table(front.join(sizes, "node"), "active", rows=n_front)
        n_active = active.count()
        alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
        few = active.where(F.col("size") <= small).select("node", "id", "n")
        pairs = few.select("node", F.col("id").alias("a"), F.col("n").alias("na")).join(few.select("node", F.col("id").alias("b"), F.col("n").alias("nb")), "node").where((F.col("a") < F.col("b")) & alike(F.col("na"), F.col("nb"))).select("a", "b")
        big = active.where(F.col("size") > small)
        pairs = pairs.unionByName(big.where((F.col("id") > F.col("pivot")) & alike(F.col("n"), F.col("pivot_n"))).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        state.consider(pairs, n_active * small)
        # What is left to find is in nodes that still hold more than one component.
        rooted = table(state.root_of(big.select("node", "id"), "id", "root"), "rooted", rows=n_active)
        per = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("k"))
        mixed = per.groupBy("node").agg(F.sum("k").alias("size"), F.max(F.struct("k", (-F.col("root")).alias("r"))).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        mixed = table(mixed.select("node", "size", (-F.col("m.r")).alias("main"), ((F.col("size") - F.col("m.k")) * F.col("size")).alias("undecided")), "mixed", rows=n_active)
        if mixed.isEmpty():
            break
        left = table(rooted.join(mixed, "node"), "left", rows=n_active)
        last = depth >= max_depth
        state.settle(left if last else left.where(F.col("undecided") <= settle_pairs), n_active)
        left = left.where(F.col("undecided") > settle_pairs)
        if last or left.isEmpty():
            break
        branched = left.select("node", "id").join(reps.select("id", "n", "sig"), "id").mapInArrow(_branch(STEP_DEPTH, branch), FRONT_SCHEMA)
        depth += STEP_DEPTH
        wanted = max(trees, trees_for(depth, threshold, recall))
        if wanted > trees:
            again = reps.select("id", "n", "sig").join(left.select("id").distinct(), "id", "left_semi")
            branched = branched.unionByName(again.mapInArrow(_plant(wanted, depth, branch, trees), FRONT_SCHEMA))
        front = table(branched, "front", rows=int(n_active * 1.25**STEP_DEPTH + n_docs * (wanted - trees) * 1.25**depth))
        trees = wanted
        n_front = front.count()
    placed = table(state.root_of(members, "rep", "part"), "placed", rows=n_docs)
    smallest = table(placed.where("part is not null").groupBy("part").agg(F.min("id").alias("component")), "smallest", rows=n_docs)
    return placed.join(smallest, "part", "left").select("id", "n", F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("body"))
    out = link(plain, shingle=shingle, threshold=threshold, trees=trees)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
