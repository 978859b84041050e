"""Near duplicates of texts and vectors against brute force, and the pipeline."""

import math
import os
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_rows import AWKWARD, docs
from tidewire.llm import _base, embeddings, exact_dedup, graph, near_dedup


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)] + [(None, 1), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    have = {frozenset(e) for e in edges if None not in e}
    want = brute_components(300, lambda i, j: frozenset((i, j)) in have)
    assert all(want[k] == v for k, v in got.items())
    assert all(k in got for e in have if len(e) == 2 for k in e)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [t for _, t in AWKWARD]
    for _ in range(25):  # families: a text and copies with ever more changes
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 150]))]
        for edits in (0, 0, 1, 2, 4, 8, 12):
            w = base[:]
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).upper() if edits == 0 else " ".join(w))
    chain = [rng.choice(vocab) for _ in range(120)]
    for i in range(40):  # neighbours are alike, ends are not
        chain[3 * i % 120] = f"c{i}"
        texts.append(" ".join(chain))
    return list(enumerate(texts))


def test_text_links_equal_brute_force(spark):
    for k in (2, 5):
        rows = corpus()
        sets = [shingles(t, k) for _, t in rows]
        want = brute_components(len(rows), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))  # noqa: B023
        got = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, rows), shingle=k).collect()}
        assert [got[i].n_shingles for i, _ in rows] == [len(s) for s in sets]
        assert [got[i].component_id for i, _ in rows] == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_group_of_near_copies_goes_through_the_branches(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.choice([3, 20, 40])):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 2) for _, t in rows]
    want = brute_components(len(rows), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    plain = docs(spark, rows).selectExpr("doc_id id", "text body")
    for few in (near_dedup.SETTLE_PAIRS, 10):
        got = {r.id: r.component for r in near_dedup.link(plain, shingle=2, settle_pairs=few, max_depth=16).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_trees_reach_the_recall_at_every_depth():
    """Pairs with the threshold's share of equal minwise tokens, walked down all trees that are planted by that depth."""
    rng = np.random.default_rng(3)
    n = 150
    a = rng.integers(0, 2**32, (n, near_dedup.COORDINATES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    sig = np.concatenate([a, b])
    for depth in (4, 16, 22):
        trees = max(near_dedup.TREES, near_dedup.trees_for(depth, 0.8, near_dedup.RECALL))
        met = np.zeros(n, dtype=bool)
        for t in range(trees):
            root = near_dedup.mix64(np.array([t + 1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            rows, node = near_dedup._walk(np.arange(2 * n), np.repeat(root, 2 * n), sig, depth, 0.25)
            nodes = [set() for _ in range(2 * n)]
            for r, x in zip(rows.tolist(), node.tolist(), strict=True):
                nodes[r].add(x)
            met |= np.array([bool(nodes[i] & nodes[n + i]) for i in range(n)])
        assert met.mean() >= 0.96, (depth, trees)


def test_near_awkward(spark):
    assert near_dedup.near_dedup(docs(spark, AWKWARD).where("false")).count() == 0
    got = near_dedup.near_dedup(docs(spark, [(None, "a b"), (None, None), (3, "a b"), (3, "a b")]), shingle=2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == [(-1, 0, -1), (-1, 1, 3), (3, 1, 3), (3, 1, 3)]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    words = lambda c: [f"{c}{i}" for i in range(60)]
    rows = [(1, " ".join(words("a"))), (1, " ".join(words("b"))), (2, " ".join([*words("a")[:-1], "x"])), (3, " ".join([*words("b")[:-1], "y"])), (4, " ".join(words("c"))), (4, " ".join(words("c")))]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_dedup(docs(spark, rows), shingle=2).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_spread_group_is_settled_in_cells_of_any_size(spark, monkeypatch):
    """Copies whose similarities lie around the threshold, in cells of few documents and few bytes, equal brute force."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(200):
        w = base[:]
        for k in rng.sample(range(120), rng.choice([2, 3, 4, 6, 9])):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 2) for _, t in rows]
    want = brute_components(len(rows), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert 1 < len(set(want)) < len(want) - 10
    plain = docs(spark, rows).selectExpr("doc_id id", "text body")
    for block, bits in ((near_dedup.BLOCK_DOCS, near_dedup.BIT_BYTES), (25, 0)):
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
        monkeypatch.setattr(near_dedup, "BIT_BYTES", bits)
        got = {r.id: r.component for r in near_dedup.link(plain, shingle=2).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_overlaps_equal_counting():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(40)]
    column = pa.chunked_array([pa.array([s.tobytes() for s in sets], pa.binary())])
    for others in (np.arange(3), np.arange(40)):
        want = [len(np.intersect1d(sets[7], sets[y])) for y in others]
        o = near_dedup._Overlap(column)
        assert o(7, others).tolist() == want
        if len(others) > 4:
            o.bits = None
            assert o(7, others).tolist() == want


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 60, 250)] + rng.normal(0, 0.08, (250, 16))
    tight = np.repeat(base[:1], 60, axis=0) + rng.normal(0, 0.01, (60, 16))
    v = np.concatenate([base, near, tight, base[:20], 3 * base[20:25]])
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0, None], 1), (1004, [math.nan] * 16, 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [math.inf] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, cell_rows=80, block=100).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    links = s >= 0.95
    assert [got[i].n_links for i in range(len(v))] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(v))] == brute_components(len(v), lambda i, j: links[i, j])
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1005].n_links, got[1006].component_id) == (1, 1005)
    checked = embeddings.audit(df, embeddings.near_vectors(df, cell_rows=80, block=100)).collect()
    assert checked and sum(min(r.exact, r.found) for r in checked) >= 0.9 * sum(r.exact for r in checked)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_vectors_that_share_an_id_are_vectors_of_their_own(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.05, 0.0, 0.1]), (3, [0.05, 1.0, 0.1, 0.0]), (None, [0.0, 0.0, 0.0, 1.0]), (None, [0.0, 0.0, 0.02, 1.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 1, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_united_shard_graphs_find_the_links():
    """A graph grown by search and prune over overlapping shards, without all pairs: recall against all pairs, and no false link."""
    v = hot_vectors()[600:]
    s = v @ v.T >= 0.95
    np.fill_diagonal(s, False)
    x = v.astype(np.float32)
    graph, medoids = embeddings.build_graph(x, shard_rows=300)
    assert graph.shape == (len(v), 2 * embeddings.DEGREE * embeddings.OVERLAP) and 10 < len(medoids) < len(v) / 4
    i, j = embeddings.range_search(x, graph, medoids, np.arange(len(v)), 0.95 - 1e-4)
    assert s[i, j].sum() >= 0.95 * s.sum()
    i, j = embeddings.region_links(v, 0.95)
    assert s[i, j].all() and len(i) >= embeddings.RECALL * s.sum() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)


def test_margins_widen_until_the_audit_is_content(spark, monkeypatch):
    v = hot_vectors()
    links = (v @ v.T >= 0.95).sum() - len(v)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embeddings, "choose_cells", lambda x, c, n, reach, block: c)  # cells as the centroids fall, across the hot group
    spreads, real = [], embeddings._find
    monkeypatch.setattr(embeddings, "_find", lambda *a: spreads.append(a[-1]) or real(*a))
    found = embeddings.near_vectors(df, cell_rows=100, spread=0.01).agg({"n_links": "sum"}).first()[0]
    assert len(spreads) > 1 and embeddings.RECALL * links <= found <= links


def hot_vectors():
    """A third of the rows within one group of near copies, the rest in loose groups far from each other."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    hot = unit(unit(rng.normal(size=(1, 64))) + 0.12 * unit(rng.normal(size=(700, 64))))
    centres = unit(rng.normal(size=(20, 64)))
    loose = unit(centres[rng.integers(0, 20, 1400)] + 0.3 * unit(rng.normal(size=(1400, 64))))
    return np.concatenate([hot, loose])


def test_hot_group_that_is_cut_into_cells_loses_no_link(spark):
    v = hot_vectors()
    links = v @ v.T >= 0.95
    np.fill_diagonal(links, False)
    assert links[:700, :700].sum() == 700 * 699
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    for block in (300, embeddings.BLOCK):
        got = {r.vec_id: r for r in embeddings.near_vectors(df, cell_rows=20, block=block).collect()}  # by default, a margin below the chord
        found = np.array([got[i].n_links for i in range(len(v))])
        assert (found <= links.sum(axis=1)).all() and found.sum() >= embeddings.RECALL * links.sum()
        assert {got[i].component_id for i in range(700)} == {0}


def test_every_link_meets_in_the_first_own_cell():
    v = hot_vectors()
    c = embeddings.fit_centroids(v, 100)
    home, near = embeddings._cells_of(v, c, embeddings._reach(0.95))
    i, j = np.nonzero(v @ v.T >= 0.95)
    first = np.minimum(home[i], home[j])
    assert len(set(home[:700])) > 4 and near[i, first].all() and near[j, first].all()
    assert 1 < len(embeddings.choose_cells(v, c, 10**6, embeddings._reach(0.95), embeddings.BLOCK)) < 100


def test_exhaustive_shard_equals_brute_force():
    v = hot_vectors()[600:]
    s = v @ v.T >= 0.95
    np.fill_diagonal(s, False)
    copies = np.arange(len(v)) % 3 + 1
    links, root = embeddings.exact_links(v, 0.95, lambda i, j: (i + j) % 2 == 0, copies, rows=64)
    even = (np.arange(len(v))[:, None] + np.arange(len(v))) % 2 == 0
    assert links.tolist() == ((s & even) @ copies).tolist()
    assert root.tolist() == brute_components(len(v), lambda i, j: s[i, j])


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows.collect()
        stage(spark, rows, sf).write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        after = rows.collect()
        if name != "packing":
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in after}
        if name == "quality":
            lost = [labels[r.doc_id] for r in before if r.doc_id not in ids and r.doc_id in labels]
            assert lost and sum(lost) <= 0.1 * len(lost)
        if name == "exact_dedup":
            best = defaultdict(int)
            for r in before:
                best[r.text.encode().lower()] = max(best[r.text.encode().lower()], r.doc_id)
            assert ids == set(best.values()) and len(after) == len(ids)
        if name == "near_dedup":
            sets = [shingles(r.text, 5) for r in before]
            root = brute_components(len(before), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))  # noqa: B023
            groups = defaultdict(list)
            for i, r in enumerate(root):
                groups[r].append(before[i].doc_id)
            assert ids == {min(g) for g in groups.values()}
        if name == "mixing":
            assert ids <= {r.doc_id for r in before}
        if name == "packing":
            assert ids == {r.doc_id for r in before}
    assert corpus_pipeline.run(spark, sf).columns[0] == "doc_id"


def test_tables_on_the_way_are_released(spark):
    from tidewire.llm import _base

    kept = _base.table(spark.range(3).toDF("x"), "kept")
    path = _base.run_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path)
    _base.release(spark)
    assert not os.path.exists(path)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs(spark, AWKWARD), docs(spark, AWKWARD).where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert out.count() >= 0
            assert name == "packing" or out.columns == df.columns
    kept = corpus_pipeline.exact(spark, docs(spark, AWKWARD), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept if r.text and r.text.lower() == "hello world" and r.doc_id) == [5]


def test_rows_from_other_regions_are_searched_for_and_not_built_in():
    """Links of heads with each other and with visitors, none among visitors; a block that is met in a later part without its own links."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    v = np.concatenate([base + rng.normal(size=base.shape) * 0.03 * k for k in range(4)])
    v = (v / np.linalg.norm(v, axis=1)[:, None])[rng.permutation(len(v))]
    heads, n = 400, len(v)
    s = (v @ v.T >= 0.95) & ~np.eye(n, dtype=bool)
    visits = np.arange(n) >= heads
    for within in (True, False):
        want = s & ~(visits[:, None] & visits[None])
        if not within:
            want &= visits[:, None] != visits[None]
        i, j = embeddings.region_links(v, 0.95, heads=heads, within=within)
        assert want[i, j].all() and len(i) >= embeddings.RECALL * want.sum() > 200 and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(j.tolist(), i.tolist(), strict=True))
        copies = rng.integers(1, 4, n)
        links, _ = embeddings.exact_links(v, 0.95, lambda i, j, within=within: (visits[i] != visits[j]) | within, copies, heads=heads)
        assert (links == want @ copies).all()
    assert len(embeddings.region_links(v, 0.95, heads=0)[0]) == 0 and len(embeddings.region_links(v, 0.95, heads=n, within=False)[0]) == 0


def test_tables_have_no_checksum_files_and_are_checked_when_read(spark):
    """Each further file that Hadoop lays down is a further process that is seen to hold the whole memory of its JVM."""
    rows = spark.range(1000).selectExpr("id", "sha2(cast(id AS string), 256) AS text")
    index = exact_dedup.DigestIndex(spark)
    index.flush(rows.selectExpr("unhex(text) AS key", "id AS keep_id"), 1000)
    for frame in (_base.table(rows, "plain", rows=1000), index.entries()):
        files = [Path(f.removeprefix("file://")) for f in frame.inputFiles()]
        assert frame.count() == 1000
        for f in files:
            assert sorted(p.name for p in f.parent.iterdir()) == sorted(["_SUCCESS", *[p.name for p in files]])
            data = bytearray(f.read_bytes())
            data[1000] ^= 1  # in the first page
            f.write_bytes(data)
        with pytest.raises(Exception, match="(?i)checksum"):
            frame.collect()
