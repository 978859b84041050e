"""Sharding, exact dedup, licences, mixing, packing: brute force, round trips and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, licenses, mixing, packing, sharding

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id int, body string, score double, row string"


def docs(spark, texts):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "k", 1, "b", 0.5, "r") for i, t in texts], DDL)


AWKWARD = [(1, None), (2, ""), (3, "   \n\t"), (4, "Hello World"), (5, "hello world"), (5, "hello world"), (None, "hello WORLD"), (7, "É x"), (8, "é x"), (9, "word " * 30000), (10, "a"), (11, "ß\x1fq <|endoftext|> 12 it's")]


# Sharding


def plain_fill(shards, slots):
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    prefs = {}
    for i in order:
        offset, skip = sharding.preference(shards[i], slots)
        prefs[i] = iter([(offset + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i in order:
            if len(owner) == slots:
                break
            owner[next(s for s in prefs[i] if s not in owner)] = i
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns():
    shards = [f"x{i}" for i in range(7)]
    assert sharding.fill(shards, 251) == plain_fill(shards, 251)
    counts = Counter(sharding.fill(sharding.SHARDS))
    assert max(counts.values()) - min(counts.values()) <= 1
    with pytest.raises(ValueError):
        sharding.fill(shards, 250)


def test_losing_a_shard_moves_few_slots():
    a, b = sharding.fill(sharding.SHARDS), sharding.fill(sharding.SHARDS[:-1])
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 63) < 0.1 * sharding.SLOTS


def test_placement_reads_the_table(spark):
    table = sharding.fill(sharding.SHARDS)
    rows = sharding.place(docs(spark, AWKWARD), "doc_id").collect()
    assert len(rows) == len(AWKWARD) and all(table[r.slot] == r.shard for r in rows)
    assert sharding.place(docs(spark, AWKWARD).where("false"), "doc_id").count() == 0
    clash = spark.createDataFrame([(1, "a", 7.5)], "doc_id bigint, Slot string, shard double")
    out = sharding.place(clash, "doc_id")
    assert out.columns == ["doc_id", "Slot", "shard", "slot_", "shard_"] and tuple(out.first())[:3] == (1, "a", 7.5)
    assert out.first().shard_ == table[out.first().slot_]


# Exact dedup


@pytest.mark.parametrize("key_bytes", [32, 1])
def test_exact_groups(spark, key_bytes):
    texts = AWKWARD + [(100 + i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup.deduplicate(docs(spark, texts), key_bytes=key_bytes).collect()
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").encode().lower()].append(i)
    assert len(got) == len(texts)
    by_sha = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id)
    smallest = exact_dedup.deduplicate(docs(spark, [(3, "x"), (2, "X")]), keep="smallest").collect()
    assert {r.keep_id for r in smallest} == {2}
    assert exact_dedup.deduplicate(docs(spark, AWKWARD).where("false")).count() == 0


def test_index_compacts_and_answers(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    for batch in range(5):
        index.flush(spark.createDataFrame([(bytearray([k]), batch * 10 + k) for k in range(4)], "key binary, keep_id bigint"))
    assert sum(len(r) for r in index.levels.values()) < 5
    assert index.get(b"\x02").first()[1:] == (42, 5)
    assert sorted((bytes(r.key)[0], r.keep_id, r.group_size) for r in index.entries().collect()) == [(k, 40 + k, 5) for k in range(4)]


# Licences


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "repo/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "repo/src/a.py", "plain code here"),
        (3, "repo/src/b.py", "Licensed under the Apache License, Version 2.0.\nand a lot of other words that follow the header of the file"),
        (4, "repo/vendor/COPYING", "GNU General Public License Version 3, 29 June 2007"),
        (5, "repo/vendor/deep/er/c.py", None),
        (6, "other/d.py", "the driver has a licence to drive"),
        (7, None, "nothing"),
        (8, "repo/src/b.py", ""),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "doc_id bigint, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "header"), 4: ("GPL-3.0", "file"), 5: ("GPL-3.0", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: ("MIT", "inherited")}
    assert licenses.scan(df.where("false")).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def test_wrapped_headers_and_repeated_rows(spark):
    wrapped = "Permission is\nhereby granted, free of charge, to any person\nobtaining a copy of this software\nand associated documentation files"
    comment = "import os\n# Licensed under the Apache License,\n# Version 2.0 (the License); you may not use this file\n# except in compliance with the License.\n\n" + "x = 1 + 2 * 3 over and over\n" * 20
    long = "Released under the MIT License.\n" + "a lot of words that are not about it at all\n" * 30
    rows = [(1, "a/LICENSE", wrapped), (2, "a/b/x.py", None), (3, "c/y.py", comment), (4, "d/z.py", long), (4, "d/z.py", long), (5, "d/other.py", ""), (6, "e/LICENSE", MIT), (6, "e/LICENSE", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {(r.doc_id, r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == {(1, "MIT", "file"), (2, "MIT", "inherited"), (3, "Apache-2.0", "header"), (4, "MIT", "header"), (5, None, "none"), (6, "MIT", "file")}
    assert licenses.scan(df).count() == len(rows)


def plain_scan(rows):
    """The scan, one row at a time: (license, origin, score) by id."""
    terms = lambda t: Counter(w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])", t.lower()) if w)
    marked = lambda t: any(m in t.lower() for m in licenses.MARKS)
    tidy = lambda p: re.sub(r"\s+", " ", p).strip(" ").lower()
    pieces, alone = defaultdict(list), Counter()
    for i, _, text in rows:
        if not text or not marked(text):
            continue
        for p in re.split(r"\n|(?<=[.!?])\s+", text):
            if marked(p):
                pieces[i].append((tidy(p), len(p.split()), True))
                alone[tidy(p)] += 1
        lines = text.split("\n")
        for k in range(len(lines)):
            if marked(lines[k]) or (k + 1 < len(lines) and marked(lines[k + 1])):
                pieces[i] += [(tidy(" ".join(lines[k : k + n])), len(" ".join(lines[k : k + n]).split()), False) for n in range(2, licenses.WRAP + 1) if k + n <= len(lines)]
    seen = Counter()
    for p, n in alone.items():
        for w in terms(p):
            seen[w] += n
    for _, t in licenses.TEMPLATES:
        for w in terms(t):
            seen[w] += 1
    total = sum(alone.values()) + len(licenses.TEMPLATES)
    vector = lambda t: {w: tf * (math.log((total + 1) / (seen[w] + 1)) + 1) for w, tf in terms(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for i, path, text in rows:
        scored, whole, part = [], 0, 0
        for p, n, single in pieces[i]:
            v = vector(p)
            s, name = min((-round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), 6), name) for name, t in licenses.TEMPLATES for u in [vector(t)])
            if -s >= licenses.THRESHOLD:
                scored.append((s, name))
                whole, part = (whole + n, part) if single else (whole, max(part, n))
        if scored:
            s, name = min(scored)
            own[i] = (name, -s, max(whole, part) / len(text.split()) >= licenses.FILE_SHARE or path.rsplit("/", 1)[-1].split(".")[0].lower() in licenses.FILE_NAMES)
    dirs = {}
    for i, path, _ in rows:
        if i in own and own[i][2]:
            at = path.rpartition("/")[0]
            dirs[at] = min(dirs.get(at, (0, "")), (-own[i][1], own[i][0]))
    out = {}
    for i, path, _ in rows:
        up = path.rpartition("/")[0].split("/")
        near = next((d for k in range(len(up), -1, -1) for d in ["/".join(up[:k])] if d in dirs), None)
        if i in own:
            out[i] = (own[i][0], "file" if own[i][2] else "header", own[i][1])
        else:
            out[i] = (dirs[near][1], "inherited", -dirs[near][0]) if near is not None else (None, "none", None)
    return out


def test_scan_equals_a_scan_row_by_row(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "driver", "has", "no", "licence", "to", "drive", "code", "copyright", "rest", "of", "it"]) for _ in range(n))
    rows = []
    for i in range(60):
        t = licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))][1].split()
        if rng.random() < 0.3:
            t[rng.randrange(len(t))] = "thing"
        wrap = rng.choice([100, 6, 4])
        header = "\n".join(" ".join(t[k : k + wrap]) for k in range(0, len(t), wrap))
        body = [header if rng.random() < 0.6 else "", prose(rng.choice([0, 5, 60])) + rng.choice([".", ""]), prose(8)]
        rng.shuffle(body)
        path = "/".join(["", *rng.choices("ab", k=rng.randrange(4)), rng.choice(["x.py", "LICENSE", "copying.txt", f"f{i}.c"])])
        rows.append((i, path, rng.choice(["\n", "\n\n", " "]).join(body)))
    got = {r.doc_id: (r.license, r.origin, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    want = plain_scan(rows)
    for i, _, _ in rows:
        assert got[i][:2] == want[i][:2] and (want[i][2] is None or abs(got[i][2] - want[i][2]) < 2e-6), (rows[i], got[i], want[i])


# Mixing


def mixture(spark):
    clean = [(i, "some quiet words that say little " * 4) for i in range(60)]
    junk = [(100 + i, "click!! here!! now!! free!! " * 6) for i in range(20)]
    toxic = [(200 + i, "some quiet words and one scoundrel that say little " * 3) for i in range(20)]
    labels = [(i, "clean") for i, _ in clean] + [(i, "junk") for i, _ in junk] + [(i, "toxic") for i, _ in toxic]
    return docs(spark, clean + junk + toxic), spark.createDataFrame(labels, "id bigint, domain string")


def test_rates_meet_the_targets(spark):
    df, labels = mixture(spark)
    targets = {"clean": 0.7, "junk": 0.1, "toxic": 0.2}
    out = mixing.mix(df, labels, targets).collect()
    total = sum(r.tokens * r.rate for r in out)
    for d, share in targets.items():
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in out) / total - share) < 0.02
    assert all(r.rate >= 0 for r in out)
    applied = Counter(r.doc_id for r in mixing.apply(df, labels, targets).collect())
    assert applied == Counter({r.doc_id: r.copies for r in out if r.copies})


def test_rates_meet_the_targets_of_the_queries(spark):
    df, labels = mixture(spark)
    df = df.crossJoin(spark.range(6).withColumnRenamed("id", "again")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("again")).drop("again")
    labels = labels.crossJoin(spark.range(6).withColumnRenamed("id", "again")).select((F.col("id") + 1000 * F.col("again")).alias("id"), "domain")
    out = mixing.mix(df, labels).collect()
    total = sum(r.tokens * r.rate for r in out)
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in out) / total - share) < 0.01 * share


def brute_rates(t, p, want, rounds=200_000):
    """Plain projected gradient on one rate for each document."""
    size = t.sum()
    r = np.ones(len(t))
    for _ in range(rounds):
        miss = (p.T @ (t * r) - want) / size
        after = np.maximum(0, r - p @ miss)
        if np.abs(after - r).max() < 1e-12:
            break
        r = after
    return r


@pytest.mark.parametrize("targets", [[0.9, 0.05, 0.05], [0.2, 0.2, 0.6], [0.0, 0.5, 0.5], pytest.param([1.0, 0.0, 0.0], marks=pytest.mark.xfail(reason="known shortfall: 40 rounds end 0.0064 of all tokens from this unreachable target, brute force 0.0025"))])
def test_rates_are_as_near_as_brute_force(spark, targets):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    p[:20] = [0.5, 0.3, 0.2]
    t = rng.integers(1, 50, 200)
    soft = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p, strict=True)], "tokens bigint, p0 double, p1 double, p2 double")
    fitted = mixing.fit_rates(soft, 3, targets)
    want = np.array(fitted.wanted)
    r = np.array([x.r for x in soft.select(mixing.fold_rates([F.col(f"p{i}") for i in range(3)], fitted.steps).alias("r")).collect()])
    assert (r >= 0).all() and np.allclose(p.T @ (t * r), fitted.reached, rtol=1e-9)
    best = brute_rates(t.astype(float), p, want)
    off = lambda r: np.linalg.norm(p.T @ (t * r) - want) / t.sum()
    assert off(r) <= off(best) + 3e-3  # of all tokens, also where targets are out of reach
    assert fitted.met == bool((np.abs(np.array(fitted.reached) - want) <= mixing.TOLERANCE * np.where(want > 0, want, t.sum())).all())


def test_mixing_awkward_rows(spark):
    labels = spark.createDataFrame([(4, "clean"), (4, "junk"), (None, "junk"), (9, None)], "id bigint, domain string")
    assert mixing.mix(docs(spark, AWKWARD), labels).count() == len(AWKWARD)
    assert mixing.mix(docs(spark, AWKWARD).where("false"), labels).count() == 0
    assert mixing.apply(docs(spark, AWKWARD), labels.where("false")).columns == docs(spark, AWKWARD).columns


# Packing


def test_pieces_cover_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(i, t) for i, t in enumerate(dict.fromkeys(t for _, t in AWKWARD))] + [(1000 + i, f"number {i} of some " * (i % 37)) for i in range(300)]
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in texts}
    pieces = packing.pack(docs(spark, texts).repartition(2)).collect()
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        per_doc[r.doc_id].append(r)
        per_seq[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, rows in per_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for rows in per_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert set(per_doc) == set(ids)
    assert packing.pack(docs(spark, AWKWARD)).count() >= len(AWKWARD)
    assert packing.pack(docs(spark, AWKWARD).where("false")).count() == 0


def test_many_texts_are_encoded_together_as_the_tokenizer_does():
    """Whatever the texts and wherever lookups and generations of the memo end; a word reaches the model once, with and without signs."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(3)
    odd = ["", " \n", "don't it'll ''s '!s _x_ 12 a1b", "a\x00b \x07 c\x1cd", "ª º ² × ÷ é É ß į İ ſ", "日本 語", "<|endoftext|> x", "A" * 300, "e\u0301 \u00a0 \u2003x", "$$$ !!, (a)"] * 2
    texts = odd + [" ".join(rng.choice(("thing", "Größe", "l'été", "x9")) + rng.choice(("", ",", ".)", "'s")) for _ in range(rng.randrange(40))) for _ in range(60)]
    rng.shuffle(texts)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for cache, together in ((8, 1), (5, 7), (40, 64), (1000, 10_000)):
        encode = packing.WordEncoder(path, cache, look_up=together)
        for _ in range(2):
            assert [np.frombuffer(b, dtype="<u4").tolist() for b in encode.many(texts)] == want
        assert [encode(t) for t in texts[:5]] == [np.array(ids, dtype="<u4").tobytes() for ids in want[:5]]
    encode, asked = packing.WordEncoder(path), []
    real = encode._tokenize
    encode._tokenize = lambda word: asked.append(word) or real(word)
    list(encode.many(["thing thing, Thing.", "thing) other", "other, thing"]))
    assert sorted(asked) == [")", ",", ".", "other", "thing"]


def test_texts_that_the_tokenizer_takes_whole_do_not_pile_up():
    """No text waits for more than the next few, though none of them has stretches to look up."""
    encode, read = packing.WordEncoder(look_up=10), 0

    def texts():
        nonlocal read
        for _ in range(1000):
            read += 1
            yield "日本" if read % 2 else ""

    next(encode.many(texts()))
    assert read <= 20


def test_all_pairs_and_triples_of_frequent_lengths_are_patterns():
    h = np.random.default_rng(2).integers(0, 4, 64)
    frequent = {int(v) for v in np.argsort(-h[1:], kind="stable")[:5] + 1}
    have = [int(v) for v in np.flatnonzero(h) if v]
    want = {(64 - b, b, 0) for b in have if 2 * b <= 64 and 64 - b in have}
    want |= {tuple(sorted((a, b, 64 - a - b), reverse=True)) for a in have for b in have if 64 - a - b in have and {a, b, 64 - a - b} & frequent}
    assert {tuple(map(int, r)) for r in packing.patterns(h, 64, 5)} == want


def test_patterns_fill_the_window_and_respect_the_histogram():
    lengths = np.array([3000, 1096] * 10 + [2048] * 5 + [1000, 2000, 1096, 5, 4095, 1])
    h = np.bincount(lengths, minlength=4096)
    rows = packing.patterns(h, 4096)
    assert len(rows) and (rows.sum(axis=1) == 4096).all() and (h[rows[rows > 0]] > 0).all()
    x = packing.solve_counts(rows, h)
    assert (x >= 0).all() and x.max() > 5
    more = packing.solve_counts(rows, h, rounds=5000, still=1e-9)
    assert np.abs(x - more).max() < 0.5
    plan = packing.plan(lengths)
    assert sum(p[2] for p in plan) == lengths.sum()
    assert len({p[0] for p in plan}) == len(lengths) and len(plan) <= len(lengths) + 8


def test_runs_of_prose_are_not_written(spark, monkeypatch):
    """Prose beside licence words, and a header within it: only what may reach the threshold is written and compared."""
    rng = random.Random(5)
    prose = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(12))
    rows = [(i, f"a{i}/x.py", "\n".join([prose(), prose() + " licence " + prose(), prose(), prose(), prose(), prose(), prose(), "Released under the MIT License" if i % 4 == 0 else prose()])) for i in range(40)]
    written, real = {}, licenses.table
    monkeypatch.setattr(licenses, "table", lambda df, name, **k: written.setdefault(name, real(df, name, **k)))
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {i: "MIT" if i % 4 == 0 else None for i in range(40)}
    assert 10 <= written["licence-sentences"].count() <= 40  # with every run, more than 200
