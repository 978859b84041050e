"""Quality, toxicity and language models: exactness of the numerics, held-out accuracy, awkward rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_rows import AWKWARD, docs
from tidewire.llm import lm, quality, queries, toxicity
from tidewire.llm._text import hash_bytes, lower, span_hashes, words

SF = "/root/testdata/sf0.01"


def test_words_and_hashes_agree_with_python():
    texts = ["Hello  World\tx", "", "é É ", "a\x0bb\x0cc\x1fd", "same same"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    low = lower(data)
    starts, ends, per = words(low, offsets)
    got = [[low[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in itertools.pairwise(per)]
    assert got == [r.lower().split() for r in raw]
    h = span_hashes(low, starts, ends)
    assert h[-1] == h[-2] and int(h[0]) == hash_bytes(b"hello") and len(set(h.tolist())) == len({w for g in got for w in g})


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    x, first = rng.normal(size=(7, 3)).astype(np.float32), np.array([0, 3, 4, 7])
    m = quality.Crf(rng.normal(size=3).astype(np.float32), rng.normal(size=(2, 2)), rng.normal(size=2))
    p, pairs, log_z = m.marginals((x @ m.weights).astype(np.float64), first)
    total, all_pairs = 0.0, np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        scores, z = {}, 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            s = m.start[y[0]] + sum(float(x[a + k] @ m.weights) * y[k] for k in range(b - a)) + sum(m.trans[u, v] for u, v in itertools.pairwise(y))
            scores[y] = math.exp(s)
            z += scores[y]
        total += math.log(z)
        for k in range(b - a):
            assert abs(sum(v for y, v in scores.items() if y[k]) / z - p[a + k, 1]) < 1e-6
        for y, v in scores.items():
            for u, w in itertools.pairwise(y):
                all_pairs[u, w] += v / z
    assert abs(total - log_z) < 1e-6 and np.allclose(pairs, all_pairs)


def test_line_features_split_like_python():
    texts = ["one two\nTHREE!!\n", "", "\n\n", "x"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    x, weight, first = quality.line_features(data, offsets)
    assert np.diff(first).tolist() == [len(t.split("\n")) for t in texts]
    assert (weight - 1).tolist() == [float(len(line)) for t in texts for line in t.split("\n")]
    assert quality.own_features(x).shape[1] == quality.OWN


def _lines(texts):
    raw = [t.encode() for t in texts]
    return quality.line_features(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))


def test_lines_are_weighed_with_their_neighbours(monkeypatch):
    numbers, _, first = _lines(["one two\nTHREE!!\n", "", "a b c\n\nd $$$ e", "x"])
    rng = np.random.default_rng(4)
    m = quality.Crf(rng.normal(size=quality.FEATURES).astype(np.float32), np.zeros((2, 2)), np.zeros(2))
    own, zero = quality.own_features(numbers), np.zeros(quality.OWN, dtype=np.float32)
    want = []
    for a, b in itertools.pairwise(first):
        for i in range(a, b):
            row = np.concatenate([own[i], own[i - 1] if i > a else zero, own[i + 1] if i + 1 < b else zero, [1]])
            want.append(float(row @ m.weights))
    for lines in (quality.LINES, 2):
        monkeypatch.setattr(quality, "LINES", lines)
        assert np.allclose(m.emissions(numbers, first), want, atol=1e-4)


def test_chain_labels_the_lines_of_mixed_documents():
    """Documents are labelled; bad ones hold a good line, somewhere in the middle. The field tells the lines apart and learns switches."""
    rng = np.random.default_rng(6)
    vocab = [f"{c}{v}{d}" for c in "bdklmnrst" for v in "aeiou" for d in "nrst"]
    good = lambda: " ".join(rng.choice(vocab, rng.integers(8, 16))) + "."
    bad = lambda: " ".join(["BUY!!!", "$$$", "###", "NOW!!"][int(k)] for k in rng.integers(0, 4, rng.integers(12, 20)))
    texts, labels, truth = [], [], []
    for k in range(300):
        runs = [1] * 8 if k % 2 else [0] * 6 + [1] + [0] * 6
        texts.append("\n".join(good() if r else bad() for r in runs))
        labels.append(k % 2)
        truth += runs
    numbers, weight, first = _lines(texts)
    model = quality.fit(numbers, weight, first, np.array(labels))
    marginals, pairs, _ = model.marginals(model.emissions(numbers, first), first)
    p = marginals[:, 1]
    assert ((p >= 0.5) == np.array(truth, dtype=bool)).mean() > 0.95
    assert 90 < pairs[0, 1] < 180 and 90 < pairs[1, 0] < 180  # each of 150 bad documents switches twice; without hidden labels, none does
    assert (((quality._weighted(p, weight, first)) >= quality.CUT) == np.array(labels)).mean() > 0.95


def test_quality_keeps_columns_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "a fine line of text", "x"), (2, None, None)], "doc_id bigint, text string, _QUALITY_TEXT string")
    model = quality.Crf(np.zeros(quality.FEATURES, dtype=np.float32), np.zeros((2, 2)), np.zeros(2))
    assert sorted(map(tuple, quality.keep_good(df, model).collect())) == [(1, "a fine line of text", "x"), (2, None, None)]


def test_a_text_of_many_lines_takes_little_memory():
    import tracemalloc

    data, offsets = np.frombuffer(b"\n" * 60_000, dtype=np.uint8), np.array([0, 60_000])
    model = quality.Crf(np.zeros(quality.FEATURES, dtype=np.float32), np.zeros((2, 2)), np.zeros(2))
    tracemalloc.start()
    assert model.read(data, offsets)[2].tolist() == [0.5]
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_that_differ_are_not_learned_from(spark, module):
    df = spark.createDataFrame([(i, f"plain words {i}") for i in range(20)], "doc_id bigint, text string")
    both = spark.createDataFrame([(i, y, y) for i in range(20) for y in (0, 1)], "doc_id bigint, quality int, toxic int")
    assert all(abs(r.score - 0.5) < 0.01 for r in module.classify(df, both).collect())


def _held_out(spark, name, label):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    pairs = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality_on_held_out_rows(spark):
    assert _held_out(spark, "op7_quality_classifier", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert _held_out(spark, "op10_toxicity", "toxic") > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_awkward_rows(spark, module):
    df = docs(spark, AWKWARD)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int").selectExpr("doc_id", "quality", "quality toxic")
    out = module.classify(df, none).collect()
    assert len(out) == len(AWKWARD) and all(abs(r.score - 0.5) < 0.01 for r in out)
    assert module.classify(df.where("false"), none).count() == 0


def insults():
    plain = ("you are an idiot and a moron with a loser smile and scum worthless idiot moron loser stupid " * 50).encode()
    return toxicity.CharModel.of_counts(toxicity.char_counts(np.frombuffer(plain, dtype=np.uint8)))


def known_words(*spelt):
    data = np.frombuffer("".join(spelt).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in spelt])
    return np.sort(toxicity.skeletons(data, ends - np.array([len(w) for w in spelt]), ends))


def test_disguises_are_undone():
    model = insults()
    got = toxicity.restore(["An 1d10t, a m0r0n! i d i o t idiooot l.o.s.e.r l*ser scum!!! it's 2024 st-u-pid"], model)[0].split()
    assert got[:6] == ["an", "idiot", "a", "moron", "idiot", "idiot"] and got[6:9] == ["loser", "loser", "scum!!!"]
    assert got[9:] == ["it's", "2024", "stupid"]


def test_weak_disguises_of_lexicon_words_are_undone():
    model, known = insults(), known_words("idiot", "stupid", "scum", "moron", "loser")
    text = "id-iot sc.um iddiott stvpid $cum lo$er$ well-known"
    assert toxicity.restore([text], model, known)[0].split()[:4] == ["idiot", "scum", "idiot", "stupid"]
    assert toxicity.restore(["well-known letter"], model, known)[0] == "well-known letter"
    assert toxicity.restore(["a s t u p i d i d i o t"], model, known)[0] == "a stupid idiot"
    assert toxicity.restore(["$$$$cum"], model)[0] == "scum"


def brute_decode(observed, model, parts):
    """The best value over all paths, one by one."""
    best = -math.inf

    def walk(k, a, b, value):
        nonlocal best
        if k == len(observed):
            best = max(best, value + model.log[a, b, 0])
            return
        ch, last = observed[k], observed[k - 1] if k else ""
        for x, y, v in [(a, b, value), *([(0, 0, value + model.log[a, b, 0] - toxicity.COST_WORD)] if parts and b else [])]:
            for letter in toxicity.LOOKS.get(ch, ch if ch.isalpha() else ""):
                c = ord(letter) - 96
                walk(k + 1, y, c, v + model.log[x, y, c] - (toxicity.COST_SIGN if letter != ch else 0) - (toxicity.COST_KEEP_REPEAT if ch == last else 0))
            if ch.isalpha():
                if ch == last or (y and toxicity.LETTERS[y - 1] == ch):
                    walk(k + 1, x, y, v - toxicity.COST_DROP_REPEAT)
            elif not ch.isdigit() or ch == last:
                walk(k + 1, x, y, v - (toxicity.COST_DROP_REPEAT if ch == last else toxicity.COST_DROP_SIGN))

    walk(0, 0, 0, 0.0)
    return best


@pytest.mark.parametrize("parts", [False, True])
def test_decoding_equals_enumeration(parts):
    rng = np.random.default_rng(9)
    model = toxicity.CharModel.of_counts(rng.integers(0, 50, toxicity._N**3))
    for _ in range(60):
        word = "".join(rng.choice(list("aabuvo0016*!.$e"), rng.integers(1, 7)))
        want, (value, text) = brute_decode(word, model, parts), toxicity.viterbi(word, model, parts)
        assert (want == value == -math.inf) or abs(want - value) < 1e-9, (word, want, value, text)


def test_skeletons_ignore_what_the_channel_may_change():
    spelt = ["idiot", "iddiott", "id-iot", "i.d.i.oo.t", "voov", "uou", "idiots"]
    data = np.frombuffer(" ".join(spelt).encode(), dtype=np.uint8)
    starts = np.array([" ".join(spelt).index(w) if k == 0 else len(" ".join(spelt[:k])) + 1 for k, w in enumerate(spelt)])
    h = toxicity.skeletons(data, starts, starts + np.array([len(w) for w in spelt]))
    assert len(set(h[:4].tolist())) == 1 and h[4] == h[5] and h[6] not in h[:6]


def test_gru_gradients_equal_differences():
    rng = np.random.default_rng(2)
    m = lm.Gru.fresh(5, np.zeros(5), hidden=4)
    m = lm.Gru(*[p.astype(np.float64) + rng.normal(0, 0.3, p.shape) for p in m.params()])
    inputs, target = rng.integers(0, 5, (6, 3)), rng.integers(0, 5, (6, 3))
    fresh = rng.random((6, 3)) < 0.3
    h0 = rng.normal(size=(3, 4))
    grads, _, _ = lm.gradients(m, inputs, fresh, target, h0)
    for k, g in enumerate(grads):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            params = [p.copy() for p in m.params()]
            losses = []
            for d in (1e-3, -1e-3):
                params[k][at] = m.params()[k][at] + d
                losses.append(lm.gradients(lm.Gru(*params), inputs, fresh, target, h0)[2])
            assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 2e-3


def test_head_words_are_found_by_their_leading_bits(monkeypatch):
    """What a binary search of all hashes gives, also where they crowd; and no word is searched for so."""
    rng = np.random.default_rng(8)
    top = np.uint64(2**64 - 1)
    spread = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    crowd = np.uint64(7) << np.uint64(60) | np.arange(0, 600, 3, dtype=np.uint64)
    for hashes in (spread, crowd, np.concatenate([spread, crowd, [np.uint64(0), top]]), spread[:1], np.array([top]), spread[:0]):
        hashes = np.unique(hashes)
        words_ = np.concatenate([hashes, rng.integers(0, 2**64, 3000, dtype=np.uint64), crowd + np.uint64(1), [np.uint64(0), top]])
        zeros = np.zeros(len(hashes), dtype=np.int64)
        head = lm.Head(hashes, zeros, zeros, zeros, 3)
        at, there = head.look_up(words_)
        assert there.tolist() == np.isin(words_, hashes).tolist()
        if len(hashes):
            assert at.tolist() == np.searchsorted(hashes, words_).clip(max=len(hashes) - 1).tolist()
        with monkeypatch.context() as m:
            m.setattr(np, "searchsorted", None)
            assert head.look_up(words_)[1].tolist() == there.tolist()


def test_a_window_of_steps_is_the_plain_recurrence():
    """With and without what back-propagation needs, with resets and with one lane."""
    rng = np.random.default_rng(12)
    sig = lambda x: 1 / (1 + np.exp(-x))
    for lanes in (1, 4):
        m = lm.Gru(*[p.astype(np.float64) + rng.normal(0, 0.3, p.shape) for p in lm.Gru.fresh(5, np.zeros(5), hidden=3).params()])
        inputs, fresh, h = rng.integers(0, 5, (7, lanes)), rng.random((7, lanes)) < 0.3, rng.normal(size=(lanes, 3))
        start, want, before, gates = h.copy(), [], [], []
        for t in range(7):
            h = np.where(fresh[t][:, None], 0, h)
            x, u = m.ex[inputs[t]], h @ m.u
            z, r = sig(x[:, :3] + u[:, :3]), sig(x[:, 3:6] + u[:, 3:6])
            new = np.tanh(x[:, 6:] + r * u[:, 6:])
            before.append(h)
            gates.append((z, r, new, u[:, 6:]))
            h = z * h + (1 - z) * new
            want.append(h)
        for keep in (False, True):
            out, end, tape = m.steps(inputs, fresh, start, keep=keep)
            assert np.allclose(out, want) and np.allclose(end, h) and np.allclose(start, m.steps(inputs[:0], fresh[:0], start)[1])
        for got, plain in zip(tape, [before, *zip(*gates, strict=True)], strict=True):
            assert np.allclose(got, plain)


def test_lane_scores_equal_one_by_one():
    rng = np.random.default_rng(3)
    m = lm.Gru.fresh(6, np.zeros(6), hidden=5)
    sizes = [1, 70, 3, 200, 9, 33]
    first = np.cumsum([0, *sizes])
    cls = rng.integers(0, 6, first[-1])
    got = lm.class_scores(m, cls, first, lanes=3, window=16)
    for d, (a, b) in enumerate(itertools.pairwise(first)):
        h, prev, total = np.zeros((1, 5), dtype=np.float32), 0, 0.0
        for c in cls[a:b]:
            states, h, _ = m.steps(np.array([[prev]]), np.zeros((1, 1), dtype=bool), h)
            total += float(lm.log_softmax_at(states[0], m.v, m.b, np.array([c]))[0])
            prev = c
        assert abs(total - got[d]) < 1e-3


def test_a_long_document_among_short_ones_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    m = lm.Gru.fresh(6, np.zeros(6), hidden=4)
    sizes = [200_000, *[20] * 300]
    first = np.cumsum([0, *sizes])
    tracemalloc.start()
    got = lm.class_scores(m, rng.integers(0, 6, first[-1]), first)
    assert tracemalloc.get_traced_memory()[1] < 60e6 and (got < 0).all()
    tracemalloc.stop()


def test_base_scores_equal_plain_counting(spark):
    texts = [*AWKWARD, *[(100 + i, f"the cat {i % 9} sat on the mat {i}") for i in range(60)]]
    got = lm.score_documents(docs(spark, texts), head_words=8).collect()
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 4)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(docs(spark, texts).where("false")).count() == 0


def test_contexts_are_counted_over_all_documents(spark):
    texts = [*AWKWARD, *[(100 + i, f"the cat{i} sat on the mat{i % 7} the end") for i in range(60)], (900, "a rare" + " the long tail" * 3000)]
    df = docs(spark, texts).selectExpr("doc_id id", "text body")
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    code = lambda w: int(lm.END if w is None else np.uint64(hash_bytes(w)))
    counts, pairs = Counter(), Counter()
    for _, t in texts:
        h = [code(w) for w in toks(t)]
        counts.update(h)
        pairs.update((h[i], h[j]) for i in range(len(h)) for j in range(max(0, i - 5), min(len(h), i + 6)) if i != j)
    top = [{"h": int(np.uint64(h).view(np.int64)), "c": c} for h, c in counts.items()]
    got = lm.count_contexts(df.repartition(3), top)
    head = lm._frequent(top)
    slot = lm._common(head)
    common = {int(s): int(h) for h, s in zip(head.hashes, slot, strict=False) if s >= 0}
    want = [[pairs[int(h), common[s]] if s in common else 0 for s in range(lm.COMMON)] for h in head.hashes]
    assert got.tolist() == want and (got.sum(axis=1) > 0).sum() == sum(any(r) for r in want) > 60


def test_network_learns_from_every_training_document(spark):
    texts = [*AWKWARD, *[(100 + i, f"the cat{i} sat on the mat " * (i % 5)) for i in range(200)]]
    model = lm.train(docs(spark, texts).selectExpr("doc_id id", "text body"), head_words=50)
    assert model.trained == model.n == sum(len((t or "").encode().lower().split()) + 1 for _, t in texts)


@pytest.mark.parametrize("n", [1, 31, 70, 2050])
def test_no_token_of_a_stream_is_left_out(monkeypatch, n):
    seen = []

    def spy(model, inputs, fresh, target, h0):
        seen.append(target.ravel())
        return [np.zeros_like(p) for p in model.params()], h0, 0.0

    monkeypatch.setattr(lm, "gradients", spy)
    lm.train_on(lm.Gru.fresh(5, np.zeros(5), hidden=4), np.arange(n), np.arange(n) == 0, updates=1)
    assert set(np.concatenate(seen).tolist()) == set(range(n))


def test_model_beats_the_base(spark):
    got = queries.QUERIES["op8_lm_scoring"](spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
