"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax.

    P(word | before) = P(class of word | state) * P(word | class)

Word counts are taken over all training documents by a distributed aggregation. The ``head`` most frequent words
and the end token fall into classes: clusters of words that share contexts, cut into bands of frequency. Contexts are
counted over all training documents too: every task counts (head word, common word) pairs up to ``REACH`` words apart,
and the counts are summed in buckets of head words; the result is bounded by ``head`` x ``COMMON``.
All other words form the tail class, whose words are weighed by their exact counts, plus one, with one
share left for all unseen words. A gated recurrent network over class sequences predicts the next class.

Training is truncated back-propagation through time in numpy: the training documents are parted by a hash of the id
into as many shares as there are rounds, so that the network learns from every one. In a round every task trains on
its own part of the round's share, the parameters are averaged by the tokens trained on, and the next round starts from
the average with the next share. Scoring reads every text once, whole:
documents run in lanes, windows of steps at a time, with the state carried from window to window and reset
between documents. The terms of tail words do not depend on order, so their counts are joined afterwards,
as (document, word, times) rows; no vocabulary is broadcast but the bounded head.

Defined results: null and empty texts are the end token alone; without training documents all counts are 0
and the model falls back on its initial weights; rows of null id are training rows; repeated rows are scored
one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import table
from tidewire.llm._text import hash_bytes, lower, span_hashes, text_chunks, words

HEAD_WORDS = 1 << 16
CLUSTERS, BANDS = 8, 6
HIDDEN = 24
#: The training documents are dealt to this many rounds of training.
ROUNDS = 2
#: Streams that are long enough for MIN_UPDATES updates with more lanes train up to MOST_LANES at once.
WINDOW, TRAIN_LANES, MOST_LANES, SCORE_LANES = 32, 32, 256, 256
MIN_UPDATES = 120
#: Tokens that are scored together.
SCORE_TOKENS = 600_000
#: The most frequent words that make up a context, how far away they may be, and head words of a bucket.
COMMON, REACH, BUCKET = 160, 5, 128
END = np.uint64(0xE7037ED1A0B428DB)
_LN10 = np.log(10.0)


@dataclass
class Head:
    """The frequent words: hashes (sorted), counts, class, and log10 of the word's share of its class."""

    hashes: np.ndarray
    counts: np.ndarray
    cls: np.ndarray
    share: np.ndarray
    n_classes: int
    first: np.ndarray | None = field(default=None, repr=False, compare=False)  # for each value of the leading bits, where hashes from it on begin

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each word and whether it is there."""
        last = len(self.hashes) - 1
        if last < 0:
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        bits = (4 * last + 4).bit_length()
        if self.first is None:
            self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).clip(max=last).astype(np.int32)
        at = self.first[(h >> np.uint64(64 - bits)).view(np.int64)].astype(np.int64)
        # Few words share their leading bits; from the first of them it is no step, or a few.
        rest = np.flatnonzero(self.hashes[at] < h)
        while len(rest):
            rest = rest[at[rest] < last]
            at[rest] += 1
            rest = rest[self.hashes[at[rest]] < h[rest]]
        return at, self.hashes[at] == h


@dataclass
class Gru:
    """ex: input rows by class (with biases), u: recurrent weights, v, b: output weights. Gates in order update, reset, new."""

    ex: np.ndarray
    u: np.ndarray
    v: np.ndarray
    b: np.ndarray
    state: list = field(default_factory=list, repr=False)

    @classmethod
    def fresh(cls, n_classes: int, log_share: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> Gru:
        rng = np.random.Generator(np.random.PCG64(seed))
        f = np.float32
        return cls((rng.normal(0, 0.3, (n_classes, 3 * hidden))).astype(f), (rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))).astype(f), (rng.normal(0, 0.05, (hidden, n_classes))).astype(f), log_share.astype(f))

    def params(self) -> list[np.ndarray]:
        return [self.ex, self.u, self.v, self.b]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def unpack(self, flat: np.ndarray) -> Gru:
        out, at = [], 0
        for p in self.params():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Gru(*out)

    def steps(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """Run a window: inputs and fresh (reset before this step) are steps x lanes. Gives all states; with ``keep`` what back-propagation needs.

        Gates lie one behind the other (gate x lanes x units), so that each is worked on in one run."""
        n, (steps, lanes), kind = self.u.shape[0], inputs.shape, self.u.dtype
        ex = np.ascontiguousarray(self.ex.reshape(-1, 3, n).transpose(1, 0, 2))
        u = np.ascontiguousarray(self.u.reshape(n, 3, n).transpose(1, 0, 2))
        out = np.empty((steps, lanes, n), dtype=kind)
        gates, recurrent = (np.empty((steps if keep else 1, 3, lanes, n), dtype=kind) for _ in range(2))
        before, rows, resets, on = h, inputs.astype(np.intp), fresh.any(axis=1), ~fresh[:, :, None]
        for t in range(steps):
            if resets[t]:
                h = h * on[t]
            g, gh, o = gates[t if keep else 0], recurrent[t if keep else 0], out[t]
            np.matmul(h, u, out=gh)
            np.take(ex, rows[t], axis=1, out=g, mode="clip")
            zr, new = g[:2], g[2]
            zr += gh[:2]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            new += np.multiply(zr[1], gh[2], out=gh[1])
            np.tanh(new, out=new)
            np.subtract(h, new, out=o)
            o *= zr[0]
            o += new
            h = o
        return out, h, (np.concatenate([before[None], out[:-1]]) * on, gates[:, 0], gates[:, 1], gates[:, 2], recurrent[:, 2]) if keep else ()


def log_softmax_at(states: np.ndarray, v: np.ndarray, b: np.ndarray, target: np.ndarray) -> np.ndarray:
    # Classes x tokens: sums and maxima over classes go along whole rows.
    logits = v.T @ states.T
    logits += b[:, None]
    logits -= logits.max(axis=0)
    chosen = logits[target, np.arange(len(target))]
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(axis=0))


def gradients(model: Gru, inputs: np.ndarray, fresh: np.ndarray, target: np.ndarray, h0: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Gradients of the mean negative log-likelihood over a window, the state after it, and the loss."""
    steps, lanes = inputs.shape
    hid, n_classes = model.u.shape[0], len(model.b)
    states, h_end, (prev, z, r, new, ghn) = model.steps(inputs, fresh, h0, keep=True)
    flat = states.reshape(-1, hid)
    p = model.v.T @ flat.T  # classes x tokens
    p += model.b[:, None]
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    at = (target.ravel(), np.arange(len(flat)))
    loss = float(-np.log(np.maximum(p[at], 1e-30)).mean())
    p[at] -= 1
    p /= len(flat)
    dv, db = flat.T @ p.T, p.sum(axis=1)
    dout = (p.T @ model.v.T).reshape(steps, lanes, hid)
    # What the gradient of a state is multiplied by, for all steps at once.
    to_new = (1 - z) * (1 - new * new)
    to_z = (prev - new) * z * (1 - z)
    to_r = to_new * ghn * r * (1 - r)
    to_ghn = to_new * r
    dgx, dgh = np.empty((2, steps, lanes, 3 * hid), dtype=model.u.dtype)
    back, on = np.ascontiguousarray(model.u.T), ~fresh[:, :, None]
    resets = fresh.any(axis=1)
    dh = np.zeros((lanes, hid), dtype=model.u.dtype)
    for t in range(steps - 1, -1, -1):
        dh += dout[t]
        g = dgh[t]
        np.multiply(dh, to_z[t], out=g[:, :hid])
        np.multiply(dh, to_r[t], out=g[:, hid : 2 * hid])
        np.multiply(dh, to_ghn[t], out=g[:, 2 * hid :])
        np.multiply(dh, to_new[t], out=dgx[t, :, 2 * hid :])
        dh *= z[t]
        dh += g @ back
        if resets[t]:
            dh *= on[t]
    dgx[:, :, : 2 * hid] = dgh[:, :, : 2 * hid]
    du = prev.reshape(-1, hid).T @ dgh.reshape(-1, 3 * hid)
    one = np.zeros((steps * lanes, n_classes), dtype=np.float32)
    one[np.arange(steps * lanes), inputs.ravel()] = 1
    return [one.T @ dgx.reshape(-1, 3 * hid), du, dv, db], h_end, loss


def train_on(model: Gru, stream: np.ndarray, opens: np.ndarray, *, lanes: int = TRAIN_LANES, window: int = WINDOW, updates: int = MIN_UPDATES, rate: float = 0.01) -> Gru:
    """Truncated back-propagation over a stream of classes; ``opens`` marks the first token of each document."""
    end = 0
    n = len(stream)
    if not n:
        return model
    lanes = max(1, min(lanes, n // window), min(MOST_LANES, n // (window * updates)))
    per = -(-n // lanes)
    # The last lane is filled up from the beginning, so that no token is left out.
    target = np.resize(stream, per * lanes).reshape(lanes, per).T
    fresh = np.resize(opens, per * lanes).reshape(lanes, per).T.copy()
    inputs = np.empty_like(target)
    inputs[1:] = target[:-1]
    inputs[0] = end
    inputs[fresh] = end  # the end class before the first word
    m = [np.zeros_like(p) for p in model.params()]
    v = [np.zeros_like(p) for p in model.params()]
    step = 0
    params = [p.copy() for p in model.params()]
    passes = max(1, -(-updates // max(1, -(-per // window))))
    for _ in range(passes):
        h = np.zeros((lanes, model.u.shape[0]), dtype=np.float32)
        for a in range(0, per, window):
            current = Gru(*params)
            grads, h, _ = gradients(current, inputs[a : a + window], fresh[a : a + window], target[a : a + window], h)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            step += 1
            for i, g in enumerate(grads):
                g = g * scale
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] = (params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Gru(*params)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with the end token after each, and where each text's begin."""
    data = lower(data)
    starts, ends, per_text = words(data, offsets)
    h = span_hashes(data, starts, ends)
    n_docs = len(offsets) - 1
    first = per_text + np.arange(n_docs + 1)
    out = np.full(len(h) + n_docs, END, dtype=np.uint64)
    mask = np.ones(len(out), dtype=bool)
    mask[first[1:] - 1] = False
    out[mask] = h
    return out, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch, "body"):
            unique, n = np.unique(tokens(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])


def _clusters(contexts: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of context rows, started from rows far apart; rows without contexts join the heaviest cluster."""
    x = np.sqrt(contexts)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    some = norm[:, 0] > 0
    x[some] /= norm[some]
    if not some.any():
        return np.zeros(len(x), dtype=np.int64)
    mean = (x * weight[:, None]).sum(axis=0)
    centers = [mean / max(np.linalg.norm(mean), 1e-9)]
    near = x @ centers[0]
    solid = some & (contexts.sum(axis=1) >= 20)
    solid = solid if solid.any() else some
    while len(centers) < k:
        pick = int(np.argmin(np.where(solid, near, 2)))
        centers.append(x[pick])
        near = np.maximum(near, x @ centers[-1])
    c = np.stack(centers)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            total = (x[own == j] * weight[own == j, None]).sum(axis=0)
            if np.linalg.norm(total) > 0:
                c[j] = total / np.linalg.norm(total)
    own = np.argmax(x @ c.T, axis=1)
    own[~some] = np.bincount(own[some], weights=weight[some], minlength=k).argmax()
    return own


def _frequent(top: list) -> Head:
    """The head words, not yet in classes."""
    hashes = np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64)
    counts = np.array([r["c"] for r in top], dtype=np.int64)
    order = np.argsort(hashes)
    return Head(hashes[order], counts[order], np.full(len(top), 2, dtype=np.int64), np.zeros(len(top)), 3)


def _common(head: Head) -> np.ndarray:
    """Of each head word, which of the common ones it is; -1 if none. One more -1 stands for no word."""
    slot = np.full(len(head.hashes) + 1, -1, dtype=np.int64)
    common = np.argsort(-head.counts, kind="stable")[:COMMON]
    slot[common] = np.arange(len(common))
    return slot


def _contexts(head: Head):
    """Of a task's documents, the pairs (head word, common word) and their counts, packed by buckets of head words."""
    n = len(head.hashes)
    slot = _common(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * COMMON, dtype=np.int32)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "body"):
                h, first = tokens(data, offsets)
                at, there = head.look_up(h)
                # Gaps between documents and at both ends, so that no pair crosses from one to the next.
                spread = np.full(len(h) + REACH * (len(first) + 1), n, dtype=np.int64)
                spread[REACH + np.arange(len(h)) + REACH * np.repeat(np.arange(len(first) - 1), np.diff(first))] = np.where(there, at, n)
                common = slot[spread]
                where = np.flatnonzero(common >= 0)
                common = common[where]
                for gap in (*range(-REACH, 0), *range(1, REACH + 1)):
                    a = spread[where + gap]
                    ok = a < n
                    np.add.at(total, a[ok] * COMMON + common[ok], np.int32(1))
        code = np.flatnonzero(total)
        edges = np.searchsorted(code, np.arange(0, n + BUCKET, BUCKET) * COMMON)
        for k in range(len(edges) - 1):
            if edges[k + 1] > edges[k]:
                part = code[edges[k] : edges[k + 1]]
                packed = ((part - k * BUCKET * COMMON) << 32) | total[part]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed.astype("<i8").tobytes()], pa.binary())], ["bucket", "packed"])

    return run


def _sum_bucket(group: pa.Table) -> pa.Table:
    total = np.zeros(BUCKET * COMMON, dtype=np.int64)
    for blob in group.column("packed"):
        packed = np.frombuffer(blob.as_buffer(), dtype="<i8")
        total[packed >> 32] += packed & 0xFFFFFFFF  # a code occurs once in a blob
    return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def count_contexts(docs: DataFrame, top: list) -> np.ndarray:
    """How often each head word (by hash) stands near each common word, over all documents."""
    head = _frequent(top)
    out = np.zeros((-(-len(top) // BUCKET) * BUCKET, COMMON), dtype=np.float32)
    if not len(top):
        return out
    summed = docs.select("body").mapInArrow(_contexts(head), "bucket bigint, packed binary").groupBy("bucket").applyInArrow(_sum_bucket, "bucket bigint, counts binary")
    for batch in summed.toArrow().to_batches():  # as many as there are buckets of head words
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("counts"), strict=True):
            out[k * BUCKET : (k + 1) * BUCKET] = np.frombuffer(blob.as_buffer(), dtype=np.int64).reshape(BUCKET, COMMON)
    return out[: len(top)]


def make_head(top: list, contexts: np.ndarray, *, clusters: int = CLUSTERS, bands: int = BANDS) -> Head:
    """Classes of the frequent words, given their contexts. Class 0 is the end token, class 1 the tail."""
    words_ = _frequent(top)
    hashes, counts, cls = words_.hashes, words_.counts, words_.cls
    n_classes = 2 + clusters * bands
    if len(hashes):
        own = _clusters(contexts, counts.astype(np.float64), clusters)
        for j in range(clusters):
            inside = np.flatnonzero(own == j)
            inside = inside[np.argsort(-counts[inside], kind="stable")]
            mass = np.cumsum(counts[inside]) - counts[inside]
            cls[inside] = 2 + j * bands + np.minimum(bands - 1, (mass * bands // max(1, counts[inside].sum())).astype(np.int64))
        cls[hashes == END] = 0
    total = np.bincount(cls, weights=counts, minlength=n_classes)
    share = np.log10(counts / np.maximum(total[cls], 1)) if len(hashes) else np.zeros(0)
    return Head(hashes, counts, cls, share, n_classes)


def _classes(head: Head, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, there = head.look_up(h)
    cls = np.where(there, head.cls[at] if len(head.cls) else 1, 1)
    cls[(h == END) & ~there] = 0
    return cls, at, there


def _trainer(head: Head, model: Gru):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, seen, held, opens, size = model, 0, [], [], 0

        def learn():
            nonlocal trained
            trained = train_on(trained, np.concatenate(held), np.concatenate(opens))

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "body"):
                h, first = tokens(data, offsets)
                mark = np.zeros(len(h), dtype=bool)
                mark[first[:-1]] = True
                held.append(_classes(head, h)[0])
                opens.append(mark)
                size, seen = size + len(h), seen + len(h)
                if size >= 1_000_000:
                    learn()
                    held, opens, size = [], [], 0
        if size:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([trained.pack().astype(np.float64)], pa.list_(pa.float64()))], ["n", "w"])

    return run


@dataclass
class Model:
    head: Head
    gru: Gru
    counts: DataFrame
    n: int
    v: int
    tail_total: int
    tail_types: int
    trained: int  # tokens that the network learned from


def train(docs: DataFrame, *, head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> Model:
    """docs: id, body, the training documents."""
    counts = table(docs.select("body").mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    sizes = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sizes["n"]), int(sizes["v"])
    top = counts.orderBy(F.desc("c"), "h").limit(head_words).collect()  # bounded by head_words
    tail_total = n - sum(r["c"] for r in top)
    head = make_head(top, count_contexts(docs, top))
    mass = np.bincount(head.cls, weights=head.counts, minlength=head.n_classes).astype(np.float64) if len(head.cls) else np.zeros(head.n_classes)
    mass[1] = tail_total
    gru = Gru.fresh(head.n_classes, np.log((mass + 0.5) / (mass.sum() + 0.5 * head.n_classes)))
    trained = 0
    for i in range(rounds):
        slice_ = docs.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(rounds)) == i).select("body")
        learnt = slice_.mapInArrow(_trainer(head, gru), "n bigint, w array<double>")
        parts = learnt.select("n", F.posexplode("w").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
        rows = parts.orderBy("i").collect()  # as many as the network has parameters
        if rows:
            gru = gru.unpack(np.array([r["x"] for r in rows]))
            trained += int(rows[0]["n"])
    return Model(head, gru, counts, n, v, tail_total, v - len(top), trained)


def class_scores(gru: Gru, cls: np.ndarray, first: np.ndarray, *, lanes: int = SCORE_LANES, window: int = WINDOW) -> np.ndarray:
    """Natural-log likelihood of each document's class sequence; the state is carried through the whole document.

    Documents are dealt to lanes as long as the longest one; there are only as many lanes as keep what is laid out within
    about four times the tokens, so a long document beside short ones takes no more memory than its own length asks for."""
    sizes = np.diff(first)
    n_docs = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    lanes = max(1, min(lanes, n_docs, 4 * int(sizes.sum()) // max(1, int(sizes.max(initial=0)))))
    load = np.zeros(lanes, dtype=np.int64)
    members: list[list[int]] = [[] for _ in range(lanes)]
    import heapq

    heap = [(0, i) for i in range(lanes)]
    for d in order:
        total, i = heapq.heappop(heap)
        members[i].append(int(d))
        heapq.heappush(heap, (total + int(sizes[d]), i))
        load[i] = total + sizes[d]
    by_load = np.argsort(-load, kind="stable")
    members, load = [members[i] for i in by_load], load[by_load]
    longest = int(load[0]) if lanes else 0
    target = np.zeros((longest, lanes), dtype=np.int16)
    fresh = np.zeros((longest, lanes), dtype=bool)
    owner = np.full((longest, lanes), n_docs, dtype=np.int32)
    for i, docs in enumerate(members):
        at = 0
        for d in docs:
            n = int(sizes[d])
            target[at : at + n, i] = cls[first[d] : first[d + 1]]
            fresh[at, i] = True
            owner[at : at + n, i] = d
            at += n
    inputs = np.zeros_like(target)
    inputs[1:] = target[:-1]
    inputs[fresh] = 0
    out = np.zeros(n_docs + 1)
    h = np.zeros((lanes, gru.u.shape[0]), dtype=np.float32)
    for a in range(0, longest, window):
        live = int(np.searchsorted(-load, -a, side="left"))  # lanes with more than `a` tokens
        b = min(longest, a + window)
        states, h, _ = gru.steps(inputs[a:b, :live], fresh[a:b, :live], h[:live])
        logs = log_softmax_at(states.reshape(-1, states.shape[2]), gru.v, gru.b, target[a:b, :live].ravel())
        out += np.bincount(owner[a:b, :live].ravel(), weights=logs, minlength=n_docs + 1)
    return out[:n_docs]


_SCORED = "rid bigint, id bigint, held_out boolean, n_tokens bigint, model double, known_log double, n_head bigint, n_tail bigint, th array<bigint>, tn array<bigint>"


def _scorer(head: Head, gru: Gru):
    logs = np.log10(head.counts + 1.0)

    def score_some(parts: list, rid: int) -> pa.RecordBatch:
        """parts: (ids, held_out, token hashes, first token of each text) of consecutive texts."""
        h = np.concatenate([p[2] for p in parts])
        sizes = np.concatenate([np.diff(p[3]) for p in parts])
        first = np.concatenate(([0], np.cumsum(sizes)))
        n_docs = len(sizes)
        cls, where, there = _classes(head, h)
        model = class_scores(gru, cls, first) / _LN10
        doc = np.repeat(np.arange(n_docs), sizes)
        known = np.zeros(n_docs)
        if len(logs):
            model += np.bincount(doc[there], weights=head.share[where[there]], minlength=n_docs)
            known = np.bincount(doc[there], weights=logs[where[there]], minlength=n_docs)
        tail, tail_doc = h[~there], doc[~there]
        order = np.lexsort((tail, tail_doc))
        tail, tail_doc = tail[order], tail_doc[order]
        edge = np.ones(len(tail), dtype=bool)
        edge[1:] = (tail[1:] != tail[:-1]) | (tail_doc[1:] != tail_doc[:-1])
        spots = np.flatnonzero(edge)
        times = np.diff(np.concatenate((spots, [len(tail)])))
        splits = pa.array(np.searchsorted(tail_doc[spots], np.arange(n_docs + 1)).astype(np.int32))
        columns = [
            pa.array(np.arange(rid, rid + n_docs)), pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), pa.array(sizes), pa.array(model), pa.array(known),
            pa.array(np.bincount(doc[there], minlength=n_docs)), pa.array(np.bincount(doc[~there], minlength=n_docs)),
            pa.ListArray.from_arrays(splits, pa.array(tail[spots].view(np.int64))), pa.ListArray.from_arrays(splits, pa.array(times.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["rid", "id", "held_out", "n_tokens", "model", "known_log", "n_head", "n_tail", "th", "tn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rid = (context.partitionId() if context else 0) << 33
        parts: list = []
        held = 0
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "body"):
                h, first = tokens(data, offsets)
                parts.append((batch.column("id").slice(at, end - at), batch.column("held_out").slice(at, end - at), h, first))
                held += len(h)
                if held >= SCORE_TOKENS:
                    out = score_some(parts, rid)
                    rid, parts, held = rid + out.num_rows, [], 0
                    yield out
        if parts:
            yield score_some(parts, rid)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: id, body, held_out -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scored = table(docs.select("id", "body", "held_out").mapInArrow(_scorer(model.head, model.gru), _SCORED), "lm-scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("th", "tn")).alias("t")).select("rid", F.col("t.th").alias("h"), F.col("t.tn").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(model.counts, "h", "left").groupBy("rid").agg(F.sum(F.col("times") * F.log10(c + 1)).alias("tail_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    sums = table(sums, "lm-tails")
    whole = F.lit(float(np.log10(model.n + model.v + 1)))
    rare = F.lit(float(np.log10(model.tail_total + model.tail_types + 1)))
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    return scored.drop("th", "tn").join(sums, "rid", "left").select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_head") + tail_known).cast("bigint").alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("known_log") + tail_log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + tail_log - F.col("n_tail") * rare).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held: int = 2, head_words: int = HEAD_WORDS) -> DataFrame:
    """Train on the rows whose crc32 of the id as text is not ``held`` modulo ``folds``, and score all rows."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("body"))
    plain = plain.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)) == held, F.lit(False)))
    model = train(plain.where(~F.col("held_out")).select("id", "body"), head_words=head_words)
    return score(plain, model)


def word_hash(word: str) -> int:
    return hash_bytes(word.encode())
