"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. The score of a label is linear in features of the line and of
the lines before and after it; a transition matrix ties neighbouring labels. Forward-backward gives each
line's probability of being good, and the mean over lines, weighted by their length, is the document's score.

Training: labels are of documents, so those of lines are hidden. At first every line bears its document's label
and is learned by its own features alone (with neighbours or transitions, a document's lines would never differ). Then, in
turns, the lines of bad documents get the field's own marginals as labels, tilted towards bad as little as makes good lines
at most ``BAD_SHARE`` of the document's length, and the expected log-likelihood of the whole field is maximised by Adam in
numpy: good lines inside bad documents are learned as good, and so are the transitions between good and bad. In the end the
log-loss of the documents' own scores is lowered, through forward-backward, until bad documents are below ``ENOUGH``. Training reads a bounded sample of labelled
rows (``train_rows``, by a hash of the id), of which only the lines' own features reach the driver. Scoring is one pass over
all texts without a shuffle: a batch's lines are featurised from the Arrow buffer, each line's features are weighed
for itself and for its two neighbours at once, some lines at a time, and forward-backward runs over all
documents of a chunk in step, position by position.

Defined results: null or empty texts have one empty line and are scored like it; very long texts are scored
whole; labels that are null, and ids with labels that differ, are not learned from; without any label, or only one
kind, every score is the share of label 1 (1/2 without labels); repeated rows get equal scores; an empty table gives
an empty result; other columns are never read, and kept under whatever name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import agreed_labels
from tidewire.llm._text import span_hashes, text_chunks, words

TRAIN_ROWS = 6000
CUT = 0.3
#: Most of a bad document's length that its good lines take while it is learned from.
BAD_SHARE = 0.1
#: A bad document whose score is below is bad enough to be left as it is.
ENOUGH = 0.1
#: A tilt of a line's score that decides its label.
SURE = 30.0
#: Bytes of text, and lines, whose features are held at once.
CHUNK, LINES = 1 << 19, 1 << 14

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"-",
    "bang": b"!",
    "sign": b"%&$#*@+=~^_\\/",
    "bar": b"|",
    "bracket": b"<>{}[]()",
}
_LUTS = np.zeros((len(_CLASSES) + 2, 256), dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES.values()):
    _LUTS[_i, list(_chars)] = 1
_LUTS[-2, 97:123] = 1  # lower-case letters
_LUTS[-1, 128:192] = 1  # continuation bytes: one for each further byte of a non-ASCII character
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"!%&$#*@+=~^_|")] = True
_STEPS = (0.02, 0.1, 0.3)
BASE_FEATURES = (len(_CLASSES) + 2) + 6
OWN = BASE_FEATURES * (1 + len(_STEPS)) + 4
#: Weights of a line's own features, of those of the line before and after it, and a constant.
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of each line, see ``own_features``; weight of each line; number of lines before each text)."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")  # a break that ends a text opens an empty line
    # The line after a text's last break belongs to that text, and so comes before the next text's first.
    per_doc = 1 + np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=n_docs) if len(breaks) else np.ones(n_docs, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(per_doc)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    ends[-1] = len(data)
    last = first[1:] - 1
    cut = np.ones(len(starts), dtype=np.int64)
    cut[last] = 0
    ends -= cut  # without the break itself
    ends[last] = offsets[1:]
    ends = np.maximum(ends, starts)
    size = (ends - starts).astype(np.float32)
    n = len(starts)

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(values, out=sums[1:], dtype=np.int32)
        return (sums[ends] - sums[starts]).astype(np.float32)

    base = np.empty((n, BASE_FEATURES), dtype=np.float32)
    chars = np.maximum(size, 1)
    for i in range(len(_LUTS)):
        base[:, i] = within(_LUTS[i][data]) / chars
    k = len(_LUTS)
    w_start, w_end, _ = words(data, offsets)
    bounds = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    n_words = (bounds[1] - bounds[0]).astype(np.float32)
    per = np.maximum(n_words, 1)

    def of_words(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return (sums[bounds[1]] - sums[bounds[0]]).astype(np.float32)

    if len(w_start):
        h = span_hashes(data, w_start, w_end)
        again = np.zeros(len(h), dtype=bool)
        again[1:] = h[1:] == h[:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[2:] = again[2:] & again[1:-1]
        signed = _SIGN[data[w_end - 1]]
        lone = signed & (w_end - w_start == 1)
        loud = _LUTS[0][data[w_start]] & _LUTS[0][data[np.maximum(w_start + 1, 0).clip(max=len(data) - 1)]] & (w_end - w_start >= 3)
    else:
        again = twice = signed = lone = loud = np.zeros(0, dtype=bool)
    doubled = np.zeros(len(data), dtype=np.uint8)
    if len(data) > 1:
        doubled[1:] = (data[1:] == data[:-1]) & _SIGN[data[1:]]
    for j, values in enumerate((of_words(again) / per, of_words(twice) / per, of_words(signed) / per, of_words(lone) / per, of_words(loud) / per, np.minimum(1, within(doubled) / per))):
        base[:, k + j] = values
    return np.concatenate([base, (np.log1p(size) / 10)[:, None], (np.log1p(n_words) / 7)[:, None], np.minimum(1, size / per / 20)[:, None], (n_words == 0).astype(np.float32)[:, None]], axis=1), size + 1, first


def own_features(numbers: np.ndarray) -> np.ndarray:
    """A line's own features: its numbers, and which of the shares among them exceed some steps."""
    base = numbers[:, :BASE_FEATURES]
    return np.concatenate([base, *[(base > s).astype(np.float32) for s in _STEPS], numbers[:, BASE_FEATURES:]], axis=1)


def _from_before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's value taken from the line before it; 0 for a text's first line."""
    out = np.zeros_like(values)
    out[1:] = values[:-1]
    out[first[:-1]] = 0
    return out


def _from_after(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's value taken from the line after it; 0 for a text's last line."""
    out = np.zeros_like(values)
    out[:-1] = values[1:]
    out[first[1:] - 1] = 0
    return out


@dataclass
class Crf:
    weights: np.ndarray  # of label good against label bad
    trans: np.ndarray  # 2 x 2
    start: np.ndarray  # 2
    prior: float = 0.5

    def emissions(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of label good of each line, out of its features and its neighbours'."""
        w = self.weights[: 3 * OWN].reshape(3, OWN).T
        parts = [own_features(numbers[a : a + LINES]) @ w for a in range(0, len(numbers), LINES)]
        own = np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.float32)
        return (own[:, 0] + _from_before(own[:, 1], first) + _from_after(own[:, 2], first) + self.weights[-1]).astype(np.float64)

    def marginals(self, good: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label) of each line, the summed probabilities of label pairs, and the log of the normalisers' product."""
        emit = np.stack([np.zeros_like(good), good], axis=1)
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        begin, counts = first[:-1][order], counts[order]
        longest = int(counts[0]) if len(counts) else 0
        alive = [int(np.searchsorted(-counts, -t, side="left")) for t in range(longest)]  # texts of more than t lines
        top = emit.max(axis=1, keepdims=True)
        e = np.exp(emit - top)
        a_t = np.exp(self.trans)
        alpha, scale = np.empty_like(e), np.empty(len(e))
        for t in range(longest):
            rows = begin[: alive[t]] + t
            a = (np.exp(self.start) if t == 0 else alpha[rows - 1] @ a_t) * e[rows]
            s = a.sum(axis=1)
            alpha[rows], scale[rows] = a / s[:, None], s
        beta = np.ones_like(e)
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            rows = begin[: alive[t + 1]] + t
            b = beta[rows + 1] * e[rows + 1] / scale[rows + 1][:, None]
            pairs += (alpha[rows].T @ b) * a_t
            beta[rows] = b @ a_t.T
        return alpha * beta, pairs, float(np.log(scale).sum() + top.sum())

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, number of lines before each text, score of each text)."""
        numbers, weight, first = line_features(data, offsets)
        good = self.marginals(self.emissions(numbers, first), first)[0][:, 1]
        return good, first, np.clip(_weighted(good, weight, first), 0, 1)


def _weighted(values: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean of each text's lines, weighted by their length."""
    sums = np.concatenate(([0.0], np.cumsum(values * weight)))
    total = np.concatenate(([0.0], np.cumsum(weight, dtype=np.float64)))
    return (sums[first[1:]] - sums[first[:-1]]) / (total[first[1:]] - total[first[:-1]])


def _hidden(model: Crf, good: np.ndarray, weight: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected labels of all lines given their documents': (P(good) of each line, summed label pairs, summed first labels)."""
    each = np.repeat(np.arange(len(labels)), np.diff(first))
    sure = np.where(labels == 1, SURE, 0.0)
    over = lambda tilt: (labels == 0) & (_weighted(model.marginals(good + (sure - tilt)[each], first)[0][:, 1], weight, first) > BAD_SHARE)
    low, high = np.zeros(len(labels)), np.where(over(np.zeros(len(labels))), SURE, 0.0)
    for _ in range(8):  # each bad document's tilt by bisection
        middle = (low + high) / 2
        more = over(middle)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    p, pairs, _ = model.marginals(good + (sure - high)[each], first)
    return p[:, 1], pairs, p[first[:-1]].sum(axis=0)


def fit(numbers: np.ndarray, weight: np.ndarray, first: np.ndarray, labels: np.ndarray, *, steps: int = 100, rounds: int = 2, again: int = 40, last: int = 120, rate: float = 0.05, decay: float = 1e-4) -> Crf:
    """Maximum likelihood: of lines by themselves that bear the document's label, then of the label sequences expected under it."""
    share = float(labels.mean()) if len(labels) else 0.5
    model = Crf(np.zeros(FEATURES, dtype=np.float32), np.zeros((2, 2)), np.zeros(2), share)
    if not len(labels) or labels.min() == labels.max():
        model.weights[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    x = own_features(numbers)
    n, docs = len(numbers), len(labels)
    inner = np.diff(first) - 1
    y = np.repeat(labels, np.diff(first)).astype(np.float64)
    pairs_y = np.diag([inner[labels == 0].sum(), inner[labels == 1].sum()]).astype(np.float64)
    opening = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=np.float64)

    def emissions() -> np.ndarray:
        own = x @ model.weights[: 3 * OWN].reshape(3, OWN).T
        return (own[:, 0] + _from_before(own[:, 1], first) + _from_after(own[:, 2], first) + model.weights[-1]).astype(np.float64)

    theta = np.zeros(FEATURES + 6)
    each = np.repeat(np.arange(docs), inner + 1)
    share_of = weight / np.add.reduceat(weight, first[:-1])[each]  # of a line in its document's length

    def climb(steps: int, rate: float, gradient) -> None:
        """Adam along what ``gradient`` gives for line scores, label pairs and first labels."""
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            by_line, by_pair, by_start, scale = gradient(emissions())
            r = by_line.astype(np.float32)
            # A line's residual goes to its own features, and to its neighbours'.
            g_w = np.concatenate([x.T @ r, x.T @ _from_after(r, first), x.T @ _from_before(r, first), [r.sum()]]) / scale - decay * theta[:FEATURES]
            g = np.concatenate([g_w, by_pair.ravel() / scale - decay * theta[-6:-2], by_start / docs - decay * theta[-2:]])
            if alone:
                g[OWN : 3 * OWN] = g[-6:] = 0  # each line by itself
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta[:] += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.weights, model.trans, model.start = theta[:FEATURES].astype(np.float32), theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy()

    def likelihood(good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        p, pairs, _ = model.marginals(good, first)
        return y - p[:, 1], pairs_y - pairs, opening - p[first[:-1]].sum(axis=0), n

    def document(good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Of the log-loss of documents' scores. A score is linear in the marginals, whose derivatives are covariances of the
        labels: along one direction, those are a difference of two runs of forward-backward."""
        value = np.clip(_weighted(model.marginals(good, first)[0][:, 1], weight, first), 1e-3, 1 - 1e-3)
        pull = np.where(labels == 1, 1 / value, np.where(value > ENOUGH, -1 / (1 - value), 0.0))
        way = pull[each] * share_of
        tiny = 1e-4 / max(1e-9, float(np.abs(way).max()))
        (p, up, _), (q, down, _) = (model.marginals(good + t * way, first) for t in (tiny, -tiny))
        return (p - q)[:, 1] / (2 * tiny), (up - down) / (2 * tiny), (p - q)[first[:-1]].sum(axis=0) / (2 * tiny), docs

    alone = True
    climb(steps, rate, likelihood)
    alone = False
    for _ in range(rounds):
        y, pairs_y, opening = _hidden(model, emissions(), weight, first, labels)
        climb(again, rate / 3, likelihood)
    climb(last, rate / 5, document)
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in text_chunks(batch, "body", CHUNK):
            numbers, weight, first = line_features(data, offsets)
            rows = np.concatenate([numbers, weight[:, None]], axis=1).astype(np.float32)
            blobs = [rows[first[i] : first[i + 1]].tobytes() for i in range(end - at)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, end - at), pa.array(blobs, pa.binary())], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Crf:
    """docs: id, body. labels: id, label (0 or 1), rows to learn from only."""
    sample = agreed_labels(labels).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    # At most `train_rows` ids and labels are broadcast.
    chosen = docs.join(F.broadcast(sample), "id").select(F.col("label").cast("int").alias("label"), "body")
    got = chosen.mapInArrow(_featurise, "label int, x binary").toArrow()
    labels_ = np.array(got.column("label").to_pylist(), dtype=np.int64)
    width = BASE_FEATURES + 5
    parts = [np.frombuffer(b, dtype=np.float32).reshape(-1, width) for b in got.column("x").to_pylist()]
    rows = np.concatenate(parts) if parts else np.zeros((0, width), dtype=np.float32)
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return fit(rows[:, :-1], rows[:, -1], first, labels_)


def score(docs: DataFrame, model: Crf, *, cut: float = CUT) -> DataFrame:
    """docs: id, body -> id, n_lines, n_bad_lines, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "body", CHUNK):
                good, first, value = model.read(data, offsets)
                bad = np.concatenate(([0], np.cumsum(good < 0.5)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, end - at), pa.array(np.diff(first)), pa.array(bad[first[1:]] - bad[first[:-1]]), pa.array(value), pa.array((value >= cut).astype(np.int32))],
                    ["id", "n_lines", "n_bad_lines", "score", "predicted"],
                )

    return docs.select("id", "body").mapInArrow(run, "id bigint, n_lines bigint, n_bad_lines bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Crf, text_col: str = "text", *, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``cut``. One pass without a shuffle."""
    hidden = "_quality_text"
    while hidden in {c.lower() for c in docs.columns}:
        hidden += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.drop_columns([hidden])
            for at, end, data, offsets in text_chunks(batch, hidden, CHUNK):
                yield rows.slice(at, end - at).filter(pa.array(model.read(data, offsets)[2] >= cut))

    return docs.withColumn(hidden, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, train_rows: int = TRAIN_ROWS, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_lines, n_bad_lines.

    Rows whose crc32 of the id as text is 0 modulo ``folds`` are held out of the training.
    """
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds))
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where(fold != 0)
    model = train(plain, known, train_rows=train_rows)
    return score(plain, model).select(F.col("id").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")
