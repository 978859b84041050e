"""Toxicity through a noisy channel: decode disguised words, then score the restored text.

Writers disguise words by look-alike signs (1d10t), by parting the letters (i d i o t, i.d.i.o.t) and by
repeating them (idiooot). Every word or run of single letters that shows such signs becomes a lattice: each
observed character offers the letters it may stand for, with a channel cost, and between single letters a word may
end. Viterbi decoding under a character trigram model, counted over all words of all documents, picks the likeliest
restored word or words; its states are pairs of letters, all of which are kept. The restored text's words are looked
up in a lexicon of words that mark label 1, learned from labelled rows, and a logistic model over the evidence gives
the score.

Which words are decoded: those with a look-alike sign next to a letter, two parting signs, or a letter thrice; and, as
doubled letters, u for v and single parting signs are common in plain words, those others that could be restored to
a word of the lexicon at all: the channel may drop repeats and parting signs and swap u and v, so they share its
skeleton, the word without any of these. Each distinct word is decoded once per task. All passes read whole texts from Arrow buffers without a shuffle of texts; what is shuffled are
word counts of the labelled sample. The lexicon is bounded (``lexicon_words``), the character model is 29^3
numbers, the labelled sample is ``train_rows`` rows by a hash of the id.

Defined results: null or empty texts are scored like a text without evidence; labels that are null are not
learned from; without any label, or only one kind, every score is the share of label 1 (1/2 without labels);
repeated rows get equal scores; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import agreed_labels
from tidewire.llm._text import hash_bytes, lower, span_hashes, text_chunks, words

TRAIN_ROWS = 20_000
LEXICON_WORDS = 2000
CUT = 0.5

# Signs that stand for letters, and the signs that may part letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "%": "", "&": "",
    "*": "aeiouy", "?": "", "^": "a", "v": "vu", "u": "uv",
}
PARTING = b".-_*,~'`/\\:;|+^=\""
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Character classes of the model: 0 word edge, 1-26 letters, 27 any other letter.
_CLASS = np.zeros(256, dtype=np.int64)
for _c in LETTERS:
    _CLASS[ord(_c)] = ord(_c) - 96
_CLASS[128:] = 27
_N = 28
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[ord(c) for c in LOOKS if not c.isalpha()]] = True
_PART = np.zeros(256, dtype=bool)
_PART[list(PARTING)] = True
_OPENING, _CLOSING = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_OPENING[list(b"$@!(|+*")] = True
_CLOSING[list(b"$@")] = True
#: Decoded words that a task keeps before it starts afresh.
DECODED_WORDS = 200_000
COST_SIGN, COST_DROP_REPEAT, COST_DROP_SIGN, COST_KEEP_REPEAT, COST_WORD = 0.7, 0.2, 1.0, 0.1, 0.5


def cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the signs around them; a word of signs alone becomes empty."""
    plain = _LETTER[data] | ((data >= 48) & (data <= 57))
    left = np.concatenate(([0], np.cumsum(plain)))
    spots = np.flatnonzero(plain)
    a, b = left[starts], left[ends]
    some = b > a
    s, e = starts.copy(), starts.copy()
    s[some], e[some] = spots[a[some]], spots[b[some] - 1] + 1
    return s, e


@dataclass
class CharModel:
    """log P(next class | two classes before), interpolated."""

    log: np.ndarray
    decoded: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"log": self.log, "decoded": {}}

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> CharModel:
        c3 = counts.reshape(_N, _N, _N).astype(np.float64)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1 + 1).sum()
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        return cls(np.log(p3))


def char_counts(data: np.ndarray) -> np.ndarray:
    """Trigram counts of classes over all runs of letters (lower-case bytes), with two edges before each."""
    if len(data) < 3:
        return np.zeros(_N**3, dtype=np.int64)
    c = _CLASS[data]
    counts = np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3).reshape(_N, _N, _N)
    counts[0, 0] = counts[:, 0].sum(axis=0)  # whatever stood before the edge is none of the word's business
    counts[1:, 0] = 0
    counts[0, 0, 0] = 0
    return counts.ravel()


def viterbi(observed: str, model: CharModel, parts: bool = False) -> tuple[float, str]:
    """Value and text of the likeliest restored word for an observed one (lower-case); with ``parts``, words with blanks between.

    A state is the last two classes; what else a step looks at is the observed character before, which all paths share.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    last = ""
    for ch in observed:
        if parts:
            ends = [(value + float(model.log[a, b, 0]) - COST_WORD, text + " ") for (a, b), (value, text) in states.items() if b]
            if ends and max(ends)[0] > states.get((0, 0), (-math.inf, ""))[0]:
                states = states | {(0, 0): max(ends)}
        after: dict[tuple[int, int], tuple[float, str]] = {}

        def offer(key: tuple[int, int], value: float, text: str, after=after) -> None:
            if key not in after or after[key] < (value, text):
                after[key] = (value, text)

        letter_like = ch.isalpha()
        options = LOOKS.get(ch, ch if letter_like else "")
        for (a, b), (value, text) in states.items():
            for letter in options:
                c = ord(letter) - 96 if "a" <= letter <= "z" else 27
                cost = (0.0 if letter == ch else COST_SIGN) + (COST_KEEP_REPEAT if last == ch else 0.0)
                offer((b, c), value + float(model.log[a, b, c]) - cost, text + letter)
            if letter_like:
                if last == ch or (0 < b < 27 and LETTERS[b - 1] == ch):
                    offer((a, b), value - COST_DROP_REPEAT, text)
            elif not ch.isdigit() or last == ch:
                offer((a, b), value - (COST_DROP_REPEAT if last == ch else COST_DROP_SIGN), text)
        if not after:
            return -math.inf, ""
        states, last = after, ch
    value, text = max((value + float(model.log[a, b, 0]), text) for (a, b), (value, text) in states.items())
    return value, text.strip()


def decode(observed: str, model: CharModel, parts: bool = False) -> str:
    return viterbi(observed, model, parts)[1]


def _run_before(of: np.ndarray) -> np.ndarray:
    """At each place, and behind the last, the length of the run of ``of`` that ends right before it."""
    spots = np.arange(len(of) + 1)
    fresh = np.where(np.concatenate(([True], ~of)), spots, 0)
    return spots - np.maximum.accumulate(fresh)


def bodies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation around them, but with the edge signs that look like letters."""
    s, e = cores(data, starts, ends)
    some = e > s
    opening = np.minimum(_run_before(_OPENING[data])[s], s - starts)
    closing = np.minimum(_run_before(_CLOSING[data][::-1])[::-1][e], ends - e)
    return s - np.where(some, opening, 0), e + np.where(some, closing, 0)


def skeletons(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words without parting signs and repeats, v as u."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    word = np.zeros(len(data) + 1, dtype=np.int32)
    word[starts] = 1
    word = np.cumsum(word)[:-1]  # which word a byte is in, counted from 1; what lies between words does not matter
    keep = ~_PART[data]
    plain, of = data[keep], word[keep]
    again = np.zeros(len(plain), dtype=bool)
    plain = np.where(plain == 118, np.uint8(117), plain)
    again[1:] = (plain[1:] == plain[:-1]) & (of[1:] == of[:-1])
    kept = np.concatenate(([0], np.cumsum(keep)))
    single = np.concatenate(([0], np.cumsum(~again)))
    return span_hashes(plain[~again], single[kept[starts]], single[kept[ends]])


def disguised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bodies show a sign of disguise: a letter next to a look-alike sign, letters parted twice, or a letter thrice."""
    n = len(data)
    if n < 2 or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    letter, sign, part = _LETTER[data], _SIGNS[data], _PART[data]

    def inside(spots: np.ndarray, shift: int) -> np.ndarray:
        """How many spots whose ``shift`` bytes before also belong to the word."""
        sums = np.concatenate(([0], np.cumsum(spots, dtype=np.int32)))
        return sums[ends] - sums[np.minimum(starts + shift, ends)]

    pair = np.zeros(n, dtype=bool)
    pair[1:] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    triple = np.zeros(n, dtype=bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & (data[2:] < 128)
    return ((inside(pair, 1) > 0) | (inside(part, 0) > 1) | (inside(triple, 2) > 0)) & (inside(letter, 0) > 0)


def single_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_text: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end word) of runs of three or more words of one letter or sign each within a text."""
    if not len(starts):
        return []
    single = (ends - starts == 1) & (_LETTER[data[starts]] | _SIGNS[data[starts]])
    cut = np.zeros(len(starts) + 1, dtype=bool)
    cut[per_text] = True
    prev = np.concatenate(([False], single[:-1])) & ~cut[:-1]
    first = np.flatnonzero(single & ~prev)
    nxt = np.concatenate((single[1:], [False])) & ~cut[1:]
    last = np.flatnonzero(single & ~nxt) + 1
    return [(int(a), int(b)) for a, b in zip(first, last, strict=True) if b - a >= 3]


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.searchsorted(sorted_values, values).clip(max=len(sorted_values) - 1)] == values


def restored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_text: np.ndarray, model: CharModel, known: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes], list[tuple[int, int, str]]]:
    """Of each restored word: its text, the word; and (first word, end word, words) for rebuilding the text. ``known``: sorted skeletons of the lexicon."""
    where: list[int] = []
    found: list[bytes] = []
    spans: list[tuple[int, int, str]] = []
    raw = data.tobytes()
    seen = model.decoded

    def take(observed: bytes, first: int, end: int, parts: bool) -> None:
        key = (observed, parts)
        text = seen.get(key)
        if text is None:
            if len(seen) > DECODED_WORDS:
                seen.clear()
            text = seen[key] = decode(observed.decode("utf-8", "ignore"), model, parts)
        if text:
            for word in text.split(" "):
                where.append(first)
                found.append(word.encode())
            spans.append((first, end, text))

    s, e = bodies(data, starts, ends)
    shown = disguised(data, s, e)
    if known is not None and len(known):
        shown |= _within(known, skeletons(data, s, e)) & (e > s)
    for k in np.flatnonzero(shown):
        take(raw[s[k] : e[k]], int(k), int(k) + 1, False)
    for a, b in single_runs(data, starts, ends, per_text):
        take(b"".join(raw[starts[k] : ends[k]] for k in range(a, b)), a, b, True)
    doc = np.searchsorted(per_text, np.array(where, dtype=np.int64), side="right") - 1 if where else np.zeros(0, dtype=np.int64)
    return doc, found, spans


def _hash_words(found: list[bytes]) -> np.ndarray:
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = np.frombuffer(b"".join(found), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in found])
    return span_hashes(joined, ends - np.array([len(w) for w in found]), ends)


def evidence(data: np.ndarray, offsets: np.ndarray, model: CharModel, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash) of all distinct words of restored texts, and the number of words of each text."""
    data = lower(data)
    starts, ends, per_text = words(data, offsets)
    s, e = cores(data, starts, ends)
    some = e > s
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(per_text))
    h = span_hashes(data, s[some], e[some])
    more, found, _ = restored(data, starts, ends, per_text, model, known)
    return np.concatenate([doc[some], more]), np.concatenate([h, _hash_words(found)]), np.diff(per_text)


@dataclass
class Model:
    chars: CharModel
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    coef: np.ndarray
    prior: float
    skeletons: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # of the lexicon's words, sorted

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, h, _ = evidence(data, offsets, self.chars, self.skeletons)
        x = np.zeros((n, 4))
        x[:, 0] = 1
        if len(self.hashes) and len(h):
            at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
            hit = self.hashes[at] == h
            doc, at = doc[hit], at[hit]
            one = np.unique(doc * len(self.hashes) + at)  # a word counts once in a text
            d, k = one // len(self.hashes), one % len(self.hashes)
            np.maximum.at(x[:, 1], d, self.weights[k])
            x[:, 2] = np.minimum(np.bincount(d, weights=self.weights[k], minlength=n), 20)
            x[:, 3] = np.minimum(np.bincount(d, minlength=n), 5)
        return x

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, offsets) @ self.coef, -30, 30)))


def count_chars(docs: DataFrame) -> CharModel:
    """The character model of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, dtype=np.int64)
        for batch in batches:
            for _, _, data, _ in text_chunks(batch, "body"):
                total += char_counts(lower(data))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    got = docs.select("body").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_N**3, dtype=np.int64)
    for r in got:  # at most 28^3 rows
        counts[r["code"]] = r["n"]
    return CharModel.of_counts(counts)


def learn_lexicon(sample: DataFrame, chars: CharModel, n: int, positive: int, most: int = LEXICON_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Words whose document frequency among label 1 surely exceeds that among label 0: hashes and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), dtype=np.int64)
            for at, end, data, offsets in text_chunks(batch, "body"):
                doc, h, _ = evidence(data, offsets, chars)
                pairs = np.unique(np.stack([h, doc.astype(np.uint64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), dtype=np.uint64)
                own = labels[at:end][pairs[:, 1].astype(np.int64)]
                unique, inverse = np.unique(pairs[:, 0], return_inverse=True)
                seen, inside = np.bincount(inverse, minlength=len(unique)), np.bincount(inverse, weights=own, minlength=len(unique))
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(seen.astype(np.int64)), pa.array(inside.astype(np.int64))], ["h", "seen", "inside"])

    a, b = float(positive), float(n - positive)
    inside, outside = F.col("inside") + 0.5, F.col("seen") - F.col("inside") + 0.5
    odds = F.log(inside / (a + 1 - inside)) - F.log(outside / (b + 1 - outside))
    sure = odds - 4.5 * F.sqrt(1 / inside + 1 / outside)
    counts = sample.select("label", "body").mapInArrow(run, "h bigint, seen bigint, inside bigint").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("inside").alias("inside"))
    got = counts.where(F.col("inside") >= 5).withColumns({"odds": odds, "sure": sure}).where(F.col("sure") > 0.5).orderBy(F.desc("sure"), "h").limit(most).collect()
    hashes = np.array([r["h"] for r in got], dtype=np.int64).view(np.uint64)
    weights = np.array([r["odds"] for r in got], dtype=np.float64)
    order = np.argsort(hashes)
    return hashes[order], weights[order]


def lexicon_skeletons(sample: DataFrame, chars: CharModel, hashes: np.ndarray) -> np.ndarray:
    """The sorted skeletons of the lexicon's words, which the sample spells out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "body"):
                data = lower(data)
                starts, ends, per_text = words(data, offsets)
                s, e = cores(data, starts, ends)
                some = e > s
                s, e = s[some], e[some]
                hit = _within(hashes, span_hashes(data, s, e))
                found = restored(data, starts, ends, per_text, chars)[1]
                more = np.frombuffer(b"".join(found), dtype=np.uint8)
                last = np.cumsum([len(w) for w in found], dtype=np.int64)
                first = last - np.array([len(w) for w in found], dtype=np.int64)
                held = _within(hashes, span_hashes(more, first, last))
                out = np.unique(np.concatenate([skeletons(data, s[hit], e[hit]), skeletons(more, first[held], last[held])]))
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["h"])

    got = sample.select("body").mapInArrow(run, "h bigint").distinct().collect()  # no more than the lexicon has words
    return np.sort(np.array([r["h"] for r in got], dtype=np.int64).view(np.uint64))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    coef = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (y - p) - ridge * coef
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(coef))
        step = np.linalg.solve(hess, grad)
        coef = coef + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return coef


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: id, body. labels: id, label, rows to learn from only."""
    sample = agreed_labels(labels).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("a")).first()
    n, a = int(sizes["n"]), int(sizes["a"])
    chars = count_chars(docs)
    share = a / n if n else 0.5
    if not n or a in (0, n):
        level = math.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(chars, np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([level, 0.0, 0.0, 0.0]), share)
    # At most `train_rows` ids and labels are broadcast.
    chosen = docs.join(F.broadcast(sample), "id").select(F.col("label").cast("int").alias("label"), "body")
    hashes, weights = learn_lexicon(chosen, chars, n, a)
    model = Model(chars, hashes, weights, np.zeros(4), share, lexicon_skeletons(chosen, chars, hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "body"):
                x = model.features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, end - at), *[pa.array(x[:, j]) for j in range(4)]], ["label", "x0", "x1", "x2", "x3"])

    got = chosen.mapInArrow(run, "label int, x0 double, x1 double, x2 double, x3 double").toArrow()
    x = np.stack([got.column(f"x{j}").to_numpy() for j in range(4)], axis=1)
    model.coef = fit_logistic(x, got.column("label").to_numpy().astype(np.float64))
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, cut: float = CUT, train_rows: int = TRAIN_ROWS, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Rows whose crc32 of the id as text is 0 modulo ``folds`` are held out."""
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds))
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where(fold != 0)
    model = train(plain, known, train_rows=train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch, "body"):
                value = model.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), pa.array(value), pa.array((value >= cut).astype(np.int32))], ["id", "score", "predicted"])

    scored = plain.mapInArrow(run, "id bigint, score double, predicted int")
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def restore(texts: list[str], model: CharModel, known: np.ndarray | None = None) -> list[str]:
    """Texts with disguised words restored, lower-cased: the operator's own output for a reader."""
    out = []
    for text in texts:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        data = lower(raw)
        offsets = np.array([0, len(data)])
        starts, ends, per_text = words(data, offsets)
        spans = {a: (b, w) for a, b, w in restored(data, starts, ends, per_text, model, known)[2]}
        parts, k, body = [], 0, data.tobytes()
        while k < len(starts):
            if k in spans:
                end, word = spans[k]
                parts.append(word)
                k = end
            else:
                parts.append(body[starts[k] : ends[k]].decode("utf-8", "ignore"))
                k += 1
        out.append(" ".join(parts))
    return out


def lexicon_hash(word: str) -> int:
    return hash_bytes(word.lower().encode())
