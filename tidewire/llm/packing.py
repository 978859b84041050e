"""Packing of token sequences into windows by nonnegative least squares over length combinations.

A document is its token ids and an end id. Whole windows are cut off long documents; what remains has a length
below the window. For a group of documents, shallow combinations of lengths that fill a window exactly (all pairs,
and all triples that hold one of the ``FREQUENT`` most frequent lengths) are enumerated from the histogram of
remainders; repeat counts x >= 0 with A x close to the histogram are solved by a scaled projected gradient until no
count moves any more, rounded, and laid out as far as the histogram has the lengths. Residuals are packed greedily, longest first, and cut where a window is full;
the last, open window of a group is cut at powers of two. So no window is padded.

A group is a run of documents of one input partition, closed at ``group_tokens`` tokens: its ids are all that
a task holds, beside the stretches that are looked up together and a memo of words that it gives up when it ends. Nothing is shuffled, and a partition's result depends on its rows alone, so a lost task can be
run again. Sequence ids are the partition's number times 2^32 plus a running number.

Defined results: null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed
as documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
GROUP_TOKENS = 4_000_000
#: Lengths, most frequent first, of whose triples all are enumerated.
FREQUENT = 12
#: A sweep of the solver that moves no count by more ends it.
STILL = 0.01
#: Stretches and words that a generation of the memo holds before the next one begins, some 250 bytes each.
CACHE_WORDS = 150_000
#: Stretches of texts that are looked up together; a longer text is taken by parts of so many.
LOOK_UP = 20_000

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level vocabularies use for bytes: themselves, or the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit bytes, with a memo of what stretches without blanks and words become.

    The tokenizer lower-cases, collapses white space and never joins what white space parts, so the ids of a text
    are those of its stretches; and a stretch is parted into words and signs, each of which its vocabulary model
    turns into ids. Many texts are looked up together, so that what the memo lacks is spelt, and its ids are
    cut, at once. Texts with characters on which the definitions of white space, case or normal form could
    differ, and texts that could hold a special token's string, go to the tokenizer whole.

    The memo has two generations: what is asked for again survives when the older one is dropped.
    """

    _other = re.compile(r"[^\t\n\v\f\r -~¡-į]")
    _simple = re.compile(r"[!-~ßà-öø-į]+")
    # The tokenizer's own alternatives, for the characters of _simple.
    _parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS, look_up: int = LOOK_UP):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        tokenizer = Tokenizer.from_file(path)
        self._ids = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        # A blank is never part of a word.
        self._letters = {b: c for b, c in _byte_letters().items() if b != 32}
        self._tokenize = tokenizer.model.tokenize
        self._limit, self._look_up = cache_words, look_up
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def forget(self) -> None:
        self._new, self._old = {}, {}

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as its vocabulary model gives them."""
        spelt = " ".join(words).encode().decode("latin-1").translate(self._letters)
        ids: list[int] = []
        edges = [0]
        for word in spelt.split(" "):
            ids += [token.id for token in self._tokenize(word)]
            edges.append(len(ids))
        blob = np.array(ids, dtype="<u4").tobytes()
        return [blob[4 * a : 4 * b] for a, b in pairwise(edges)]

    def _learn(self, stretches: set[str]) -> None:
        """Put the ids of these stretches, none of which the newer generation has, into it."""
        new, old, simple, split = self._new, self._old, self._simple.fullmatch, self._parts.findall
        words: dict[str, None] = {}
        parted: list[tuple[str, list[str]]] = []
        for stretch in stretches:
            if (found := old.get(stretch)) is not None:
                new[stretch] = found
            elif not (stretch.isprintable() if stretch.isascii() else simple(stretch)):
                new[stretch] = self._ids(stretch)
            elif stretch.isalpha():
                words[stretch] = None
            else:
                parted.append((stretch, split(stretch)))
        for _, parts in parted:
            for part in parts:
                if part not in new:
                    if (found := old.get(part)) is not None:
                        new[part] = found
                    else:
                        words[part] = None
        if words:
            new.update(zip(words, self._of_words(list(words)), strict=True))
        for stretch, parts in parted:
            new[stretch] = b"".join(map(new.__getitem__, parts))

    def _of_stretches(self, stretches: list[str]) -> list[bytes]:
        if len(self._new) >= self._limit:
            self._new, self._old = {}, self._new
        found = list(map(self._new.get, stretches))
        gaps = [i for i, blob in enumerate(found) if blob is None]
        if gaps:
            self._learn({stretches[i] for i in gaps})
            for i in gaps:
                found[i] = self._new[stretches[i]]
        return found

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held: list[str] = []
        # Of the texts that wait: the end of each one's stretches, or the ids of a text that went to the tokenizer whole.
        edges: list[int | bytes] = []
        room = self._look_up
        for text in texts:
            if "<|" in text or not (text.isascii() or not self._other.search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
                edges.append(self._ids(text))
                room -= 1 + len(edges[-1]) // 4
            else:
                stretches = text.lower().split()
                if len(stretches) > self._look_up:
                    yield from self._flush(held, edges)
                    held, edges, room = [], [], self._look_up
                    yield b"".join(b"".join(self._of_stretches(stretches[a : a + self._look_up])) for a in range(0, len(stretches), self._look_up))
                    continue
                held += stretches
                edges.append(len(held))
                room -= 1 + len(stretches)
            if room <= 0:
                yield from self._flush(held, edges)
                held, edges, room = [], [], self._look_up
        yield from self._flush(held, edges)

    def _flush(self, held: list[str], edges: list[int | bytes]) -> Iterator[bytes]:
        found, at = self._of_stretches(held), 0
        for edge in edges:
            if isinstance(edge, bytes):
                yield edge
            else:
                yield b"".join(found[at:edge])
                at = edge

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def patterns(histogram: np.ndarray, window: int, frequent: int = FREQUENT) -> np.ndarray:
    """Rows (a, b, c) of lengths, a >= b >= c, c = 0 in pairs, that the histogram holds and that fill the window: all
    pairs, and all triples that hold one of the ``frequent`` most frequent lengths."""
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    small = lengths[lengths * 2 <= window]
    large = window - small
    have = histogram[large] > 0
    found = [np.stack([large[have], small[have], np.zeros(int(have.sum()), dtype=lengths.dtype)], axis=1)]
    for c in lengths[np.argsort(-histogram[lengths], kind="stable")][:frequent]:
        b = lengths
        a = window - c - b
        ok = (a >= b) & (a < window)
        b, a = b[ok], a[ok]
        ok = histogram[a] > 0
        found.append(-np.sort(-np.stack([a[ok], b[ok], np.full(int(ok.sum()), c)], axis=1), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def solve_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 1000, still: float = STILL) -> np.ndarray:
    """Nonnegative repeat counts x that bring A x near the histogram in the least-squares sense; solved once a sweep moves no count by more than ``still``."""
    if not len(rows):
        return np.zeros(0)
    h = histogram.astype(np.float64).copy()
    h[0] = 0
    size = len(h)
    use = np.bincount(rows.ravel(), minlength=size).astype(np.float64)
    row_scale = 1 / np.maximum(use, 1)
    col_scale = 1 / (rows > 0).sum(axis=1)
    x = np.zeros(len(rows))
    live = (rows > 0).astype(np.float64)
    for _ in range(rounds):
        got = np.bincount(rows.ravel(), weights=(x[:, None] * live).ravel(), minlength=size)
        got[0] = 0
        step = ((h - got) * row_scale)[rows] * live
        before, x = x, np.maximum(0, x + 1.8 * step.sum(axis=1) * col_scale)
        if np.abs(x - before).max() <= still:
            break
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for d in np.flatnonzero(lengths >= window):
        for k in range(int(lengths[d]) // window):
            pieces.append((int(d), k * window, window, sequence, 0))
            sequence += 1
    rest = lengths % window
    waiting: dict[int, list[int]] = {}
    for d in np.flatnonzero(rest):
        waiting.setdefault(int(rest[d]), []).append(int(d))
    histogram = np.bincount(rest, minlength=window)
    histogram[0] = 0

    def lay(d: int, start: int, length: int, offset: int) -> None:
        pieces.append((d, start, length, sequence, offset))

    rows = patterns(histogram, window)
    counts = solve_counts(rows, histogram)
    for i in np.argsort(-counts, kind="stable"):
        times = int(round(float(counts[i])))
        if not times:
            break
        row = [int(v) for v in rows[i] if v]
        while times and all(len(waiting.get(v, ())) >= row.count(v) for v in set(row)):
            offset = 0
            for v in row:
                d = waiting[v].pop()
                lay(d, int(lengths[d]) - v, v, offset)
                offset += v
            sequence += 1
            times -= 1
    # Residuals: longest first into the open window; where nothing fits, the longest is cut.
    left = sorted((v, d) for v, ds in waiting.items() for d in ds)
    room = window
    while left:
        at = bisect_right(left, (room, 1 << 60)) - 1
        v, d = left.pop(at if at >= 0 else -1)
        start = int(lengths[d]) - v
        take = min(v, room)
        lay(d, start, take, window - room)
        if take < v:
            # The rest of a cut document is a shorter remainder of the same document.
            insort(left, (v - take, d))
        room -= take
        if not room:
            room, sequence = window, sequence + 1
    if room < window:
        pieces = _cut_tail(pieces, sequence, window - room)
    return pieces


def _cut_tail(pieces: list[tuple[int, int, int, int, int]], sequence: int, used: int) -> list[tuple[int, int, int, int, int]]:
    """The open window of ``used`` tokens becomes sequences whose lengths are powers of two."""
    tail = sorted((p for p in pieces if p[3] == sequence), key=lambda p: p[4])
    out = [p for p in pieces if p[3] != sequence]
    sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
    room, offset = sizes[0], 0
    k = 0
    for d, start, length, _, _ in tail:
        while length:
            take = min(length, room)
            out.append((d, start, take, sequence + k, offset))
            start, length, room, offset = start + take, length - take, room - take, offset + take
            if not room:
                k, offset = k + 1, 0
                room = sizes[k] if k < len(sizes) else 0
    return out


def _emit(ids: list, blobs: list[bytes], base: int, window: int) -> tuple[pa.RecordBatch, int]:
    lengths = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
    pieces = plan(lengths, window)
    pieces.sort(key=lambda p: (p[3], p[4]))
    crc = [zlib.crc32(memoryview(blobs[d])[4 * start : 4 * (start + length)]) for d, start, length, _, _ in pieces]
    table = np.array(pieces, dtype=np.int64).reshape(-1, 5)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([ids[p[0]] for p in pieces], pa.int64()), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(crc, pa.int64()), pa.array(lengths[table[:, 0]]), pa.array(table[:, 3] + base), pa.array(table[:, 4])],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
    return batch, base + (int(table[:, 3].max()) + 1 if len(table) else 0)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file that parts words at white space; by default the public 49k one.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        ids: list = []
        blobs: list[bytes] = []
        held = 0
        try:
            for batch in batches:
                texts = (text.as_py() or "" for text in batch.column("body"))
                for name, blob in zip(batch.column("id"), encode.many(texts), strict=True):
                    blob += end
                    ids.append(name.as_py())
                    blobs.append(blob)
                    held += len(blob) // 4
                    if held >= group_tokens:
                        out, base = _emit(ids, blobs, base, window)
                        yield out
                        ids, blobs, held = [], [], 0
            if blobs:
                yield _emit(ids, blobs, base, window)[0]
        finally:
            encode.forget()  # a worker may serve other stages next

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, PIECE_SCHEMA)
