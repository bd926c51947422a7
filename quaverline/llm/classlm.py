"""Language-model scoring with Brown-style class-based bigrams.

Every word that occurs in training ``least`` times or more is a unit that exchange clustering assigns to a class; rarer words
share a unit for each class of word endings. All counts cover all training documents: words are brought together by hash,
bigrams of units by unit. The most frequent units are clustered one after the other as a start; then all units move in rounds,
half of them at a time, each to the class that raises the likelihood most. A word's probability after another is
P(class | class before) times P(word | class); class bigrams are interpolated with class frequencies and emissions smoothed by
adding 0.5, so unseen words have their share in every class. What is broadcast grows by ten bytes with each word clustered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import binary, id_bucket, lower_words, shuffle_partitions, small_batches, stored, text_parts, texts

#: The end of a text; no word holds a space.
END = b" "
#: Classes of word endings.
ENDINGS = 256
#: Bytes of the texts that a map task numbers and folds at a time, about.
CHUNK_BYTES = 3 << 20
#: Words that a task numbers before it starts anew (about 150 bytes each).
CACHE_WORDS = 200_000
#: Bytes of text behind one bucket of words at most, about.
BUCKET_BYTES = 64 << 20
#: Training tokens behind the bigrams of one group, about.
GROUP_TOKENS = 500_000
#: Units whose gains are computed at a time; each takes some hundred KB in several tables.
BATCH_UNITS = 128


def key(word: bytes) -> int:
    """A 64-bit hash whose low byte is the class of the word's ending."""
    return xxhash.xxh3_64_intdigest(word) & ~0xFF | zlib.crc32(word[-2:]) & (ENDINGS - 1)


def keys(words: list[bytes]) -> np.ndarray:
    """``key`` of each word."""
    ends = np.fromiter(map(zlib.crc32, [w[-2:] for w in words]), np.uint64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & ~np.uint64(0xFF) | ends & np.uint64(ENDINGS - 1)


class _Numbers(dict):
    """Numbers words in the order in which they are met; ``fresh`` are those met since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i


class Units:
    """Numbers words for one task: keys, hot words (-1: others) and units by a local number. Units: known words, the end, endings."""

    def __init__(self, hashes: np.ndarray, hot: list[bytes] = ()):
        self.hashes = hashes
        self.hot_words = {w: i for i, w in enumerate(hot)}
        self.end = len(hashes)
        self.count = len(hashes) + 1 + ENDINGS
        self.keys = np.zeros(1 << 16, np.uint64)
        self.unit = np.zeros(1 << 16, np.int32)
        self.hot = np.zeros(1 << 16, np.int32)
        self.done = 0
        self.memo = _Numbers()

    def _note(self) -> None:
        """Keys and hot words of the words numbered since the last call, all at once."""
        new, known = self.memo.fresh, len(self.memo) - len(self.memo.fresh)
        while len(self.memo) > len(self.keys):
            self.keys, self.unit, self.hot = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.unit, self.hot))
        self.keys[known : len(self.memo)] = keys(new)
        self.hot[known : len(self.memo)] = [self.hot_words.get(w, -1) for w in new] if self.hot_words else -1
        self.memo.fresh = []

    def units(self, text: str | None) -> np.ndarray:
        at = self.numbers(text)  # may replace the arrays
        self.place()
        return self.unit[at]

    def place(self) -> None:
        """Finds the units of the words numbered since the last call."""
        if self.done < len(self.memo):
            k = self.keys[self.done : len(self.memo)]
            self.unit[self.done : len(self.memo)] = unit_of(self.hashes, k)
            self.done = len(self.memo)

    def numbers(self, text: str | None) -> np.ndarray:
        """Local numbers of the words of a text, good until the next call."""
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
            self.done = 0
        tokens = lower_words(text)
        at = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        if self.memo.fresh:
            self._note()
        return at


def unit_of(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the ascending ``hashes``, or the unit of its ending."""
    endings = len(hashes) + 1 + (keys & np.uint64(0xFF)).astype(np.int64)
    if not len(hashes):
        return endings
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, at, endings)


#: A row of whole texts as numbers: the words of each text, then those of all texts one after the other as byte planes of
#: their places among ``keys``, the ``key`` of each distinct word of the row.
_ENCODED = "doc_ids array<long>, held_out array<boolean>, sizes binary, numbers binary, keys binary"


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, the words of all texts as places among their distinct words, and the keys of those."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, ends = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(found), 0)  # white space at either end leaves an empty word
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[ends - ends[0]]
    numbered = found.filter(full).dictionary_encode()
    return np.diff(before).astype(np.uint32), numbered.indices.to_numpy(), keys(numbered.dictionary.cast(pa.large_binary()).to_pylist())


def encoded_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, held_out) as rows of ``_ENCODED`` with an id in ``chunk``, each of about ``CHUNK_BYTES`` of text.

    The texts are read and parted into words only here.
    """

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, text, held_out = (pa.concat_arrays(table.column(i).chunks) for i in range(3))
        sizes, numbers, k = encode(text)
        one = [0, len(ids)]
        return pa.RecordBatch.from_pydict(
            {"doc_ids": pa.ListArray.from_arrays(one, ids), "held_out": pa.ListArray.from_arrays(one, held_out), "sizes": [binary(sizes)], "numbers": [_planes(numbers)], "keys": [binary(k)]}
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, 0
        for batch in batches:
            ends = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for part, lo, hi in blobs.stretches(ends // CHUNK_BYTES):
                if part != last and held:
                    yield row(held)
                    held = []
                last = part
                held.append(batch.slice(lo, hi - lo))
            size = int(ends[-1]) if len(ends) else size
        if held:
            yield row(held)

    sent = rows.select("doc_id", "text", "held_out").mapInArrow(run, _ENCODED)
    return stored(sent.select(F.monotonically_increasing_id().alias("chunk"), "*"), "texts")


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``values`` of the words of all texts with ``end`` after each text."""
    return np.insert(values, np.cumsum(sizes, dtype=np.int64), end)


def _folded(a: np.ndarray, b: np.ndarray, n: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct pairs and the sums of their counts."""
    code = a.astype(np.int64) * count + b
    by = np.argsort(code, kind="stable")
    starts = blobs.runs(code[by])
    sums = np.add.reduceat(n[by].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    first = code[by][starts]
    return (first // count).astype(np.int32), (first % count).astype(np.int32), sums


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, which compress better so."""
    return binary(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: A group's bigrams by the unit before (a, b, n) and by the unit after (a2, b2, n2), as byte planes.
_PAIRS = "a binary, b binary, n binary, a2 binary, b2 binary, n2 binary"


def unit_pairs(encoded: DataFrame, hashes: np.ndarray, groups: int) -> DataFrame:
    """Counts of neighbouring units in all training documents of ``encoded_texts``, the end before each first word, as rows of ``_PAIRS``.

    A pair is in its first unit's group and in its second one's.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(hashes)
    count = len(hashes) + 1 + ENDINGS

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.uint32)
                unit = unit_of(shared.value, np.frombuffer(row["keys"], np.uint64)).astype(np.int32)
                u = with_ends(unit[_numbers(row["numbers"], np.int32)], sizes, len(shared.value))
                train = np.repeat(~np.array(row["held_out"]), sizes + np.uint32(1))
                before = np.append(len(shared.value), u[:-1])[train]  # an end stands before each text
                code, n = np.unique(before.astype(np.int64) * count + u[train], return_counts=True)
                before, after, n = (code // count).astype(np.int32), (code % count).astype(np.int32), n.astype(np.uint32)
                out: dict[str, list] = {"group": [], "side": [], "a": [], "b": [], "n": []}
                for side in (0, 1):
                    by = np.argsort(after.astype(np.int64) * count + before) if side else np.arange(len(n))
                    a, b, times = (x[by] for x in ((after, before, n) if side else (before, after, n)))
                    group = blobs.spread(a, groups)
                    to = np.argsort(group.astype(np.uint16 if groups <= 1 << 16 else np.int64), kind="stable")
                    for g, lo, hi in blobs.stretches(group[to]):
                        i = to[lo:hi]
                        for k, v in zip(out, (g, side, _planes(a[i]), _planes(b[i]), _planes(times[i]))):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("group", pa.int32()), ("side", pa.int32()), *((c, pa.binary()) for c in "abn")]))

    def merge(table: pa.Table) -> pa.Table:
        sides = np.array(table.column("side").to_pylist())
        raw = {c: table.column(c).to_pylist() for c in "abn"}
        both = []
        for side in (0, 1):
            at = np.flatnonzero(sides == side)
            both += _folded(*(np.concatenate([np.zeros(0, kind), *(_numbers(raw[c][i], kind) for i in at)]) for c, kind in (("a", np.int32), ("b", np.int32), ("n", np.uint32))), count)
        return pa.table({c: pa.array([_planes(x)], pa.binary()) for c, x in zip(("a", "b", "n", "a2", "b2", "n2"), both)})

    sent = encoded.select("held_out", "sizes", "numbers", "keys").mapInArrow(run, "group int, side int, a binary, b binary, n binary")
    return stored(sent.groupBy("group").applyInArrow(merge, _PAIRS), "unit-pairs")


def _read(row: dict) -> list[np.ndarray]:
    return [_numbers(v, np.int64 if c[0] == "n" else np.int32) for c, v in row.items()]


def starting_table(pairs: DataFrame, start: np.ndarray, n: int) -> np.ndarray:
    """Counts of neighbouring starting units; ``start`` has the number of each unit's. Its size is fixed by their number."""
    shared = pairs.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                a, b, times = _read(row)
                np.add.at(total, shared.value[a].astype(np.int64) * n + shared.value[b], times)
        rows = total.reshape(n, n)
        full = np.flatnonzero(rows.any(axis=1))
        for at in range(0, len(full), 256):
            part = full[at : at + 256]
            yield pa.RecordBatch.from_pydict({"unit": pa.array(part, pa.int32()), "counts": [binary(rows[i]) for i in part]})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"unit": table.column("unit").slice(0, 1), "counts": pa.array([binary(total)], pa.binary())})

    out = np.zeros((n, n), np.int64)
    for unit, counts in pairs.select("a", "b", "n").mapInArrow(run, "unit int, counts binary").groupBy("unit").applyInArrow(add, "unit int, counts binary").collect():
        out[unit] = np.frombuffer(counts, np.int64)
    return out


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(joint: np.ndarray) -> float:
    """Of the training data by class bigrams, without what doesn't depend on the classes."""
    return float(_xlog(joint).sum() - _xlog(joint.sum(axis=1)).sum() - _xlog(joint.sum(axis=0)).sum())


def moved(out: np.ndarray, into: np.ndarray, loop: np.ndarray, own: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class of each unit that makes the likelihood highest while all others stay.

    ``out`` and ``into`` count by class what comes after and before a unit, itself left out; ``loop`` counts itself.
    """
    u, classes = np.arange(len(own)), len(joint)
    is_own = np.arange(classes) == own[:, None]

    def side(counts: np.ndarray, other: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Gain in the cells (class, x), with the unit taken out of its own class first."""
        gain = np.zeros((len(own), classes))
        at, x = np.nonzero(counts)
        if len(at):
            rows, n = np.arange(len(at)), counts[at, x]
            table = np.ascontiguousarray(table.T)
            cells, before = table[x], _xlog(table)[x]
            cells[rows, own[at]] -= n
            same = np.flatnonzero(x == own[at])
            cells[same] -= other[at[same]]
            cells[same, own[at[same]]] -= loop[at[same]]
            # all else in ``before`` is as it was with the unit
            before[rows, own[at]] = _xlog(cells[rows, own[at]])
            before[same] = _xlog(cells[same])
            cells += n[:, None]
            logs = np.maximum(cells, 1)
            np.log(logs, out=logs)
            logs *= cells
            logs -= before
            starts = blobs.runs(at)
            gain[at[starts]] = np.add.reduceat(logs, starts)
        return gain

    gain = side(out, into, joint) + side(into, out, joint.T)
    diagonal = np.diag(joint) - is_own * (out[u, own] + into[u, own] + loop)[:, None]
    loops = loop[:, None]
    gain += _xlog(diagonal + out + into + loops) - _xlog(diagonal + out) - _xlog(diagonal + into) + _xlog(diagonal)
    for total, n in ((joint.sum(axis=1), out.sum(axis=1) + loop), (joint.sum(axis=0), into.sum(axis=1) + loop)):
        rest = total - is_own * n[:, None]
        gain -= _xlog(rest + n[:, None]) - _xlog(rest)
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[u, best] > gain[u, own] + 1e-9, best, own)


def refined(pairs: DataFrame, cls: np.ndarray, end: int, classes: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units after rounds of moves from ``cls``, and their class bigrams.

    In a round the units of one half, dealt by number, move at the same time. If that lowers the likelihood, it is taken back
    and smaller parts move from then on. A round of each part without a move ends it.
    """
    context = pairs.sparkSession.sparkContext

    def joint_of(now: np.ndarray) -> np.ndarray:
        shared = context.broadcast(now)

        def run(batches):
            total = np.zeros(classes * classes)
            for batch in batches:
                for row in batch.to_pylist():
                    a, b, n = _read(row)
                    total += np.bincount(shared.value[a].astype(np.int64) * classes + shared.value[b], n, classes * classes)
            yield pa.RecordBatch.from_pydict({"joint": [binary(total)]})

        found = pairs.select("a", "b", "n").mapInArrow(run, "joint binary").collect()
        shared.unpersist()
        return np.sum([np.frombuffer(r[0]) for r in found], axis=0).reshape(classes, classes) if found else np.zeros((classes, classes))

    def moves(now: np.ndarray, joint: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        shared = context.broadcast((now, joint))

        def run(batches):
            now, joint = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    a, b, n, a2, b2, n2 = _read(row)
                    units = np.unique(a)
                    units = units[(blobs.spread(units, 1 << 20) >> 7) % parts == part]
                    units = units[units != end]
                    ids, to = [], []
                    for at in range(0, len(units), BATCH_UNITS):
                        some = units[at : at + BATCH_UNITS]
                        tables = []
                        for x, y, m in ((a, b, n), (a2, b2, n2)):
                            lo, hi = np.searchsorted(x, some[0]), np.searchsorted(x, some[-1], "right")
                            x, y, m = x[lo:hi], y[lo:hi], m[lo:hi]
                            place = np.minimum(np.searchsorted(some, x), len(some) - 1)
                            mine = some[place] == x
                            x, y, m, place = x[mine], y[mine], m[mine], place[mine]
                            apart = x != y
                            tables.append(np.bincount(place[apart] * classes + now[y[apart]], m[apart], len(some) * classes).reshape(-1, classes))
                            loop = np.bincount(place[~apart], m[~apart], len(some))
                        best = moved(*tables, loop, now[some].astype(np.int64), joint)
                        changed = best != now[some]
                        ids.append(some[changed])
                        to.append(best[changed].astype(now.dtype))
                    if ids:
                        yield pa.RecordBatch.from_pydict({"ids": [binary(np.concatenate(ids))], "classes": [binary(np.concatenate(to))]})

        found = pairs.mapInArrow(run, "ids binary, classes binary").collect()
        shared.unpersist()
        return np.frombuffer(b"".join(r[0] for r in found), np.int32), np.frombuffer(b"".join(r[1] for r in found), now.dtype)

    now = cls.astype(np.uint16)
    joint = joint_of(now)
    parts, still = 2, 0
    for round_ in range(rounds):
        ids, to = moves(now, joint, round_ % parts, parts)
        still = 0 if len(ids) else still + 1
        if still == parts:
            break
        if len(ids):
            changed = now.copy()
            changed[ids] = to
            then = joint_of(changed)
            if likelihood(then) > likelihood(joint):
                now, joint = changed, then
            else:  # too many moved at once
                parts *= 2
    return now, joint


def exchange(bigrams: np.ndarray, classes: int, fixed: int, rounds: int = 8) -> np.ndarray:
    """Class of each unit. Each unit in turn moves to the class that raises the class-bigram likelihood most.

    Unit ``fixed`` has class 0 to itself. Units are placed by frequency, the first ones in classes of their own; a round
    without a move ends it.
    """
    n = len(bigrams)
    freq = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-freq, kind="stable")
    free = [int(u) for u in order if u != fixed]
    cls = np.full(n, classes, np.int64)  # the last number: not placed yet
    cls[fixed] = 0
    b = bigrams.astype(np.float64)
    joint = np.zeros((classes, classes))
    joint[0, 0] = b[fixed, fixed]

    def f(x):
        return x * np.log(np.maximum(x, 1))

    for round_ in range(rounds + 1):
        moved = 0
        for rank, u in enumerate(free):
            own = int(cls[u])
            loop = b[u, u]
            out = np.bincount(cls, b[u], classes + 1)
            into = np.bincount(cls, b[:, u], classes + 1)
            out[own] -= loop
            into[own] -= loop
            out, into = out[:classes], into[:classes]
            if own < classes:
                joint[own] -= out
                joint[:, own] -= into
                joint[own, own] -= loop
            left, right = joint.sum(axis=1), joint.sum(axis=0)
            n_out, n_in = out.sum() + loop, into.sum() + loop
            gain = (f(joint + out) - f(joint)).sum(axis=1) + (f(joint + into[:, None]) - f(joint)).sum(axis=0)
            diag = np.diag(joint)
            gain += f(diag + out + into + loop) - f(diag + out) - f(diag + into) + f(diag)
            gain -= f(left + n_out) - f(left) + f(right + n_in) - f(right)
            gain[0] = -np.inf
            best = 1 + rank if round_ == 0 and rank < classes - 1 else int(np.argmax(gain))
            if own < classes and gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            cls[u] = best
            joint[best] += out
            joint[:, best] += into
            joint[best, best] += loop
        if not moved:
            break
    return cls


def word_counts(encoded: DataFrame, n: int, least: int) -> DataFrame:
    """(chunk, bucket, counts) for each of ``n`` buckets of hashes that a row of ``encoded_texts`` has words of: how often they
    occur in all training documents, ascending by key; and rows without a chunk with the number of distinct training words that
    occur less than ``least`` times, by ending, and then of all training words; with the hashes and counts of the others.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h = np.frombuffer(row["keys"], np.uint64)
                train = np.repeat(~np.array(row["held_out"]), np.frombuffer(row["sizes"], np.uint32))
                times = np.bincount(_numbers(row["numbers"], np.int32)[train], minlength=len(h)).astype(np.uint32)
                by = np.argsort(h)
                h, times = h[by], times[by]
                parts = list(blobs.stretches(blobs.buckets(h, n)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()),
                        "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                        "hashes": pa.array([binary(h[lo:hi]) for _, lo, hi in parts], pa.binary()),
                        "times": pa.array([_planes(times[lo:hi]) for _, lo, hi in parts], pa.binary()),
                    }
                )

    def meet(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        h, times = np.concatenate(sent), np.concatenate([_numbers(x, np.uint32) for x in table.column("times").to_pylist()])
        by = np.argsort(h)
        starts = blobs.runs(h[by])
        distinct, counts = h[by][starts], np.add.reduceat(times[by], starts, dtype=np.int64)
        of_each = np.empty(len(h), np.int64)
        of_each[by] = np.repeat(counts, np.diff(np.append(starts, len(h))))
        types = np.bincount((distinct & np.uint64(0xFF)).astype(np.int64)[(counts > 0) & (counts < least)], minlength=ENDINGS)
        often = [binary(x[counts >= least]) for x in (distinct, counts)]
        return pa.table(
            {
                "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
                "counts": pa.array([*(_planes(x) for x in np.split(of_each, np.cumsum([len(x) for x in sent])[:-1])), None], pa.binary()),
                "types": pa.array([None] * len(sent) + [np.append(types, counts.sum()).tolist()], pa.list_(pa.int64())),
                "often": pa.array([None] * len(sent) + [often], pa.list_(pa.binary())),
            }
        )

    sent = encoded.mapInArrow(send, "chunk long, bucket int, hashes binary, times binary")
    return stored(sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, counts binary, types array<long>, often array<binary>"), "word-counts")


class ClassModel:
    """Classes of units and what scoring needs of them. ``frequent`` are the units before the end; with its other arguments
    it clusters the units one after the other; ``refit`` takes other units with their classes and class bigrams."""

    def __init__(self, frequent, bigrams: np.ndarray, types: np.ndarray, classes: int):
        end = len(frequent)
        cls = exchange(bigrams, classes, fixed=end)
        onehot = np.zeros((len(cls), classes))
        onehot[np.arange(len(cls)), cls] = 1
        counts = bigrams.sum(axis=0)  # each token follows one
        self.refit(cls, onehot.T @ bigrams @ onehot, np.concatenate([counts[: end + 1] > 0, types]).astype(np.int64))

    def refit(self, cls: np.ndarray, joint: np.ndarray, unit_types: np.ndarray) -> None:
        """``unit_types``: distinct training words of each unit."""
        classes = len(joint)
        self.cls = cls
        self.train_tokens = int(round(joint.sum()))
        self.base = float(np.log10(self.train_tokens + 0.5 * (unit_types.sum() + 1)))
        share = (joint.sum(axis=0) + 0.5) / (joint.sum() + 0.5 * classes)
        weight = 5.0
        self.transitions = np.log10((joint + weight * share) / (joint.sum(axis=1, keepdims=True) + weight))
        self.spread = np.log10(joint.sum(axis=0) + 0.5 * (np.bincount(cls, unit_types, classes) + 1))


def class_model(encoded: DataFrame, hashes: np.ndarray, counts: np.ndarray, types: np.ndarray, tokens: int, words: int, classes: int) -> ClassModel:
    """Clusters the words with ``hashes`` (ascending) and the endings; the ``words`` most frequent ones are the start."""
    end = len(hashes)
    first = np.sort(np.lexsort((hashes, -counts))[:words])
    start = np.concatenate([len(first) + 1 + (hashes & np.uint64(0xFF)).astype(np.int64), len(first) + np.arange(1 + ENDINGS)])
    start[first] = np.arange(len(first))
    pairs = unit_pairs(encoded, hashes, max(shuffle_partitions(encoded.sparkSession), tokens // GROUP_TOKENS + 1))
    table = starting_table(pairs, start.astype(np.int32), len(first) + 1 + ENDINGS)
    model = ClassModel(first, table, types, classes)
    model.end_count = int(table[len(first)].sum())
    cls, joint = refined(pairs, model.cls[start], end, classes)
    model.refit(cls, joint, np.concatenate([np.ones(end), [model.end_count > 0], types]).astype(np.int64))
    return model


def class_scores(docs: DataFrame, held_out_remainder: int = 1, modulus: int = 5, words: int = 1_000, classes: int = 64, sample_docs: int = 20_000, least: int = 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Words that occur ``least`` times in training are clustered, starting with the ``words`` most frequent ones.
    A null or empty text is its end alone. A null doc_id has the bucket of the empty text. Repeated rows count as often as they
    occur in training and have equal scores. An empty table gives no rows; without training rows all counts are 0.
    All words are counted alike; ``sample_docs`` is taken for earlier callers and has no effect.
    """
    spark = docs.sparkSession
    held = id_bucket(F.col("doc_id"), modulus) == held_out_remainder
    rows = texts(docs).withColumn("held_out", held)
    n = text_parts(rows, 1, BUCKET_BYTES)
    encoded = encoded_texts(rows)
    small_batches(spark, 1)  # a row is a whole chunk of texts or group of units
    counted = word_counts(encoded, n, least)
    types = np.zeros(ENDINGS + 1, np.int64)
    often: list[list[bytes]] = []
    for row, found in counted.filter("chunk is null").select("types", "often").collect():
        types += np.array(row, np.int64)
        often.append([bytes(x) for x in found])
    hashes, counts = (np.frombuffer(b"".join(o[i] for o in often), kind) for i, kind in enumerate((np.uint64, np.int64)))
    by = np.argsort(hashes)
    hashes, counts = hashes[by], counts[by]
    fitted = class_model(encoded, hashes, counts, types[:ENDINGS], int(types[ENDINGS]), words, classes)
    model = spark.sparkContext.broadcast((hashes, fitted))

    def score(chunk: pa.Table, found: pa.Table) -> pa.Table:
        hashes, m = model.value
        row = {c: chunk.column(c)[0].as_py() for c in ("sizes", "numbers", "keys")}
        ids, held_out = (chunk.column(c)[0].values for c in ("doc_ids", "held_out"))
        sizes, numbers, k = np.frombuffer(row["sizes"], np.uint32), _numbers(row["numbers"], np.int32), np.frombuffer(row["keys"], np.uint64)
        parts = sorted(zip(found.column("bucket").to_pylist(), found.column("counts").to_pylist()))
        count = np.empty(len(k), np.int64)
        count[np.argsort(k)] = np.concatenate([np.zeros(0, np.int64), *(_numbers(x, np.int64) for _, x in parts)])
        c = with_ends(m.cls[unit_of(hashes, k)][numbers], sizes, m.cls[len(hashes)])
        tokens = sizes.astype(np.int64) + 1
        text = np.repeat(np.arange(len(sizes)), tokens)
        fixed = np.bincount(text, m.transitions[np.append(c.dtype.type(0), c[:-1]), c] - m.spread[c], len(sizes))
        text = np.repeat(np.arange(len(sizes)), sizes)
        known = np.bincount(text, (count > 0)[numbers], len(sizes)).astype(np.int64) + (m.end_count > 0)
        logs = np.bincount(text, np.log10(count + 0.5)[numbers], len(sizes)) + np.log10(m.end_count + 0.5)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": held_out,
                "n_tokens": tokens,
                "n_known": known,
                "train_tokens": np.full(len(sizes), m.train_tokens, np.int64),
                "base_score": logs - tokens * m.base,
                "score": logs + fixed,
            }
        )

    both = [x.repartition(n, "chunk").groupBy("chunk") for x in (encoded, counted.filter("chunk is not null").select("chunk", "bucket", "counts"))]
    scored = stored(both[0].cogroup(both[1]).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    small_batches(spark)
    return scored
