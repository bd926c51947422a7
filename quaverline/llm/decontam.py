"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs with at most e edits shares at least m + 1 - q (e + 1) of its q-grams with the text, all
within e + 1 neighbouring diagonals. Diagonals are parted into bands of twice that width that overlap by half, so some
band holds them all. Bands with enough shared q-grams are verified by a banded alignment of the whole item. q is 8, and less
for the items whose length and edits leave no shared 8-gram sure, so the lemma holds for every item.

Items are broadcast in parts of a fixed size, one pass over the documents for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

Q = 8
#: Edits allowed for each character of an item.
EDIT_SHARE = 0.1
#: Characters of items that are broadcast at a time.
PART_CHARS = 8_000_000
#: Characters of documents that are looked up together.
SLAB_CHARS = 400_000
_BLOOM_BITS = 22
_GAP = Q + 1


#: Whether a code point is white space; none beyond is.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])


def normal(text: str) -> np.ndarray:
    """Code points in lower case, each white space a space; as long as ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if low.isprintable():
        return codes
    return np.where(_SPACE[np.minimum(codes, len(_SPACE) - 1)] & (codes < len(_SPACE)), np.uint32(32), codes)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit key of each q-gram; equal q-grams have equal keys, and the alignment sorts out others."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    folded = (codes ^ codes >> 8 ^ codes >> 16).astype(np.uint8).tobytes() + bytes(8 - q)
    whole = np.ndarray((len(codes) - q + 1,), np.uint64, folded, strides=(1,))
    return whole if q == 8 else whole & np.uint64((1 << 8 * q) - 1)


def budget(m: int, share: float) -> int:
    """Edits allowed in an item of m characters."""
    return int(share * m + 1e-9)


def gram_length(m: int, edits: int) -> int:
    """The longest q up to 8 for which the lemma asks for a shared q-gram at least."""
    return max(1, min(Q, m // (edits + 1)))


def _spread(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BLOOM_BITS)


class Grams:
    """Where q-grams of one length stand in items."""

    def __init__(self, q: int, numbers: list[int], codes: list[np.ndarray]):
        self.q = q
        keys = [grams(c, q) for c in codes]
        every = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(every, kind="stable")
        self.items = np.repeat(np.array(numbers, np.int64), [len(k) for k in keys])[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k in keys)])[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[_spread(self.keys)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the item and place in ``codes`` of each q-gram shared."""
        keys = grams(codes, self.q)
        at = np.flatnonzero(self.bloom[_spread(keys)])
        row = np.searchsorted(self.keys, keys[at])
        hit = row < len(self.keys)
        hit[hit] = self.keys[row[hit]] == keys[at[hit]]
        at, row = at[hit], row[hit]
        times = self.count[row]
        post = np.repeat(self.first[row] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return self.items[post], self.at[post], np.repeat(at, times)


class Index:
    """Q-grams of one part of the items."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.ids = [i for i, _ in items]
        self.codes = [normal(t.strip()) for _, t in items]
        self.edits = np.array([budget(len(c), share) for c in self.codes], np.int64)
        q = np.array([gram_length(len(c), e) for c, e in zip(self.codes, self.edits)], np.int64)
        self.least = np.array([max(1, len(c) + 1 - k * (e + 1)) for c, k, e in zip(self.codes, q, self.edits)], np.int64)
        self.grams = []
        for k in np.unique(q).tolist():
            numbers = np.flatnonzero(q == k).tolist()
            self.grams.append(Grams(k, numbers, [self.codes[i] for i in numbers]))

    def bands(self, codes: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, band) with enough shared q-grams. ``codes`` are several documents end to end, from ``edges``."""
        for table in self.grams:
            item, inside, place = table.hits(codes)
            if not len(item):
                continue
            doc = np.searchsorted(edges, place, side="right") - 1
            band = np.floor_divide(place - edges[doc] - inside, self.edits[item] + 1)
            doc, item, band = np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])
            low = int(band.min())
            code = (doc * len(self.ids) + item) * (int(band.max()) - low + 1) + (band - low)
            found, first, counts = np.unique(code, return_index=True, return_counts=True)
            for i in first[counts >= self.least[item[first]]].tolist():
                yield int(doc[i]), int(item[i]), int(band[i])


def whole_words(text: np.ndarray, start: int, stop: int) -> bool:
    """Whether no letter or digit goes on at either end of the stretch."""
    return not any(0 <= i < len(text) and chr(text[i]).isalnum() for i in (start - 1, stop))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best occurrence of the whole item with at most ``most`` edits; None if there is none.

    The occurrence may start anywhere on the diagonals from ``low`` to ``high`` (place in text less place in item). The
    earliest end among the best is taken.
    """
    if (start := _verbatim(item, text, max(low, 0), high)) is not None:
        return 0, start, start + len(item)
    found = _band_rows(item, text, low - most, high + most, most)
    if found is None or found[0] > most:
        return None
    edits, stop = found
    back = _band_rows(item[::-1], text[:stop][::-1], -most, most, most, anchored=True)
    return edits, stop - (back[1] if back else len(item)), stop


def _verbatim(item: np.ndarray, text: np.ndarray, low: int, high: int) -> int | None:
    """First diagonal of the band along which no edit is needed."""
    raw, wanted, at = text[low : high + len(item)].tobytes(), item.tobytes(), -1
    while (at := raw.find(wanted, at + 1)) >= 0:
        if at % item.itemsize == 0:
            return low + at // item.itemsize
    return None


def _band_rows(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Fewest edits of the item against a stretch of text, and that stretch's end, row by row over a band of diagonals.

    The least value of a row never falls from row to row, so a band without one up to ``most`` is given up.
    """
    m, n, width = len(item), len(text), high - low + 1
    big = m + n + 1
    steps = np.arange(width)
    shift = width + m  # of text in padded
    place = low + steps  # characters of text used after no character of the item
    row = np.where((place >= 0) & (place <= n), place if anchored else 0, big)
    padded = np.concatenate([np.full(shift, 0xFFFFFFFF, np.uint32), text, np.full(width + m + 2, 0xFFFFFFFF, np.uint32)])
    for i in range(1, m + 1):
        # cell k uses low + k + i characters of text; its diagonal neighbour is k, the one above k + 1, the left one k - 1
        start = shift + low + i - 1
        if start < 0 or start + width > len(padded):
            lo = np.clip(np.arange(start, start + width), 0, len(padded) - 1)
            last = padded[lo]
        else:
            last = padded[start : start + width]
        step = row + (last != item[i - 1])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        used = place + i
        step[(used < 0) | (used > n)] = big
        row = np.minimum(np.minimum.accumulate(step - steps) + steps, big)
        row[(used < 0) | (used > n)] = big
        if i % 8 == 0 and row.min() > most:
            return None
    k = int(np.argmin(row))
    return (int(row[k]), low + k + m) if row[k] < big else None


def find(text: np.ndarray, candidates: list[tuple[int, int]], index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, stop, edits) of verified occurrences; of those of one item that overlap, the one with fewest edits."""
    found = []
    seen: dict[int, set[int]] = {}
    for item, band in sorted(candidates):
        e = int(index.edits[item])
        if band in seen.setdefault(item, set()):
            continue  # next to a band that has an occurrence, and half of it is that band
        hit = align(index.codes[item], text, band * (e + 1), (band + 2) * (e + 1) - 1, e)
        if hit and (len(index.codes[item]) >= Q or whole_words(text, hit[1], hit[2])):
            found.append((item, hit[1], hit[2], hit[0]))
            if hit[0] == 0 and hit[1] // (e + 1) == band + 1:
                seen[item].add(band + 1)
    kept: list[tuple[int, int, int, int]] = []
    for item, a, b, edits in sorted(found, key=lambda x: (x[3], x[1], x[0])):
        if all(k[0] != item or b <= k[1] or k[2] <= a for k in kept):
            kept.append((item, a, b, edits))
    return sorted(kept, key=lambda x: (x[1], x[0]))


def occurrences(documents: list[str | None], index: Index) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each text its verified occurrences. Texts are looked up in slabs, each of at least one whole text."""
    at = 0
    while at < len(documents):
        parts, edges, size, stop = [], [], 0, at
        gap = np.full(_GAP, 0x10FFFF, np.uint32)
        while stop < len(documents) and (stop == at or size < SLAB_CHARS):
            codes = normal(documents[stop] or "")
            edges.append(size)
            parts += [codes, gap]
            size += len(codes) + _GAP
            stop += 1
        wanted: dict[int, list[tuple[int, int]]] = {}
        for doc, item, band in index.bands(np.concatenate(parts), np.array(edges)):
            wanted.setdefault(doc, []).append((item, band))
        for doc in range(stop - at):
            yield find(parts[2 * doc], wanted[doc], index) if doc in wanted else []
        at = stop


def item_parts(benchmark: DataFrame, part_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in parts of about ``part_chars`` characters each, told apart by a hash of the text; null and blank texts don't count."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // part_chars))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        yield sorted({tuple(r) for r in part if r.text.strip()}, key=str)


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, start, stop, edits): a row for each benchmark item that occurs in a document.

    An item occurs if the whole of it, in lower case and with any white space as a space, is in the text with at most
    ``edit_share`` edits for each of its characters, rounded down; one of less than 8 characters must stand there as words of
    its own. A part of an item is no leak. White space around an item doesn't count. Null, empty and blank texts hold nothing
    and aren't found; repeated rows give repeated rows; equal items count once; of occurrences of one item that overlap, that
    with the fewest edits counts, ties to the first. Either table may be empty.
    """
    spark = docs.sparkSession
    found = None
    for items in item_parts(benchmark, part_chars):
        shared = spark.sparkContext.broadcast(Index(items, edit_share))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows = [(d, index.ids[i], a, b, e) for d, own in zip(batch.column(0).to_pylist(), occurrences(batch.column(1).to_pylist(), index)) for i, a, b, e in own]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], ["doc_id", "item_id", "start", "stop", "edits"])

        part = texts(docs).mapInArrow(run, "doc_id long, item_id long, start long, stop long, edits long")
        found = part if found is None else found.unionAll(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item occurs, with all their columns, whatever else those are named.

    See ``leaks`` for what occurs. Rows with a null or empty text stay, repeated rows stay or go together, an empty table
    stays empty and an empty benchmark lets all rows stay. No shuffle.
    """
    spark, schema = docs.sparkSession, docs.schema
    small_batches(spark)
    place = docs.columns.index("text")
    for items in item_parts(benchmark, part_chars):
        shared = spark.sparkContext.broadcast(Index(items, edit_share))

        def run(batches, shared=shared):
            for batch in batches:
                clean = [not own for own in occurrences(batch.column(place).to_pylist(), shared.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
