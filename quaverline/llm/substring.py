"""Substring dedup by suffix automata of reference shards.

Which documents need which reference is found first: hashes of all windows of ``min_words`` words meet by hash, and each
window that an earlier document holds as well names one such document, its home. Homes are the reference. They are
dealt into shards; a shard's automaton is built from the whole texts of its homes, and every document that has a home
there is streamed through it for its matching statistics. Spans that match at least ``min_words`` words of a smaller
document go.

The reference of a corpus against itself grows with the corpus, so automata are built where their shard's documents are
dealt to rather than sent to every executor; a shard that many documents ask for is dealt to several groups, each with
its own copy of the bounded automaton. ``remove_reference`` broadcasts the automata of a reference whose size is checked.

Hashes travel as byte strings, one for each map batch and bucket, after equal windows of the batch are folded: a window
that a third of all documents hold is sent once for each batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import binary, stored, text_parts, texts, words

#: Windows that a map task folds at a time.
BATCH_WINDOWS = 600_000
#: Buckets of hash values for each shuffle partition, and bytes of text behind one at most, about; one bucket at a time is
#: in a task's memory.
BUCKETS_PER_PARTITION = 2
BUCKET_BYTES = 64 << 20
#: The same of shards.
SHARDS_PER_PARTITION = 4
SHARD_BYTES = 16 << 20
#: Words of one automaton (about 1 KB each while it lives); a shard with more is worked off in several.
AUTOMATON_WORDS = 100_000
#: Documents streamed through one copy of a shard's automaton.
GROUP_DOCS = 2_000


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    factor, power = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            power = power * factor
            out += hashes[j : j + count] * power
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _pairs(doc: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((home, doc))
    doc, home = doc[order], home[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (home[1:] != home[:-1])
    return doc[new], home[new]


def _by_doc(doc: np.ndarray, home: np.ndarray, n: int) -> tuple[list[int], list[bytes]]:
    """Pairs as one byte string for each group of documents."""
    group = _spread(doc, n)
    order = np.argsort(group, kind="stable")
    both = np.stack([doc, home], axis=1)[order]
    full = list(blobs.stretches(group[order]))
    return [g for g, _, _ in full], [binary(both[lo:hi]) for _, lo, hi in full]


def homes(rows: DataFrame, min_words: int) -> DataFrame:
    """Distinct (doc_id, home): for each window of a document that a smaller id holds, one such id."""
    n = text_parts(rows, BUCKETS_PER_PARTITION, BUCKET_BYTES)

    def send(batches):
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def fold():
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            doc = np.repeat(np.array(ids, np.int64)[order], [len(parts[i]) for i in order])
            h = np.concatenate([parts[i] for i in order])
            by = np.argsort(h, kind="stable")  # so a window's smallest document comes first
            h, doc = h[by], doc[by]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            least = doc[new][np.cumsum(new) - 1]
            later = doc > least
            known_groups, known = _by_doc(*_pairs(doc[later], least[later]), n)
            h, doc = h[new], doc[new]
            bucket = ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)
            out: dict[str, list] = {"bucket": [], "windows": [], "docs": [], "sizes": [], "known": [], "known_group": []}
            for b, lo, hi in blobs.stretches(bucket):
                to = np.argsort(doc[lo:hi], kind="stable")
                d, sizes = np.unique(doc[lo:hi], return_counts=True)
                out["bucket"].append(b)
                out["windows"].append(binary(h[lo:hi][to].view(np.uint8).reshape(-1, 8)[:, :7]))
                out["docs"].append(binary(d))
                out["sizes"].append(binary(sizes.astype(np.uint32)))
                out["known"].append(None)
                out["known_group"].append(None)
            for g, raw in zip(known_groups, known):
                for k, v in (("bucket", g), ("windows", None), ("docs", None), ("sizes", None), ("known", raw), ("known_group", g)):
                    out[k].append(v)
            return pa.RecordBatch.from_pydict(out, schema)

        schema = pa.schema([("bucket", pa.int32()), ("windows", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("known", pa.binary()), ("known_group", pa.int32())])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.unique(window_hashes(word_hashes(words(text)), min_words))
                if len(h):
                    ids.append(doc_id)
                    parts.append(h)
                    held += len(h)
                if held >= BATCH_WINDOWS:
                    yield fold()
                    ids, parts, held = [], [], 0
        if ids:
            yield fold()

    def meet(table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_pylist() for c in ("windows", "docs", "sizes", "known", "known_group")}
        windows = np.frombuffer(b"".join(w for w in raw["windows"] if w), np.uint8).reshape(-1, 7)
        h = np.zeros((len(windows), 8), np.uint8)
        h[:, :7] = windows
        h = h.view(np.uint64).ravel()
        docs = np.frombuffer(b"".join(d for d in raw["docs"] if d), np.int64)
        docs = np.repeat(docs, np.frombuffer(b"".join(s for s in raw["sizes"] if s), np.uint32))
        by = np.argsort(h, kind="stable")
        h, docs = h[by], docs[by]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(h)))) if len(h) else docs
        later = docs > least
        groups, pairs = _by_doc(*_pairs(docs[later], least[later]), n)
        for g, k in zip(raw["known_group"], raw["known"]):
            if k:
                groups.append(g)
                pairs.append(k)
        return pa.table({"docs": pa.array(groups, pa.int32()), "pairs": pa.array(pairs, pa.binary())})

    def distinct(table: pa.Table) -> pa.Table:
        both = np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
        doc, home = _pairs(both[:, 0], both[:, 1])
        return pa.table({"doc_id": doc, "home": home})

    sent = rows.filter("doc_id is not null").mapInArrow(send, "bucket int, windows binary, docs binary, sizes binary, known binary, known_group int")
    met = sent.groupBy("bucket").applyInArrow(meet, "docs int, pairs binary")
    return met.groupBy("docs").applyInArrow(distinct, "doc_id long, home long")


class SuffixAutomaton:
    """Of several word sequences, added in ascending document order; each state knows the first document that holds it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, first: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter strings that reach it through p."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, doc: int, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            cur = self._state(length[last] + 1, doc, {}, 0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def matches(self, doc: int, sequence: list[int], n: int) -> list[int]:
        """Ends of all windows of n items that a document below ``doc`` holds, by the matching statistics of ``sequence``.

        A match longer than n is followed by its last n items only: those are what the window at its end asks about.
        """
        nxt, link, length, first = self.next, self.link, self.length, self.first
        found, v, at = [], 0, 0
        for i, c in enumerate(sequence):
            while v and c not in nxt[v]:
                v = link[v]
                at = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                at += 1
            if at >= n:
                while length[link[v]] >= n:
                    v = link[v]
                at = min(at, n)
                if first[v] < doc:
                    found.append(i)
        return found


def spans(ends: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal [start, stop) of words that the windows with these ends cover."""
    out: list[list[int]] = []
    for e in sorted(ends):
        if out and e - n + 1 <= out[-1][1]:
            out[-1][1] = e + 1
        else:
            out.append([e - n + 1, e + 1])
    return [(a, b) for a, b in out]


def _automata(reference: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], most: int, n: int):
    """Automata of about ``most`` words each, built one at a time.

    A longer document is parted; as the parts overlap by n - 1 words, each of its windows of n words is whole in one.
    """
    automaton, held = SuffixAutomaton(), 0
    for doc, tokens in reference:
        for at in range(0, max(len(tokens) - n + 1, 1), most):
            part = tokens[at : at + most + n - 1]
            if held and held + len(part) > most:
                yield automaton
                automaton, held = SuffixAutomaton(), 0
            automaton.add(doc, [vocabulary.setdefault(w, len(vocabulary)) for w in part])
            held += len(part)
    if held:
        yield automaton


def repeated_spans(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, found): for each text, by its ``sig``, the word positions at which a window ends that a smaller document holds."""
    n = text_parts(rows, SHARDS_PER_PARTITION, SHARD_BYTES)
    pairs = stored(homes(rows.select("doc_id", "text"), min_words), "homes").withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(n)).cast("int"))
    streamed = pairs.select("shard", "doc_id").distinct()
    salts = streamed.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_DOCS).cast("int").alias("salts"))
    stream = streamed.join(salts, "shard").select("doc_id", "shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("reference"))
    reference = (
        pairs.select("shard", F.col("home").alias("doc_id")).distinct().join(salts, "shard")
        .select("doc_id", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("reference"))
    )
    roles = stream.unionByName(reference)

    def match(table: pa.Table) -> pa.Table:
        ids, bodies, sigs, refs = (table.column(c).to_pylist() for c in ("doc_id", "text", "sig", "reference"))
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        vocabulary: dict[bytes, int] = {}
        found: dict[int, set[int]] = {}
        for automaton in _automata([(ids[i], words(bodies[i])) for i in order if refs[i]], vocabulary, AUTOMATON_WORDS, min_words):
            for i in order:
                if not refs[i]:
                    found.setdefault(i, set()).update(automaton.matches(ids[i], [vocabulary.get(w, -1) for w in words(bodies[i])], min_words))
        kept = [i for i, e in found.items() if e]
        return pa.table(
            {
                "doc_id": pa.array([ids[i] for i in kept], pa.int64()),
                "sig": pa.array([sigs[i] for i in kept], pa.int64()),
                "ends": pa.array([sorted(found[i]) for i in kept], pa.list_(pa.int32())),
            }
        )

    matched = rows.join(roles, "doc_id").groupBy("shard", "salt").applyInArrow(match, "doc_id long, sig long, ends array<int>")
    return matched.groupBy("doc_id").agg(F.collect_list(F.struct("sig", "ends")).alias("found"))


def _kept(tokens: list[bytes], cut: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in cut:
        out += tokens[at:a]
        at = b
    return out + tokens[at:]


def _with_spans(docs: DataFrame, min_words: int, *keep: str) -> DataFrame:
    """doc_id, text, keep... and ends of each row. Both joins with the texts read one exchange by doc_id."""
    rows = texts(docs, F.xxhash64(F.col("text").cast("string")).alias("sig"), *keep)
    cut = repeated_spans(texts(docs, F.xxhash64(F.col("text").cast("string")).alias("sig")) if keep else rows, min_words)
    own = F.flatten(F.transform(F.filter("found", lambda x: x["sig"] == F.col("sig")), lambda x: x["ends"]))
    return rows.join(cut, "doc_id", "left").select("doc_id", "text", own.alias("ends"), *keep)


def substring_dedup(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """Digest of each document without its repeated spans: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words. Rows without a doc_id have no order: they keep everything and give no reference.
    Rows that share a doc_id are judged each by its own text, never against each other. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = words(text)
                kept = _kept(tokens, spans(ends, min_words)) if ends else tokens
                n_words.append(len(tokens))
                n_removed.append(len(tokens) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs, min_words).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_substrings(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """``docs`` with repeated spans cut from ``text``; other columns unchanged. Texts without such spans stay byte for byte.

    What is left of a cut text is its kept words joined by one space, and may be empty. Null and empty texts stay as they are,
    as do rows without a doc_id. Rows that share a doc_id are cut each by its own text, so repeated rows stay equal; of a
    passage that several documents hold, that with the smallest doc_id keeps it. An empty table stays empty. Other columns
    may have any name.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)))
    joined = _with_spans(plain, min_words, *(f"_{i}" for i in range(len(others))))

    def run(batches):
        for batch in batches:
            out = []
            for text, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(b" ".join(_kept(words(text), spans(ends, min_words))).decode("utf-8", "surrogatepass") if ends else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), *batch.columns[3:]], ["doc_id", "text", *(f"_{i}" for i in range(len(others)))])

    fields = [f"`_{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)]
    cut = joined.mapInArrow(run, ", ".join(["doc_id long", "text string", *fields]))
    names = {c: f"_{i}" for i, c in enumerate(others)}
    return cut.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def remove_reference(docs: DataFrame, reference: DataFrame, min_words: int = 13, max_reference_words: int = 2_000_000, shards: int = 8) -> DataFrame:
    """(doc_id, ends) against a separate reference that is small: its automata are broadcast, one variable for each shard.

    Raises ValueError if the reference has more than ``max_reference_words`` words.
    """
    spark = docs.sparkSession
    total = reference.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if total > max_reference_words:
        raise ValueError(f"the reference has about {total} words; at most {max_reference_words} are broadcast")
    bodies = [words(r[0]) for r in reference.select("text").collect()]
    sent = [spark.sparkContext.broadcast([b for b in bodies[k::shards] if len(b) >= min_words]) for k in range(shards)]

    def run(batches):
        built = []
        for part in sent:
            vocabulary: dict[bytes, int] = {}
            built += [(a, vocabulary) for a in _automata([(-1, b) for b in part.value], vocabulary, AUTOMATON_WORDS, min_words)]
        for batch in batches:
            ends = []
            for text in batch.column(1).to_pylist():
                tokens, own = words(text), set()
                for automaton, vocabulary in built:
                    own.update(automaton.matches(0, [vocabulary.get(w, -1) for w in tokens], min_words))
                ends.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "ends"])

    return texts(docs).mapInArrow(run, "doc_id long, ends array<int>")
