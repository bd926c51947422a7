"""Alignment of two tokenizers' tokens by the bytes they stand for, with packed bitsets of token ends.

Of each text both tokenizations spell the same bytes, a space and the text. A bitset per side has a bit where a token ends; their
AND holds the shared cuts. The rank of a cut, by popcounts of whole words and one masked word, is the number of tokens up to
it, so neighbouring cuts delimit a group of tokens on either side, and the tokens that end at a cut are linked. The links of all
texts are counted by pair of ids, and each text's links look their counts up.

Byte-level entries and pieces always end before a space that follows something else, so long texts are encoded in chunks, and
words, with the spaces before them, are encoded once and looked up from then on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import runs
from .common import Memo, binary, stored, texts
from .wavelet import _byte_letters, encode_all, tokenizer

#: Characters after which a text is cut at the next safe boundary.
CHUNK = 20_000
#: Bytes of text whose bitsets are made at a time; a longer text is taken alone.
BATCH_BYTES = 2 << 20
#: Tokens that are spelled at a time.
SLICE = 65_536
#: Longest word that is remembered.
WORD = 48
#: Links that a map task folds at a time.
BATCH_LINKS = 2_000_000
#: Most pairs of ids whose counts are broadcast, at 16 bytes each: the most frequent ones. The others' links are joined.
MOST_PAIRS = 1 << 20

META = "▁"
_BOUNDARY = re.compile(rf"(?<=[^\s\x1c-\x1f\x85{META}])(?= [^ ])")
_WORD = re.compile(r" +[^ ]*")


class Pieces(Memo):
    """Ids of words by the piece model, a word taking the spaces before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.blank = binary(np.array([self.model.piece_to_id(META)], np.uint32))
        super().__init__(self.ids)

    def ids(self, word: str) -> bytes:
        """The model puts a space before what it encodes; a lone space is what it makes of nothing."""
        return binary(np.array(self.model.encode(word[1:]), np.uint32)) if len(word) > 1 else self.blank

    def encode(self, spaced: str) -> np.ndarray:
        if META in spaced:  # stands for a space itself, and merges with those next to it
            return np.array(self.model.encode(spaced[1:]), np.uint32)
        self.trim()
        return np.frombuffer(b"".join([self[w] if len(w) <= WORD else self.ids(w) for w in _WORD.findall(spaced)]), np.uint32)


class Vocabularies:
    """Both sides' entries as bytes, their lengths, and what they look like in the text of groups."""

    def __init__(self, path_a: str, path_b: str):
        self.path_a, self.pieces = path_a, Pieces(path_b)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        model_a, model_b = tokenizer(path_a), self.pieces.model
        self.a = [bytes(byte_of[c] for c in model_a.id_to_token(i)) for i in range(model_a.get_vocab_size())]
        self.b = [bytes([int(model_b.id_to_piece(i)[3:5], 16)]) if model_b.is_byte(i) else model_b.id_to_piece(i).replace(META, " ").encode() for i in range(model_b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        if not (self.len_a.all() and self.len_b.all()):
            raise ValueError("an entry without bytes has no place among the ends")
        #: decimal ids with what follows them: even places within a side of a group, odd ones at its end
        self.names = [b"%d%s" % (i, end) for side, last in ((self.a, b"|"), (self.b, b";")) for i in range(len(side)) for end in (b",", last)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or none where a side doesn't spell a space and the text."""
        if not text:
            return None
        parts = chunks(" " + text)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a, b = np.concatenate(encode_all(parts, self.path_a)), np.concatenate([self.pieces.encode(p) for p in parts])
        return (a, b) if spells(self.a, a, raw) and spells(self.b, b, raw) else None


@lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """One for each worker process; the files lie on every machine."""
    return Vocabularies(path_a, path_b)


def chunks(spaced: str, size: int | None = None) -> list[str]:
    """Pieces of at least ``size`` characters, each with a space in front; both sides end a token where they part."""
    size, out, at = size or CHUNK, [], 0
    while len(spaced) - at > size and (cut := _BOUNDARY.search(spaced, at + size)):
        out.append(spaced[at : cut.start()])
        at = cut.start()
    return [*out, spaced[at:]]


def joined(entries: list[bytes], ids: np.ndarray) -> Iterator[bytes]:
    for i in range(0, len(ids), SLICE):
        yield b"".join([entries[t] for t in ids[i : i + SLICE].tolist()])


def spells(entries: list[bytes], ids: np.ndarray, raw: bytes) -> bool:
    at = 0
    for part in joined(entries, ids):
        if raw[at : at + len(part)] != part:
            return False
        at += len(part)
    return at == len(raw)


class Ends:
    """A bitset of token ends over the bytes of one or more texts, bit e - 1 for an end at byte e, with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, lengths: np.ndarray, total: int) -> Ends:
        bits = np.zeros(-(-total // 64) * 64, bool)
        bits[np.cumsum(lengths) - 1] = True
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def __and__(self, other: Ends) -> Ends:
        return Ends(self.words & other.words)

    def places(self) -> np.ndarray:
        """Where the ones are, as ``select`` of each."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones up to and with each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


def aligned_texts(found: list[tuple[np.ndarray, np.ndarray]], v: Vocabularies) -> Iterator[tuple[int, np.ndarray, np.ndarray, str]]:
    """For each text its number of groups, the ids linked on both sides and the digest of its groups."""
    a, b = (np.concatenate([x[side] for x in found]).astype(np.int64) for side in (0, 1))
    bytes_of, na, nb = (np.array(x) for x in zip(*((v.len_a[x].sum(), len(x), len(y)) for x, y in found)))
    total = int(bytes_of.sum())
    ends_a, ends_b = Ends.of(v.len_a[a], total), Ends.of(v.len_b[b], total)
    cuts = (ends_a & ends_b).places()
    upto_a, upto_b = ends_a.rank(cuts), ends_b.rank(cuts)  # tokens up to each cut
    sizes_a, sizes_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    # a group's tokens of side A, then those of side B, each with what follows it
    written = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
    written[np.arange(len(a)) + np.repeat(upto_b - sizes_b, sizes_a)] = 2 * a + last_a
    written[np.arange(len(b)) + np.repeat(upto_a, sizes_b)] = 2 * (len(v.a) + b) + last_b
    first = np.searchsorted(cuts, np.concatenate([[0], np.cumsum(bytes_of)]))
    tokens = np.concatenate([[0], np.cumsum(na + nb)])
    for i in range(len(found)):
        digest, tail = hashlib.sha256(), b""
        for part in joined(v.names, written[tokens[i] : tokens[i + 1]]):
            digest.update(tail)
            tail = part
        digest.update(tail[:-1])
        own = slice(first[i], first[i + 1])
        yield first[i + 1] - first[i], a[upto_a[own] - 1], b[upto_b[own] - 1], digest.hexdigest()


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, links, groups_sha256) of each row; links are pairs of 32-bit ids, or of 16-bit ones where
    both vocabularies have less than 65,536 entries."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"]

    def run(batches):
        v = vocabularies(path_a, path_b)
        kind = link_type(v)

        def solved(ids, rows, found) -> pa.RecordBatch:
            known = [x for x in found if x is not None]
            full = aligned_texts(known, v) if known else iter(())
            out = []
            for x in found:
                if x is None:
                    out.append((0, 0, 0, b"", ""))
                else:
                    n, p, q, digest = next(full)
                    out.append((len(x[0]), len(x[1]), int(n), binary(np.stack([p, q], axis=1).astype(kind)), digest))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names)

        for batch in batches:
            ids, rows, found, size = [], [], [], 0
            for doc_id, text, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids.append(doc_id)
                rows.append(row)
                found.append(v.encode(text))
                size += len(text or "")
                if size >= BATCH_BYTES:
                    yield solved(ids, rows, found)
                    ids, rows, found, size = [], [], [], 0
            if ids:
                yield solved(ids, rows, found)

    read = texts(docs, F.monotonically_increasing_id().alias("row"))
    return read.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string")


def link_type(v: Vocabularies) -> type:
    return np.uint16 if max(len(v.a), len(v.b)) <= 1 << 16 else np.uint32


def pairs_of(links: list[bytes], kind: type) -> np.ndarray:
    """Pairs of ids as one number each, that of side A in the high half."""
    both = np.frombuffer(b"".join(links), kind).reshape(-1, 2).astype(np.int64)
    return both[:, 0] << 32 | both[:, 1]


def added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct pairs and their times in all."""
    by = np.argsort(pairs, kind="stable")
    starts = runs(pairs[by])
    return pairs[by][starts], np.add.reduceat(times[by], starts) if len(starts) else times


def pair_counts(aligned: DataFrame, kind: type) -> DataFrame:
    """(pair, n, best): how many links corpus-wide hold each pair of ids, and whether no other pair of its B id has more.

    A map task sends each of its pairs once for two million links. The highest counts of the B ids, one for each entry of a
    vocabulary at most, are broadcast.
    """

    def run(batches):
        held, size = [], 0

        def fold():
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times, pa.int64())], ["pair", "n"])

        for batch in batches:
            held.append(pairs_of(batch.column(0).to_pylist(), kind))
            size += len(held[-1])
            if size >= BATCH_LINKS:
                yield fold()
                held, size = [], 0
        if size:
            yield fold()

    counts = stored(aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    highest = counts.groupBy(id_b.alias("id_b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), id_b == F.col("id_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(counts: DataFrame, most: int) -> Column | None:
    """A condition that holds for ``most`` of the pairs of ``counts`` or less, the most frequent ones; none if all are so few."""
    step = F.floor(F.log2("n") * 4)
    sizes = sorted(map(tuple, counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    at, bar = 0, None
    for s, n in sizes:
        at += n
        if at > most:
            return step >= (bar if bar is not None else s + 1)
        bar = s
    return None


def linked_counts(aligned: DataFrame, counts: DataFrame, kind: type, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum.

    The most frequent pairs, ``most_pairs`` or less, are broadcast. Links of others become rows that are joined to the rest of
    the counts; no pair of those is frequent, so no task gets more than its share.
    """
    chosen = frequent_pairs(counts, most_pairs)
    near = counts if chosen is None else counts.filter(chosen)
    table = near.select("pair", (F.col("n") * 2 + F.col("best").cast("int")).alias("code")).toArrow()
    pairs, codes = table.column("pair").to_numpy(), table.column("code").to_numpy()
    by = np.argsort(pairs)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs[by], codes[by]))
    sums = ["n_links", "n_best", "count_sum"]

    def looked_up(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, codes = shared.value
        if not len(keys):
            return np.zeros(len(links), bool), np.zeros(len(links), np.int64)
        at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
        return keys[at] == links, codes[at]

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(6).to_pylist():
                known, code = looked_up(pairs_of([raw], kind))
                code = code[known]
                out.append((len(known), int((code & 1).sum()), int((code >> 1).sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [])))], ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *sums])

    def rest(batches):
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                links = pairs_of([raw], kind)
                pairs, times = np.unique(links[~looked_up(links)[0]], return_counts=True)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(times, pa.int64())], ["row", "pair", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    found = aligned.select(*kept, "links").mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    if chosen is None:
        return found
    joined_rows = aligned.select("row", "links").mapInArrow(rest, "row long, pair long, times long").join(counts.filter(~chosen), "pair")
    more = joined_rows.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    total = lambda name, part: (F.col(name) + F.coalesce(F.col(part), F.lit(0))).alias(name)
    return found.join(more, "row", "left").select(*kept, "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Side A is a byte-level BPE of the tokenizers library, side B a piece model of sentencepiece that puts a space in front.
    Texts that are null, empty or spelled differently by a side, such as those with U+2581, have zeros and an empty digest.
    Special tokens' strings are text. Repeated rows are aligned and counted each; a null doc_id stays null; an empty table
    gives no rows. Long texts are encoded in chunks, and one without a space is encoded whole.
    """
    kind = link_type(vocabularies(path_a, path_b))
    aligned = stored(alignments(docs, path_a, path_b), "aligned")
    found = linked_counts(aligned, stored(pair_counts(aligned, kind), "counts"), kind, most_pairs)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
