"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

1. A text becomes the set of hashes of its word shingles; equal sets are one node from here on (``sid``, a hash of the
   set), so copies never meet as pairs.
2. Shingles meet by hash. Those of one node only are no part of any overlap; a node of which fewer than the required share
   are held elsewhere can have no link. What stays is the nodes with near copies, each with its shared shingles and how
   many nodes hold them. Shingles that are frequent in a bounded sample are known to be shared and aren't sent.
3. Shingles are ordered from rare to frequent. A node of n shingles overlaps any partner in at least need = ceil(t n), so
   among its first n - need + l shingles at least l are the partner's as well, if the partner's prefix is as long. Each node
   picks its l by the estimated cost of looking at and verifying candidates; a pair must share as many prefix shingles as
   the smaller l of both.
4. Candidates are verified by their whole overlap in two passes. In the first, each prefix shingle only pairs its most
   central node with the others, which joins a group of near copies through its centre. In the second, every pair that
   shares prefix shingles but isn't connected yet is a candidate, so no link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import binary, lower_words, sampled, shuffle_partitions, stored, text_parts, texts
from .components import components
from .substring import window_hashes, word_hashes

#: Shingles that a map task folds at a time.
BATCH_SHINGLES = 600_000
#: Buckets of hash values for each shuffle partition, and bytes of text behind one at most, about; one bucket at a time is
#: in a task's memory.
BUCKETS_PER_PARTITION = 2
BUCKET_BYTES = 64 << 20
#: Nodes of one block of a prefix shingle's posting; pairs of blocks are dealt to tasks.
BLOCK_NODES = 2_000
#: The same where nodes only meet the posting's centre.
STAR_NODES = 65_536
#: Bytes of the nodes' shingles behind one bucket of postings, about.
POSTING_BYTES = 8 << 20
#: Node counts from here on are not exact: capped, or of a frequent shingle.
INEXACT = 65_534
#: Nodes of one verification group.
GROUP_NODES = 2_000
#: Candidates that a task holds before it passes them on.
BATCH_PAIRS = 500_000
#: Prefix extensions to choose from.
LEVELS = (1, 2, 4, 8)
#: Cost of verifying a candidate, in looks at a posting.
VERIFY_COST = 4.0


def shingles(text: str | None, width: int) -> np.ndarray:
    """Ascending distinct hashes of the ``width``-word shingles; a shorter text is one shingle."""
    tokens = lower_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(tokens), min(width, len(tokens))))


def set_id(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=1))))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sid, n) of each row; sid is null for a text without words."""

    def run(batches):
        for batch in batches:
            sids, sizes = [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                sizes.append(len(s))
                sids.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "sid", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid long, n long")


def frequent(docs: DataFrame, width: int, sample_docs: int, share: float) -> np.ndarray:
    """Ascending shingles that at least ``share`` of a sample's sets hold; at most mean set size / share of them."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), set_id(s), np.int64))], ["h", "sid"])

    chosen = sampled(docs.select("doc_id", "text").filter("doc_id is not null"), F.col("doc_id"), sample_docs)
    found = chosen.mapInArrow(run, "h long, sid long").distinct()
    counted = found.groupBy("h").count().filter(F.col("count") >= max(20, int(share * sample_docs)))
    return np.sort(np.array([r[0] for r in counted.select("h").collect()], np.int64).view(np.uint64))


def node_group(sids: np.ndarray, groups: int) -> np.ndarray:
    """Nodes are hashes already; ``node_group_column`` is the same as a column."""
    return (sids & 0x7FFFFFFF) % groups


def node_group_column(sid: Column, groups: int) -> Column:
    return (sid.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % groups).cast("int")


def need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def shared_shingles(docs: DataFrame, width: int, percent: int, hot: np.ndarray) -> DataFrame:
    """(sid, n, tokens, counts) of nodes that may have a link: shared shingles from rare to frequent and their node counts."""
    spark = docs.sparkSession
    n_buckets = text_parts(docs, BUCKETS_PER_PARTITION, BUCKET_BYTES)
    common = spark.sparkContext.broadcast(hot)

    def send(batches):
        hot = common.value
        sets: dict[int, np.ndarray] = {}
        held = 0

        def fold():
            sids = np.array(list(sets), np.int64)
            order = np.argsort(sids)
            parts = [sets[int(s)] for s in sids[order]]
            owner = np.repeat(sids[order], [len(p) for p in parts])
            h = np.concatenate(parts)
            is_hot = np.isin(h, hot)
            rows: dict[str, list] = {"bucket": [], "hashes": [], "owners": [], "sizes": [], "kind": []}
            rest, own = h[~is_hot], owner[~is_hot]
            by = np.argsort(rest, kind="stable")
            for b, _, raw, ids, sizes in blobs.pack(rest[by], own[by], n_buckets):
                for k, v in zip(rows, (b, raw, ids, sizes, 0)):
                    rows[k].append(v)
            # each node's size and frequent shingles go straight to its group
            group = blobs.spread(sids[order], n_buckets)
            hot_sizes = np.array([int(np.isin(p, hot).sum()) for p in parts], np.uint32) if len(hot) else np.zeros(len(parts), np.uint32)
            for g in np.unique(group).tolist():
                at = np.flatnonzero(group == g)
                tokens = [parts[i][np.isin(parts[i], hot)] for i in at if hot_sizes[i]]
                numbers = np.stack([np.array([len(parts[i]) for i in at], np.uint32), hot_sizes[at]], axis=1)
                for k, v in zip(rows, (g, binary(np.concatenate(tokens)) if tokens else b"", binary(sids[order][at]), binary(numbers), 1)):
                    rows[k].append(v)
            return pa.RecordBatch.from_pydict(rows, blobs.ARROW.append(pa.field("kind", pa.int32())))

        for batch in batches:
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                if len(s) and (sid := set_id(s)) not in sets:
                    sets[sid] = s
                    held += len(s)
                if held >= BATCH_SHINGLES:
                    yield fold()
                    sets, held = {}, 0
        if sets:
            yield fold()

    def meet(table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_pylist() for c in ("hashes", "owners", "sizes", "kind")}
        at = [i for i, k in enumerate(raw["kind"]) if k == 0]
        h, owner = blobs.unpack(*([raw[c][i] for i in at] for c in ("hashes", "owners", "sizes")))
        by = np.lexsort((owner, h))
        h, owner = h[by], owner[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])  # a node seen by several map batches
        h, owner = h[new], owner[new]
        starts = blobs.runs(h)
        counts = np.diff(np.append(starts, len(h)))
        each = np.repeat(counts, counts)
        held = each > 1
        h, owner, each = h[held], owner[held], np.minimum(each[held], INEXACT).astype(np.uint16)
        group = blobs.spread(owner, n_buckets)
        by = np.lexsort((owner, group))
        h, owner, each, group = h[by], owner[by], each[by], group[by]
        rows: dict[str, list] = {"group": [], "hashes": [], "owners": [], "sizes": [], "counts": [], "kind": []}
        for g, lo, hi in blobs.stretches(group):
            ids, sizes = np.unique(owner[lo:hi], return_counts=True)
            for k, v in zip(rows, (g, binary(h[lo:hi]), binary(ids), binary(sizes.astype(np.uint32)), binary(each[lo:hi]), 0)):
                rows[k].append(v)
        buckets = table.column("bucket").to_pylist()
        for i, k in enumerate(raw["kind"]):
            if k == 1:
                for name, v in zip(rows, (buckets[i], raw["hashes"][i], raw["owners"][i], raw["sizes"][i], None, 1)):
                    rows[name].append(v)
        fields = [("group", pa.int32()), *((c, pa.binary()) for c in ("hashes", "owners", "sizes", "counts")), ("kind", pa.int32())]
        return pa.table(rows, pa.schema(fields))

    def gather(table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_pylist() for c in ("hashes", "owners", "sizes", "counts", "kind")}
        size: dict[int, int] = {}
        hashes, owners, counts = [], [], []
        for h, o, s, c, kind in zip(*raw.values()):
            ids, tokens = np.frombuffer(o, np.int64), np.frombuffer(h, np.uint64)
            if kind == 0:
                numbers = np.frombuffer(s, np.uint32)
                counts.append(np.frombuffer(c, np.uint16))
            else:
                both = np.frombuffer(s, np.uint32).reshape(-1, 2)
                size.update(zip(ids.tolist(), both[:, 0].tolist()))
                numbers = both[:, 1]
                # the low bytes are what the others have; two frequent shingles that differ in the high one alone count as one
                tokens = tokens & np.uint64((1 << 8 * blobs.WIDTH) - 1)
                counts.append(np.full(len(tokens), INEXACT + 1, np.uint16))
            hashes.append(tokens)
            owners.append(np.repeat(ids, numbers))
        h, owner, count = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, owners, counts))
        by = np.lexsort((h, count, owner))
        h, owner, count = h[by], owner[by], count[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner, count = h[new], owner[new], count[new]
        starts = blobs.runs(owner)
        ends = np.append(starts[1:], len(h)).astype(np.int64)
        out: dict[str, list] = {"sid": [], "n": [], "tokens": [], "counts": []}
        for a, b in zip(starts.tolist(), ends.tolist()):
            sid = int(owner[a])
            if b - a >= need(size[sid], percent):
                for k, v in zip(out, (sid, size[sid], binary(h[a:b]), binary(count[a:b]))):
                    out[k].append(v)
        return pa.table(out, pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())]))

    sent = docs.select("doc_id", "text").mapInArrow(send, blobs.SCHEMA + ", kind int")
    met = sent.groupBy("bucket").applyInArrow(meet, "group int, hashes binary, owners binary, sizes binary, counts binary, kind int")
    return met.groupBy("group").applyInArrow(gather, "sid long, n long, tokens binary, counts binary")


def prefix(n: int, counts: np.ndarray, percent: int) -> tuple[int, int]:
    """How many of a node's shared shingles its prefix takes, and how many of them a pair must share.

    The shingles that no other node holds come before the shared ones in the order and take their places in the prefix.
    """
    base = len(counts) - need(n, percent)  # a prefix that asks for l shared shingles has l more
    looks = np.cumsum(counts.astype(np.float64) - 1)
    best, chosen = math.inf, 1
    for level in LEVELS:
        size = base + level
        if size > len(counts):
            break
        cost = looks[size - 1] * (1 + VERIFY_COST / level)
        if cost < best:
            best, chosen = cost, level
    return min(base + chosen, len(counts)), chosen


def centrality(counts: np.ndarray, n: int) -> int:
    """High for the centre of near copies, which holds the shingles that most of them hold."""
    return int(np.log(counts).sum() / n * 1e6)


def long_postings(nodes: DataFrame, percent: int) -> dict[int, tuple[int, int]]:
    """How many nodes have each of the most frequent shingles in their prefixes, if more than a block, and the most central one.

    Only shingles whose number of nodes isn't known are counted, which are few: frequent in a sample or held by 65,534 nodes.
    """

    def run(batches):
        for batch in batches:
            found, central, sids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for sid, n, tokens, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                c = np.frombuffer(counts, np.uint16)
                size = prefix(n, c, percent)[0]
                found.append(np.frombuffer(tokens, np.uint64)[:size][c[:size] >= INEXACT])
                central.append(np.full(len(found[-1]), centrality(c, n)))
                sids.append(np.full(len(found[-1]), sid))
            h, rank, sid = (np.concatenate(x) for x in (found, central, sids))
            by = np.lexsort((sid, rank, h))
            starts = blobs.runs(h[by])
            last = by[np.append(starts[1:], len(h)).astype(int) - 1] if len(h) else by
            times = np.diff(np.append(starts, len(h)))
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[last].view(np.int64)), "times": pa.array(times, pa.int64()), "central": pa.array(rank[last]), "sid": pa.array(sid[last])})

    found = nodes.select("sid", "n", "tokens", "counts").mapInArrow(run, "h long, times long, central long, sid long")
    counted = found.groupBy("h").agg(F.sum("times").alias("times"), F.max(F.struct("central", "sid"))["sid"].alias("centre"))
    return {h: (times, centre) for h, times, centre in counted.filter(F.col("times") > BLOCK_NODES).collect()}


def block_pairs(sid: int, blocks: int) -> list[int]:
    """The cells of a posting's upper triangle of block pairs that a node belongs to."""
    own = own_block(sid, blocks)
    return [min(own, k) * blocks + max(own, k) for k in range(blocks)]


def own_block(sid: int, blocks: int) -> int:
    return (sid >> 31 & 0x7FFFFFFF) % blocks


def verified_links(nodes: DataFrame, labels: DataFrame | None, percent: int, groups: int) -> DataFrame:
    """(a, b) of linked nodes. Without ``labels`` only pairs of a prefix shingle's most central node with the others are
    looked at; with them all pairs that share enough of their prefixes and have different labels. A group of nodes passes
    on no more links than connect it.

    For all pairs, a posting of more than a block's nodes is dealt to tasks by pairs of blocks; for those with the centre, one of
    65,534 nodes or more is dealt by blocks, and its centre to each of them. There are as many buckets of postings as the nodes'
    shingles ask for, and a bucket's pairs are passed on a part at a time.
    """
    held_bytes = nodes.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    n_buckets = max(shuffle_partitions(nodes.sparkSession), -(-held_bytes // POSTING_BYTES))
    star = labels is None
    many = nodes.sparkSession.sparkContext.broadcast(long_postings(nodes, percent))
    rows = nodes.withColumn("label", F.col("sid")) if star else nodes.join(labels, nodes.sid == labels.node, "left").select("sid", "n", "tokens", "counts", F.coalesce("root", "sid").alias("label"))

    def cells(sid: int, tokens: np.ndarray, counts: np.ndarray) -> list[tuple[int, list[int]]]:
        """Places in a prefix whose posting is parted, with the node's cells there."""
        out = []
        for i in np.flatnonzero(counts >= INEXACT if star else counts > BLOCK_NODES).tolist():
            n, centre = many.value.get(int(tokens[i].view(np.int64)), (0, 0)) if counts[i] >= INEXACT else (int(counts[i]), 0)
            if star and n > STAR_NODES:
                blocks = -(-n // STAR_NODES)
                out.append((i, list(range(blocks)) if sid == centre else [own_block(sid, blocks)]))
            elif n > BLOCK_NODES and not star:
                out.append((i, block_pairs(sid, -(-n // BLOCK_NODES))))
        return out

    def send(batches):
        for batch in batches:
            hashes, ids, facts, places = [], [], [], []
            for sid, n, tokens, counts, label in zip(*(batch.column(i).to_pylist() for i in range(5))):
                c = np.frombuffer(counts, np.uint16)
                size, level = prefix(n, c, percent)
                h, cell = np.frombuffer(tokens, np.uint64)[:size], np.zeros(size, np.int64)
                if parted := cells(sid, h, c[:size]):
                    times = np.ones(size, np.int64)
                    for i, own in parted:
                        times[i] = len(own)
                    h, cell = np.repeat(h, times), np.zeros(times.sum(), np.int64)
                    for i, own in parted:
                        at = times[:i].sum()
                        cell[at : at + len(own)] = 1 + np.array(own)
                hashes.append(h)
                places.append(cell)
                ids.append(np.full(len(h), sid, np.int64))
                facts.append(np.tile(np.array([[n, level, label, centrality(c, n)]], np.int64), (len(h), 1)))
            if not hashes:
                continue
            h, owner, fact, cell = np.concatenate(hashes), np.concatenate(ids), np.concatenate(facts), np.concatenate(places)
            with np.errstate(over="ignore"):  # a posting's cells are postings of their own
                h = np.where(cell > 0, (h + cell.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93), h)
            bucket = blobs.spread(h, n_buckets)
            by = np.argsort(bucket, kind="stable")
            full = list(blobs.stretches(bucket[by]))
            cut = [by[lo:hi] for _, lo, hi in full]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in full], pa.int32()), "hashes": [binary(h[i]) for i in cut], "owners": [binary(owner[i]) for i in cut], "facts": [binary(fact[i]) for i in cut]})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        owner = np.frombuffer(b"".join(table.column("owners").to_pylist()), np.int64)
        fact = np.frombuffer(b"".join(table.column("facts").to_pylist()), np.int64).reshape(-1, 4)
        del table
        by = np.lexsort((owner, h))
        h, owner, fact = h[by], owner[by], fact[by]
        size, level, label, central = fact.T
        pending: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate(pending) if pending else np.zeros((0, 3), np.int64)
            pending.clear()
            group = node_group(pairs[:, 0], groups)
            order = np.argsort(group, kind="stable")
            full = list(blobs.stretches(group[order]))
            return pa.RecordBatch.from_pydict({"group": pa.array([g for g, _, _ in full], pa.int32()), "pairs": pa.array([binary(pairs[order[lo:hi]]) for _, lo, hi in full], pa.binary())})

        held = 0
        starts = blobs.runs(h)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(h)).astype(int).tolist()):
            if b - a < 2:
                continue
            if star:
                firsts = [b - 1 - int(np.argmax(central[a:b][::-1]))]  # of equally central ones the last, as in long_postings
            else:
                if (label[a:b] == label[a]).all():
                    continue
                firsts = range(a, b - 1)
            for i in firsts:
                lo = a if star else i + 1
                fits = 100 * np.minimum(size[lo:b], size[i]) >= percent * np.maximum(size[lo:b], size[i])
                js = lo + np.flatnonzero(fits & (label[lo:b] != label[i]))
                if len(js):
                    pending.append(np.stack([np.full(len(js), owner[i]), owner[js], np.minimum(level[js], level[i])], axis=1))
                    held += len(js)
                    if held >= BATCH_PAIRS:
                        yield flush()
                        held = 0
        yield flush()

    def ask(key, pairs: pa.Table, own: pa.Table) -> pa.Table:
        out: dict[str, list] = {"group": [], "sid": [], "n": [], "tokens": [], "others": []}
        if pairs.num_rows:
            p = np.frombuffer(b"".join(pairs.column("pairs").to_pylist()), np.int64).reshape(-1, 3)
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:, :2] != p[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(p)))
            p = p[starts]
            if not star:  # a centre is compared whatever they share: its links only spare the second pass work
                p = p[times >= p[:, 2]]
            sets = dict(zip(own.column("sid").to_pylist(), zip(own.column("n").to_pylist(), own.column("tokens").to_pylist())))
            first = blobs.runs(p[:, 0])
            for a, b in zip(first.tolist(), np.append(first[1:], len(p)).astype(int).tolist()):
                sid, others = int(p[a, 0]), p[a:b, 1]
                group = node_group(others, groups)
                for g in np.unique(group).tolist():
                    for k, v in zip(out, (g, sid, *sets[sid], binary(others[group == g]))):
                        out[k].append(v)
        return pa.table(out, pa.schema([("group", pa.int32()), ("sid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("others", pa.binary())]))

    def verify(key, asked: pa.Table, own: pa.Table) -> pa.Table:
        a_side, b_side = [], []
        if asked.num_rows:
            labels_of = dict(zip(own.column("sid").to_pylist(), own.column("label").to_pylist()))
            sizes = dict(zip(own.column("sid").to_pylist(), own.column("n").to_pylist()))
            raw = dict(zip(own.column("sid").to_pylist(), own.column("tokens").to_pylist()))
            sets: dict[int, set[int]] = {}
            parent: dict[int, int] = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, n, tokens, others in zip(*(asked.column(c).to_pylist() for c in ("sid", "n", "tokens", "others"))):
                mine = set(np.frombuffer(tokens, np.uint64).tolist())
                for y in np.frombuffer(others, np.int64).tolist():
                    # nodes with one label are connected already
                    rx, ry = root(("n", x)), root(("l", labels_of[y]))
                    if rx == ry:
                        continue
                    if (theirs := sets.get(y)) is None:
                        theirs = sets[y] = set(np.frombuffer(raw[y], np.uint64).tolist())
                    both = len(mine & theirs)
                    if 100 * both >= percent * (n + sizes[y] - both):
                        parent[rx] = ry
                        a_side.append(x)
                        b_side.append(y)
        return pa.table({"a": pa.array(a_side, pa.int64()), "b": pa.array(b_side, pa.int64())})

    grouped = rows.withColumn("group", node_group_column(F.col("sid"), groups))
    sent = rows.select("sid", "n", "tokens", "counts", "label").mapInArrow(send, "bucket int, hashes binary, owners binary, facts binary")
    pairs = sent.groupBy("bucket").applyInArrow(candidates, "group int, pairs binary")
    held = grouped.select("group", "sid", "n", "tokens", "label").groupBy("group")
    asked = pairs.groupBy("group").cogroup(held).applyInArrow(ask, "group int, sid long, n long, tokens binary, others binary")
    return asked.groupBy("group").cogroup(held).applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, sample_docs: int = 20_000, frequent_share: float = 0.005) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id reachable by links.

    Null and empty texts have no shingles and no link. Texts with equal sets are one node; repeated rows are copies. Rows
    without a doc_id link like others, but never name a component; one that is alone has a null component.
    An empty table gives no rows. Components that take more than 60 rounds to settle are a RuntimeError.
    """
    rows = texts(docs)
    sets = stored(shingle_sets(rows, width), "sets")
    hot = frequent(rows, width, sample_docs, frequent_share)
    nodes = stored(shared_shingles(rows, width, percent, hot), "nodes")
    groups = max(1, -(-nodes.count() // GROUP_NODES))  # not more: a node goes once to each group that it has candidates in
    first = stored(verified_links(nodes, None, percent, groups), "centre")
    roots = components(first)
    second = stored(verified_links(nodes, stored(roots, "roots"), percent, groups), "rest")
    joined = components(first.unionAll(second))
    known = sets.join(joined, sets.sid == joined.node, "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    named = known.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return known.join(named, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with all their columns, whatever else those are named.

    Rows without a doc_id stay, as nothing can name them. Rows that share a doc_id stay or go together, so repeated rows stay
    repeated. Null and empty texts are linked with nothing and stay. An empty table stays empty.
    """
    found = near_duplicates(docs, **how)
    gone = found.filter("doc_id is not null and component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
