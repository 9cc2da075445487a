"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the reflected Gray code, so that neighbours
in the order share long bit patterns. Consecutive fingerprints form leaf groups,
consecutive groups form upper nodes; a node keeps the mask of the bits on which all
below it agree, and their value. Two nodes whose shared bits already differ in more
than ``radius`` places have no pair of close fingerprints, and all below them is
pruned at once.

The index is spread over tasks by masked patterns as well: 64 bits in radius + 1
blocks, of which two linked fingerprints share at least one whole. A pattern that
too many distinct fingerprints share is refined by the same rule over its remaining
bits, again and again if need be, until at most 16 bits are free. So no task ever
gets more than ``capacity`` (or 65,536) fingerprints of a pattern, whatever the data.
A pattern's task returns an edge for each fingerprint that isn't the least of its
component there, not its pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed, gathered, narrow, parts, shuffle_width, utf8
from .components import least_linked, stars
from .exact import Bitmap

FULL = (1 << 64) - 1
#: Children of a node.
FAN = 8
#: Pairs of nodes looked at in one vectorised step.
STEP = 1 << 17
#: Texts of a group that are compared with the rest of it in the first further round; how much more in each next one, up to what.
HUBS, MORE, MOST = 16, 16, 4096
#: Members of a group, or pairs, that one task looks at, about; sets that documents of one fingerprint are dealt out to.
SHARE, SETS = 4096, 4096


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _majority(words: list[bytes], shingle: int, seed: int, others: int = 0) -> list[int]:
    """SimHash of word shingles, and ``others`` more whose bits come from the same hashes mixed anew."""
    if not words:
        return [0] * (1 + others)
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros((1 + others, 64), dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, 1 << 16):
        stop = min(n, start + (1 << 16))
        hashes = np.fromiter((digest(join(words[i : i + shingle]), seed) for i in range(start, stop)), dtype="<u8", count=stop - start)
        for k in range(1 + others):
            if k:  # the finaliser of the SplitMix64 generator
                mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & FULL)
                mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(31)
            else:
                mixed = hashes
            counts[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text in UTF-8, A-Z lower-cased.

    Fewer words than ``shingle``: all of them are the one shingle. No words or null: 0.
    """
    return _majority(_words(text), shingle, seed)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's 64 bits as a signed long."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x, shingle, seed) for x in utf8(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(arrow_rows(score, text=1), f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code's sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Gray-ordered fingerprints (distinct, unsigned) under nodes of shared masked patterns."""

    def __init__(self, prints: np.ndarray, exact: int = 0):
        """exact: bits on which linked fingerprints must agree; they lead the order."""
        self.exact = np.uint64(exact)
        self.prints = prints[np.lexsort((gray_rank(prints & ~self.exact), prints & self.exact))]
        n = len(self.prints)
        #: From the leaves up: (value, mask of agreed bits) of the nodes of a level.
        self.levels = [(self.prints, np.full(n, FULL, dtype=np.uint64))]
        low = high = self.prints
        while len(low) > 1:
            heads = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            self.levels.append((low, ~(low ^ high)))

    def close(self, level: int, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        """Which pairs of a level's nodes may have links below them; on the leaf level, which are links."""
        value, mask = self.levels[level]
        apart = (value[a] ^ value[b]) & mask[a] & mask[b]
        return (np.bitwise_count(apart) <= radius) & (apart & self.exact == 0)

    def links(self, radius: int):
        """Batches (a, b) of places in ``prints``, a < b, of all pairs within ``radius``."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        child = np.arange(FAN)
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield a, b
                continue
            # One step's worth at a time and its children first, so that what waits is bounded by the depth.
            rest = STEP // FAN**2
            if len(a) > rest:
                todo.append((level, a[rest:], b[rest:]))
                a, b = a[:rest], b[:rest]
            n = len(self.levels[level - 1][0])
            below_a = np.repeat(a[:, None] * FAN + child, FAN, axis=1).ravel()
            below_b = np.tile(b[:, None] * FAN + child, (1, FAN)).ravel()
            there = (below_b < n) & ((below_a < below_b) if level == 1 else (below_a <= below_b))
            below_a, below_b = below_a[there], below_b[there]
            near = self.close(level - 1, below_a, below_b, radius)
            if near.any():
                todo.append((level - 1, below_a[near], below_b[near]))


def _joined(radius: int, flush: int):
    """For mapInArrow over rows (space, mask, pattern, fp) in that order: edges (space, a, b) that connect each pattern's as its links do."""

    def edges(got: np.ndarray):
        for space, exact in np.unique(got[:2], axis=1).T:
            own = (got[0] == space) & (got[1] == exact)
            index = GrayIndex(np.unique(got[3, own]), int(exact))
            label = least_linked(len(index.prints), index.links(radius))
            # The least fingerprint by its number stands for a component, so that other patterns' edges are the same ones.
            least = np.full(len(label), FULL, dtype=np.uint64)
            np.minimum.at(least, label, index.prints)
            ends, least = index.prints.view(np.int64), least[label].view(np.int64)
            a = np.nonzero(ends != least)[0]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), int(space), dtype=np.int64)), pa.array(ends[a]), pa.array(least[a])], names=["space", "a", "b"])

    def run(batches):
        kept: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(4)]))
            rows += batch.num_rows
            if rows >= flush:
                got = np.concatenate(kept, axis=1)
                last = (got[:3] == got[:3, -1:]).all(axis=0)  # its pattern may go on
                if not last.all():
                    yield from edges(got[:, ~last])
                kept = [got[:, last]]
                rows = int(last.sum())
        if rows:
            yield from edges(np.concatenate(kept, axis=1))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of ``free`` as masks of ``parts`` consecutive blocks."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def link(prints: DataFrame, radius: int = 3, capacity: int = 50_000) -> DataFrame:
    """Edges (space, a, b) that connect the distinct fingerprints (space, fp) as all links within ``radius`` do.

    No more than ``radius`` and one of a fingerprint, before patterns are refined.
    Fingerprints of different spaces are never connected.
    """
    prints = prints.select(F.col("space").cast("long").alias("space"), "fp").distinct()
    key = ["space", "mask", "pattern"]
    found = None
    level = set(_blocks(FULL, radius + 1))
    rows = prints.select("space", "fp", F.explode(F.array(*(F.lit(_signed(m)) for m in sorted(level)))).alias("mask"))
    while True:
        rows = checkpointed(rows.select("space", "mask", F.expr("fp & mask").alias("pattern"), "fp"))
        total = rows.count()
        few = total <= capacity or all(bin(FULL & ~m).count("1") <= 16 for m in level)
        hot = rows.groupBy(*key).count().where(F.col("count") > capacity).drop("count") if not few else None
        heavy = hot is not None and not hot.isEmpty()
        cold = rows.join(hot, key, "left_anti") if heavy else rows
        width = shuffle_width(rows, total, 4 * capacity)
        part = cold.select("space", "mask", "pattern", "fp").repartition(width, *key).sortWithinPartitions(*key).mapInArrow(_joined(radius, capacity), "space long, a long, b long")
        found = part if found is None else found.unionByName(part)
        if not heavy:
            return found.distinct()
        finer = {m: [m | x for x in _blocks(FULL & ~m, radius + 1)] for m in level if bin(FULL & ~m).count("1") > 16}
        split = F.create_map(*(y for m, x in finer.items() for y in (F.lit(_signed(m)), F.array(*(F.lit(_signed(i)) for i in x)))))
        level = {m for x in finer.values() for m in x}
        rows = rows.join(hot, key, "left_semi").select("space", "fp", F.explode(split[F.col("mask")]).alias("mask")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, capacity: int = 50_000) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``.

    component_id is the smallest id of all documents that links of at most ``radius``
    differing bits lead to, itself included. Equal fingerprints are one node, however
    many documents have them. Null text counts as no words (fingerprint 0). Null ids
    are returned and never the smallest, unless a component has no other. Repeated
    rows are returned as often as they are there. No rows: no rows.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    star = stars(link(nodes.withColumn("space", F.lit(0)), radius, capacity).select("a", "b"))
    n = star.count()
    member = checkpointed(gathered(star.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct()), 2 * n))
    first = nodes.join(member, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(first, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    ids = nodes.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp) -> Column:
    """A fingerprint's 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _shingles(text: bytes | None, shingle: int) -> set[bytes]:
    words = _words(text)
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def resembling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, candidate_shingle: int = 2, tries: int = 20, radius: int = 3, seed: int = 42, capacity: int = 50_000) -> DataFrame:
    """Pairs (a, b) of ids of texts whose sets of ``shingle`` words have a Jaccard similarity of at least ``similarity``.

    Candidates: links within ``radius`` in any of ``tries`` fingerprints of
    ``candidate_shingle`` words. The index above gives the groups that these connect,
    and in a group all links between texts that aren't of one component yet are
    compared by their sets of shingles (``_joined_in``). So the pairs found connect
    what all true index links would; shingles count by 64-bit hashes. Texts
    without words, null among them, resemble each other; fewer words than ``shingle``
    are one shingle. Rows without an id have no pairs; rows that share an id are taken
    for one. Texts of any length are taken whole; other columns play no part. No rows:
    no pairs.
    """
    return _resembling(docs, id_col, text_col, shingle, similarity, candidate_shingle, tries, radius, seed, capacity)[0]


def _resembling(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, candidate_shingle: int, tries: int, radius: int, seed: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(the pairs, the components that they make, as ``stars`` gives them)."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_majority(_words(x), candidate_shingle, seed, tries - 1) for x in utf8(batch.column(1))]
        flat = np.array(found, dtype=np.uint64).view(np.int64).ravel()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * tries, pa.int32()), pa.array(flat))], names=["id", "fps"])

    rows = narrow(docs, id=id_col, text=text_col).where("id is not null")
    kind = dict(rows.dtypes)["id"]
    prints = checkpointed(rows.mapInArrow(arrow_rows(score, text=1), f"id {kind}, fps array<long>"))
    each = prints.select("id", F.posexplode("fps").alias("space", "fp")).select("id", F.col("space").cast("long").alias("space"), "fp")
    nodes = checkpointed(each.groupBy("space", "fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    linked = link(nodes, radius, capacity)
    ends = linked.join(nodes.select("space", F.col("fp").alias("a"), F.col("first").alias("x")), ["space", "a"]).join(nodes.select("space", F.col("fp").alias("b"), F.col("first").alias("y")), ["space", "b"]).select("x", "y")
    # Documents of one fingerprint: each with the first of its set, and the sets' firsts with the first of all.
    shared = checkpointed(each.join(nodes.where("n > 1"), ["space", "fp"]).select("id", "space", "fp", "first", "n"))
    low = F.min("id").over(Window.partitionBy("space", "fp", F.pmod(F.xxhash64("id"), F.lit(SETS))))
    same = shared.withColumn("low", low).select(F.col("id").alias("x"), F.when(F.col("id") == F.col("low"), F.col("first")).otherwise(F.col("low")).alias("y"))
    edges = checkpointed(ends.unionByName(same).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    n = edges.count()
    star = stars(gathered(edges, n))
    members = gathered(star.select(F.col("a").alias("id"), F.col("b").alias("k")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("k")).distinct()), n)
    # Who shares most fingerprints with others stands in a group's middle.
    fame = gathered(shared, tries * n).groupBy("id").agg(F.sum("n").alias("fame"))
    return _joined_in(rows, prints, members, fame, n, shingle, similarity, tries, radius)


def _sets(rows: DataFrame, there, shingle: int) -> DataFrame:
    """(id, set): the shingles, as sorted 64-bit hashes, of the texts (id, text) whose id's hash passes a test."""

    def run(batches):
        for batch in batches:
            for part in parts(batch.filter(pa.array(there(batch.column(2).to_numpy(zero_copy_only=False)))), 1, 1 << 20):
                found = [sorted(x - (1 << 64) if x >> 63 else x for x in map(xxhash.xxh64_intdigest, _shingles(t, shingle))) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

    return rows.select("id", "text", F.xxhash64("id").alias("key")).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, set array<long>")


def _joined_in(rows: DataFrame, prints: DataFrame, members: DataFrame, fame: DataFrame, n: int, shingle: int, similarity: float, tries: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of linked members (id, k) of a group that resemble each other, the components that they make, as ``stars`` gives them).

    A group's core is the component of its most famous text. All members but those that
    have joined the core meet the rest of the group, in blocks that grow: in the end
    each two members that are not of one component have met, and no two of the core
    need to. So a group of very many copies of one text costs no more than its size for
    each member that isn't one. Where two meet, the join's condition compares their
    fingerprints and, if these are linked, their sets; only what resembles leaves it,
    once for a text and component. ``n``: about how many members there are.
    """
    part = members.limit(0).select(F.col("id").alias("a"), F.col("k").alias("b"))
    found = part
    sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    known = checkpointed(gathered(members.join(fame, "id", "left").withColumn("fame", F.coalesce("fame", F.lit(0))).join(sizes, "k").withColumn("turn", F.expr("pmod(xxhash64(id), size)")), n))
    cores = known.groupBy("k").agg(F.max_by("id", F.struct("fame", F.xxhash64("id"))).alias("core"))
    members = checkpointed(gathered(known.drop("fame").join(cores, "k"), n))
    # Of rows that share an id, the smallest set and fingerprints count.
    bitmap = Bitmap(members.select(F.xxhash64("id").alias("key")), "key")
    sets = gathered(checkpointed(_sets(rows, bitmap.test, shingle)), n, 1 << 12).groupBy("id").agg(F.min("set").alias("set"))
    prints = gathered(checkpointed(prints.where(bitmap.column(F.xxhash64("id")))), n).groupBy("id").agg(F.min("fps").alias("fps"))
    held = checkpointed(gathered(members.select("id").join(sets, "id").join(prints, "id"), n, 1 << 12))
    share = Fraction(similarity).limit_denominator(10_000)
    num, den = share.numerator, share.denominator
    near = " or ".join(f"bit_count(fa[{i}] ^ fb[{i}]) <= {radius}" for i in range(tries))
    close = f"{num}L * greatest(size(sa), size(sb)) <= {den}L * least(size(sa), size(sb))"
    alike = f"size(array_intersect(sa, sb)) * {num + den}L >= {num}L * (size(sa) + size(sb))"
    past, now = 0, HUBS
    while True:
        own = _named(_named(members.withColumn("v", F.col("id")).withColumn("c", F.col("core")), "v", part), "c", part)
        outside = F.col("v") != F.col("c")
        left = own.where(outside & (F.col("turn") >= past)).select("k").distinct()
        own = checkpointed(gathered(own.join(left, "k", "left_semi"), n))
        if own.isEmpty():
            return found, part
        salts = F.ceil(F.col("size") / SHARE).cast("long")
        first = (F.col("id") == F.col("core")) if past == 0 else F.lit(False)
        hubs = own.where(outside & F.col("turn").between(past, now - 1) | first).join(held, "id")
        hubs = hubs.select("k", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("id").alias("b"), F.col("v").alias("vb"), F.col("fps").alias("fb"), F.col("set").alias("sb"))
        others = own.where((F.col("turn") >= past) | ~outside).join(held, "id")
        others = others.select("k", F.pmod(F.xxhash64("id", F.lit(1)), salts).alias("salt"), F.col("id").alias("a"), F.col("v").alias("va"), F.col("fps").alias("fa"), F.col("set").alias("sa"))
        met = others.join(hubs, ["k", "salt"]).where(f"va <> vb and {close} and ({near}) and {alike}")
        new = met.groupBy("a", "vb").agg(F.min("b").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new = checkpointed(gathered(new, n))
        if not new.isEmpty():
            found = found.unionByName(new)
            joined = stars(_named(_named(new, "a", part), "b", part))
            part = checkpointed(gathered(_named(part, "b", joined).unionByName(joined), n))
        past, now = now, min(now * MORE, now + MOST)


def _named(rows: DataFrame, column: str, part: DataFrame) -> DataFrame:
    """``rows`` with the smallest node of its component (of ``stars``) in place of the node in ``column``."""
    names = part.select(F.col("a").alias(column), F.col("b").alias("_root"))
    return rows.join(names, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each group, with all their columns.

    A group: what links of ``near_duplicates`` connect and, with a ``similarity``,
    pairs that share that much of their five-word shingles (``resembling``). Rows of
    one id stay or go together; rows without an id stay. Null and empty texts are one
    group. Texts of any length are taken whole; columns of any name are kept as they
    are. Only rows whose id a bitmap can't tell from a dropped one are shuffled. No
    rows: no rows.
    """
    found = checkpointed(near_duplicates(docs, id_col, text_col, shingle, radius, seed).where("doc_id is not null").select("doc_id", "component_id").where("doc_id <> component_id"))
    edges = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    if similarity is not None:
        edges = edges.unionByName(_resembling(docs, id_col, text_col, 5, similarity, 2, 20, radius, seed, 50_000)[1])
    dropped = checkpointed(stars(edges).select(F.col("a").alias("doc_id"), F.xxhash64("a").alias("key")).distinct())
    bitmap = Bitmap(dropped, "key")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id")).withColumn("listed", bitmap.column(F.xxhash64("id")))
    rest = keyed.where("listed").join(dropped, F.col("id") == dropped["doc_id"], "left_anti")
    return keyed.where("not listed").select("row.*").unionByName(rest.select("row.*"))
