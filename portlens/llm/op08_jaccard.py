"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

A document's set holds the hashes (64 bits) of its distinct five-word shingles; equal
sets are one class, known by a hash of the set. Two classes link when 100 times the
intersection is at least 75 times the union. The result has, for every document, the size
of its set and the smallest id that links reach.

Candidates. In any one order of all shingles, two linking sets share one of the first
n - ceil(0.75 n) + 1 shingles of each. The order here puts shingles that many documents
have (HEAVY) last and is by hash otherwise. The classes that share such a shingle are
sorted by size and cut where neighbours differ by more than the similarity allows; a band
of up to TILE classes is a tile, a longer one is cut into several.

Comparing. In a tile, signatures (shingles hashed to a bitmap; the widths follow the sizes
and fold to the narrower one) bound the overlap from above: |A and B| <= (|A| + |B| -
differing bits) / 2. Pairs that pass are suspects and are intersected exactly. Pairs already
in one component are skipped:
  1. every class goes to the one tile that most of its shingles have in common;
  2. every tile whose classes are still in several components is compared: of a tile of up
     to FEW classes the pairs, which many tiles have in common, are listed once;
  3. of bands over several tiles, the classes outside the band's largest component
     are compared with all its classes, in tiles of bounded size.
A larger tile first gives the likeliest suspects that would join its components, then, if it
still has several, all that are left. Signatures of listed pairs, and sets of suspect ones,
are sent once for each pair, those of a class with many partners once for MEMBERS of them.
Every linking pair is compared or already connected, so components are exact.

A text without words, or null, has the empty set and links with nothing. Null ids are
passed through and are never a component's id while another id is in it. Repeated rows
are one class. An empty table has no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from portlens.llm.common import other_columns, rows, slices, stored, text_or_empty
from portlens.llm.components import components
from portlens.llm.shingles import shingle_hashes

PERCENT = 75
TILE = 256
HEAVY = 2  # documents of one task that have a shingle
MAX_HEAVY = 1_000_000
FEW = 48  # classes of a tile whose pairs are listed
BROADCAST_ROWS = 400_000
STEP = 2_000_000  # shingles a task holds at once
PART = 1_000_000  # shingles a group of the candidate search holds
BITS = 8  # of a signature, for each shingle
MIN_BITS, MAX_BITS = 512, 1 << 19
HUB, LEAF = 0, 1
# Two members of a band's tile are not compared; outsiders are, with all.
OUTSIDER, MEMBER, EITHER = 0, 1, 2
MEMBERS = 1024  # members in a tile with outsiders


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owner = shingle_hashes(texts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))


def class_of(shingles: np.ndarray) -> int:
    return xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least overlap at which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def classes(docs: DataFrame) -> DataFrame:
    """Rows of documents (no_id, id, text_hash, n, class) and of shingles that a task met often (shingle, times)."""
    schema = pa.schema([("no_id", pa.bool_()), ("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("shingle", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def often() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found, times = found[times >= HEAVY].view(np.int64), times[times >= HEAVY]
            blank = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.bool_()), blank, blank, blank, blank, pa.array(found), pa.array(times, pa.int64())], schema=schema)

        for batch in slices(batches, 128):
            sets = sets_of(batch.column("text").to_pylist())
            blank = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("no_id"), batch.column("id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()), pa.array(map(class_of, sets), pa.int64()), blank, blank], schema=schema)
            held += sets
            size += sum(map(len, sets))
            if size > STEP:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return keyed(docs).mapInArrow(run, "no_id boolean, id long, text_hash long, n long, class long, shingle long, times long")


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def heavy_shingles(found: DataFrame) -> np.ndarray:
    """The shingles put last in the order, sorted; at most MAX_HEAVY, the most frequent."""
    counted = found.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    if counted.count() > MAX_HEAVY:
        counted = counted.orderBy(F.desc("times"), "shingle").limit(MAX_HEAVY)
    return np.sort(np.array([r[0] for r in counted.select("shingle").toLocalIterator()], np.int64).view(np.uint64))


_ENTRY = np.dtype([("shingle", "<u8"), ("class", "<i8"), ("n", "<u4")])


def shared_lists(docs: DataFrame, heavy: np.ndarray, parts: int) -> DataFrame:
    """(band, piece, members, times): classes that share a first shingle, by size.

    `band` is null for a band within one tile; `times` counts shingles with the same members.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            entries = np.unique(np.concatenate(held))
            part = (entries["shingle"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(part) else np.zeros(0, np.int64)
            pieces = np.split(entries, cuts[1:])
            return rows(pa.schema([("part", pa.int64()), ("entries", pa.binary())]), (part[cuts].astype(np.int64), [p.tobytes() for p in pieces]))

        for batch in slices(batches, 128):
            for shingles in sets_of(batch.column("text").to_pylist()):
                n = len(shingles)
                if not n:
                    continue
                at = np.minimum(np.searchsorted(last, shingles), max(len(last) - 1, 0))
                common = last[at] == shingles if len(last) else np.zeros(n, bool)
                entries = np.empty(prefix_length(n), _ENTRY)
                entries["shingle"] = np.concatenate([shingles[~common], shingles[common]])[: len(entries)]
                entries["class"], entries["n"] = class_of(shingles), n
                held.append(entries)
                size += len(entries)
            if size > STEP // 2:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    schema = pa.schema([("band", pa.int64()), ("piece", pa.int32()), ("members", pa.list_(pa.int64())), ("times", pa.int64())])

    def bands(key: tuple, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate([np.frombuffer(e, _ENTRY) for batch in pieces for e in batch.column("entries").to_pylist()])
        entries = entries[np.lexsort((entries["class"], entries["n"], entries["shingle"]))]
        again = np.zeros(len(entries), bool)
        again[1:] = entries[1:] == entries[:-1]
        entries = entries[~again]
        # A new band begins with another shingle, or with a size too far from the one before.
        new = np.ones(len(entries), bool)
        n = entries["n"].astype(np.int64)
        new[1:] = (entries["shingle"][1:] != entries["shingle"][:-1]) | (100 * n[:-1] < PERCENT * n[1:])
        starts = np.append(np.flatnonzero(new), len(entries))
        long = np.flatnonzero(np.diff(starts) > 1)
        small: dict[bytes, int] = {}
        big = []
        members = entries["class"]
        for start, stop in zip(starts[long].tolist(), starts[long + 1].tolist(), strict=True):
            if stop - start <= TILE:
                name = np.sort(members[start:stop]).tobytes()
                small[name] = small.get(name, 0) + 1
            else:
                band = xxh3_64_intdigest(entries[start : start + 1].tobytes()) - (1 << 63)
                big += [(band, i, members[at : min(at + TILE, stop)], 1) for i, at in enumerate(range(start, stop, TILE))]
        out = [(None, 0, np.frombuffer(m, "<i8"), times) for m, times in small.items()] + big
        for at in range(0, len(out), 5000):
            yield rows(schema, zip(*out[at : at + 5000], strict=True))

    blobs = docs.select(text_or_empty().alias("text")).mapInArrow(emit, "part long, entries binary")
    return blobs.groupBy("part").applyInArrow(bands, "band long, piece int, members array<long>, times long")


def signature(shingles: np.ndarray) -> bytes:
    width = min(MAX_BITS, max(MIN_BITS, BITS << (len(shingles) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sent(frame: DataFrame, rows: int) -> DataFrame:
    """A few numbers a row: sent to every executor while that is some tens of MB, so that texts stay where they are."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def signatures(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(class, n, bits) of the classes of places (no_id, id, text_hash, class), from one document of each."""
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = sets_of(batch.column("text").to_pylist())
            yield rows(schema, (batch.column("class"), map(len, sets), map(signature, sets)))

    texts = keyed(docs).join(_sent(places, places.count()), ["no_id", "id", "text_hash"])
    return texts.select("text", "class").mapInArrow(run, "class long, n long, bits binary")


class Tile:
    """Classes to compare, with sizes, signatures and present components."""

    def __init__(self, members: dict[int, tuple]) -> None:
        order = sorted(members, key=lambda c: (members[c][0], c))
        self.classes = order
        self.n = np.array([members[c][0] for c in order], np.int64)
        bits = [np.frombuffer(members[c][1], np.uint8) for c in order]
        self.root = np.array([members[c][2] for c in order], np.int64)
        self.side = np.array([members[c][3] for c in order])
        width = min(map(len, bits))
        self.bits = np.array([np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in bits])
        self.bits = self.bits.view(np.uint64)

    def possible(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Earlier, so smaller, classes of other components that may link with the i-th by size and signature, and how far their bound is above what is needed."""
        low = int(np.searchsorted(self.n, -(-PERCENT * int(self.n[i]) // 100)))
        near = low + np.flatnonzero(self.root[low:i] != self.root[i])
        if self.side[i] == MEMBER:
            near = near[self.side[near] != MEMBER]
        differ = np.bitwise_count(self.bits[near] ^ self.bits[i]).sum(axis=1).astype(np.int64)
        spare = (self.n[near] + self.n[i] - differ) // 2 - needed(self.n[near], self.n[i])
        return near[spare >= 0], spare[spare >= 0] / self.n[i]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _top(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def suspected(tile: Tile, every: bool) -> Iterator[tuple[int, int]]:
    """Pairs of different components that signatures don't rule out: all, or the likeliest that join components."""
    found = [(near, spare) for near, spare in map(tile.possible, range(len(tile.classes)))]
    if every:
        for i, (near, _) in enumerate(found):
            yield from ((tile.classes[i], tile.classes[j]) for j in near.tolist())
        return
    first = np.concatenate([near for near, _ in found])
    second = np.repeat(np.arange(len(found)), [len(near) for near, _ in found])
    order = np.argsort(-np.concatenate([spare for _, spare in found]), kind="stable")
    root = tile.root.tolist()
    parent = {r: r for r in root}
    for j, i in zip(first[order].tolist(), second[order].tolist(), strict=True):
        a, b = _top(parent, root[i]), _top(parent, root[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield tile.classes[i], tile.classes[j]


def suspects(members: DataFrame, every: bool) -> DataFrame:
    """Suspect pairs (a, b), a < b, of the tiles of (tile, class, n, bits, root, side), each in one task at a time."""
    columns = ["tile", "class", "n", "bits", "root", "side"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {}, []
        for batch in slices(batches, 1000):
            for tile, name, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if tile != now:
                    if len(held) > 1:
                        out += suspected(Tile(held), every)
                    now, held = tile, {}
                # A class on both sides of a tile stays on the first, the side of the outsiders.
                if name not in held or rest[3] < held[name][3]:
                    held[name] = tuple(rest)
            if out:
                yield rows(schema, zip(*out, strict=True))
                out = []
        if len(held) > 1:
            out += suspected(Tile(held), every)
        if out:
            yield rows(schema, zip(*out, strict=True))

    found = members.select(*columns).repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_groups(pairs: DataFrame, n: int) -> DataFrame:
    """(class, group, side): every one of the n pairs (a, b) as a hub and a leaf of one group.

    The partner of more pairs is the pair's hub and has up to MEMBERS leaves in a
    group. A leaf has few hubs: of m pairs at most the root of 2 m.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("k"))
    of = lambda end: ends.select(F.col("class").alias(end), F.col("k").alias(f"k_{end}"))
    a_first = F.struct(F.col("k_a"), F.col("a")) > F.struct(F.col("k_b"), F.col("b"))
    told = pairs.join(_sent(of("a"), 2 * n), "a").join(_sent(of("b"), 2 * n), "b").select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.when(a_first, F.col("k_a")).otherwise(F.col("k_b")).alias("k"))
    # A hub's number of pairs bounds its leaves.
    told = told.withColumn("group", F.xxhash64("hub", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("k") / MEMBERS))))
    hubs = told.select(F.col("hub").alias("class"), "group", F.lit(HUB).alias("side")).distinct()
    return hubs.unionByName(told.select(F.col("leaf").alias("class"), "group", F.lit(LEAF).alias("side")))


def met(rows_of: DataFrame, value: str, fits: Callable[[int, bytes, int, bytes], bool]) -> DataFrame:
    """Pairs (a, b) of hub and leaf for which fits(n, value, n, value); the hub's value comes first and the leaves' pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple = (None, None, 0, b"")
        for batch in slices(batches, 128):
            out = []
            for group, side, name, n, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if side == HUB:
                    hub = group, name, n, own
                elif group == hub[0] and fits(n, own, hub[2], hub[3]):
                    out.append((hub[1], name))
            if out:
                yield rows(pa.schema([("a", pa.int64()), ("b", pa.int64())]), zip(*out, strict=True))

    dealt = rows_of.select("group", "side", "class", "n", value).repartition("group").sortWithinPartitions("group", "side")
    found = dealt.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def likely(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that sizes and signatures don't rule out."""

    def fits(n: int, a: bytes, m: int, b: bytes) -> bool:
        if 100 * min(n, m) < PERCENT * max(n, m):
            return False
        width = min(len(a), len(b))
        x, y = (np.bitwise_or.reduce(np.frombuffer(v, np.uint8).reshape(-1, width), axis=0).view(np.uint64) for v in (a, b))
        return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2 >= needed(n, m)

    return met(in_groups(pairs, pairs.count()).join(signs, "class"), "bits", fits)


def verified(docs: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by exact intersection."""
    schema = pa.schema([("group", pa.int64()), ("side", pa.int32()), ("class", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = sets_of(batch.column("text").to_pylist())
            for name, own, groups in zip(batch.column("class").to_pylist(), found, batch.column("groups").to_pylist(), strict=True):
                k = len(groups)
                yield rows(schema, ([g["group"] for g in groups], [g["side"] for g in groups], [name] * k, [len(own)] * k, [own.tobytes()] * k))

    def fits(n: int, a: bytes, m: int, b: bytes) -> bool:
        return overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= needed(n, m)

    members = in_groups(pairs, pairs.count()).groupBy("class").agg(F.collect_list(F.struct("group", "side")).alias("groups"))
    members = stored(members.join(_sent(places, places.count()), "class"), "members")
    sent = members.agg(F.sum(F.size("groups"))).first()[0] or 0
    texts = keyed(docs).join(_sent(members, sent), ["no_id", "id", "text_hash"])
    whole = texts.select("text", "class", "groups").mapInArrow(sets, "group long, side int, class long, n long, shingles binary")
    return met(whole, "shingles", fits)


def listed(members: DataFrame) -> DataFrame:
    """Of tiles (tile, class, n, root) of up to FEW classes the pairs (a, b) of different components; of others that have several their classes (tile, a)."""
    schema = pa.schema([("tile", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def pairs(tiles: np.ndarray, name: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        cuts = np.flatnonzero(np.diff(tiles)) + 1
        seen, wide = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(np.arange(len(tiles)), cuts):
            if len(at) > FEW:
                wide += [at] if (root[at] != root[at[0]]).any() else []
                continue
            i, j = np.triu_indices(len(at), 1)
            i, j = at[i], at[j]
            fit = (root[i] != root[j]) & (100 * n[i] >= PERCENT * n[j]) & (100 * n[j] >= PERCENT * n[i])
            seen.append(np.stack([np.minimum(name[i], name[j])[fit], np.maximum(name[i], name[j])[fit]], axis=1))
        both = np.unique(np.concatenate(seen), axis=0)
        yield np.zeros(len(both), np.int64), both[:, 0], both[:, 1]
        rest = np.concatenate(wide)
        yield tiles[rest], name[rest], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in chain(batches, [None]):
            if batch is None:
                now, left = left, None
            else:
                now = [batch.column(c).to_numpy() for c in range(4)]
                now = now if left is None else [np.concatenate(x) for x in zip(left, now, strict=True)]
                # The last tile may go on in the next batch.
                whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
                now, left = [x[:whole] for x in now], [x[whole:] for x in now]
            if now is not None and len(now[0]):
                for tile, a, b in pairs(*now):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], schema=schema)

    dealt = members.select("tile", "class", "n", "root").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "tile long, a long, b long")


def rooted(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members with their present component as `root`: their own class while unlinked."""
    if found is None:
        return members.withColumn("root", F.col("class"))
    found = _sent(found.select(F.col("node").alias("class"), "component"), found.count())
    return members.join(found, "class", "left").withColumn("root", F.coalesce("component", "class")).drop("component")


class Search:
    """Links found so far, the components that they make, and the pairs compared."""

    def __init__(self, docs: DataFrame, places: DataFrame) -> None:
        self.docs, self.places = docs, places
        self.now: DataFrame | None = None
        self.links: DataFrame | None = None
        self.compared: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> bool:
        """Intersect those of the pairs (a, b) that were not compared before; whether there are pairs at all."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return False
        if self.compared is not None:
            pairs = stored(pairs.join(self.compared, ["a", "b"], "left_anti"), "pairs")
        self.compared = pairs if self.compared is None else self.compared.unionByName(pairs)
        found = stored(verified(self.docs, pairs, self.places), "found")
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.now = stored(components(self.links), "components")
        return True


def link_classes(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """(node, component) of the classes that link with another; None if none does."""
    total = found.agg(F.sum(F.col("n") / 4 + 2)).first()[0] or 0
    raw = shared_lists(docs, heavy_shingles(found), max(16, int(total / PART) + 1))
    raw = stored(raw.withColumn("tile", F.xxhash64("members")), "lists")
    tiles = raw.groupBy("tile").agg(F.first("members").alias("members"), F.sum("times").alias("times"))
    flat = stored(tiles.select("tile", "times", F.explode("members").alias("class")), "members")
    chosen = flat.groupBy("class").agg(F.max_by("tile", F.struct("times", "tile")).alias("tile"))
    place = F.min(F.struct("no_id", "id", "text_hash")).alias("p")
    places = stored(found.where("n > 0").groupBy("class").agg(place).join(chosen, "class").select("p.*", "class", "tile"), "places")
    signs = stored(signatures(docs, places.drop("tile")), "signatures")
    search = Search(docs, places.drop("tile"))

    one_each = places.select("class", "tile").join(signs, "class").withColumn("root", F.col("class")).withColumn("side", F.lit(EITHER))
    search.compare(suspects(one_each, every=False))

    sizes = signs.select("class", "n")
    for every in (False, True):
        open_tiles = rooted(flat.select("tile", "class"), search.now)
        found = stored(listed(open_tiles.join(_sent(sizes, signs.count()), "class")), "open")
        large = found.where("b is null").select("tile", F.col("a").alias("class"))
        again = rooted(large, search.now).join(signs, "class").withColumn("side", F.lit(EITHER))
        pairs = suspects(again, every)
        if not every:
            pairs = pairs.unionByName(likely(stored(found.where("b is not null").select("a", "b").distinct(), "listed"), signs))
        if not search.compare(pairs.distinct()) or large.isEmpty():
            break

    # Of the bands with the same tiles, one is enough.
    pieces = raw.where("band is not null").select("band", "tile", "members")
    same = pieces.groupBy("band").agg(F.count("*").alias("k"), F.sum(F.xxhash64("tile").cast("decimal(20,0)")).alias("all"))
    pieces = pieces.join(same.groupBy("k", "all").agg(F.min("band").alias("band")).select("band"), "band")
    bands = stored(pieces.select("band", F.explode("members").alias("class")).distinct(), "bands")
    for every in (False, True):
        wide = stored(rooted(bands, search.now), "wide")
        if not search.compare(across(wide, signs, every)):
            break
    return search.now


def across(wide: DataFrame, signs: DataFrame, every: bool) -> DataFrame:
    """Suspected pairs of bands (band, class, root) over several tiles: outsiders of the largest component against all."""
    shares = wide.groupBy("band", "root").agg(F.count("*").alias("k"))
    main = shares.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most")).where("all > most")
    main = main.select("band", "main", F.ceil((F.col("all") - F.col("most")) / TILE).alias("o"), F.ceil(F.col("all") / MEMBERS).alias("m"))
    each = wide.join(main, "band")
    dealt = lambda n: F.pmod(F.xxhash64("class"), n)
    outside = each.where("root != main").select("class", "root", "band", dealt(F.col("o")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y"), F.lit(OUTSIDER).alias("side"))
    inside = each.select("class", "root", "band", F.explode(F.sequence(F.lit(0), F.col("o") - 1)).alias("x"), dealt(F.col("m")).alias("y"), F.lit(MEMBER).alias("side"))
    both = outside.unionByName(inside).withColumn("tile", F.xxhash64("band", "x", "y"))
    return suspects(both.join(signs, "class"), every)


def clusters(docs: DataFrame) -> DataFrame:
    """(no_id, id, text_hash, n, class, low): every document, its set's size and class, and the least place
    (no_id, id, text_hash) that links reach."""
    found = stored(classes(docs), "classes")
    place = F.struct("no_id", "id", "text_hash")
    some = found.where("n > 0")
    least = some.groupBy("class").agg(F.min(place).alias("place"))
    joined = stored(rooted(least, link_classes(docs, found)).withColumnRenamed("root", "component"), "least")
    low = joined.groupBy("component").agg(F.min("place").alias("low"))
    named = joined.join(low, "component").select("class", "low")
    documents = found.where("n is not null").select("no_id", "id", "text_hash", "n", "class")
    alone = documents.where("n = 0").withColumn("low", place)
    return documents.where("n > 0").join(named, "class").select(*alone.columns).unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without words stay."""
    chosen = clusters(docs).where((F.col("n") == 0) | (F.struct("no_id", "id", "text_hash") == F.col("low")))
    chosen = chosen.select("no_id", "id", "text_hash", "n").distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    # Of rows equal in id and text the least by all columns stays.
    copy = F.row_number().over(Window.partitionBy("no_id", "id", "text_hash").orderBy(*other_columns(docs)))
    return marked.join(chosen, ["no_id", "id", "text_hash"]).withColumn("copy", copy).where("n = 0 or copy = 1").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    own = lambda place: F.when(~place["no_id"], place["id"])
    return clusters(docs).select(own(F.struct("no_id", "id")).alias("doc_id"), F.col("n").alias("n_shingles"), own(F.col("low")).alias("component_id"))
