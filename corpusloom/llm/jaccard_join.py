"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import BUCKET_HASHES, CHUNK_BYTES, QUESTION, answered, question, rows_of, unpacked
from ..operators.components import connected_components
from ..operators.shingle_sets import described_sets, set_documents
from .common import discarded, mix64, written

#: Sets of one size band and the next share signatures of a tag. Up to this size they are all subsets that leave
#: out as few elements as linked sets may differ by; above, those of a partitioned domain.
SMALL_SET = 9
#: Second-level parts of the domain, and how many of them a signature leaves out.
PARTS, LEFT_OUT = 3, 1
#: Partitionings tried for sets that have an empty signature; the last one's empty signatures count.
SCHEMES = 3
#: Bits of a set's sketch for each of its elements, at least, and of any sketch.
SKETCH_BITS, LEAST_BITS = 2, 256
#: Elements of the sets that are signed at once, about.
SIGNED_ELEMENTS = 1 << 18
#: Keys that the members of a circle are dealt by when they are joined to what is known of it.
SALTS = 16
#: Elements of the whole sets on one side of those that are compared in one group, about (16 MB).
PIECE_ELEMENTS = 1 << 21


def bands(percent: int, upto: int) -> list[tuple[int, int]]:
    """Size bands [low, high] such that linked sets are in one band or in neighbours."""
    out, low = [], 1
    while not out or out[-1][1] < upto:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def most_apart(percent: int, size: int) -> int:
    """The largest symmetric difference of linked sets of at most this size each."""
    return 2 * size * (100 - percent) // (100 + percent)


def small_signatures(values: np.ndarray, bounds: np.ndarray, which: np.ndarray, tags: np.ndarray, leave: dict[int, int]) -> tuple[list[int], list[int]]:
    """All subsets of small sets that leave out up to leave[tag] elements (never all)."""
    sigs, who = [], []
    for s, tag in zip(which.tolist(), tags.tolist(), strict=True):
        own = values[bounds[s] : bounds[s + 1]]
        for k in range(min(leave[tag], len(own) - 1) + 1):
            for subset in combinations(range(len(own)), len(own) - k):
                sigs.append(xxhash.xxh3_64_intdigest(own[list(subset)].tobytes(), tag))
                who.append(s)
    return sigs, who


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and whose they are: any two linked sets that differ share one.

    For sets of a tag, the domain is cut into n1 parts of PARTS parts each. Linked sets differ in at most k elements,
    hence in more than LEFT_OUT in at most k // (LEFT_OUT + 1) of the n1 parts; in every other one they agree on all of its parts
    but LEFT_OUT. n1 leaves `spare` such parts more than one, so that a set with at most `spare` parts that have an empty
    signature shares one that isn't; others repeat this with another partitioning, and finally keep their empty ones.
    """
    sizes = np.diff(bounds)
    levels = bands(percent, int(sizes.max(initial=1)) * 2)
    highs = np.array([h for _, h in levels])
    apart = np.array([most_apart(percent, int(h)) for h in highs])
    bad = apart // (LEFT_OUT + 1)
    spare = np.maximum(1, bad // 12)
    n1 = bad + 1 + spare
    sigs, who = [], []
    own_band = np.searchsorted(highs, sizes)
    for tag_of in (own_band, own_band + 1):
        small = np.flatnonzero(highs[tag_of] <= SMALL_SET)
        found = small_signatures(values, bounds, small, tag_of[small], {t: int(apart[t]) for t in range(len(levels))})
        sigs.append(np.array(found[0], np.uint64))
        who.append(np.array(found[1], np.int64))
        todo = np.flatnonzero(highs[tag_of] > SMALL_SET)
        for scheme in range(SCHEMES):
            if not len(todo):
                break
            tags, parts = tag_of[todo], n1[tag_of[todo]]
            lengths = sizes[todo]
            ends = np.cumsum(lengths)
            own = values[np.arange(ends[-1]) + np.repeat(bounds[todo] - (ends - lengths), lengths)]
            base = np.concatenate(([0], np.cumsum(parts * PARTS)))
            h = mix64(own + np.uint64(0x51ED27 * (scheme + 1)))
            first = ((h >> np.uint64(32)) * np.repeat(parts, lengths).astype(np.uint64)) >> np.uint64(32)
            place = np.repeat(base[:-1], lengths) + first.astype(np.int64) * PARTS + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, place, mix64(own))
            counts = np.bincount(place, minlength=base[-1]).reshape(-1, PARTS)
            sums = sums.reshape(-1, PARTS)
            owner = np.repeat(np.arange(len(todo)), parts)
            number = (np.arange(len(owner)) - np.repeat(base[:-1] // PARTS, parts)).astype(np.uint64)
            key = mix64((np.repeat(tags, parts).astype(np.uint64) << np.uint64(40)) + (number << np.uint64(4)) + np.uint64(scheme))
            empties = np.zeros(len(owner), bool)
            made, mine = [], []
            for skip in range(PARTS):
                keep = [p for p in range(PARTS) if p != skip]
                empty = counts[:, keep].sum(axis=1) == 0
                empties |= empty
                sig = key + np.uint64(skip)
                for p in keep:
                    sig = mix64(sig ^ sums[:, p])
                some = np.ones(len(sig), bool) if scheme == SCHEMES - 1 else ~empty
                made.append(sig[some])
                mine.append(owner[some])
            uncertain = np.bincount(owner[empties], minlength=len(todo)) > spare[tags]
            sig, whose = np.concatenate(made), np.concatenate(mine)
            sigs.append(sig)
            who.append(todo[whose])
            todo = todo[uncertain]
    return np.concatenate(sigs), np.concatenate(who)


def sketches(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Whether the number of each set's elements is odd in each of a power of two of parts of the domain, as bits.

    Two sets differ in at least as many elements as their sketches in bits. A sketch's halves xored are the sketch over half as many parts.
    """
    bits = 1 << np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) * SKETCH_BITS)), int(LEAST_BITS).bit_length() - 1).astype(np.int64)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, sizes) + (mix64(values) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little")
    return [odd[(e - b) // 8 : e // 8].tobytes() for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def sketched(elements: list[bytes]) -> list[bytes]:
    """sketches() of sets given as bytes, so many at once as have about SIGNED_ELEMENTS elements."""
    sizes = np.array([len(x) // 8 for x in elements], np.int64)
    ends, out = np.cumsum(sizes), []
    while len(out) < len(elements):
        start = len(out)
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + SIGNED_ELEMENTS, side="right")))
        out += sketches(np.frombuffer(b"".join(elements[start:stop]), np.uint64), sizes[start:stop])
    return out


class Sketches:
    """Sketches of several lengths, compared over as many parts as the shortest has."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.bits = raw, np.array([8 * len(x) for x in raw], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def over(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches of at least so many bits, folded to so many; and each one's row among these."""
        if bits not in self.folded:
            which = np.flatnonzero(self.bits >= bits)
            row = np.zeros(len(self.raw), np.int64)
            row[which] = np.arange(len(which))
            fold = [np.bitwise_xor.reduce(np.frombuffer(self.raw[k], np.uint64).reshape(-1, bits // 64), axis=0) for k in which.tolist()]
            self.folded[bits] = np.stack(fold), row
        return self.folded[bits]

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many elements x must differ in from each of the others at least."""
        bits = min(int(self.bits[others].min()), int(self.bits[x]))
        matrix, row = self.over(bits)
        return np.bitwise_count(matrix[row[others]] ^ matrix[row[x]]).sum(axis=1, dtype=np.int64)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def listed(values: np.ndarray) -> np.ndarray:
    """An array as its distinct values and their places, of which few bytes are left when packed."""
    distinct, which = np.unique(values, return_inverse=True)
    return np.concatenate(([len(distinct)], distinct.view(np.int64), which)).astype(np.int64)


def unlisted(data: np.ndarray) -> np.ndarray:
    n = int(data[0])
    return data[1 : n + 1][data[n + 1 :]]


def least_first(asked: list[np.ndarray], along: list[np.ndarray], _chunks: np.ndarray) -> list[np.ndarray]:
    """For each signature a chunk asks, listed: the least set that any chunk has for it; 0 where no other chunk asks."""
    _, which, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    ids = np.concatenate([unlisted(x) for x in along])
    least = np.full(len(counts), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    said = np.where(counts > 1, least, 0)[which]
    return [listed(x) for x in np.split(said, np.cumsum([len(x) for x in asked])[:-1])]


class OwnSets:
    """The distinct sets that a chunk keeps for all others, from a row with own_ids, own_sizes and elements."""

    def __init__(self, row: dict):
        self.ids = unpacked(row["own_ids"])
        self.bounds = np.concatenate(([0], np.cumsum(unpacked(row["own_sizes"]).astype(np.int64))))
        self.values = np.frombuffer(row["elements"], np.uint64)

    def signatures(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct signatures of the sets, sorted; then for each signature of a set its place among these, and the set."""
        sigs, who, start = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while start < len(self.ids):
            stop = max(start + 1, int(np.searchsorted(self.bounds, self.bounds[start] + SIGNED_ELEMENTS, side="right")) - 1)
            part = self.bounds[start : stop + 1]
            found = signatures(self.values[part[0] : part[-1]], part - part[0], percent)
            sigs.append(found[0])
            who.append(found[1] + start)
            start = stop
        distinct, which = np.unique(np.concatenate(sigs), return_inverse=True)
        return distinct, which, np.concatenate(who)


def shingle_links(docs: DataFrame, width: int = 5, percent: int = 75, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, n_shingles, set_id for each document; and the links a, b found between sets.

    Documents with equal sets are one node, kept by the first chunk that has it. A set can link only if percent of its elements are in
    other sets too; sets for which a count of elements by hash cells (never too low) rules that out have no links, and signatures are made
    for the others alone. A chunk asks each signature once, with its least set, so that one in a third of all sets is one
    row for a chunk. The answers are the signature group's first (least) set. The links are enough to connect all sets that links
    connect: each set is compared with the first that it shares most groups with, then with its nearest one of another component, then with all
    of other components among the members of its firsts' circles; the last two rule pairs out by sketches, block by block, and
    what is left is compared on whole sets. The last one passes on sets, not pairs, and gives links that join no more than is apart yet, so that its rows follow the members of circles.
    """
    described, n_buckets = described_sets(docs, width, percent, chunk_bytes, bucket_hashes)
    own = described.select("chunk", "own_ids", "own_sizes", "elements").where("length(elements) > 0")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            sets = OwnSets(row)
            distinct, which, who = sets.signatures(percent)
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, which, sets.ids[who])
            # 40 bits of a signature in its bucket are enough: those that only seem equal are compared in vain.
            yield from question(row["chunk"], distinct, n_buckets, lambda s, least=least: listed(least[s]), bits=40)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set that shares a signature, with the first of all its groups: the one of most groups, and all of them."""
        for row in rows_of(batches):
            sets = OwnSets(row)
            distinct, which, who = sets.signatures(percent)
            said = np.concatenate([unlisted(unpacked(x["said"])) for x in sorted(row["answers"] or [], key=lambda x: x["bucket"])] or [np.empty(0, np.int64)])
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, which, sets.ids[who])
            several = (np.bincount(which, minlength=len(distinct)) > 1) | (said != 0)
            least = np.where(said != 0, np.minimum(said, least), least)
            used = several[which]
            pairs = np.stack((who[used], least[which[used]]), axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))) if len(pairs) else np.empty(0, np.int64)
            counts = np.diff(np.append(new, len(pairs)))
            pairs = pairs[new]
            met = np.unique(pairs[:, 0])
            ends = np.searchsorted(pairs[:, 0], met, side="right")
            starts = np.searchsorted(pairs[:, 0], met)
            other = pairs[:, 1] != sets.ids[pairs[:, 0]]
            most = np.where(other, counts, 0)
            best = [int(a + most[a:b].argmax()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            best = np.array(best, np.int64)
            circles = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(pairs[:, 1])) if len(met) else pa.array([], pa.list_(pa.int64()))
            sizes = np.diff(sets.bounds)[met]
            elements = [sets.values[sets.bounds[s] : sets.bounds[s + 1]].tobytes() for s in met.tolist()]
            columns = [pa.array(sets.ids[met]), pa.array(sizes), pa.array(pairs[best, 1], mask=~other[best]), circles, pa.array(elements, pa.binary()), pa.array(sketched(elements), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "n", "nearest", "circles", "elements", "sketch"])

    firsts = answered(own.mapInArrow(ask, QUESTION), n_buckets, least_first)
    known = written(own.join(firsts, "chunk").mapInArrow(meet, "set_id long, n long, nearest long, circles array<long>, elements binary, sketch binary"), "circle-members")
    documents = written(set_documents(described), "set-documents")
    discarded(described)

    def verified(pairs: DataFrame, ours: DataFrame, name: str) -> DataFrame:
        """Those of the pairs a, b (set ids; theirs has b's elements) that are linked, by their whole sets."""
        both = pairs.join(ours.select(F.col("set_id").alias("a"), F.col("elements").alias("ours")), "a")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch["ours"], batch["theirs"], strict=True):
                    u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    keep.append(linked(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), percent))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return written(both.mapInArrow(compare, "a long, b long"), f"{name}-links")

    def with_theirs(pairs: DataFrame) -> DataFrame:
        return pairs.join(known.select(F.col("set_id").alias("b"), F.col("elements").alias("theirs")), "b")

    # Each set with the first set that it shares most groups with: one comparison a set, and the set itself is at hand.
    nearest = known.where("nearest is not null").select(F.col("nearest").alias("a"), F.col("set_id").alias("b"), F.col("elements").alias("theirs"))
    links = verified(nearest, known.where(F.array_contains("circles", F.col("set_id"))), "nearest")

    # Each set that isn't of its circle's largest component with the one of another component that the circle has nearest
    # by their sketches. A pair not tried then has a set among them with several candidates; those come last, whole, with all that they may link with.
    found = written(across_components(open_circles(known, links), percent, nearest=True), "near-found")
    near = found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    near = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    several = found.groupBy(F.col("a").alias("set_id")).agg(F.max("several").alias("several"), F.min("b").alias("x"), F.max("b").alias("y")).where("several or x < y")
    more = links.unionByName(verified(with_theirs(near), known, "near"))
    parts = written(may_link(open_circles(known, more, several.select("set_id")), percent), "may-link")
    whole = parts.join(known.select("set_id", "elements"), "set_id")
    links = more.unionByName(written(joining_links(whole, percent), "across-links"))
    return documents, links


def open_circles(known: DataFrame, links: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The members of circles that have several components: circle, n, n_ask, asks (only's sets; without only, those outside the
    circle's largest component), that largest component, total (members of all circles that have the same), and the members' set_id, n_shingles, component and sketch. Of known, set_id, n, circles and sketch are read, whole sets are not.

    A circle is counted by component and then as one, so that a circle in a third of all sets meets in partial
    counts alone; its members find its count by circle and salt.
    """
    component = connected_components(links, "a", "b")
    labelled = known.select("set_id", "circles").join(component.withColumnRenamed("node", "set_id"), "set_id", "left")
    if only is not None:
        labelled = labelled.join(only.withColumn("chosen", F.lit(1)), "set_id", "left")
    chosen = F.coalesce("chosen", F.lit(0)) if only is not None else F.lit(0)
    labelled = written(labelled.select("set_id", "circles", F.coalesce("component", "set_id").alias("component"), chosen.alias("chosen")), "labelled-members")
    placed = labelled.select(F.explode("circles").alias("circle"), "set_id", "component", "chosen")
    counts = placed.groupBy("circle", "component").agg(F.count("*").alias("n"), F.sum("chosen").alias("chosen"))
    several = counts.groupBy("circle").agg(F.sum("n").alias("n"), F.sum("chosen").alias("n_chosen"), F.max(F.struct("n", "component")).alias("most"))
    n_ask = F.col("n") - F.col("most.n") if only is None else F.col("n_chosen")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    several = several.where("most.n < n").select("circle", "n", n_ask.alias("n_ask"), F.col("most.component").alias("largest")).where("n_ask > 0")
    several = written(several, "open-circles")
    several = several.join(several.groupBy("largest").agg(F.sum("n").alias("total")), "largest").withColumn("salt", salts)
    members = placed.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS))).join(several, ["circle", "salt"])
    asks = F.col("component") != F.col("largest") if only is None else F.col("chosen") > 0
    members = written(members.select("circle", "n", "n_ask", asks.alias("asks"), "largest", "total", "set_id", "component"), "open-members")

    return members.join(known.select("set_id", F.col("n").alias("n_shingles"), "sketch"), "set_id")


def circle_groups(rest: DataFrame, block: int = 4096) -> DataFrame:
    """The sets that are compared together, by home, i and j: those of `left` with those of `right`, where they are listed in a circle of both (all, where circles is null).

    rest is as open_circles() gives it; pairs are those of a set that asks with any other, so that a circle's largest component isn't
    compared with itself. Circles of more than `block` sets are dealt to blocks of those that ask and blocks of all, each pair of blocks in a group
    of its own, so that a task holds two blocks at most. Smaller ones, many of which have the same largest component and nearly the same members, go by that component, dealt
    by circle to as many groups as keep each near `block` members: a set goes there once, with its circles, and not once for each of them.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("set_id"), blocks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["set_id", "n_shingles", "sketch", "component", "asks"]
    large = rest.where(F.col("n") > block)
    part = F.pmod(F.xxhash64("circle"), blocks("total")).cast("int")
    once = [F.first(c).alias(c) for c in columns if c != "set_id"]
    small = rest.where(F.col("n") <= block).withColumn("i", part).groupBy("set_id", "largest", "i").agg(F.collect_list("circle").alias("circles"), *once)
    among = small.select(F.col("largest").alias("home"), "i", F.lit(-1).alias("j"), F.col("asks").alias("left"), F.lit(True).alias("right"), "circles", *columns)
    none = F.lit(None).cast("array<bigint>").alias("circles")
    among = among.unionByName(large.select(F.col("circle").alias("home"), upto("n_ask").alias("i"), mine("n").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), none, *columns))
    asking = large.where("asks").select(F.col("circle").alias("home"), mine("n_ask").alias("i"), upto("n").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), none, *columns)
    return asking.unionByName(among)


class Group:
    """A group of circle_groups()."""

    def __init__(self, group: pa.Table, percent: int):
        self.percent = percent
        self.ids, self.n, self.component = (group[c].to_numpy() for c in ("set_id", "n_shingles", "component"))
        self.left, right, self.asks = (group[c].to_numpy().astype(bool) for c in ("left", "right", "asks"))
        self.drawn, self.circles = Sketches(group["sketch"].to_pylist()), group["circles"].to_pylist()
        listed_at: dict[int, list[int]] = {}
        for x, own in enumerate(self.circles):
            for c in own or ():
                listed_at.setdefault(c, []).append(x)
        self.members = {c: np.array(x) for c, x in listed_at.items()}
        order = np.flatnonzero(right)
        self.order = order[np.lexsort((self.ids[order], self.n[order]))]
        self.sizes = self.n[self.order]

    def candidates(self, x: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of sets that sketches allow to link with x, of those not marked in but, and what of both they differ in at least."""
        n, percent = self.n, self.percent
        low, high = np.searchsorted(self.sizes, -(-n[x] * percent // 100)), np.searchsorted(self.sizes, n[x] * 100 // percent, side="right")
        others = self.order[low:high]
        if self.circles[x] is not None:
            met = np.zeros(len(self.ids), bool)
            for c in self.circles[x]:
                met[self.members[c]] = True
            others = others[met[others]]
        others = others[(self.component[others] != self.component[x]) & ~but[others]]
        if not len(others):
            return others, np.empty(0)
        apart = self.drawn.apart(x, others)
        may = apart * (100 + percent) <= (n[x] + n[others]) * (100 - percent)
        return others[may], (apart / (n[x] + n[others]))[may]


def across_components(rest: DataFrame, percent: int, nearest: bool = False, block: int = 4096) -> DataFrame:
    """Pairs a, b (and how far apart their sketches are) of one circle and different components that sketches allow to link, from circle_groups().

    Pairs have a < b and may come from several groups; they grow with the square of a circle's sets. With `nearest`, each set that asks comes with its nearest one in a circle alone, and whether it has several.
    """

    def compare(group: pa.Table) -> pa.Table:
        own, out = Group(group, percent), []
        ids = own.ids
        for x in np.flatnonzero(own.left).tolist():
            others, apart = own.candidates(x, np.zeros(len(ids), bool) if nearest else own.asks & (ids <= ids[x]))
            if nearest and len(others):
                best = np.lexsort((ids[others], apart))[0]
                out.append((int(ids[x]), int(ids[others[best]]), float(apart[best]), len(others) > 1))
            elif not nearest:
                for y, far in zip(others.tolist(), apart.tolist(), strict=True):
                    out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y])), far, False))
        made = list(zip(*out, strict=True)) or [()] * 4
        kinds = {"a": pa.int64(), "b": pa.int64(), "apart": pa.float64(), "several": pa.bool_()}
        return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(made, kinds.items(), strict=True)})

    return circle_groups(rest, block).groupBy("home", "i", "j").applyInArrow(compare, "a long, b long, apart double, several boolean")


def may_link(rest: DataFrame, percent: int, block: int = 4096, piece_elements: int = PIECE_ELEMENTS) -> DataFrame:
    """Sets to compare whole: those that the pairs of across_components() lead to from each other in a group have one home, i, j and root.

    A set has one row in a group. Only where those of a root have more than `piece_elements` elements, they are cut into pieces, and each two pieces
    p, q meet apart from others, so that no task holds more than two of these, or than two sets; piece is a set's own.
    """
    kinds = {"home": "long", "i": "int", "j": "int", "root": "long", "p": "int", "q": "int", "piece": "int", "set_id": "long", "component": "long"}

    def find(key: tuple, group: pa.Table) -> pa.Table:
        own = Group(group, percent)
        # A set that both asks and is asked stands twice in a group of two blocks.
        _, at = np.unique(own.ids, return_inverse=True)
        kin = at.copy()
        for x in np.flatnonzero(own.left).tolist():
            others, _ = own.candidates(x, kin == kin[x])
            if len(others):
                kin[np.isin(kin, kin[others])] = kin[x]
        _, one = np.unique(own.ids, return_index=True)
        kin = kin[one]
        several = np.bincount(kin, minlength=1)[kin] > 1
        kin, one = kin[several], one[several]
        rows: list[tuple[np.ndarray, ...]] = []
        for k in np.unique(kin).tolist():
            these = one[kin == k]
            ends = np.cumsum(own.n[these])
            _, piece = np.unique((ends - 1) // piece_elements, return_inverse=True)
            for p, q in combinations(range(int(piece[-1]) + 1), 2) if piece[-1] else [(0, 0)]:
                there = (piece == p) | (piece == q)
                n = int(there.sum())
                rows.append((np.full(n, own.ids[these[0]]), np.full(n, p), np.full(n, q), piece[there], own.ids[these[there]], own.component[these[there]]))
        made = [np.concatenate(c) for c in zip(*rows, strict=True)] or [np.empty(0, np.int64)] * 6
        columns = [*(np.full(len(made[0]), k.as_py()) for k in key), *made]
        return pa.table({name: pa.array(c).cast(pa.int64() if kind == "long" else pa.int32()) for c, (name, kind) in zip(columns, kinds.items(), strict=True)})

    return circle_groups(rest, block).groupBy("home", "i", "j").applyInArrow(find, ", ".join(map(" ".join, kinds.items())))


def joining_links(whole: DataFrame, percent: int) -> DataFrame:
    """Linked pairs a, b (a < b) of different components, as few as join all that a group of may_link(), with its elements, has linked: fewer than it has sets."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        ids, label, piece = (group[c].to_numpy().copy() for c in ("set_id", "component", "piece"))
        # Pairs of one piece are left to the group of that and the next.
        within = key[5].as_py() - key[4].as_py() <= 1
        elements = group["elements"].to_pylist()
        n = np.array([len(x) // 8 for x in elements], np.int64)
        order = np.lexsort((ids, n))
        ids, label, piece, n, elements = ids[order], label[order], piece[order], n[order], [elements[k] for k in order.tolist()]
        drawn = Sketches(sketched(elements))
        distinct, codes = np.unique(np.frombuffer(b"".join(elements), np.uint64), return_inverse=True)
        own = np.split(codes, np.cumsum(n)[:-1])
        mine, out = np.zeros(len(distinct), bool), []
        for x in range(len(ids)):
            others = np.arange(x + 1, np.searchsorted(n, n[x] * 100 // percent, side="right"))
            others = others[(label[others] != label[x]) & (within | (piece[others] != piece[x]))]
            if not len(others):
                continue
            apart = drawn.apart(x, others)
            may = apart * (100 + percent) <= (n[x] + n[others]) * (100 - percent)
            others = others[may][np.argsort(apart[may], kind="stable")]
            mine[own[x]] = True
            for y in others.tolist():
                if label[y] != label[x] and linked(int(np.count_nonzero(mine[own[y]])), int(n[x]), int(n[y]), percent):
                    out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                    label[label == label[y]] = label[x]
            mine[own[x]] = False
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return whole.groupBy("home", "i", "j", "root", "p", "q").applyInArrow(compare, "a long, b long")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 75, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, set_id, component.

    set_id and component (null for empty sets) tell sets and components apart even where doc_ids repeat or are null. A set holds the distinct `width`-word shingles of the text, A-Z in lower case; a text with fewer words is one
    shingle. Documents link when 100 * intersection >= percent * union; component_id is the least doc_id that
    links lead to. Shingles and sets are told apart by 64-bit hashes.

    Cases: texts without words (null ones too) have empty sets, link with nothing and are their own components; null ids
    take part, and a component of them alone is null; rows that repeat are linked with each other; an
    empty table gives an empty result; other columns are ignored.
    """
    described, links = shingle_links(docs, width, percent, chunk_bytes, bucket_hashes)
    component = connected_components(links, "a", "b")
    least = described.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = least.join(component.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = written(named.join(smallest, "component").select(F.col("set_id").alias("class_set"), "component_id", "component"), "classes")
    out = described.join(classes, F.col("set_id") == F.col("class_set"), "left")
    least_id = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", least_id.alias("component_id"), "set_id", "component")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
