"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most ``2 r`` bits exactly if the balls of radius ``r`` around them share a value. So
every distinct fingerprint emits all values within half the linking radius (2,081 for a radius of 4), equal values meet in
one bucket, and what meets is linked. Whatever shares a value lies within ``2 r`` of each other by the triangle inequality,
so a star to the smallest member keeps every link of a group without its pairs.

Shipping 2,081 rows for each fingerprint would cost far more disk than the corpus. So a bucket holds all values with the same
bits at some places, and fingerprints are shipped to it in their stead: a ball of radius 2 reaches 1 + b + b (b - 1) / 2 of
the 2 ** b buckets, 79 of 4,096 for b = 12. A bucket enumerates its own values from the fingerprints, as a value's bits at the
places are those of the fingerprint and a known mask; a linear hash of the other bits cuts them into bounded blocks. The
number of places grows with the fingerprints, until the fullest bucket, counted beforehand, is within a bound.

Nulls and texts without words have fingerprint zero and link like any other. Rows with equal doc_id count as one node; a null
doc_id joins no rows. Texts of any length count whole. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows, discard, materialise, text_bytes

SEED = 42
#: Values that one task sorts at once, and fingerprints that one bucket gets; places that buckets are told by, at least and at most.
BLOCK, BUCKET = 4_000_000, 8_000_000
MIN_PLACES, MAX_PLACES = 6, 20


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """The 64-bit SimHash of a text in UTF-8: a bit is 1 if it is set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - words_per_shingle] + 1).tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).view(np.uint64).reshape(-1, 8)
    # Each byte of a row counts one bit; 255 rows can be added as 64-bit numbers before a byte overflows.
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            values = [fingerprint(x, words_per_shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, fp long")


def masks_within(radius: int) -> np.ndarray:
    """All 64-bit values with at most ``radius`` bits set."""
    return np.array([sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], np.uint64)


def linear_hash(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The exclusive or of a column for each set bit of a value; ``columns`` are 64 numbers."""
    tables = np.zeros((8, 256), np.uint32)  # one lookup for each byte of a value
    for byte in range(8):
        for bit in range(8):
            tables[byte, (np.arange(256) >> bit) & 1 == 1] ^= np.uint32(columns[8 * byte + bit])
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    out = tables[0, octets[:, 0]]
    for byte in range(1, 8):
        out = out ^ tables[byte, octets[:, byte]]
    return out


def columns_of(places: list[int], sub_bits: int) -> np.ndarray:
    """Columns of a hash whose high bits are a value's bits at ``places`` and whose low ``sub_bits`` mix its other bits."""
    columns = np.random.default_rng(SEED).integers(0, 1 << 32, 64, np.uint64) & np.uint64((1 << sub_bits) - 1)
    for i, place in enumerate(places):
        columns[place] |= np.uint64(1 << (sub_bits + i))
    return columns


def star_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) with the smallest node of its component, by hooking and pointer jumping."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def bucket_links(fps: np.ndarray, bucket: int, places: list[int], sub_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints by the values of their balls that fall into one bucket: (node, smallest node it reaches there)."""
    masks, columns = masks_within(radius // 2), columns_of(places, sub_bits)
    codes = linear_hash(masks, columns)
    order = np.argsort(codes, kind="stable")
    masks, codes = masks[order], codes[order]
    slots = np.arange((1 << (len(places) + sub_bits)) + 1)
    first = np.searchsorted(codes, slots)
    held = np.diff(first)
    own = linear_hash(fps, columns)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for sub in range(1 << sub_bits):
        want = own ^ np.uint32((bucket << sub_bits) | sub)
        counts = held[want]
        carrier = np.repeat(np.arange(len(fps)), counts)
        place = np.arange(len(carrier)) - np.repeat(np.cumsum(counts) - counts, counts) + first[want][carrier]
        values = fps[carrier] ^ masks[place]
        ordered = np.sort(values)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        spot = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[spot] == values
        group, member = spot[hit], fps[carrier[hit]]
        order = np.lexsort((member, group))
        group, member = group[order], member[order]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.repeat(member[begins], np.diff(np.r_[begins, len(group)]))
        pairs = np.unique(np.stack([least, member], 1)[least != member], axis=0)
        close = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius
        left.append(pairs[close, 0])
        right.append(pairs[close, 1])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    nodes, roots = star_components(np.concatenate(left), np.concatenate(right))
    return nodes[nodes != roots], roots[nodes != roots]


def bucket_loads(counts: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Fingerprints that each bucket gets, given how many have its bits at the places."""
    out = np.zeros(1 << bits, np.int64)
    for n in range(radius // 2 + 1):
        for flipped in combinations(range(bits), n):
            out += counts[np.arange(1 << bits) ^ sum(1 << i for i in flipped)]
    return out


def chosen_places(fps: DataFrame, n: int, radius: int) -> tuple[list[int], int, int]:
    """The places that tell buckets, the fullest bucket, and the fingerprints at its centre.

    Places whose bits are set most evenly come first. 64 sums and at most 2 ** MAX_PLACES counts reach the driver.
    """
    sums = fps.agg(*(F.sum(F.getbit("fp", F.lit(i)).cast("long")) for i in range(64))).first()
    even = sorted(range(64), key=lambda i: (abs(2 * (sums[i] or 0) - n), i))
    bits = MIN_PLACES
    while True:
        places = even[:bits]
        code = sum((F.shiftleft(F.getbit("fp", F.lit(p)).cast("int"), i) for i, p in enumerate(places)), F.lit(0))
        counts = np.zeros(1 << bits, np.int64)
        for at, count in fps.groupBy(code.alias("at")).count().collect():
            counts[at] = count
        loads = bucket_loads(counts, bits, radius)
        if loads.max() <= BUCKET or bits == MAX_PLACES:
            return places, int(loads.max()), int(counts.max())
        bits = min(MAX_PLACES, bits + 2)


def ball_links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(u, v), v > u: links that join all of the ``n`` distinct values ``fp`` which differ in at most ``radius`` bits."""
    places, _, centre = chosen_places(fps, n, radius)
    balls, sub_bits = len(masks_within(radius // 2)), 0
    while centre * balls >> sub_bits > BLOCK and sub_bits < 24 - len(places):
        sub_bits += 1

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = columns_of(places, 0)
        reached = np.unique(linear_hash(masks_within(radius // 2), columns))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            buckets = (linear_hash(values, columns)[:, None] ^ reached[None, :]).ravel()
            order = np.argsort(buckets, kind="stable")
            shipped, ends = values[order // len(reached)], np.flatnonzero(np.diff(buckets[order], append=-1)) + 1
            blobs = [shipped[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[order][ends - 1].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(group.column("blob").to_pylist()), np.uint64)
        nodes, roots = bucket_links(values, group.column("bucket")[0].as_py(), places, sub_bits, radius)
        return pa.table({"u": roots.view(np.int64), "v": nodes.view(np.int64)})

    return fps.select("fp").mapInArrow(ship, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, "u long, v long").distinct()


def id_links(marked: DataFrame) -> DataFrame:
    """(u, v): links between the different values ``fp`` of rows that share a doc_id."""
    several = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).where("u < most").drop("most")
    return marked.join(several, "doc_id").where("fp > u").select("u", F.col("fp").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of ``links`` (u, v) with the least node of its component, by large and small stars.

    A round replaces links by links to the least neighbour; it is written to the shared folder, and only a count and a
    checksum reach the driver. Null ends are dropped. No links give an empty table.
    """
    edges = links.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialise(edges, "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        before, edges = edges, materialise(small, "links")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest doc_id reachable by links of at most ``radius``
    differing bits. An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, words_per_shingle), "fingerprints")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "balls")
    n = fps.count()
    roots = components(ball_links(fps, n, radius).unionByName(id_links(marked)))
    known = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = materialise(known, "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = known.join(least, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
