"""Near duplicates by b-bit MinHash.

Each text keeps, of the minima of its shingle hashes under many permutations, a
key for each band of minima and the low bits of all of them, packed. Texts that
share a band key are candidates; counting equal low bits of two packed signatures
and taking off the bits that are equal by chance estimates their similarity, and
every candidate that could reach the threshold is decided on the full sets. A
second sketch, of the parities of hashed shingles, bounds the difference of two
sets for certain and spares most of those decisions.

Texts with equal sets are one node. Within a band key, first every node is
compared with the key's smallest node only; then only nodes that this left in
different components are paired, so a large group of copies costs one comparison
a member, and yet no link that joins two components is left untried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components
from tideline.llm.storage import narrow_batches, stored
from tideline.llm.words import Block, blocks, mix, windows

#: Minima in a band, and low bits kept of each.
ROWS, BITS = 5, 2
#: So many bands that a pair at the threshold shares none with at most this probability.
MISS = 1e-8
#: Candidates whose estimate is below the threshold by more than this many of its standard deviations are not decided on the sets.
DEVIATIONS = 7.0
#: Members of one band key that are paired in one task.
KEY_ROWS = 512
PER_LONG = 64 // BITS
#: Bits of a set's odd sketch: bit i says whether an odd number of its shingles hash to i. Few, so that the join's condition stays small enough to be compiled.
SKETCH_BITS = 512
SCHEMA = "n_shingles long, digest_a long, digest_b long, band_keys array<long>, packed array<long>"


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_sets(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts of a block, ascending in each text, and where each text's begin."""
    b.find_words(lower=True)
    h = b.word_hashes()
    short = (b.n_words > 0) & (b.n_words < n)
    per = np.where(b.n_words >= n, b.n_words - n + 1, short.astype(np.int64))
    out = np.zeros(int(per.sum()), np.uint64)
    at = np.concatenate([[0], np.cumsum(per)])
    full = windows(h, n)
    inside = b.doc[: len(full)] == b.doc[n - 1 :][: len(full)]
    of = b.doc[: len(full)][inside]
    out[at[of] + (np.flatnonzero(inside) - b.word_offsets[of])] = full[inside]
    for d in np.flatnonzero(short):
        w = h[b.word_offsets[d] : b.word_offsets[d + 1]]
        out[at[d]] = mix(windows(w, len(w)) + np.uint64(len(w)))[0]
    kept = []
    for d in range(b.n):
        s = np.sort(out[at[d] : at[d + 1]])
        kept.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    sizes = np.array([len(s) for s in kept], np.int64)
    return (np.concatenate(kept) if kept else out), np.concatenate([[0], np.cumsum(sizes)])


def minima(sets: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """count minima, each under another permutation, of each set that isn't empty (others: all ones)."""
    sizes = np.diff(at)
    some = np.flatnonzero(sizes)
    out = np.full((count, len(sizes)), ~np.uint64(0), np.uint64)
    if len(some):
        starts = at[some]
        odd, add = mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(1 << 20))
        for i in range(count):
            out[i, some] = np.minimum.reduceat(sets * odd[i] + add[i], starts)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def sign(b: Block, n: int, bands: int) -> list[pa.Array]:
    sets, at = shingle_sets(b, n)
    sizes = np.diff(at)
    total = np.zeros((2, len(sets) + 1), np.uint64)
    np.cumsum(mix(sets ^ np.uint64(0x1234567)), out=total[0, 1:])
    np.cumsum(mix(sets ^ np.uint64(0x89ABCDE)), out=total[1, 1:])
    digests = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
    m = mix(minima(sets, at, bands * ROWS))
    banded = m.reshape(bands, ROWS, b.n)
    keys = np.zeros((bands, b.n), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, r])
    keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))
    packed = np.zeros((b.n, -(-bands * ROWS // PER_LONG)), np.uint64)
    low = m & np.uint64((1 << BITS) - 1)
    for i in range(bands * ROWS):
        packed[:, i // PER_LONG] |= low[i] << np.uint64(BITS * (i % PER_LONG))
    return [pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]), _lists(keys.T), _lists(packed)]


def signatures(docs: DataFrame, id_col: str, text: str, n: int, bands: int) -> DataFrame:
    """(id, n_shingles, digest of the set, band keys, packed low bits) of each row."""
    rows = docs.select(F.col(text).alias("text"), F.col(id_col).cast("long").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(b.first, b.n), *sign(b, n, bands)], names=["id", *[x.split()[0] for x in SCHEMA.split(", ")]])

    return rows.mapInArrow(run, "id long, " + SCHEMA)


def sets_of(rows: DataFrame, n: int) -> DataFrame:
    """(id, shingles) of (text, id) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                sets, at = shingle_sets(b, n)
                lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(sets.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(b.first, b.n), lists], names=["id", "shingles"])

    return rows.select("text", "id").mapInArrow(run, "id long, shingles array<long>")


def odd_sketches(rows: DataFrame, n: int) -> DataFrame:
    """(id, odd) of (text, id) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                sets, at = shingle_sets(b, n)
                place = (mix(sets) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
                odd = np.zeros((b.n, SKETCH_BITS), np.uint8)
                for d in range(b.n):
                    odd[d] = np.bincount(place[at[d] : at[d + 1]], minlength=SKETCH_BITS) & 1
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(b.first, b.n), _lists(np.packbits(odd, axis=1, bitorder="little").view(np.uint64))], names=["id", "odd"])

    return rows.select("text", "id").mapInArrow(run, "id long, odd array<long>")


def could_reach(size_x: str, size_y: str, odd_x: str, odd_y: str, percent: int) -> F.Column:
    """False only if the sets' similarity is below percent for certain: each bit in which the sketches differ is a shingle that one set lacks."""
    differ = sum((F.bit_count(F.col(odd_x)[w].bitwiseXOR(F.col(odd_y)[w])) for w in range(SKETCH_BITS // 64)), F.lit(0))
    total = F.col(size_x) + F.col(size_y)
    return 100 * (total - differ) >= percent * (total + differ)


def equal_low_bits(x: str, y: str, count: int) -> F.Column:
    """In how many of the count packed places x and y have equal low bits."""
    longs = -(-count // PER_LONG)
    lowest = sum(1 << (BITS * i) for i in range(PER_LONG))
    lowest -= (lowest >> 63) << 64
    different = F.lit(0)
    for w in range(longs):
        differ = F.col(x)[w].bitwiseXOR(F.col(y)[w])
        any_bit = differ
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(differ, k))
        different = different + F.bit_count(any_bit.bitwiseAND(F.lit(lowest)))
    return F.lit(count) - different  # unused places never differ


def estimate(x: str, y: str, count: int) -> F.Column:
    """Similarity from the share of equal low bits, less those equal by chance."""
    chance = 2.0**-BITS
    return (equal_low_bits(x, y, count) / F.lit(float(count)) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(threshold: float, count: int) -> float:
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - DEVIATIONS * (p * (1 - p) / count) ** 0.5 / (1 - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept, n_links) of each row of docs.

    Rows are linked if 100 * intersection >= percent * union of their sets of n
    words (A-Z lower-cased; with fewer words, the whole sequence). component_id
    is the smallest id reachable over links, kept whether that is the row's own.
    Null and empty texts have no shingles and are linked with nothing. Ids are
    taken as unique; rows that repeat an id are returned once each, and of rows
    with a null id every one is a component (null) of its own. An empty table
    gives an empty result, other columns are not looked at, and a text of any length
    is taken whole, in memory in proportion to it. n_links: confirmed links to other sets that were
    tried (not all that exist), plus rows with the same set.
    """
    narrow_batches(docs.sparkSession)
    bands = bands_for(percent / 100)
    count = bands * ROWS
    signed = stored(signatures(docs, id_col, text, n, bands))
    some = signed.where("n_shingles > 0 and id is not null")
    # Rows with equal sets are one node, named by the smallest id.
    classes = stored(some.groupBy("digest_a", "digest_b", "n_shingles").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    nodes = some.join(classes.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    keyed = nodes.select("id", F.explode("band_keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("members")).where("members > 1")
    held = stored(keyed.join(shared, "key"))
    candidates = stored(held.select("id").distinct())
    members = stored(held.join(nodes.join(candidates, "id", "left_semi").select("id", F.col("n_shingles").alias("size"), "packed"), "id"))

    # The only time that texts are moved; later joins read the candidates' alone.
    texts = stored(docs.select(F.col(text).alias("text"), F.col(id_col).cast("long").alias("id")).join(candidates, "id", "left_semi"))
    low = least_estimate(percent / 100, count)
    odd = stored(odd_sketches(texts, n).dropDuplicates(["id"]))

    def fits(a: str, b: str) -> F.Column:
        return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))

    def decided(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        pairs = stored(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = stored(sets_of(texts.join(ids, "id", "left_semi"), n).dropDuplicates(["id"]))
        x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(x, "a").join(y, "b").where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    # Every node against the smallest of each of its band keys.
    centers = members.where("id = center").select("key", F.col("packed").alias("center_packed"), F.col("size").alias("center_size"))
    star = members.where("id <> center").join(centers, "key").where(fits("size", "center_size") & (estimate("packed", "center_packed", count) >= low))
    tried = stored(star.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct())
    links = stored(decided(tried))
    for most in (1, None):
        # Band keys whose members are still in different components: their pairs across these.
        label = components(links)
        now = members.join(label, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        mixed = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("held")).where("c0 < c1")
        rows = stored(now.join(mixed.select("key", "held"), "key").join(odd, "id"))
        shares = F.ceil(F.col("held") / KEY_ROWS).cast("int")
        left = rows.select("key", F.pmod(F.xxhash64("id"), shares).cast("int").alias("share"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("za"), F.col("packed").alias("pa"), F.col("odd").alias("oa"))
        right = rows.select("key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("zb"), F.col("packed").alias("pb"), F.col("odd").alias("ob"))
        found = left.join(right, ["key", "share"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("za", "zb") & (estimate("pa", "pb", count) >= low) & could_reach("za", "zb", "oa", "ob", percent))
        pairs = found.select("a", "b", "ca", "cb", estimate("pa", "pb", count).alias("e")).distinct().join(tried, ["a", "b"], "left_anti")
        if most:
            # Of a node's partners in one component, the likeliest first: one link joins all.
            pairs = pairs.groupBy("a", "cb").agg(F.max_by("b", F.struct("e", "b")).alias("b"))
        pairs = stored(pairs.select("a", "b"))
        if pairs.isEmpty():
            break
        links = stored(links.union(decided(pairs)))
        tried = stored(tried.union(pairs))
    label = components(links)
    per = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("linked"))
    of_class = classes.join(label.withColumnRenamed("id", "node"), "node", "left").join(per, "node", "left").select("digest_a", "digest_b", "n_shingles", F.coalesce("component", "node").alias("found"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = signed.select("id", "digest_a", "digest_b", "n_shingles").join(of_class, ["digest_a", "digest_b", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("found")).otherwise(F.col("id"))
    return done.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("n_links")), F.lit(0)).alias("n_links"))
