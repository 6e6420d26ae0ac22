"""SimHash near-duplicates: bit-sliced comparison of candidates, components in Spark.

Equal fingerprints are one row from the start. Two fingerprints within three bits agree on at
least two of five blocks of bits, so every pair of blocks is a table of keys, and only rows of
one key are compared. A key with many rows is dealt out as pairs of sub-blocks. Within a task
the fingerprints lie as 64 vertical bit planes in Python's long integers: one XOR per plane
compares a fingerprint with thousands, two carry-save planes count the differing bits up to
three, a third marks those beyond, and the comparison ends once all are beyond. Only a spanning
forest of the links leaves the task. ``similar`` uses the same comparison with more bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, staged

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: Fixed by the radius: bit widths of the five blocks, from the highest bit down.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a key up to which it is one group; larger keys are dealt out in sub-blocks of this size.
GROUP_ROWS = 2048
#: One in so many rep is counted to find the large keys.
COUNTED = 16
#: Runs up to this length are compared together, longer ones one by one.
SHORT_RUN = 32


def count_planes(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of bit lanes, those of ``levels[k]`` of weight 2**k -> bit planes of each lane's weighted sum, lowest first.

    Full adders take three rows of a weight to one of it and one carry of the next.
    """
    planes, carries = [], []
    for k in range(64):
        if k < len(levels):
            carries = [*carries, levels[k]]
        elif not carries:
            break
        rows, carries = np.concatenate(carries), []
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            half = a ^ b
            carries.append(a & b | half & c)
            rows = np.concatenate([half ^ c, rows[3 * third :]])
        if len(rows) == 2:
            carries.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        planes.append(rows[0])
    return planes


def over(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Lanes whose bit-sliced number is over ``least``."""
    more = np.zeros_like(planes[0])
    same = ~more
    for k in range(max(len(planes), least.bit_length()) - 1, -1, -1):
        plane = planes[k] if k < len(planes) else np.zeros_like(more)
        if least >> k & 1:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return more


def majority(rows: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows (n x lanes, 64 bits each)."""
    return over(count_planes([rows]), len(rows) // 2)


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """64-bit hashes of the text's word shingles in order; of all its words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = min(words_each, len(words)) - 1
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[last:] - 1).tolist(), strict=False)])
    return np.frombuffer(hashes, ">u8").astype(np.uint64)


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 without words."""
    hashes = shingle_hashes(text, words_each)
    return int(majority(hashes[:, None]).view(np.int64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp of every row; narrow, without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(text, words_each) for text in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_planes(fps: np.ndarray) -> list[int]:
    """One integer for each bit, from the highest, of the fingerprints (n x words); its bit i is that of fingerprint i."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), 8 * fps.shape[1]), axis=1)
    return [int.from_bytes(np.packbits(column, bitorder="little").tobytes(), "little") for column in bits.T]


def set_bits(word: int, n: int) -> np.ndarray:
    """Positions of the ones among the lowest n bits."""
    raw = np.frombuffer(word.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def within_radius(planes: Iterator[int], lanes: int, radius: int) -> int:
    """Lanes that differ in at most ``radius`` of the planes, which hold the differing bits.

    The counters start so high that the first difference beyond the radius carries out of them.
    """
    width = radius.bit_length()
    counters = [lanes if ((1 << width) - 1 - radius) >> k & 1 else 0 for k in range(width)]
    beyond = 0
    for carry in planes:
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
            if not carry:
                break
        else:
            beyond |= carry
            if beyond & lanes == lanes:
                return 0
    return lanes & ~beyond


def distances(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)


def links_of_short_runs(fps: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """All pairs within the radius of rows in one run; each shift of the planes is a comparison of many pairs."""
    planes, n, shift, found = [p for p in bit_planes(fps) if p], len(fps), 1, []
    while shift < n:
        same = run[shift:] == run[:-shift]
        if not same.any():
            break
        lanes = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        near = within_radius((p ^ (p >> shift) for p in planes), lanes, radius)
        if near:
            found += [(int(i), int(i) + shift) for i in set_bits(near, n)]
        shift += 1
    return found


def links_of_long_run(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of one run's links: each row is compared once, with the rows not yet reached.

    Each tree starts at the row nearest to the majority of those left, so that copies of one
    text hang on what is nearest to it.
    """
    found, rows = [], np.arange(len(fps))  # rows: those not yet reached, by lane
    planes, live, queue, bits = bit_planes(fps), (1 << len(fps)) - 1, [], 64 * fps.shape[1]
    while live:
        if not queue:
            left = rows[set_bits(live, len(rows))]
            hub = int(np.bitwise_count(fps[left] ^ majority(fps[left])).sum(axis=1, dtype=np.int64).argmin())
            live &= ~(1 << int(np.searchsorted(rows, left[hub])))
            queue.append(int(left[hub]))
            continue
        at = queue.pop()
        value, full = int.from_bytes(fps[at].astype(">u8").tobytes(), "big"), (1 << len(rows)) - 1
        near = within_radius((p ^ full if value >> (bits - 1 - k) & 1 else p for k, p in enumerate(planes)), live, radius)
        if near:
            reached = rows[set_bits(near, len(rows))]
            found += [(at, int(i)) for i in reached]
            queue += reached.tolist()
            live &= ~near
            if 2 * live.bit_count() < len(rows) and len(rows) > 64:
                rows = rows[set_bits(live, len(rows))]
                planes, live = bit_planes(fps[rows]), (1 << len(rows)) - 1
    return found


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links, in their order, that join rows not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for a, b in links:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            kept.append((a, b))
    return kept


def _finder(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (key, i, j, rep, words of fp) rows -> edges (a, b, apart); holds one batch and the runs that it cuts."""

    def edges(table: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        sizes, fps = np.bincount(run), np.ascontiguousarray(table[4:].T).view(np.uint64)
        short = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= SHORT_RUN))
        pairs = np.array(links_of_short_runs(fps[short], run[short], radius), np.int64).reshape(-1, 2)
        pairs = short[pairs]
        nearest = pairs[np.argsort(distances(fps, *pairs.T), kind="stable")]
        found = forest(list(map(tuple, nearest.tolist())))
        for number in np.flatnonzero(sizes > SHORT_RUN):
            own = np.flatnonzero(run == number)
            found += [(int(own[a]), int(own[b])) for a, b in links_of_long_run(fps[own], radius)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        ends = np.sort(table[3][np.stack([a, b])], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(distances(fps, a, b))], ["a", "b", "apart"])

    def run_numbers(table: np.ndarray) -> np.ndarray:
        new = np.any(table[:3, 1:] != table[:3, :-1], axis=0)
        return np.concatenate(([0], np.cumsum(new)))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([column.to_numpy().astype(np.int64) for column in batch.columns]))
            first = kept[0][:3, 0]
            if np.array_equal(first, kept[-1][:3, -1]):
                continue  # one run so far
            table = np.concatenate(kept, axis=1)
            run = run_numbers(table)
            whole = run < run[-1]
            yield edges(table[:, whole], run[whole])
            kept = [table[:, ~whole]]
        if kept:
            table = np.concatenate(kept, axis=1)
            yield edges(table, run_numbers(table))

    return links


def block_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: number of the block pair above the pair's bits."""
    shifts = [sum(BLOCKS[k + 1 :]) for k in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in zip(shifts, BLOCKS, strict=True)]
    keys = [
        F.lit(number << 26).cast("long").bitwiseOR(F.shiftleft(block[a], 13)).bitwiseOR(block[b])
        for number, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return F.array(*keys)


def edges_of_keys(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(key, rep, words of a fingerprint) -> edges (a, b, apart) that connect all rep of a key within the radius; a < b.

    Only a spanning forest of each key's links leaves its task. Two rep of a key whose
    fingerprints are equal are linked too. How many parts a key is dealt out in changes no
    result, so its rows are estimated from every sixteenth rep.
    """
    some = rows.where(F.pmod(F.xxhash64(F.lit("count"), "rep"), F.lit(COUNTED)) == 0)
    hot = some.groupBy("key").agg((F.count("*") * COUNTED).alias("count")).where(F.col("count") > GROUP_ROWS)
    hot = staged(hot.select(F.col("key").alias("_key"), F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("parts")), "hot-keys")
    dealt = rows.join(hot, F.col("key") == F.col("_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", *words)
    ordered = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", *words)
    return ordered.mapInArrow(_finder(radius), "a long, b long, apart long").distinct()


def link_edges(reps: DataFrame) -> DataFrame:
    """(fp, rep) with distinct fp -> edges (a, b) that connect all rep within the radius; a < b."""
    rows = reps.select(F.explode(block_keys(F.col("fp"))).alias("key"), "rep", "fp")
    return edges_of_keys(rows, ["fp"], RADIUS).select("a", "b")


def _followed(step: DataFrame) -> DataFrame:
    """(node, label) with label < node or a root's own -> (node, label) with the root at the end of each chain of labels.

    Each round looks up the label of the label, which halves the chains.
    """
    while True:
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = staged(step.join(onward, "label").select("node", F.col("further").alias("label"), (F.col("label") != F.col("further")).alias("moved")), "labels")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        step = step.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, component): the smallest node that each node with an edge reaches.

    Each round every node points to its smallest neighbour if that is smaller; a node that has
    only larger neighbours, none of which points to it, points to the smallest of them. Chains
    of pointers are followed to their root by doubling, and the graph is contracted to the
    roots. No root is alone, so each round at least halves the nodes; with the doubling the
    number of steps grows with the square of the logarithm of the graph at most. Every join has
    staged tables on both sides, so that rows of one node can be split over tasks.
    """
    edges = staged(edges, "edges")
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        nearest = staged(both.groupBy("node").agg(F.min("near").alias("near")), "nearest")
        pointed = nearest.where("near < node").select(F.col("near").alias("node")).distinct().withColumn("pointed", F.lit(True))
        hooked = nearest.join(pointed, "node", "left")
        label = F.when((F.col("near") < F.col("node")) | F.col("pointed").isNull(), F.col("near")).otherwise(F.col("node"))
        step = _followed(staged(hooked.select("node", label.alias("label")), "pointers"))
        if found is None:
            found = step
        else:
            onward = found.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
            found = staged(onward.select("node", F.coalesce("further", "label").alias("label")), "found")
        half = staged(edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").select("la", "b"), "half-edges")
        full = half.join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where(F.col("la") != F.col("lb"))
        edges = staged(full.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    if found is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(least, "label").select("node", "component")


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id reachable over links of 3 bits or fewer.

    Null or empty text has fingerprint 0 and links like any other. Rows without doc_id get a
    null component and link nothing. Repeated rows share a component. Texts have no length
    limit; an empty table gives an empty result. Ids are of any type that has an order. Other
    columns are left out, so clashing names do no harm.
    """
    prints = staged(fingerprints(docs, words_each), "fingerprints")
    # Fingerprints are the nodes, so that ids may be of any type that has an order.
    least = staged(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")), "least-ids")
    labels = staged(components(link_edges(least.select("fp", F.col("fp").alias("rep")))), "components")
    rooted = least.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    rooted = staged(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = staged(rooted.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "classes")
    joined = prints.join(named, F.col("fp") == F.col("_fp"), "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
