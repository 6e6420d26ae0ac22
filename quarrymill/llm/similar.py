"""SimHash near-duplicates at a Jaccard similarity, for the pipeline's stage.

Links are exact: two texts are linked if the sets of their word shingles have a Jaccard
similarity of LEAST or more. SimHash only says which texts to compare. At a similarity of 0.8
about 15 of 100 SimHash bits differ, so a text gets many more than 64 bits: each of a number of
tables takes its own bits as key, and rows of one key are compared by WORDS fingerprints of
their own within RADIUS bits, bit-sliced as in ``simhash``. The tables are as many as let a
pair at the limit miss all of them once in a hundred times; nearer pairs miss far less often.

Texts of one shingle set are one node from the start. Candidates leave the tables as spanning
trees, and each node's nearest candidate is verified first, which joins most of a large group
with one comparison for each text. Families, the components of all candidates, are searched
whole where those links did not join them: their sets are dealt out in blocks, and a task
counts the common shingles of two blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, staged
from quarrymill.llm.simhash import SEED, components, count_planes, edges_of_keys, forest, over, shingle_hashes

SHINGLE_WORDS = 5
#: Two sets are similar if the common shingles are at least LEAST[0] / LEAST[1] of all.
LEAST = (4, 5)
#: Fingerprint words of 64 bits, and the bits in which candidates may differ: 19 are expected at
#: the limit, with a standard deviation of 4; sets of a few shingles spread more widely.
WORDS, RADIUS = 2, 38
#: Share of equal bits at the limit (sets of equal size: cosine 8/9), and the share of such pairs that may miss all tables.
AGREE, MISS = 1 - math.acos(8 / 9) / math.pi, 0.01
#: A part of a family has about so many sets and so many bytes of them at most.
PART_SETS, PART_BYTES = 512, 16 << 20


def table_sizes(rows: int) -> tuple[int, int]:
    """Bits of a key and number of tables: about four unrelated rows share a key, whatever the number of rows."""
    bits = max(16, math.ceil(math.log2(max(2, rows))) - 2)
    return bits, math.ceil(math.log(MISS) / math.log(1 - AGREE**bits))


def shingle_set(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; empty without words."""
    return np.unique(shingle_hashes(text, words_each))


def simhash_words(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash bits of a set, as ``words`` words of 64, each from hashes of its own."""
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # fixed values of a public 64-bit mixer
    levels: list[np.ndarray] = []
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at : at + 4096, None] + steps
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        for k, plane in enumerate(count_planes([mixed])):
            if k == len(levels):
                levels.append(plane[None])
            else:
                levels[k] = np.concatenate([levels[k], plane[None]])
    return over(count_planes(levels), len(shingles) // 2)


def table_keys(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key of each table: its number above its own bits of the words."""
    every = np.unpackbits(words.astype(">u8").view(np.uint8))[: bits * tables].reshape(tables, bits)
    return (every @ (1 << np.arange(bits, dtype=np.int64))) | np.arange(tables, dtype=np.int64) << bits


def sketches(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """doc_id, row, node, words and keys of (doc_id, row, text); the node is a hash of the shingle set, and texts without words have no keys."""
    extra = -(-bits * tables // 64)

    def sketch(shingles: np.ndarray) -> tuple[int, list[int], list[int]]:
        node = int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))
        if not len(shingles):
            return node, [0] * WORDS, []
        found = simhash_words(shingles, WORDS + extra)
        return node, found[:WORDS].view(np.int64).tolist(), table_keys(found[WORDS:], bits, tables).tolist()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sketch(shingle_set(text)) for text in batch.column(2).to_pylist()]
        nodes, words, keys = zip(*found, strict=True) if found else ((), (), ())
        lists = [pa.array(nodes, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "row", "node", "words", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, node long, words array<long>, keys array<long>"
    return rows.select("doc_id", "row", "text").mapInArrow(by_slices(work), schema)


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, words, keys) -> (a, b, apart): trees of candidate pairs in each table."""
    rows = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("rep"), *[F.col("words")[k].alias(f"w{k}") for k in range(WORDS)])
    return edges_of_keys(rows, [f"w{k}" for k in range(WORDS)], RADIUS)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """node, shingles (64-bit hashes as bytes) of (node, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingle_set(text).tobytes() for text in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(by_slices(work), "node long, shingles binary")


def enough(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with so many in common are similar."""
    return LEAST[1] * common >= LEAST[0] * (n + m - common)


def similar(a: bytes, b: bytes) -> bool:
    common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return bool(enough(common, len(a) // 8, len(b) // 8))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        keep = pa.array([similar(a, b) for a, b in zip(left, right, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    first = staged(pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a"), "half-pairs")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return staged(both.select("a", "b", "left", "right").mapInArrow(by_slices(work), "a long, b long"), "links")


def links_of_sets(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links between similar sets of different labels."""
    sizes = np.array([len(one) for one in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    first, own = np.searchsorted(shingle[order], np.arange(shingle.max() + 2)), owner[order]
    starts, found = np.concatenate(([0], np.cumsum(sizes))), []
    for row, n in enumerate(sizes.tolist()):
        mine = shingle[starts[row] : starts[row + 1]]
        spans, counts = first[mine], first[mine + 1] - first[mine]
        places = np.repeat(spans - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        common = np.bincount(own[places], minlength=len(sets))
        near = np.flatnonzero((labels != labels[row]) & (np.arange(len(sets)) > row) & enough(common, n, sizes))
        found += [(row, int(other)) for other in near]
    return forest(found)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (family, i, j, node, label, shingles) rows -> links (a, b); holds one (family, i, j) at a time."""
    at, held = None, []

    def links() -> pa.RecordBatch:
        nodes = np.array([node for node, _, _ in held], np.int64)
        labels = np.array([label for _, label, _ in held], np.int64)
        found = links_of_sets([np.frombuffer(raw, np.uint64) for _, _, raw in held], labels) if len(set(labels.tolist())) > 1 else []
        ends = np.sort(nodes[np.array(found, np.int64).reshape(-1, 2)], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        for key, *values in zip(keys, *(batch.column(k).to_pylist() for k in range(3, 6)), strict=True):
            if key != at:
                if held:
                    yield links()
                at, held = key, []
            held.append(tuple(values))
    if held:
        yield links()


def links_in_families(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, family, label) -> links (a, b) that connect what is similar in a family and differs in label.

    Every two sets of a family meet in some task, unless their parts hold one label only. A
    family of n parts thus sends each set to n tasks.
    """
    labels = families.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    unjoined = staged(families.join(labels.where("low <> high").select("family"), "family"), "open-families")
    full = staged(unjoined.join(sets, "node").select("family", "node", "label", "shingles"), "open-sets")
    sizes = full.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / PART_SETS, F.col("bytes") / PART_BYTES)).cast("int").alias("parts")
    dealt = full.join(staged(sizes.select("family", parts), "family-parts"), "family")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label", "shingles")
    ordered = grouped.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return staged(ordered.mapInArrow(_block_links, "a long, b long").distinct(), "family-links")


def _named(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the component of each under ``name``; a node without an edge is its own."""
    found = components(edges).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return nodes.join(found, F.col("node") == F.col("_node"), "left").withColumn(name, F.coalesce("_component", "node")).drop("_node", "_component")


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of each whole row, which tells rows of one doc_id apart."""
    return docs.withColumn("_similar_row", F.xxhash64(*[docs[c] for c in docs.columns]))


def _nearest(end: str, other: str) -> Column:
    return F.min_by(F.struct(F.least(end, other).alias("a"), F.greatest(end, other).alias("b")), F.struct("apart", other))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row and component of every row with a doc_id; rows linked over similarities of LEAST or more share a component."""
    rows = with_row(docs.where(F.col("doc_id").isNotNull())).select("doc_id", F.col("_similar_row").alias("row"), "text")
    found = staged(sketches(rows, *table_sizes(docs.count())), "sketches")
    first = found.groupBy("node").agg(F.first("words").alias("words"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "row")).alias("at"))
    nodes = staged(first, "nodes")
    pairs = staged(candidates(nodes), "candidates")

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = staged(both.groupBy("a").agg(_nearest("a", "b").alias("pair")).select("pair.a", "pair.b").distinct(), "nearest-pairs")
    members = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "members")
    wanted = staged(nodes.join(members, "node", "left_semi").select("node", "at.doc_id", "at.row"), "compared")
    texts = rows.join(wanted.hint("shuffle_hash"), ["doc_id", "row"])  # the same join at every size, without sorting texts
    sets = staged(shingle_sets(texts).dropDuplicates(["node"]), "shingle-sets")  # wholly equal rows give a node twice
    near = verified(nearest, sets)
    families = staged(_named(_named(members, pairs, "family"), near, "label"), "families")
    links = near.unionByName(links_in_families(families, sets))
    return _named(found.select("doc_id", "row", "node"), links, "component").drop("node")


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, then of the smallest row hash.

    Texts without words are near-duplicates of each other. Rows of one doc_id with texts that are
    not linked both stay; rows without doc_id stay. Null text counts as empty. Texts have no
    length limit; an empty table gives an empty result.
    """
    kept = similar_groups(docs).groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("at"))
    kept = staged(kept.select(F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("_similar_row")), "kept-rows")
    one = with_row(docs.where(F.col("doc_id").isNotNull())).join(kept.hint("shuffle_hash"), ["doc_id", "_similar_row"], "left_semi")
    one = one.dropDuplicates(["doc_id", "_similar_row"]).select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
