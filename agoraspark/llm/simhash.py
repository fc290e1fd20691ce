"""SimHash near-duplicates: fingerprints, and a binary-trie self-join within a Hamming distance.

Fingerprints that are equal are one row before the join. A fingerprint of 64 bits whose partner differs in r bits at
most shares one of r + 1 blocks of bits with it exactly, so each is dealt out once per block value; a block value that
holds too many rows is dealt again by the remaining bits, as long as bits are left, so no task depends on one hot value.
Within a block value the sorted rows are a binary trie: pairs of nodes are followed together from the root, differing
bits are added up, and a pair is dropped once its errors exceed the budget, or if both nodes are known to be in one
component. What leaves a task is a spanning forest of its links, at most one link a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraspark.llm.common import drop_tools, row_key, stored, unclashing
from agoraspark.llm.components import connected_components

SEED = 42
BLOCK_LIMIT = 1 << 16  # rows of one block value beyond which it is dealt again
PAIRS_AT_ONCE = 1 << 15  # node pairs that are split at a time; about four times as many wait at each of the trie's levels
ROWS_AT_ONCE = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of size words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at bytes 20 and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    begins = [0, *(gaps[: len(gaps) - size + 1] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A 64-bit number whose bits are those set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def lanes_of(hashes: np.ndarray, lanes: int) -> list[int]:
    """One 64-bit fingerprint per lane; lane 0 takes the hashes as they are, others remix them."""
    out = [majority_bits(hashes)]
    for lane in range(1, lanes):
        with np.errstate(over="ignore"):
            x = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(majority_bits(x ^ (x >> np.uint64(32))))
    return out


def fingerprints(docs: DataFrame, size: int = 3, lanes: int = 1, sets: bool = False) -> DataFrame:
    """doc_id, row (hash of the text), fp (an array of signed 64-bit lanes) for every row of docs. Null texts count as empty: all lanes zero.

    With sets also shingles, the distinct shingles of the text as the lower halves of their hashes.
    """
    names = ["doc_id", "row", "fp"] + ["shingles"] * sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tools()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part, prints, held = batch.slice(first, 1024), [], []
                for value in part.column(2):
                    hashes = shingle_hashes(value.as_py(), size)
                    prints.append(np.array(lanes_of(hashes, lanes), np.uint64).view(np.int64))
                    if sets:
                        held.append(np.unique(hashes.astype(np.uint32)).view(np.int32))
                columns = [_listed(prints), _listed(held)] if sets else [_listed(prints)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)

    schema = "doc_id long, row long, fp array<long>" + ", shingles array<int>" * sets
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs)[1].alias("row"), docs["text"].alias("text")).mapInArrow(run, schema)


def _listed(rows: list[np.ndarray]) -> pa.Array:
    """One list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


class Forest:
    """Disjoint sets over 0..n-1 with vectorised unions; keeps the links that joined sets."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.concatenate([[True], high[1:] != high[:-1]])
            root[high[first]] = low[first]
            self.links.append((a[order][first], b[order][first]))
            while True:  # shorten all paths
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def trie_links(keys: np.ndarray, starts: np.ndarray, width: int, radius: int, close: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places in keys) that span every set of keys of one group connected by a distance of radius or less.

    keys: unsigned numbers of width bits, sorted within each group; starts: where groups begin, and the end.
    close(a, b) may refuse links by other evidence.
    """
    forest = Forest(len(keys))
    a, a2 = starts[:-1], starts[1:]
    a, a2 = a[a2 - a > 1], a2[a2 - a > 1]
    # a pair of nodes: [a, a2) and [b, b2) in keys, equal for a node with itself; depth bits are behind it
    stack = [(0, a, a2, a, a2, np.zeros(len(a), np.int64))] if len(a) else []
    while stack:
        depth, a, a2, b, b2, errors = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack.append((depth, *(v[PAIRS_AT_ONCE:] for v in (a, a2, b, b2, errors))))
            a, a2, b, b2, errors = (v[:PAIRS_AT_ONCE] for v in (a, a2, b, b2, errors))
        single = ((a2 - a == 1) & (b2 - b == 1)) | (depth == width)
        if single.any():
            x, y, many = a[single], b[single], (a2 - a)[single] * (b2 - b)[single] > 1
            _link(forest, keys, x[~many], y[~many], radius, close)
            for row in np.flatnonzero(many):  # ranges of equal keys at the last level
                left, right = np.arange(a[single][row], a2[single][row]), np.arange(b[single][row], b2[single][row])
                _link_ranges(forest, keys, left, right, radius, close)
            rest = ~single
            a, a2, b, b2, errors = a[rest], a2[rest], b[rest], b2[rest], errors[rest]
        if not len(a):
            continue
        if forest.links:
            # all of both nodes in one component: nothing to add.
            known = forest.root[a] == forest.root[b]
            if known.any():
                least, most = _extremes(forest.root, a[known], a2[known])
                least2, most2 = _extremes(forest.root, b[known], b2[known])
                done = np.zeros(len(a), bool)
                done[known] = (least == most) & (least2 == most2) & (least == least2)
                a, a2, b, b2, errors = a[~done], a2[~done], b[~done], b2[~done], errors[~done]
                if not len(a):
                    continue
        bit = np.uint64(width - 1 - depth)
        mid, mid2 = _middle(keys, a, a2, bit), _middle(keys, b, b2, bit)
        same = a == b
        parts = [
            (a, mid, b, mid2, errors, np.ones(len(a), bool)),
            (mid, a2, mid2, b2, errors, np.ones(len(a), bool)),
            (a, mid, mid2, b2, errors + 1, np.ones(len(a), bool)),
            (mid, a2, b, mid2, errors + 1, ~same),
        ]
        grown = []
        for p, p2, q, q2, e, use in parts:
            keep = use & (p2 > p) & (q2 > q) & (e <= radius) & ~((p == q) & (p2 - p == 1))
            grown.append([v[keep] for v in (p, p2, q, q2, e)])
        merged = [np.concatenate(v) for v in zip(*grown, strict=True)]
        if len(merged[0]):
            stack.append((depth + 1, *merged))
    if not forest.links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(v) for v in zip(*forest.links, strict=True))
    return x, y


def _link(forest: Forest, keys: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, close: Callable | None) -> None:
    """Link those of the pairs that are near."""
    apart = (x != y) & (forest.root[x] != forest.root[y])
    x, y = x[apart], y[apart]
    near = np.bitwise_count(keys[x] ^ keys[y]) <= radius
    x, y = x[near], y[near]
    if close is not None and len(x):
        fine = close(x, y)
        x, y = x[fine], y[fine]
    forest.union(x, y)


def _link_ranges(forest: Forest, keys: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, close: Callable | None) -> None:
    """Link two ranges of equal keys: with no further test each to the first, else every pair not yet in one component."""
    if close is None:
        _link(forest, keys, np.concatenate([left, np.full(len(right), left[0])]), np.concatenate([np.full(len(left), left[0]), right]), radius, None)
        return
    for x in left:
        _link(forest, keys, np.full(len(right), x), right, radius, close)


def _middle(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the rows with a bit set begin in each range; ranges share all higher bits."""
    low, high = begin.copy(), end.copy()
    one = np.uint64(1)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        at = (low + high) >> 1
        set_ = ((keys[np.minimum(at, len(keys) - 1)] >> bit) & one).astype(bool)
        high = np.where(open_ & set_, at, high)
        low = np.where(open_ & ~set_, at + 1, low)


def _extremes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each range."""
    padded = np.append(values, values[-1])
    at = np.column_stack([begin, end]).ravel()
    return np.minimum.reduceat(padded, at)[::2], np.maximum.reduceat(padded, at)[::2]


def _deal(rows: DataFrame, width: int, radius: int) -> tuple[DataFrame, bool]:
    """Give each row (with a column key) a group for every block of its key, so that keys within radius meet in a group.

    Groups of over BLOCK_LIMIT rows are dealt again by the bits that are left. Adds the column grp; keeps the others. Also
    returns whether the bits were used up with such groups about.
    """
    names = rows.columns
    first = F.col("lane") if "lane" in names else F.lit(0)
    rows = rows.select(*names, first.cast("long").alias("grp"), F.col("key").alias("rest"))
    done, exhausted = None, False
    while width >= 2 * (radius + 1):
        size = width // (radius + 1)
        mask = (1 << size) - 1
        parts = []
        for k in range(radius + 1):
            value = F.shiftrightunsigned("rest", k * size).bitwiseAND(F.lit(mask).cast("long"))
            low = F.col("rest").bitwiseAND(F.lit((1 << k * size) - 1).cast("long"))
            high = F.shiftleft(F.shiftrightunsigned("rest", (k + 1) * size), k * size) if (k + 1) * size < 64 else F.lit(0).cast("long")
            parts.append(F.struct(F.xxhash64("grp", F.lit(width), F.lit(k), value).alias("grp"), high.bitwiseOR(low).alias("rest")))
        rows = rows.select(*names, F.explode(F.array(*parts)).alias("p")).select(*names, "p.grp", "p.rest")
        width -= size
        if width < 2 * (radius + 1):
            break
        exhausted = True
        hot = stored(rows.groupBy("grp").count().filter(F.col("count") > BLOCK_LIMIT).select("grp", F.lit(True).alias("hot")), "hot-groups")
        if hot.isEmpty():
            exhausted = False
            break
        marked = rows.join(hot, "grp", "left")
        cool = marked.filter("hot is null").drop("hot")
        done = cool if done is None else done.unionByName(cool)
        rows = marked.filter("hot").drop("hot")
    return (rows if done is None else done.unionByName(rows)).drop("rest"), exhausted


def _tiled(dealt: DataFrame) -> DataFrame:
    """Split groups of over BLOCK_LIMIT rows whose bits are used up, so that every two rows of one still meet in a group.

    A group's rows are dealt to chunks of half the limit in expectation by their ids, and every two chunks are a new group: each row
    is in as many of them as there are chunks. So no pair is left out, and no task holds more than two chunks at a time.
    """
    counts = dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_LIMIT)
    hot = stored(counts.select("grp", F.ceil(2 * F.col("n") / BLOCK_LIMIT).cast("long").alias("chunks")), "hot-keys")
    if hot.isEmpty():
        return dealt
    marked = dealt.join(hot, "grp", "left").withColumn("chunk", F.pmod("id", "chunks"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).alias("other")
    tile = F.xxhash64("grp", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return marked.select("*", other).withColumn("grp", F.when(F.col("other") < 0, F.col("grp")).otherwise(tile)).select(*dealt.columns)


def _blocks(width: int, radius: int) -> list[Column]:
    """The values of the radius + 1 blocks of key, of which those of two keys within radius share one."""
    size = width // (radius + 1)
    last = width - radius * size  # takes the bits that are left over
    value = lambda k: F.shiftrightunsigned("key", k * size).bitwiseAND(F.lit((1 << (last if k == radius else size)) - 1).cast("long"))
    return [F.struct(F.lit(k).alias("block"), value(k).alias("value")) for k in range(radius + 1)]


def _around_heavy_keys(rows: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """Take out the rows whose very key over BLOCK_LIMIT rows have, which no bits can split.

    Returns the rows that are left, and the groups in which each such key's rows meet all rows within radius of it.
    """
    counts = rows.groupBy("lane", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_LIMIT)
    heavy = stored(counts.select("lane", "key"), "heavy-keys")
    if heavy.isEmpty():
        return rows, None
    blocks = F.explode(F.array(*_blocks(width, radius))).alias("p")
    theirs = heavy.select("lane", F.col("key").alias("heavy"), blocks).select("lane", "heavy", "p.block", "p.value")
    near = rows.select("*", blocks).select(*rows.columns, "p.block", "p.value").join(theirs, ["lane", "block", "value"])
    near = near.filter(F.bit_count(F.col("key").bitwiseXOR(F.col("heavy"))) <= radius).withColumn("grp", F.xxhash64("lane", "heavy"))
    return rows.join(heavy, ["lane", "key"], "left_anti"), _tiled(near.drop("block", "value", "heavy", "lane").dropDuplicates(["id", "grp"]))


def near_links(rows: DataFrame, width: int, radius: int, max_total: int | None = None) -> DataFrame:
    """Links a, b (ids) that connect all rows whose keys differ in radius bits or less.

    rows: id (long), key (long, of width bits) and, if max_total is given, lane (int) and fp (array of longs): then only
    keys of one lane meet, and the whole of both fp may differ in max_total bits at most. Keys may repeat then; groups of
    over BLOCK_LIMIT rows that are left when all bits are dealt, and those around a key of so many rows, are met chunk by chunk. The limit never decides what is linked.
    """
    apart = None
    if max_total is not None:
        rows, apart = _around_heavy_keys(rows, width, radius)
    dealt, exhausted = _deal(rows, width, radius)
    if max_total is not None:
        dealt = dealt.drop("lane")
        if exhausted:
            dealt = _tiled(dealt)
        if apart is not None:
            dealt = dealt.unionByName(apart)
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", F.shiftrightunsigned("key", 1), F.col("key").bitwiseAND(F.lit(1).cast("long")))

    def solve(groups: np.ndarray, ids: np.ndarray, keys: np.ndarray, full: np.ndarray | None) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])

        def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.bitwise_count(full[x] ^ full[y]).sum(axis=1) <= max_total

        a, b = trie_links(keys, starts, width, radius, close if full is not None else None)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tools()
        held: list[list[np.ndarray | None]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            groups, ids = (column(c).to_numpy(zero_copy_only=False) for c in ("grp", "id"))
            keys = column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            full = None
            if max_total is not None:
                fp = column("fp")
                full = fp.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            if size >= ROWS_AT_ONCE:  # up to the last group's beginning
                cut = int(np.searchsorted(groups != held[-1][0][-1], True)) if groups[0] == held[-1][0][-1] else 0
                if cut < len(groups):
                    parts = [groups, ids, keys, full]
                    held.append([None if v is None else v[:cut] for v in parts])
                    yield solve(*_joined(held))
                    held, size = [], 0
                    groups, ids, keys, full = (None if v is None else v[cut:] for v in parts)
            held.append([groups, ids, keys, full])
            size += len(groups)
        if held:
            yield solve(*_joined(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _joined(held: list[list[np.ndarray | None]]) -> list[np.ndarray | None]:
    return [None if v[0] is None else np.concatenate(v) for v in zip(*held, strict=True)]


def components_by_fingerprint(prints: DataFrame, radius: int = 3) -> DataFrame:
    """prints: doc_id, fp (long). Returns doc_id, fp, component_id (the least doc_id reachable by links of radius or less)."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = connected_components(near_links(classes.select(F.col("fp").alias("id"), F.col("fp").alias("key")), 64, radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint and component of every document. Empty and null texts have fingerprint zero and are linked like others.

    Texts are read whole however long. Bits on which the shingles tie are not set. Repeated rows give repeated results; rows
    without doc_id are linked, but name no component while another row is in it. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    prints = stored(fingerprints(docs, size).select("doc_id", F.col("fp")[0].alias("fp")), "fingerprints")
    return components_by_fingerprint(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8  # shared shingles by all shingles of both texts
NEAR_LANES = 5
NEAR_RADIUS = 3  # of the 32 bits of half a lane
NEAR_TOTAL = 70  # of all 320 bits: 48.5 differ on average at a similarity of 0.8, with a deviation of 6.4
HOT_PARTNERS, HOT_LIMIT = 5_000, 200_000  # pairs from which a row is copied to several tasks, or more, so that at most HOT_LIMIT rows are


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the sets (id, shingles) have a Jaccard similarity of NEAR_SIMILARITY or more.

    A row b that is in many pairs is copied, so that its pairs are tested in several tasks.
    """
    many = max(HOT_PARTNERS, pairs.count() // HOT_LIMIT)
    hot = F.broadcast(pairs.groupBy("b").count().filter(F.col("count") > many).select("b", F.ceil(F.col("count") / many).cast("int").alias("copies")))
    left = pairs.join(hot, "b", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("a"), F.col("copies")), F.lit(0))).select("a", "b", F.col("copy").cast("int").alias("copy"))
    right = sets.join(hot, sets["id"] == hot["b"], "left").select("id", F.col("shingles").alias("theirs"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    rows = left.join(sets.select(F.col("id").alias("a"), "shingles"), "a").join(right.withColumnRenamed("id", "b"), ["b", "copy"])
    shared = F.size(F.array_intersect("shingles", "theirs"))
    return rows.filter(shared >= NEAR_SIMILARITY * (F.size("shingles") + F.size("theirs") - shared)).select("a", "b")


def confirmed_components(links: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root of the graph of those links (a, b) that similar() confirms.

    One link a node is tested first; of the others, which are many in large groups, only those that still join different
    components are. The components are those of all confirmed links.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "candidates")
    first = stored(links.groupBy("a").agg(F.min("b").alias("b")), "tested")
    sure = stored(similar(first, sets), "confirmed")
    roots = stored(connected_components(sure), "roots")
    rest = links.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    rest = stored(rest.filter("root_a <> root_b"), "untested")
    if rest.isEmpty():
        return roots
    more = stored(similar(rest.select("a", "b"), sets), "confirmed")
    return roots if more.isEmpty() else connected_components(sure.unionByName(more))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text) and group_id (the least doc_id of its group) by a similarity of five-word shingles of 0.8 or more.

    A fingerprint of 320 bits estimates the similarity; pairs are candidates if one of its ten parts of 32 bits differs in
    3 bits at most (found by the trie self-join), and all of it in NEAR_TOTAL bits at most. At a similarity of exactly 0.8
    that is so of 0.95 of the pairs, at 0.85 of 0.99. The candidates that connect others are confirmed by their shingles, so
    no link of a lower similarity is made. Rows of equal fingerprints are one to the join. Rows without doc_id have no group.
    """
    prints = stored(fingerprints(docs, NEAR_SHINGLE, NEAR_LANES, sets=True).filter("doc_id is not null"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = stored(classes.select(F.xxhash64("fp").alias("id"), "fp", "first"), "prints")
    parts = [F.struct(F.lit(2 * k + j).alias("lane"), F.shiftrightunsigned(F.col("fp")[k], 32 * j).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("key")) for k in range(NEAR_LANES) for j in (0, 1)]
    rows = classes.select("id", "fp", F.explode(F.array(*parts)).alias("p")).select("id", "fp", "p.lane", "p.key")
    links = stored(near_links(rows, 32, NEAR_RADIUS, NEAR_TOTAL), "near-links")
    linked = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    heads = classes.join(linked, "id", "left_semi").select("id", "first.doc_id", "first.row")
    sets = stored(prints.select("doc_id", "row", "shingles").join(heads, ["doc_id", "row"]).select("id", "shingles").dropDuplicates(["id"]), "sets")
    roots = stored(confirmed_components(links, sets), "near-roots")
    labels = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("root"), F.col("first.doc_id").alias("first_id"))
    least = labels.groupBy("root").agg(F.min("first_id").alias("group_id"))
    return prints.select("doc_id", "row", "fp").join(labels.select("fp", "root"), "fp").join(least, "root").select("doc_id", "row", "group_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs but for those whose near-duplicate group has a document of smaller doc_id; all columns as they are.

    Rows without doc_id stay, and so do rows that repeat the doc_id of the one that stays, in its group or in none. Null and
    empty texts are equal to each other and to texts without words. Repeated rows stay or go together.
    """
    extra_id, extra_row = unclashing(docs, "extra_id", "extra_row")
    extra = near_groups(docs).filter("doc_id <> group_id").select(F.col("doc_id").alias(extra_id), F.col("row").alias(extra_row)).distinct()
    _, row = row_key(docs)
    return docs.join(extra, (docs["doc_id"].cast("long") == extra[extra_id]) & (row == extra[extra_row]), "left_anti")
