"""N-gram Jaccard join: size-banded tiles with bitmap signatures and exact sorted-array intersection."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slice, commonest, few, small_batches, spare_name, staged

_WORDS = 8  # 64-bit words of a bitmap


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_LONG = 64  # bytes of the longest word that is hashed by table
_INSIDE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: A fixed value for each byte at each place in a word.
_TABLE = _mix(_mix(np.arange(1, 256 * _LONG + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _block_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" %b " % text, np.uint8)
    inside = _INSIDE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    if lengths.max() > _LONG:
        np.minimum(place, _LONG - 1, out=place)
    h = _mix(np.add.reduceat(_TABLE[place * 256 + b[inside]], first))
    for i in np.flatnonzero(lengths > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + lengths[i]])
    return h


def word_hashes(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased text, computed over blocks that end between words.

    A word of at most 64 bytes has the sum of fixed random values, one for each byte and place; a
    longer one its xxh3 hash.
    """
    parts, at = [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + block)
        end = cut.start() if cut else len(text)
        parts.append(_block_hashes(text[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased.

    Fewer than k words make one shingle; a text without words has an empty set.
    """
    h = word_hashes((text or b"").lower())
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += h[j : j + n] * (_mix(np.full(1, j + 1, np.uint64)) | np.uint64(1))
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity signature: each shingle flips one of 512 bits.

    Bits that differ between two signatures count at most the shingles that only one of both has.
    """
    counts = np.bincount((s & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view("<i8")


def wide_bitmap(s: np.ndarray) -> np.ndarray:
    """A parity signature of 4096 bits (of other hash bits), for pairs of long texts that 512 bits can't tell apart."""
    counts = np.bincount(((s >> np.uint64(20)) & np.uint64(4095)).astype(np.int64), minlength=4096) & 1
    return np.packbits(counts.astype(np.uint8))


def prefix(s: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which two linked sets share one at least: the first n - ceil(t n) + 1 in one fixed order, common ones last."""
    n = len(s) - (-(-percent * len(s) // 100)) + 1
    if len(heavy):
        own = buckets(s)
        at = np.searchsorted(heavy["bucket"], own)
        at[at == len(heavy)] = 0
        common = heavy["bucket"][at] == own
        light = s[~common]
        if len(light) < n:  # common ones are sorted only if they are needed
            s, level = s[common], heavy["level"][at[common]]
            light = np.concatenate([light, s[np.lexsort((s, level))]])
        s = light
    return s[:n]


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (a hash of the text) and text: a row is known by its id and its text."""
    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))


#: How many hash buckets shingles are counted in, to put common ones last.
_BUCKETS = 1 << 23


def buckets(s: np.ndarray) -> np.ndarray:
    return s >> np.uint64(64 - 23)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, h, n, node (hash of its set; null if empty) and its bitmap; besides, rows (bucket, hits) of shingles common in a task.

    A task counts its shingles by bucket, in a table of fixed size, and tells those well above the mean.
    """
    schema = "doc_id bigint, h bigint, n bigint, node bigint, bits array<bigint>, bucket bigint, hits bigint"
    arrow = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.list_(pa.int64())), ("bucket", pa.int64()), ("hits", pa.int64())])

    def run(batches):
        counts = np.zeros(_BUCKETS, np.uint32)

        def make(batch):
            rows = []
            for d, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                s = shingle_set(t, k)
                np.add.at(counts, buckets(s).astype(np.intp), 1)
                rows.append({"doc_id": d, "h": h, "n": len(s)} | ({"node": node_of(s), "bits": bitmap(s).tolist()} if len(s) else {}))
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        yield from by_slice(make)(batches)
        often = np.flatnonzero(counts >= 4 + 4 * int(counts.sum(dtype=np.int64)) // _BUCKETS)
        for i in range(0, len(often), 100_000):
            part = often[i : i + 100_000]
            empty = [pa.nulls(len(part), f.type) for f in arrow][:5]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part), pa.array(counts[part].astype(np.int64))], schema=arrow)

    return docs.mapInArrow(run, schema)


def node_of(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def _sets(docs: DataFrame, nodes: DataFrame, k: int, of=lambda s: s) -> DataFrame:
    """nodes (node, rid, rh, ...) without rid and rh, with set: the node's sorted 64-bit array (or ``of`` it), computed from the row of that id and text."""
    schema = nodes.drop("rid", "rh").schema

    def make(batch):
        keep, sets = [], []
        for i, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            s = shingle_set(text, k)
            if len(s) and node_of(s) == node:  # else another text of the same hash
                keep.append(i)
                sets.append(of(s).tobytes())
        out = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
        return out.append_column("set", pa.array(sets, pa.binary()))

    # an id may be null
    picked = docs.join(few(nodes), F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh"))).select(*schema.names, "text")
    return picked.mapInArrow(by_slice(make), T.StructType([*schema.fields, T.StructField("set", T.BinaryType())]))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_edges(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected within a tile, each between a root and a member.

    Members are in order of size; each is compared with those whose size and differing bits leave
    100 * overlap >= percent * union possible, and that are not connected to it yet.
    """
    order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
    size = np.array([len(sets[i]) for i in order])
    bits = np.array([bitmap(sets[i]) for i in order]).view(np.uint64)
    root = np.arange(len(order))
    for i in range(1, len(order)):
        lo = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        while True:
            near = np.arange(lo, i)
            near = near[root[lo:i] != root[i]]
            if not len(near):
                break
            differ = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1).astype(np.int64)
            total = size[near] + size[i]
            overlap = (total - differ) // 2
            near = near[100 * overlap >= percent * (total - overlap)]
            hit = next((j for j in near.tolist() if _linked(sets[order[j]], sets[order[i]], percent)), None)
            if hit is None:
                break
            old, new = max(root[i], root[hit]), min(root[i], root[hit])
            root[root == old] = new
            lo = max(lo, 0)
    return [(nodes[order[r]], nodes[order[i]]) for i, r in enumerate(root.tolist()) if r != i]


def _forest(batches):
    """Of a task's edges, as many as keep what they connect connected: each node's smallest reached node and itself."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    ends = [(find(x), x) for x in list(root) if find(x) != x]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends, strict=True)], names=["a", "b"])


#: Labels (two integers each) that a join is broadcast with.
_BROADCAST_LABELS = 1_000_000


def components(nodes: DataFrame, edges: DataFrame, rows_per_task: int = 250_000) -> DataFrame:
    """node, comp (smallest node reached) by smallest labels of neighbours and pointer jumping, written each round.

    edges are read more than once, so they should be a written table.  Tasks of about rows_per_task edges first
    replace theirs by spanning stars, so that a group's pairs don't all go through the rounds.  A round has one exchange where a count shows
    that labels may be broadcast, and as many files as its rows ask for.
    """
    tasks = edges.count() // rows_per_task + 1
    stars = staged(edges.select("a", "b").coalesce(tasks).mapInArrow(_forest, "a bigint, b bigint"), "stars")
    both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both.coalesce(tasks), "edges")
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = staged(ends.select("node", F.col("node").alias("comp")).coalesce(tasks), "labels")
    n = labels.count()
    sent = F.broadcast if n <= _BROADCAST_LABELS else lambda x: x
    changed = n
    while changed:
        seen = both.join(sent(labels.select(F.col("node").alias("b"), "comp")), "b").select(F.col("a").alias("node"), "comp", F.lit(None).cast("bigint").alias("old"))
        low = labels.select("node", "comp", F.col("comp").alias("old")).unionAll(seen).groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved = low.join(sent(jump), "comp").select("node", F.least("comp", "up").alias("comp"), "old")
        moved = staged(moved.coalesce(n // rows_per_task + 1), "labels")
        changed = moved.where("comp <> old").limit(1).count()
        labels = moved.select("node", "comp")
    return nodes.select("node").join(sent(labels), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def linked_sets(docs: DataFrame, k: int = 3, percent: int = 90, tile: int = 256, heavy_rows: int = 524288, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's group: doc_id, h (hash of its text), n (size of its set), node (its set) and comp, one row per document.

    Two documents link where 100 * intersection >= percent * union of their k-word shingle sets; comp
    is equal where links reach, and null, as node, for an empty set.

    1. Each text gets a hash of its set (its node) and a 512-bit signature; equal sets become one node.
    2. Each node emits its prefix: linked sets share one of its shingles.  Common shingles come last
       (a bounded list of at most heavy_rows buckets of them only orders prefixes, so it never loses a link).
       Shingles of one node alone go.
    3. Each node goes to the tile of its commonest smallest partner, dealt in blocks of about ``tile``,
       twice if there are several; in a block, ordered by size, signatures bound overlap and sorted arrays decide.
    4. What still shares a prefix shingle but not a component is paired under the same size and
       signature bounds, and where the shingle lies in the prefixes that the pair's own sizes ask
       for, in joins that Spark may split, and decided exactly.

    Sets and shingles count as equal when their 64-bit hashes are.
    """
    spark = docs.sparkSession
    base = _docs(docs, id_col, text_col)
    found = staged(signatures(base, k), "signatures")
    rows = found.where("bucket is null").select("doc_id", "h", "n", "node", "bits")
    common = staged(found.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")), "common")
    common = commonest(common, "hits", heavy_rows).orderBy("bucket").toArrow()
    heavy = np.zeros(common.num_rows, dtype=[("bucket", "<u8"), ("level", "<i4")])
    heavy["bucket"], heavy["level"] = common.column("bucket").to_numpy(), np.floor(np.log2(np.maximum(common.column("hits").to_numpy(), 1)))
    sent = spark.sparkContext.broadcast(heavy)  # at most heavy_rows entries of 12 bytes

    def emit(batches):
        seen: set[int] = set()  # equal sets of a task emit once

        def make(batch):
            keys, nodes, at = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                if len(s) and (node := node_of(s)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    p = prefix(s, sent.value, percent)
                    keys.append(p.view(np.int64))
                    nodes.append(np.full(len(p), node))
                    at.append(np.arange(len(p), dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, at)], names=["key", "node", "at"]) if keys else None

        yield from by_slice(make)(batches)

    # written once, so that texts are cut into shingles once for the aggregation and the join
    keys = staged(base.select("text").mapInArrow(emit, "key bigint, node bigint, at int"), "keys")
    shared = staged(keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").select("key", "hub"), "shared")
    # merged at every size, so that the plan, and what it needs, is one for small and large inputs
    members = staged(keys.join(shared.hint("merge"), "key").distinct(), "members")

    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("r")
    per_node = rows.where("node is not null").groupBy("node").agg(first, F.min("n").alias("size"), F.any_value("bits").alias("bits"))
    nodes = staged(per_node.select("node", F.col("r.doc_id").alias("rid"), F.col("r.h").alias("rh"), "size", "bits"), "nodes")
    home = members.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("home"))
    # a hub goes to its own tile too, so that its members meet it
    tiles = home.unionAll(home.select(F.col("home").alias("node"), "home")).distinct()
    counts = tiles.groupBy("home").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    tiles = tiles.join(counts, "home").join(nodes.select("node", "size"), "node")
    # the hub goes to each block of its tile; a tile of several blocks is dealt twice by unrelated hashes,
    # so that what is connected within blocks of one dealing is connected across them by the other
    blocks = F.ceil(F.col("c") / tile).cast("int")
    one = F.pmod(F.xxhash64("node"), blocks).cast("int")
    two = (blocks + F.pmod(F.xxhash64(F.lit(1), "node"), blocks)).cast("int")
    own = F.when(blocks > 1, F.array(one, two)).otherwise(F.array(F.lit(0)))
    dealt = tiles.select("home", "node", F.when(F.col("node") == F.col("home"), F.sequence(F.lit(0), F.when(blocks > 1, 2 * blocks - 1).otherwise(F.lit(0)))).otherwise(own).alias("block"))
    dealt = dealt.select("home", "node", F.explode("block").alias("block"))
    wanted = staged(dealt.join(nodes.select("node", "rid", "rh"), "node"), "tiles")

    edge_schema = "a bigint, b bigint"

    def in_tiles(batches):
        def solved():
            pairs = np.array(tile_edges(list(own), list(own.values()), percent), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        own: dict[int, np.ndarray] = {}
        now = None
        for batch in batches:
            homes, blocks, nodes_here, sets = (batch.column(c).to_pylist() for c in ("home", "block", "node", "set"))
            for home, block, node, s in zip(homes, blocks, nodes_here, sets, strict=True):
                if now != (home, block):
                    if len(own) > 1:
                        yield solved()
                    own, now = {}, (home, block)
                own[node] = np.frombuffer(s, np.uint64)
        if len(own) > 1:
            yield solved()

    # many tiles are tiny: one sorted pass over a partition instead of a call for each
    tiled = _sets(base, wanted, k).repartition("home", "block").sortWithinPartitions("home", "block").mapInArrow(in_tiles, edge_schema)
    edges = staged(tiled, "tile-edges")
    # every member, also one that is alone in its tile
    labels = staged(components(members.select("node").distinct(), edges), "components")

    # what is left: members of one key in different components
    marked = members.select("key", "node", "at").join(labels, "node")
    open_keys = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = staged(marked.join(open_keys, "key").join(nodes.select("node", "size", "bits"), "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    total = F.col("x.size") + F.col("y.size")
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(1, _WORDS)), F.bit_count(F.col("x.bits")[0].bitwiseXOR(F.col("y.bits")[0])))
    fits = (100 * ((total - differ) / 2) >= percent * (total - (total - differ) / 2)) & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size"))
    # a pair's own prefixes are those that its needed overlap leaves, shorter than either's alone
    spare = total - F.expr(f"ceil({percent} * (x.size + y.size) / {100 + percent}.0D - 1e-6)")
    early = (F.col("x.at") <= spare - F.col("y.size")) & (F.col("y.at") <= spare - F.col("x.size"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & early & fits)
    pairs = staged(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    if pairs.limit(1).count():
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
        # wide signatures of half a kilobyte first, so that few pairs need their sets brought together
        ends = staged(ends.distinct().join(nodes.select("node", "rid", "rh"), "node"), "ends")
        wide = staged(_sets(base, ends, k, wide_bitmap).groupBy("node").agg(F.any_value("set").alias("set")).join(nodes.select("node", "size"), "node"), "wide")

        def may_link(batches):
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("s", "t"))
                    differ = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
                    both = batch.column("n").to_numpy() + batch.column("m").to_numpy()
                    overlap = (both - differ) // 2
                    yield batch.select(["a", "b"]).filter(pa.array(100 * overlap >= percent * (both - overlap)))

        side = lambda e, n, v: wide.select(F.col("node").alias(e), F.col("size").alias(n), F.col("set").alias(v))
        pairs = staged(pairs.join(side("a", "n", "s"), "a").join(side("b", "m", "t"), "b").select("a", "b", "n", "m", "s", "t").mapInArrow(may_link, edge_schema), "close-pairs")
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
        ends = staged(ends.distinct().join(nodes.select("node", "rid", "rh"), "node"), "close-ends")
        sets = staged(_sets(base, ends, k), "sets")

        def exact(batches):
            for batch in batches:
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                s, t = batch.column("s"), batch.column("t")
                keep = [i for i in range(len(a)) if _linked(np.frombuffer(s[i].as_py(), np.uint64), np.frombuffer(t[i].as_py(), np.uint64), percent)]
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

        sets = sets.groupBy("node").agg(F.any_value("set").alias("set"))
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
        more = full.select("a", "b", "s", "t").mapInArrow(exact, edge_schema)
        lifted = more.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        upper = components(labels.select(F.col("comp").alias("node")).distinct(), staged(lifted, "lifted"))
        labels = labels.join(upper.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp").select("node", F.col("top").alias("comp"))
    every = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    return rows.select("doc_id", "h", "n", "node").join(every, "node", "left").select("doc_id", "h", "n", "node", "comp")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, tile: int = 256, heavy_rows: int = 524288, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact near-duplicate components (see linked_sets): doc_id, n_shingles, component_id, one row per document.

    component_id is the smallest doc_id reachable by links.
    Null and empty texts have an empty set and stand alone.  A row with a null doc_id is linked as any
    other, but names a component never (null if no other row does).  Repeated ids and
    rows each give a row; of several texts under one id each has its own set.  Other columns are
    ignored.  An empty table gives no rows.
    """
    rows = staged(linked_sets(docs, k, percent, tile, heavy_rows, id_col, text_col), "linked")
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 3, percent: int = 90, tile: int = 256, heavy_rows: int = 524288, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each group that links connect (see linked_sets).

    It is the row with the smallest id, one with an id before those without; of several texts under
    that id the one with the smallest hash, and of equal rows any.  Rows are told apart by id and text,
    so a text stays though its id is that of a copy.  Null and empty texts are linked with nothing and stay.
    """
    rows = staged(linked_sets(docs, k, percent, tile, heavy_rows, id_col, text_col), "linked")
    own = rows.where("comp is not null").groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
    first = own.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("r"))
    is_first = F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h") == F.col("r.h"))
    judged = staged(own.join(first, "comp").select(F.col("doc_id").alias("rid"), F.col("h").alias("rh"), is_first.alias("stays"), "copies").where("not stays or copies > 1"), "judged")
    h = spare_name(docs, "h")
    left = docs.withColumn(h, F.xxhash64(text_col))
    judged = judged.select(*(F.col(c).alias(spare_name(docs, c)) for c in judged.columns))
    rid, rh, stays, _ = judged.columns
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(rid)) & (F.col(h) == F.col(rh))
    out = left.join(few(judged.where(~F.col(stays)).select(rid, rh)), same, "left_anti")
    repeated = judged.where(stays).select(rid, rh)
    if repeated.limit(1).count():
        repeated = few(repeated)
        out = out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates([id_col, h]))
    return out.select(*docs.columns)
