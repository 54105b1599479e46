"""SimHash fingerprints and their links within a small Hamming radius, found in BK-trees.

Shards. Two 64-bit fingerprints that differ in at most two bits agree in two of four 16-bit
bands, so a fingerprint joins six shards, one per pair of bands, and every link lies inside a
shard. A shard too full for one tree is cut on: among its free bits, cut in three, at least one
part agrees as well. After three such cuts at most ten bits are free, which is 1,024 different
fingerprints: every tree has a proven bound and no fingerprint is left out.

Trees. The shard's fingerprints form a BK-tree (children keyed by the Hamming distance to their
parent); each is looked up by following only the edges within the radius, then inserted. The
tree meets its queries by the shard key rather than by broadcast: all trees together grow with
the corpus. Only one link per fingerprint and shard leaves the task, enough for components.
"""
from __future__ import annotations

import math
import random
from itertools import combinations
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot
from ..plans.streamed import shuffle_width
from .components import components

RADIUS = 2
TREE_NODES = 1024
BLOCK_WORDS = 1 << 18
_ALL = (1 << 64) - 1
plain = methodcaller("as_py")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shingle_blocks(text, n_words: int):
    """The shingles of a text as byte strings, block by block."""
    import numpy as np
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    n = max(1, len(words) - n_words + 1) if words else 0
    for at in range(0, n, BLOCK_WORDS):
        some = words[at:min(at + BLOCK_WORDS, n) + n_words - 1]
        flat = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = [0, *(ends[:max(0, len(some) - n_words)] + 1).tolist()]
        yield [flat[s:e] for s, e in zip(starts, ends[min(n_words, len(some)) - 1:].tolist())]


def _votes(text, n_words: int, digest, n_bits: int) -> int:
    """The bits set in more than half of the shingles' digests."""
    import numpy as np
    votes, n = np.zeros(n_bits, np.int64), 0
    for shingles in _shingle_blocks(text, n_words):
        bits = np.frombuffer(b"".join(map(digest, shingles)), np.uint8).reshape(len(shingles), n_bits // 8)
        votes += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        n += len(shingles)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big") if n else 0


def _fingerprint(text, n_words: int) -> int:
    from xxhash import xxh64_digest
    return _votes(text, n_words, lambda x: xxh64_digest(x, 42), 64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3) -> DataFrame:
    """(id, ``fp`` long): the 64-bit SimHash of the whole text over shingles of ``n_words``
    words, repeats included; words are cut at ASCII white space with A-Z lowered. A text of
    fewer words is one shingle; a null text or one without words has fingerprint 0."""
    def run(batches):
        for b in batches:
            got = [_signed(_fingerprint(t, n_words)) for t in map(plain, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], names=[id_col, "fp"])
    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _band(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) & ~((1 << lo) - 1)


def _cut(mask: int) -> list[int]:
    """The mask widened by each third of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    size = -(-len(free) // 3)
    return [mask | sum(1 << i for i in free[k:k + size]) for k in range(0, len(free), size)]


def _linked(keys, fps, radius: int):
    """Fingerprints linked inside each run of equal keys, one link to the run's root each."""
    import numpy as np
    edge = np.flatnonzero(np.diff(keys)) + 1
    for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(keys)].tolist()):
        if hi - lo > 1:
            yield from tree_links([x & _ALL for x in fps[lo:hi].tolist()], radius)


def tree_links(fps: list[int], radius: int):
    """Build one BK-tree and link each new fingerprint to those already there within the
    radius; yields (fingerprint, root of its group) for all but the roots."""
    parent = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    top, children = fps[0], {fps[0]: {}}
    parent[top] = top
    for x in fps[1:]:
        if x in children:
            continue
        found, todo = [], [top]
        while todo:
            node = todo.pop()
            d = (node ^ x).bit_count()
            if d <= radius:
                found.append(node)
            kids = children[node]
            if kids:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        node = top
        while True:
            d = (node ^ x).bit_count()
            if d not in children[node]:
                children[node][d] = x
                children[x] = {}
                break
            node = children[node][d]
        parent[x] = x
        for y in found:
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)
    for x in fps:
        if parent[x] != x:
            yield _signed(x), _signed(root(x))


def _tree_task(radius: int):
    def run(batches):
        import numpy as np
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(k, f):
            pairs = list(_linked(k, f, radius))
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:  # sorted by key: only the last run is carried on
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy()))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)
    return run


def links(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``radius`` bits: each component of
    the full link graph is a component of these. ``radius`` is at most 2."""
    if not 0 <= radius <= 2:
        raise ValueError("the shards are exact for a radius of at most 2 bits")
    bands = [_band(16 * i, 16 * i + 16) for i in range(4)]
    masks = [(0, a | b) for a, b in combinations(bands, 2)]
    rows, ready = distinct_fps.select("fp", F.lit(0).alias("cut")), []
    for level in range(4):
        every = F.array(*[F.struct(F.lit(of).alias("of"), F.lit(i).alias("id"), F.lit(_signed(m)).alias("mask"))
                          for i, (of, m) in enumerate(masks)])
        rows = (rows.withColumn("s", F.explode(F.filter(every, lambda s: s["of"] == F.col("cut"))))
                    .select("fp", F.col("s.id").alias("cut"),
                            F.xxhash64(F.lit(level), "s.id", F.col("fp").bitwiseAND(F.col("s.mask"))).alias("shard")))
        if level == 3:
            ready.append(rows.select("shard", "fp"))
            break
        full = rows.groupBy("shard").count().filter(F.col("count") > TREE_NODES).select("shard")
        ready.append(rows.join(full, "shard", "left_anti").select("shard", "fp"))
        rows = rows.join(full, "shard", "left_semi").select("fp", "cut")
        masks = [(i, m) for i, (_, mask) in enumerate(masks) for m in _cut(mask)]
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return (out.repartition(shuffle_width(out), "shard").sortWithinPartitions("shard", "fp")
               .mapInArrow(_tree_task(radius), "a long, b long").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3,
                radius: int = RADIUS) -> DataFrame:
    """(id, ``fp``, ``component_id``): one row per input row. Fingerprints within ``radius`` bits
    link, zero included; ``component_id`` is the smallest id reachable, the row's own included.
    Equal texts share a fingerprint and are one node, however many there are; null ids keep
    their row and never name a component unless all its ids are null; an empty table gives an
    empty table. Other columns are not read."""
    fps = snapshot(fingerprints(docs, id_col, text_col, n_words), "simhash")
    nodes = snapshot(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    rooted = components(links(nodes.select("fp"), radius), "simhash-links")
    named = nodes.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# --- Similarity 0.8 and more: wide radius, sampled shards, checked links -----------------------

SIMILARITY, SHINGLE_WORDS = 0.8, 5
#: Shingle sets of similarity 0.8 differ in some 15 % of the fingerprint's 128 bits; the radius
#: is over two and a half deviations above that.
WIDE_RADIUS = 30
MISSED = 0.02
BIT_DIFFERS = 0.145
#: A node carries for each of so many shares of its shingles whether their number is odd.
PARITY_BITS = 512
PAIRS_AT_ONCE = 1 << 18


def sampling(n: int) -> tuple[int, int]:
    """Bits sampled per shard name and number of samples for n fingerprints: shards of unrelated
    fingerprints keep their size as n grows, and a pair that differs in ``BIT_DIFFERS`` of its
    bits shares a shard in at least one sample with probability 1 - ``MISSED``."""
    bits = max(16, n.bit_length() - 2)
    return bits, math.ceil(-math.log(MISSED) / (1 - BIT_DIFFERS) ** bits)


def _different(text, n_words: int):
    """128-bit digests of the different shingles of a text as rows of two words, by the first word."""
    import numpy as np
    from xxhash import xxh3_128_digest
    got = [np.frombuffer(b"".join(map(xxh3_128_digest, block)), np.uint64) for block in _shingle_blocks(text, n_words)]
    every = np.concatenate(got).reshape(-1, 2) if got else np.empty((0, 2), np.uint64)
    return every[np.unique(every[:, 0], return_index=True)[1]]


def _wide(shingles) -> int:
    """The bits set in more than half of the different shingles' digests."""
    import numpy as np
    votes = np.zeros(128, np.int64)
    for at in range(0, len(shingles), BLOCK_WORDS):
        some = np.ascontiguousarray(shingles[at:at + BLOCK_WORDS]).view(np.uint8)
        votes += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(shingles)).tobytes(), "big") if len(shingles) else 0


def _wide_task(n_words: int):
    def run(batches):
        import numpy as np
        from xxhash import xxh3_64_intdigest
        for b in batches:
            rows = []
            for text in map(plain, b.column(1)):
                own = _different(text, n_words)
                fp, names = _wide(own), np.ascontiguousarray(own[:, 0])
                odd = np.packbits(np.bincount((names % PARITY_BITS).astype(np.int64), minlength=PARITY_BITS) & 1)
                rows.append((_signed(fp >> 64), _signed(fp & _ALL), _signed(xxh3_64_intdigest(names.tobytes())), len(names), odd.tobytes()))
            kinds = zip(("x", "y", "z", "size", "odd"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))
            cols = {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)}
            yield pa.RecordBatch.from_arrays([b.column(0), *cols.values()], names=["row", *cols])
    return run


def _set_task(n_words: int):
    def run(batches):
        import numpy as np
        from xxhash import xxh64_intdigest
        for b in batches:
            sets = [np.unique(np.array([xxh64_intdigest(w) for block in _shingle_blocks(t, n_words) for w in block], np.uint64)).view(np.int64)
                    for t in map(plain, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
    return run


def spanning_links(fps: list[int], radius: int):
    """Links (later, earlier, distance) that span the groups of one BK-tree, the nearest of each
    group for every new fingerprint."""
    parent = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    top, children = fps[0], {fps[0]: {}}
    parent[top] = top
    for x in fps[1:]:
        if x in children:
            continue
        found, todo, node = [], [top], top
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append((d, at))
            kids = children[at]
            if kids:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
        while True:
            d = (node ^ x).bit_count()
            if d not in children[node]:
                children[node][d] = x
                children[x] = {}
                break
            node = children[node][d]
        parent[x] = x
        for d, y in sorted(found):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield x, y, d


def _name(fp: int, z: int) -> str:
    return f"{fp:032x}{z & _ALL:016x}"


def _shard_links(x, y, z, radius: int):
    """Links (a, b, distance) of one shard in the order of x, y and z. Nodes of one fingerprint
    link to the first of them, which stands for it in the tree."""
    first, last = {}, None
    for p, q, r in zip(x.tolist(), y.tolist(), z.tolist()):
        fp = (p & _ALL) << 64 | q & _ALL
        if first.setdefault(fp, r) != r and (fp, r) != last:
            yield _name(fp, r), _name(fp, first[fp]), 0
        last = fp, r
    for a, b, d in spanning_links(list(first), radius):
        yield _name(a, first[a]), _name(b, first[b]), d


def _sampled_tree_task(radius: int):
    def run(batches):
        import numpy as np
        held = None

        def out(shards, *cols):
            edge = np.flatnonzero(np.diff(shards)) + 1
            lo, hi = np.r_[0, edge], np.r_[edge, len(shards)]
            links = []
            for i, j in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist()):
                links += _shard_links(*(c[i:j] for c in cols), radius)
            names = [pa.array([link[k] for link in links], pa.string()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*names, pa.array([link[2] for link in links], pa.int32())], names=["a", "b", "d"])

        for batch in batches:  # sorted by shard: only the last shard is carried on
            new = [c.to_numpy() for c in batch.columns]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield out(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield out(*held)
    return run


def _sampled(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes once for each sample, with the ``shard`` they fall into."""
    bits, samples = sampling(n)
    draw = random.Random(20_240_607)
    masks = [sum(1 << i for i in draw.sample(range(128), bits)) for _ in range(samples)]
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m >> 64)).alias("x"), F.lit(_signed(m & _ALL)).alias("y")) for i, m in enumerate(masks)])
    shard = F.xxhash64("m.i", F.col("x").bitwiseAND(F.col("m.x")), F.col("y").bitwiseAND(F.col("m.y")))
    return nodes.withColumn("m", F.explode(every)).select(shard.alias("shard"), *nodes.columns)


def _full(nodes: DataFrame, n: int) -> DataFrame:
    """The shards of more than ``TREE_NODES`` nodes, their numbers of blocks and least nodes."""
    shards = _sampled(nodes.select("x", "y", "z"), n).groupBy("shard").agg(F.count("*").alias("n"), F.min(F.struct("x", "y", "z")).alias("least"))
    return shards.filter(F.col("n") > TREE_NODES).select("shard", F.ceil(F.col("n") / (TREE_NODES - 1)).cast("int").alias("blocks"), "least")


def _candidates(nodes: DataFrame, n: int, radius: int, full: DataFrame | None = None) -> DataFrame:
    """Links (a, b, d) between nodes that share a sampled shard and lie within the radius.

    A shard of more than ``TREE_NODES`` is cut into blocks; its smallest fingerprint is planted
    in every block, so that a group cut apart still meets in one node."""
    full = _full(nodes, n) if full is None else full
    rows = _sampled(nodes.select("x", "y", "z"), n)
    usual = rows.join(full, "shard", "left_anti")
    block = F.pmod(F.xxhash64("x", "y", "shard"), F.col("blocks"))
    cut = rows.join(full, "shard").select(F.xxhash64("shard", block).alias("shard"), "x", "y", "z")
    pivots = full.select(F.col("shard").alias("of"), "least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    pivots = pivots.select(F.xxhash64("of", F.col("k").cast("long")).alias("shard"), "least.x", "least.y", "least.z")
    trees = usual.unionByName(cut).unionByName(pivots)
    return (trees.repartition(shuffle_width(nodes), "shard").sortWithinPartitions("shard", "x", "y", "z")
                 .mapInArrow(_sampled_tree_task(radius), "a string, b string, d int").groupBy("a", "b").agg(F.min("d").alias("d")))


def _apart(x, y, group, size, odd, side, radius: int, similarity: float):
    """Index pairs of one shard within the radius whose ends are of different groups and may have
    the similarity: the sizes allow it, and the shares whose parity differs, each of which holds a
    shingle of one text alone, are not too many. Side 0 meets side 1; side 2 meets itself."""
    import numpy as np
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        own = left[at:at + step, None]
        keep = np.bitwise_count(x[own] ^ x[right]) + np.bitwise_count(y[own] ^ y[right]) <= radius
        keep &= (group[own] != group[right]) & ((side[own] != 2) | (own < right))
        i, j = np.nonzero(keep)
        i, j = own[i, 0], right[j]
        near = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
        i, j = i[near], j[near]
        alone = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
        near = alone <= (size[i] + size[j]) * (1 - similarity) / (1 + similarity) + 1e-6
        yield i[near], j[near]


def _apart_task(radius: int, similarity: float):
    def run(batches):
        import numpy as np
        held = None

        def out(cols):
            shards, x, y, z, group, size, odd, side = cols
            edge = np.flatnonzero(np.diff(shards)) + 1
            for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(shards)].tolist()):
                if hi - lo < 2 or (group[lo:hi] == group[lo]).all():
                    continue
                some = (c[lo:hi] for c in (x, y, group, size, odd, side))
                for i, j in _apart(*some, radius, similarity):
                    if len(i):
                        names = [pa.array([f"{p:016x}{q:016x}{r:016x}" for p, q, r in zip(x[k].tolist(), y[k].tolist(), z[k].view(np.uint64).tolist())], pa.string())
                                 for k in (lo + i, lo + j)]
                        yield pa.RecordBatch.from_arrays(names, names=["a", "b"])

        for batch in batches:  # sorted by shard: only the last shard is carried on
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new[1], new[2] = new[1].view(np.uint64), new[2].view(np.uint64)
            new[6] = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from out([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None:
            yield from out(held)
    return run


def _block_pairs(rows: DataFrame) -> DataFrame:
    """The rows of full shards once for each pair of blocks of at most half ``TREE_NODES`` or so
    that they take part in, with the pair as their shard. A group that fills a block alone has
    blocks of its own, which need not meet each other."""
    half = max(1, TREE_NODES // 2)
    groups = rows.groupBy("shard", "group").agg(F.count("*").alias("c"))
    large = groups.filter(F.col("c") > half).select("shard", "group", F.ceil(F.col("c") / half).alias("own"))
    small = groups.filter(F.col("c") <= half).groupBy("shard").agg(F.ceil(F.sum("c") / half).alias("blocks"))
    large, small = snapshot(large, "simhash-large-groups"), snapshot(small, "simhash-small-groups")
    blocks = (large.select("shard", F.col("group").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("k"))
                   .unionByName(small.select("shard", F.lit(None).cast("long").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))))
    blocks = blocks.select("shard", F.xxhash64("of", "k").alias("block"), "of")
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = (F.col("a.block") < F.col("b.block")) & ~F.coalesce(F.col("a.of") == F.col("b.of"), F.lit(False))
    alone = (F.col("a.block") == F.col("b.block")) & F.col("a.of").isNull()
    pairs = a.join(b, (F.col("a.shard") == F.col("b.shard")) & (meet | alone)).select(
        F.col("a.shard").alias("shard"), F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    ends = pairs.select("shard", F.xxhash64("shard", "one", "two").alias("pair"), F.explode(F.when(F.col("one") == F.col("two"), F.array(
        F.struct(F.col("one").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(
            F.struct(F.col("one").alias("block"), F.lit(0).alias("side")), F.struct(F.col("two").alias("block"), F.lit(1).alias("side"))))).alias("e"))
    ends = ends.select("shard", "pair", "e.block", "e.side")
    dealt = F.xxhash64("x", "y", "z")
    placed = (rows.join(large, ["shard", "group"], "left").join(small, "shard", "left")
                  .withColumn("of", F.when(F.col("own").isNotNull(), F.col("group")))
                  .withColumn("k", F.pmod(dealt, F.coalesce("own", "blocks"))).withColumn("block", F.xxhash64("of", "k")))
    return placed.join(ends, ["shard", "block"]).select(F.col("pair").alias("shard"), *[c for c in rows.columns if c != "shard"], "side")


def _still_apart(nodes: DataFrame, touched: DataFrame, full: DataFrame, n: int, radius: int, similarity: float) -> DataFrame:
    """All pairs (a, b) of a shard within the radius whose ends are of different checked groups
    and may have the similarity. ``nodes`` have a ``root``.

    A pair of a usual shard that no tree link joins truly has a failed link at the group of either
    end, so only the nodes of such ``touched`` groups come. In full shards, whose trees see blocks,
    all nodes come, and every block meets every other."""
    cols = ["x", "y", "z", F.xxhash64("root").alias("group"), "size", "odd"]
    rows = _sampled(nodes.join(touched, "root", "left_semi").select(*cols), n).join(full, "shard", "left_anti").withColumn("side", F.lit(2))
    if not full.isEmpty():
        rows = rows.unionByName(_block_pairs(_sampled(nodes.select(*cols), n).join(full.select("shard"), "shard")))
    return (rows.repartition(shuffle_width(nodes), "shard").sortWithinPartitions("shard")
                .mapInArrow(_apart_task(radius, similarity), "a string, b string").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _checked(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose shingle sets have the Jaccard similarity."""
    both = (links.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b"))
    common = F.size(F.array_intersect("s", "t"))
    return both.filter(common >= F.lit(similarity) * (F.size("s") + F.size("t") - common)).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS,
                   similarity: float = SIMILARITY, radius: int = WIDE_RADIUS) -> DataFrame:
    """(id, ``component_id``), one row per input row: groups of texts linked by a Jaccard
    similarity of at least ``similarity`` between their sets of ``n_words``-word shingles.

    Candidates are 128-bit SimHash fingerprints within ``radius`` bits, met in BK-trees over
    shards named by sampled bits (see ``sampling``); each link is checked exactly on whole texts.
    Where a tree's link fails the check, all pairs between groups still apart are checked as well.
    The bits are voted by different shingles, as the sets are, and texts are one node if their
    shingle sets are the same; others of one fingerprint are checked like any pair. ``component_id`` is the smallest id reachable. Null texts and texts without words form
    one group; null ids come first; an empty table gives an empty table."""
    src = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    fps = snapshot(src.mapInArrow(_wide_task(n_words), f"row {kind}, x long, y long, z long, size long, odd binary"), "simhash-wide")
    name = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("x", "y", "z")]))
    nodes = snapshot(fps.groupBy("x", "y", "z").agg(F.min("row").alias("least"), F.first("size").alias("size"), F.first("odd").alias("odd")).withColumn("node", name), "simhash-wide-nodes")
    n = nodes.count()
    full = snapshot(_full(nodes, n), "simhash-full-shards")
    found = snapshot(_candidates(nodes, n, radius, full), "simhash-candidates")

    def sets_of(links, but=None):
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        ends = ends if but is None else ends.join(but, "node", "left_anti")
        chosen = nodes.join(ends, "node").select("node", F.col("least").alias("row"))
        texts = src.join(chosen, "row").select("node", "text").dropDuplicates(["node"])
        return snapshot(texts.mapInArrow(_set_task(n_words), "node string, shingles array<long>"), "simhash-shingles")

    def with_roots(links, groups):
        return (links.join(groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
                     .join(groups.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
                     .select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).filter("ra != rb"))

    sets = sets_of(found)
    # the nearest link of each node first; of the others only those between groups still apart
    nearest = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b")
    sure = snapshot(_checked(nearest, sets, similarity), "simhash-nearest")
    apart = with_roots(found, components(sure, "simhash-nearest-groups")).select("a", "b")
    sure = snapshot(sure.unionByName(_checked(apart, sets, similarity)), "simhash-checked")
    rooted = components(sure, "simhash-checked-groups")
    # the trees link groups by unchecked links: where one failed, every pair is looked at
    failed = snapshot(with_roots(found, rooted), "simhash-failed")
    touched = failed.select(F.col("ra").alias("root")).unionByName(failed.select(F.col("rb").alias("root"))).distinct()
    grouped = nodes.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    late = snapshot(_still_apart(grouped, touched, full, n, radius, similarity).join(known, ["a", "b"], "left_anti"), "simhash-late")
    if not late.isEmpty():
        more = sets_of(late, sets.select("node"))
        rooted = components(sure.unionByName(_checked(late, sets.unionByName(more), similarity)), "simhash-similar-groups")
    named = nodes.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("best"))
    got = fps.join(named.join(smallest, "root").select("x", "y", "z", "best"), ["x", "y", "z"])
    return got.select(F.col("row.id").alias(id_col), F.col("best.id").alias("component_id"))
