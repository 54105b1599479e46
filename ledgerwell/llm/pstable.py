"""Embedding near-dedup by p-stable hashing (Datar et al., 2004).

Vectors are scaled to length one and projected on random normal directions; the projections of
one table, shifted and divided by ``WIDTH``, are rounded down and together name the vector's
bucket there. Vectors that share a bucket in some table are compared by the exact cosine.

Equal vectors are one node with a count. Only bucket names are grouped first; vectors travel only
to buckets that hold at least two. A bucket beyond ``BLOCK`` is cut into blocks and each pair of
blocks is compared by itself, so a full bucket is many tasks and nothing is capped. A pair is
counted in the first table where it meets, so no pair has to leave its task: each vector
contributes its number of links there and one link for the components.

At cosine 0.95 a pair meets in some table with probability 0.99, at 0.975 with more than 0.999;
two unrelated vectors of 64 dimensions meet in one table with probability 2e-5.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot
from ..plans.streamed import shuffle_width
from .components import components

COSINE = 0.95
TABLES = 32
HASHES = 12
WIDTH = 1.6
BLOCK = 1024
SEED = 20_240_117


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors):
    """Rows scaled to length one in double precision, by the largest component first."""
    import numpy as np
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column):
    """Rows of equal length as an array."""
    import numpy as np
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _hash_task(tables: int, hashes: int, width: float):
    def run(batches):
        import numpy as np
        made = {}

        def functions(dim):
            if dim not in made:
                rng = np.random.default_rng((SEED, dim))
                made[dim] = (rng.standard_normal((dim, tables * hashes)), rng.random(tables * hashes) * width,
                             rng.integers(1 << 62, size=hashes, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            return made[dim]

        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == dim))
                directions, shift, mix = functions(dim)
                cells = np.floor((_unit(_matrix(rows.column(1))) @ directions + shift) / width).astype(np.int64).astype(np.uint64)
                names = (cells.reshape(-1, tables, hashes) * mix).sum(axis=2, dtype=np.uint64) ^ np.uint64(dim)
                flat = pa.array(names.astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), lists],
                                                 names=["node", "vector", "copies", "buckets"])
    return run


def _roots(n: int, i, j):
    """Smallest index that each of n points reaches over the links i-j."""
    import numpy as np
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(rows: pa.Table, cosine: float):
    """Links among the rows of one block, or across a pair of blocks."""
    import numpy as np
    table, block, other = (rows.column(c)[0].as_py() for c in ("table", "i", "j"))
    x = _unit(_matrix(rows.column("vector").combine_chunks()))
    names = _matrix(rows.column("buckets").combine_chunks())
    copies = rows.column("copies").to_numpy()
    if block == other:
        i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    else:
        side = rows.column("side").to_numpy()
        left, right = np.flatnonzero(side == block), np.flatnonzero(side == other)
        i, j = np.nonzero(x[left] @ x[right].T >= cosine)
        i, j = left[i], right[j]
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= names[i, t] != names[j, t]
    i, j = i[fresh], j[fresh]
    n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
    at = np.flatnonzero(n)
    nodes = rows.column("node").to_pylist()
    root = _roots(len(x), i, j)
    return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in at], pa.string()), pa.array([nodes[root[k]] for k in at], pa.string()),
                                       pa.array(n[at].astype(np.int64))], names=["a", "b", "n"])


def _compare_task(cosine: float):
    def run(batches):
        import numpy as np
        held = None
        for batch in batches:  # sorted by (table, bucket, i, j)
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            if not rows.num_rows:
                continue
            keys = [rows.column(c).to_numpy() for c in ("table", "bucket", "i", "j")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = [0, *edge.tolist()]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                yield _compare(rows.slice(lo, hi - lo), cosine)
            held = rows.slice(bounds[-1])
        if held is not None:
            yield _compare(held, cosine)
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``), one row per input row.

    ``n_links`` counts the other rows linked directly, equal vectors included; ``component_id`` is
    the smallest id reachable, the row's own included; ``kept`` marks the row that has that id.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, and neither do vectors of different lengths. Rows with a null id count as others but
    name no component; ids that repeat stay separate rows; an empty table gives an empty table."""
    both = F.concat(F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector")))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
                   .select("id", "vector", F.when(usable("vector"), F.concat(both, F.lit("-"), F.size("vector"))).alias("node")))
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least"))
    kind = nodes.schema["vector"].dataType.simpleString()
    least = snapshot(nodes.select("node", "least", "copies"), "vector-nodes")
    hashed = snapshot(nodes.select("node", "vector", "copies").mapInArrow(
        _hash_task(tables, hashes, width), f"node string, vector {kind}, copies long, buckets array<long>"), "vector-buckets")
    places = hashed.select("node", F.posexplode("buckets").alias("table", "bucket"))
    crowded = (places.groupBy("table", "bucket").count().filter("count > 1")
                     .select("table", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = (places.join(crowded, ["table", "bucket"]).withColumn("side", side)
                    .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("node", "table", "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side"))
    key = ["table", "bucket", "i", "j"]
    met = (spread.join(hashed, "node").repartition(shuffle_width(hashed), *key).sortWithinPartitions(*key)
                 .mapInArrow(_compare_task(cosine), "a string, b string, n long"))
    found = snapshot(met, "vector-links")
    totals = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    rooted = components(found.select("a", "b"), "vector-components")
    named = (least.join(totals, "node", "left").join(rooted, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (rows.select("id", "node").join(named, "node", "left")
                .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
                .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links,
       coalesce(m.root, e.vec_id) AS component_id, coalesce(m.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = e.vec_id
"""
