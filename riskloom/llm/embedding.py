"""Embedding near-duplicates: int8 tile products with proven error bounds, doubtful pairs in full.

Distinct vectors of one label are cut into blocks, and each pair of blocks is a tile. What travels to a
tile is int8: a unit vector u is s1*q1 + s2*q2 + e, where q1 holds u and q2 holds what q1 leaves, each
with a scale of its own, so that |u - s1*q1| and |e| are known. With x = x' + d the product of two
unit vectors differs from that of their quantised forms by at most |dx| + (1 + |dx|)|dy|, plus a slack for
rounding. Products of q1 decide most pairs (certainly linked, or certainly not), q1 and q2 together
nearly all others; the pairs that may still lie on either side are computed in double precision
from the vectors as they are, which are fetched for these pairs alone. A tile gives counts of links, a
spanning forest and its doubtful pairs, never all its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose
label or vec_id is null, link with nothing; vectors of other lengths are not compared; repeated rows
are separate vectors, which link if they are usable; a null vec_id has a null component and is not kept;
rows of one vec_id have one component; an empty table gives an empty result; components of any finite
size are scaled by a power of two, so that no square overflows. Columns besides vec_id, embedding and
label play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm.common import dropped, prepare, spread_join, staged
from riskloom.llm.components import connected

#: Vectors in a block; a tile has two blocks at most. Rows of a tile that are multiplied at once.
BLOCK, ROWS = 4096, 256
#: Pairs that are computed in double precision at a time.
PAIRS = 1 << 14
#: Added to error bounds for the rounding of the bounds' own arithmetic.
SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantised(x: np.ndarray) -> dict[str, np.ndarray]:
    """q1, q2 (int8), s1, s2, and e1, e2: at least the lengths of u - s1*q1 and u - s1*q1 - s2*q2, of unit vectors u along x."""
    u = scaled(x)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s1 = np.abs(u).max(axis=1) / 127
    q1 = np.rint(u / s1[:, None])
    rest = u - s1[:, None] * q1
    s2 = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-300)
    q2 = np.rint(rest / s2[:, None])
    left = rest - s2[:, None] * q2
    out = {"q1": q1.astype(np.int8), "q2": q2.astype(np.int8), "s1": s1, "s2": s2}
    return out | {"e1": np.linalg.norm(rest, axis=1) + SLACK, "e2": np.linalg.norm(left, axis=1) + SLACK}


def _margin(ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
    return ex + ey + ex * ey + SLACK


def decided(x: dict, y: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, k, l): pairs i, j have a cosine of the threshold or more, pairs k, l may have; all others have less."""
    d = x["q1"].shape[1]
    exact = np.float32 if d * 127 * 127 < 2**24 else np.float64  # integers are exact in it
    product = (x["q1"].astype(exact) @ y["q1"].astype(exact).T).astype(np.float64) * x["s1"][:, None] * y["s1"][None, :]
    margin = _margin(x["e1"][:, None], y["e1"][None, :])
    i, j = np.nonzero(product - margin >= threshold)
    a, b = np.nonzero((product + margin >= threshold) & (product - margin < threshold))
    sure, maybe = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for at in range(0, len(a), PAIRS):
        k, l = a[at : at + PAIRS], b[at : at + PAIRS]
        fine = (_both(x, k) * _both(y, l)).sum(axis=1)
        margin = _margin(x["e2"][k], y["e2"][l])
        sure[at : at + PAIRS] = fine - margin >= threshold
        maybe[at : at + PAIRS] = (fine + margin >= threshold) & (fine - margin < threshold)
    return np.concatenate([i, a[sure]]), np.concatenate([j, b[sure]]), a[maybe], b[maybe]


def _both(x: dict, k: np.ndarray) -> np.ndarray:
    return x["s1"][k, None] * x["q1"][k] + x["s2"][k, None] * x["q2"][k]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the smallest index that links reach; root has those of earlier links."""
    nodes = np.arange(len(root))
    i, j = np.concatenate([i, nodes]), np.concatenate([j, root])
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_QUANTISED = "label long, size int, node {0}, weight long, uid binary, q binary, s1 double, s2 double, e1 double, e2 double"


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a batch as int8; v is the last column."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        parts = []
        for d in np.unique(size):  # vectors of one length at a time
            own = batch.filter(pa.array(size == d))
            x = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, -1)
            z = quantised(x)
            q = np.concatenate([z["q1"], z["q2"]], axis=1)
            columns = [*own.columns[:-1], pa.array([r.tobytes() for r in q], pa.binary())] + [pa.array(z[k]) for k in ("s1", "s2", "e1", "e2")]
            parts.append(pa.RecordBatch.from_arrays(columns, names=[*own.schema.names[:-1], "q", "s1", "s2", "e1", "e2"]))
        yield from parts


def _tile_links(threshold: float, kind: pa.DataType):
    fields = [("uid", pa.binary()), ("node", kind), ("links", pa.int64()), ("other", kind), ("with", pa.binary())]

    def run(table: pa.Table) -> pa.Table:
        node, uid = table.column("node").combine_chunks(), table.column("uid").combine_chunks()
        weight, block = (table.column(c).to_numpy() for c in ("weight", "block"))
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(weight), -1)
        d = q.shape[1] // 2
        whole = {"q1": q[:, :d], "q2": q[:, d:]} | {k: table.column(k).to_numpy() for k in ("s1", "s2", "e1", "e2")}
        first, last = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
        one, two = np.nonzero(block == first)[0], np.nonzero(block == last)[0]
        links, root = np.zeros(len(weight), np.int64), np.arange(len(weight))
        doubt: list[tuple[np.ndarray, np.ndarray]] = []
        part = lambda k: {n: v[k] for n, v in whole.items()}
        y = part(two)
        for at in range(0, len(one), ROWS):
            rows = one[at : at + ROWS]
            i, j, k, l = decided(part(rows), y, threshold)
            i, j, k, l = rows[i], two[j], rows[k], two[l]
            if first == last:
                i, j, k, l = i[i < j], j[i < j], k[k < l], l[k < l]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            root = _forest(root, i, j)
            doubt.append((k, l))
        own = np.nonzero(links > 0)[0]
        k, l = (np.concatenate(x) if doubt else np.zeros(0, np.int64) for x in (list(zip(*doubt, strict=True)) or [[], []]))
        take = lambda c, at: c.take(pa.array(at, pa.int64()))
        nothing = lambda n, t: pa.nulls(n, t)
        sure = [take(uid, own), take(node, own), pa.array(links[own]), take(node, root[own]), nothing(len(own), pa.binary())]
        maybe = [take(uid, k), nothing(len(k), kind), nothing(len(k), pa.int64()), nothing(len(k), kind), take(uid, l)]
        return pa.table([pa.chunked_array([a, b]) for a, b in zip(sure, maybe, strict=True)], schema=pa.schema(fields))

    return run


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows whose vectors x and y, the last two columns, have a cosine of the threshold or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (v.values.to_numpy(zero_copy_only=False).astype(np.float64)[None] for v in (x, y))
            keep.append(bool(cosines(x, y)[0] >= threshold))
        yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))


def links(vectors: DataFrame, threshold: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding, label."""
    prepare(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType
    v = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    as_text = F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ","))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & good, F.lit(False))
    v = v.withColumn("uid", F.when(usable, F.substring(F.unhex(F.sha2(as_text.cast("binary"), 256)), 1, 16)))
    rows = staged(v.select("vec_id", "uid"), "embedding-rows")
    nodes = v.filter("uid is not null").groupBy("uid").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    nodes = staged(nodes.select("label", F.size("v").alias("size"), "node", "weight", "uid", "v"), "embedding-nodes")
    small = staged(nodes.mapInArrow(_quantise, _QUANTISED.format(kind.simpleString())), "embedding-quantised")
    sizes = small.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = small.join(sizes, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block",
        "node", "weight", "uid", "q", "s1", "s2", "e1", "e2",
    )
    schema = f"uid binary, node {kind.simpleString()}, links long, other {kind.simpleString()}, with binary"
    found = staged(tiles.groupBy("label", "size", "b1", "b2").applyInArrow(_tile_links(threshold, to_arrow_type(kind)), schema), "embedding-links")
    dropped(small)
    pairs = found.filter("with is not null").select("uid", "with")
    own = lambda u, n, w, x: nodes.select(F.col("uid").alias(u), F.col("node").alias(n), F.col("weight").alias(w), F.col("v").alias(x))
    pairs = pairs.join(own("uid", "a", "wa", "x"), "uid").join(own("with", "b", "wb", "y"), "with").select("uid", "with", "a", "b", "wa", "wb", "x", "y")
    schema = f"uid binary, with binary, a {kind.simpleString()}, b {kind.simpleString()}, wa long, wb long"
    near = staged(pairs.mapInArrow(lambda batches: _exact(batches, threshold), schema), "embedding-doubtful")
    sure = found.filter("with is null")
    edges = sure.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(near.select("a", "b"))
    parts = connected(edges)
    ends = F.explode(F.array(F.struct(F.col("uid").alias("uid"), F.col("wb").alias("links")), F.struct(F.col("with").alias("uid"), F.col("wa").alias("links"))))
    counted = sure.select("uid", "links").unionByName(near.select(ends.alias("e")).select("e.uid", "e.links"))
    counted = counted.groupBy("uid").agg(F.sum("links").alias("links"))
    per = nodes.select("uid", "node", "weight").join(counted, "uid", "left").join(parts, "node", "left")
    per = per.select("uid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "node").alias("root"))
    out = spread_join(rows, per, "uid")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"),
    )
