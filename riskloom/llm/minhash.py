"""MinHash near-duplicates by an inverted join on signature coordinates.

Each distinct set of word shingles has a signature of COORDINATES minima. A coordinate and its value
are a token; the sets that have a token are its posting list. Two sets are a candidate pair if at
least matches(percent) of their tokens are the same. Tokens are ordered by rarity, and a set is posted
only under its prefix, as many of its rarest tokens as any partner must hit one of (those that no
other set has count towards the prefix and post nothing).

A pair's collisions are counted in the list of its first common prefix token and in no other: of each
member the rest of the list is merged, coordinates are counted in steps, and members that can't reach
the match threshold with the coordinates left are skipped. Lists of more than BLOCK members are cut into
blocks, each two of which are a tile of their own. What reaches the threshold must also pass a bound on
the similarity that bit maps of the two sets prove (bits that one of two maps has are shingles that
one of the sets has), and is confirmed on the full sets, which are fetched for these pairs alone.

Only components are asked for, so that sets which are connected already need not be compared. While
lists hold many more pairs than members, every list first compares its members with one of them, another
one each round, as long as that links many. What is linked is one root; lists whose members have
one root are done, and in the others members of different roots are merged. So that no group gives all
its pairs, a member asks for no more than its best few partners of a tile; if any had more, the lists
are merged again with the roots that follow and many times as many, until none had more.

A pair at the threshold of 0.85 has 54.4 equal coordinates of 64 on average; that fewer than 40 are
equal has a probability of about 2e-6, and less above the threshold. Other thresholds have as many
matches as keep that probability at MISSED at most: 35 at 0.8.

Defined results: a text without words (null, empty, white space) has an empty set and no links;
one of fewer than five words is one shingle; equal sets (copies, repeated rows) are one node; rows
of one doc_id are one document for linking; rows with a null doc_id have a null component and are
not kept; an empty table gives an empty result. Texts of any length are taken whole; columns of docs
besides doc_id and the text play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER_BYTES, dropped, free, prepare, spread_join, staged
from riskloom.llm.components import connected

#: Coordinates of a signature, and the share of pairs at the threshold that may have too few equal ones.
COORDINATES, MISSED = 64, 2.5e-6
#: Members of a list in a block; a tile has two blocks at most.
BLOCK = 1024
#: Pairs in open lists, as a multiple of their members, up to which all are compared at once.
DENSE = 16
#: Links of a round of comparisons with one member, as a share of the members, below which it is the last; partners at first.
FEW, TOP = 0.1, 32
#: The most bits in a set's map.
MOST_BITS = 4096
#: Coordinates that are counted in a step.
STEP = 16
#: Documents whose sets are compared that are broadcast at most to pick their texts; beyond, texts are shuffled to them.
BROADCAST_ROWS = 200_000

_random = np.random.default_rng(20_240_611)
_A = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MIX = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int) -> int:
    """How many coordinates must be equal, so that at most MISSED of the pairs at the threshold have fewer."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISSED:
            return max(k, 1)
    return COORDINATES


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_set(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8."""
    words = raw.translate(LOWER_BYTES).split()  # splits on \x20 and \x09-\x0D
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    total = np.full(n - k + 1, k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)  # a short text's only shingle differs from longer ones
    for j in range(k):
        total = (total ^ h[j : n - k + 1 + j]) * _MIX[j]
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set (not empty) under COORDINATES hash functions, as int32."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out.view(np.int32)


def sketches(docs: DataFrame, text: str = "text", size: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes of a hash of the whole set), signature (null if empty)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 1):
                sets = [shingle_set(x or b"", size) for x in part.column(1).cast(pa.binary()).to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter(signatures(full).tolist() if full else [])
                columns = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, signature array<int>")


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most 128 rows and, but for single rows, 1 MB of a column's values."""
    ends = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + 128, int(np.searchsorted(ends, before + (1 << 20), side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def linked(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sketches, components): the second has node and root for each set that is linked to another text's."""
    least = matches(percent)
    sketch = staged(sketches(docs, text, size), "minhash-sketches")
    active = staged(_prefixes(sketch, least), "minhash-prefixes")
    posted = active.select("set_key", "node", F.explode("prefix").alias("token"))
    met = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    posted = staged(posted.join(met, "token"), "minhash-postings")
    rows = docs.select(F.col("doc_id").alias("node"), F.col(text).alias("_text"))
    ids = posted.select("node").distinct()
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "node", "left_semi")
    full = staged(_with_sets(rows, size).join(active.select("node", "set_key"), ["node", "set_key"]), "minhash-sets")
    members = active.select("set_key", "signature", "mask").join(full.select("set_key", "bits").dropDuplicates(["set_key"]), "set_key")
    members = staged(members, "minhash-members")
    kind = docs.schema["doc_id"].dataType.simpleString()
    roots, found, more, hubs, k, top = None, None, True, True, 0, TOP
    while more:
        lists = staged(_open_lists(posted, roots), "minhash-lists")
        size_of = lists.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
        size_of = size_of.agg(F.sum("c").alias("n"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
        open_, posts = size_of.agg(F.sum("pairs"), F.sum("n")).first()
        if not open_:
            break
        hubs = hubs and open_ > DENSE * posts
        pairs = _hub_pairs(lists, members, least, percent, k) if hubs else _merged(lists, members, least, percent, top)
        pairs = staged(pairs, "minhash-pairs")
        new = staged(_confirmed(pairs.select("a", "b"), full, percent, kind), "minhash-links")
        links = new.count()
        if links:
            found = new if found is None else found.unionByName(new)
            roots = connected(found)
        if hubs:
            hubs, k = links >= FEW * posts, k + 1
        else:
            more, top = not pairs.filter("more").isEmpty(), top * 32
        dropped(pairs)
        dropped(lists)
    for df in (posted, full, active, members):
        dropped(df)
    if roots is None:
        roots = sketch.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")).filter(F.lit(False))
    return sketch, roots


def _prefixes(sketch: DataFrame, least: int) -> DataFrame:
    """set_key, node, signature, prefix (tokens), mask (the prefix's coordinates) of sets with enough tokens that others have."""
    sets = sketch.filter("signature is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")
    )
    sets = staged(sets, "minhash-distinct")
    tokens = sets.select("set_key", F.posexplode("signature").alias("k", "value")).select(
        "set_key", (F.col("value").cast("long") * COORDINATES + F.col("k")).alias("token")
    )
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = tokens.join(shared, "token").groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    own = own.filter(F.size("own") >= least)
    own = own.select("set_key", F.slice(F.col("own.token"), F.lit(1), F.size("own") - (least - 1)).alias("prefix"))
    mask = F.expr(f"aggregate(prefix, 0L, (m, t) -> m | shiftleft(1L, cast(pmod(t, {COORDINATES}) as int)))")
    return sets.join(own, "set_key").select("set_key", "node", "signature", "prefix", mask.alias("mask"))


def _open_lists(posted: DataFrame, roots: DataFrame | None) -> DataFrame:
    """token, set_key, node, root of the lists whose members have several roots."""
    if roots is None:
        return posted.withColumn("root", F.col("node"))
    lists = posted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lists = staged(lists, "minhash-rooted")
    several = lists.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("token")
    return lists.join(several, "token")


def _hub_pairs(lists: DataFrame, members: DataFrame, least: int, percent: int, k: int) -> DataFrame:
    """(a, b, more): each member of a list with one of the list, if they have different roots and may be similar."""
    order = F.xxhash64("set_key", "token", F.lit(k))
    hubs = lists.groupBy("token").agg(F.min_by(F.struct("set_key", "root"), order).alias("hub"))
    pairs = lists.join(hubs, "token").filter(F.col("hub.root") != F.col("root"))
    pairs = pairs.select(F.col("set_key").alias("a"), F.col("hub.set_key").alias("b")).distinct()
    own = lambda key, signature, n, bits: members.select(
        F.col("set_key").alias(key), F.col("signature").alias(signature), F.col("bits.n").alias(n), F.col("bits.map").alias(bits)
    )
    pairs = pairs.join(own("b", "sb", "nb", "mb"), "b").join(own("a", "sa", "na", "ma"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (batch.column(c).flatten().to_numpy().reshape(-1, COORDINATES) for c in ("sa", "sb"))
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                maps = zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)
                apart = np.fromiter((_apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in maps), np.int64, batch.num_rows)
                keep = ((sa == sb).sum(axis=1) >= least) & (apart * (100 + percent) <= (na + nb) * (100 - percent))
                out = [batch.column("a"), batch.column("b"), pa.array(np.zeros(batch.num_rows, bool))]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "more"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a binary, b binary, more boolean")


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its hash; a few bits a shingle, 64 at least and MOST_BITS at most."""
    bits = min(MOST_BITS, max(64, 1 << int(4 * len(shingles)).bit_length()))
    out = np.zeros(bits, bool)
    out[(shingles >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A map (or several, as rows) as it would be with size words."""
    return np.bitwise_or.reduce(words.reshape(*words.shape[:-1], -1, size), axis=-2)


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """At most the number of shingles that only one of the sets has."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _merged(lists: DataFrame, members: DataFrame, least: int, percent: int, top: int) -> DataFrame:
    """(a, b, more): pairs in open lists that have different roots and may be similar, up to top of a member in a tile; more if it had more."""
    counts = staged(lists.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")), "minhash-list-sizes")
    long = counts.groupBy("token").agg(F.sum("c").alias("n")).filter(F.col("n") > BLOCK).select("token")
    # a root of more than BLOCK members has blocks of its own, which need not meet each other
    kind = F.when(F.col("c") > BLOCK, F.col("root").cast("string")).otherwise("")
    kinds = counts.join(long, "token").select("token", "root", kind.alias("kind"), "c")
    blocks = kinds.groupBy("token", "kind").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"))
    every = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.groupBy("token").agg(F.collect_list(F.struct("kind", F.concat_ws("#", "kind", "i").alias("name"))).alias("every"))
    member = lists.join(kinds.drop("c"), ["token", "root"]).join(blocks, ["token", "kind"])
    member = member.withColumn("name", F.concat_ws("#", "kind", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("string")))
    member = member.join(every, "token").withColumn("other", F.explode(F.filter("every", lambda b: (b["kind"] == "") | (b["kind"] != F.col("kind")))))
    tiles = member.select("token", F.least("name", "other.name").alias("x"), F.greatest("name", "other.name").alias("y"), "name", "set_key", "root")
    none = F.lit("")
    short = lists.join(long, "token", "left_anti").select("token", none.alias("x"), none.alias("y"), none.alias("name"), "set_key", "root")
    tiles = short.unionByName(tiles).join(members.select("set_key", "signature", "mask", "bits.n", "bits.map"), "set_key")
    tiles = tiles.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    tiles = tiles.select("token", "x", "y", "name", "root", "set_key", "signature", "mask", "n", "map")
    return tiles.mapInArrow(_collisions(least, percent, top), "a binary, b binary, more boolean")


def _collisions(least: int, percent: int, top: int):
    """Counts the collisions of each two members of a tile; tiles are neighbouring rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            token, x, y = (batch.column(k) for k in range(3))
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for c in (token, x, y):
                v = c.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(3)):
                new[0] = False
            starts = np.nonzero(new)[0]
            if len(starts) == 0:
                held.append(batch)
                continue
            if starts[0] > 0 or held:
                yield from whole([*held, batch.slice(0, starts[0])], [0])
            yield from whole([batch.slice(starts[0], starts[-1] - starts[0])], starts[:-1] - starts[0])
            held = [batch.slice(starts[-1])]
        yield from whole(held, [0])

    def whole(parts: list[pa.RecordBatch], starts) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        token = table.column("token").to_numpy()
        signature = table.column("signature").chunk(0).flatten().to_numpy().reshape(-1, COORDINATES)
        mask = table.column("mask").to_numpy().astype(np.uint64)
        root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        name = table.column("name").combine_chunks().dictionary_encode().indices.to_numpy()
        apart = pc.not_equal(table.column("x"), table.column("y")).to_numpy()
        n = table.column("n").to_numpy()
        maps = [np.frombuffer(x, np.uint64) for x in table.column("map").to_pylist()]
        words = np.fromiter(map(len, maps), np.int64, len(maps))
        first, second, more = [], [], []
        for s, e in zip(starts, [*starts[1:], len(token)], strict=True):
            k = int(token[s]) % COORDINATES
            for i in range(s, e - 1):
                near = np.arange(i + 1, e)
                other = root[near] != root[i]
                if apart[s]:
                    other &= name[near] != name[i]
                near = near[other]
                if len(near) == 0:
                    continue
                # a pair belongs to the list of its first common prefix token
                both = mask[near] & mask[i] & np.uint64((1 << k) - 1)
                count = np.zeros(len(near), np.int64)
                for step in range(0, COORDINATES, STEP):
                    equal = signature[near, step : step + STEP] == signature[i, step : step + STEP]
                    count += equal.sum(axis=1)
                    bits = (equal.astype(np.uint64) << np.arange(step, step + STEP, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    stay = (count + (COORDINATES - step - STEP) >= least) & ((both & bits) == 0)
                    if not stay.all():
                        near, count, both = near[stay], count[stay], both[stay]
                        if len(near) == 0:
                            break
                if len(near):
                    stay = np.zeros(len(near), bool)
                    for size in np.unique(words[near]):
                        own = np.nonzero(words[near] == size)[0]
                        less = min(size, words[i])
                        others = folded(np.stack([maps[j] for j in near[own]]), less)
                        differ = np.bitwise_count(others ^ folded(maps[i], less)).sum(axis=1, dtype=np.int64)
                        stay[own] = differ * (100 + percent) <= (n[near[own]] + n[i]) * (100 - percent)
                    near, count = near[stay], count[stay]
                best = near[np.argsort(-count, kind="stable")[:top]]
                first.extend([i] * len(best))
                second.extend(best.tolist())
                more.extend([len(near) > top] * len(best))
        key = table.column("set_key")
        for at in range(0, len(first), 10_000):
            pair = [key.take(pa.array(v[at : at + 10_000], pa.int64())).combine_chunks() for v in (first, second)]
            yield pa.RecordBatch.from_arrays([*pair, pa.array(more[at : at + 10_000])], names=["a", "b", "more"])

    return run


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int, kind: str) -> DataFrame:
    """(a, b) as nodes, of the pairs of sets that are as similar as percent."""
    one = full.select(F.col("set_key").alias("a"), F.col("node").alias("na"), F.col("shingles").alias("sa"))
    two = full.select(F.col("set_key").alias("b"), F.col("node").alias("nb"), F.col("shingles").alias("sb"))
    n, m = F.octet_length("sa"), F.octet_length("sb")
    both = pairs.join(two, "b").join(one, "a").filter(100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select(F.col("na").alias("a"), F.col("nb").alias("b"), "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """node, set_key, shingles and bits (their number and map) of each distinct row of node and text; copies within a task are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        bits = pa.struct([("n", pa.int64()), ("map", pa.binary())])
        for batch in batches:
            fields = [pa.field("node", batch.schema.field(0).type), pa.field("set_key", pa.binary()), pa.field("shingles", pa.binary()), pa.field("bits", bits)]
            for part in _pieces(batch, 1):
                rows = []
                for node, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    own = shingle_set(raw or b"", size)
                    shingles = own.tobytes()
                    key = hashlib.blake2b(shingles, digest_size=16).digest()
                    if (node, key) not in seen:
                        seen.add((node, key))
                        rows.append({"node": node, "set_key": key, "shingles": shingles, "bits": {"n": len(own), "map": bit_map(own).tobytes()}})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    kind = rows.schema["node"].dataType.simpleString()
    return rows.mapInArrow(run, f"node {kind}, set_key binary, shingles binary, bits struct<n:long,map:binary>")


def deduplicated(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    sketch, parts = linked(docs, text, size, percent)
    nodes = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    roots = nodes.join(parts, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    out = spread_join(sketch.select("doc_id", "n_shingles", "set_key"), roots, "set_key")
    # a doc_id of several sets belongs to the smallest of their components
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.select("doc_id", "n_shingles", whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that deduplicated() keeps, with their columns.

    Of rows that repeat a doc_id and its set one stays; texts without words, and rows with a null
    doc_id, have no copies and all stay.
    """
    marked = deduplicated(docs, text, size, percent)
    own = free(docs, "_id")
    dropped = marked.filter("doc_id is not null and not kept").select(F.col("doc_id").alias(own)).distinct()
    rest = docs.join(dropped, docs["doc_id"] == dropped[own], "left_anti")
    again = marked.filter("kept and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = staged(again, "minhash-repeated")
    if again.isEmpty():
        return rest
    one = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rest.join(again, "doc_id", "left_anti").unionByName(one.select("row.*"))
