"""Scoring texts by prediction by partial matching over a byte-context trie.

A text is its tokens (words, A-Z lower-cased) and one end; as a byte stream, the words with a space
between them, and a closing END. The trie is trained on the streams of all training texts, with how
often each symbol follows each context of up to ORDER bytes; contexts run across the borders of
words, and a text begins behind ORDER ends. Every byte of every text is coded with it: a symbol with
count c among n in a context with d kinds has the probability c/(n+d), an escape d/(n+d); symbols
that the longer context has are excluded after an escape, and behind the empty context stands a
uniform choice among the bytes left. The base score is of single tokens: log10((c+0.1)/(n+0.1(v+1))).

Texts are put into chunks. A chunk sends each distinct gram (ORDER+1 bytes) and word once; counts
are summed in Spark and stay distributed; code lengths are computed shard by shard, each of the grams
with the same last two context bytes; and the chunk gets back the lengths of its grams and the counts of its words, so that a word or gram
of every document adds one row per chunk. Only tables whose size bytes bound (two bytes' counts)
reach the driver.

Defined results: null and empty texts have one token, the end; a null id counts as held out (crc32
of the empty text is 0); repeated rows count, and are scored, each; without training texts every
byte has the same probability; an empty table gives an empty result; texts of any length are coded
whole; columns of docs besides doc_id and the text play no part and may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER_BYTES, prepare, remainder, remainder_col, staged

#: Bytes of context.
ORDER = 5
#: Bytes of streams in a chunk, in a piece of it whose grams are counted at once, and in one that is coded at once.
CHUNK_BYTES, PIECE_BYTES, CODED_BYTES = 24 << 20, 2 << 20, 1 << 19
#: Grams of chunks that are put into rows at once.
PACKED = 1 << 20
#: Texts in a chunk.
CHUNK_DOCS = 65_536
END = b"\n"  # no word has white space


def grams(words: list[bytes], closing: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """(codes, which word) of the ORDER+1 bytes that end at each byte of each word and its closing byte, which also stands before it."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(closing * ORDER + w + closing for w in words), np.uint8).astype(np.int64)
    code = np.zeros(len(raw) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | raw[k : len(raw) - ORDER + k]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return code[np.repeat(starts - firsts, sizes) + np.arange(sizes.sum())], np.repeat(np.arange(len(words)), sizes)


def _look(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted table; 0 for others."""
    if len(table) == 0:
        return np.zeros(len(keys))
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, values[i], 0.0)


def code_lengths(codes: np.ndarray, counts: np.ndarray, asked: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each asked gram's last byte after the others.

    codes and counts hold all grams with the last two context bytes of any asked one; pairs[b, s] is
    how often s follows b over all grams.
    """
    total = np.zeros(len(asked))
    open_ = np.ones(len(asked), bool)
    known = counts > 0
    codes, counts = codes[known], counts[known].astype(float)
    gone_n, gone_d = np.zeros(len(asked)), np.zeros(len(asked))
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(ORDER, -1, -1):
        if k >= 2:
            gram, inverse = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            tables.append((gram, np.bincount(inverse, counts, len(gram))))
        elif k == 1:
            tables.append((np.nonzero(pairs.ravel())[0], pairs.ravel()[pairs.ravel() > 0].astype(float)))
        else:
            single = pairs.sum(axis=0)
            tables.append((np.nonzero(single)[0], single[single > 0].astype(float)))
    for k, (gram, count) in zip(range(ORDER, -1, -1), tables, strict=True):
        context, of = np.unique(gram >> 8, return_inverse=True)
        n, d = np.bincount(of, count, len(context)), np.bincount(of, minlength=len(context)).astype(float)
        own = asked & ((1 << 8 * (k + 1)) - 1)
        left_n, left_d = _look(own >> 8, context, n) - gone_n, _look(own >> 8, context, d) - gone_d
        seen = _look(own, gram, count)
        both = left_n + left_d
        hit = open_ & (seen > 0)
        total[hit] += np.log10(seen[hit] / both[hit])
        open_ &= ~hit
        away = open_ & (both > 0) & (left_d > 0)
        total[away] += np.log10(left_d[away] / both[away])
        if k:  # what this context has is excluded in the next
            lower, values = tables[ORDER - k + 1]
            out = np.bincount(of, _look(gram & ((1 << 8 * k) - 1), lower, values), len(context))
            gone_n, gone_d = _look(own >> 8, context, out), _look(own >> 8, context, d)
        else:
            kinds = float(len(gram))
    total[open_] -= math.log10(max(1.0, 256 - kinds))
    return total


def chunked(docs: DataFrame, text: str, modulus: int) -> DataFrame:
    """chunk, doc_id, training, stream of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        chunk, n, held = uuid.uuid4().int >> 65, 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            chunks, streams = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                stream = b" ".join((raw or b"").translate(LOWER_BYTES).split())
                if n >= CHUNK_DOCS or held >= CHUNK_BYTES:
                    chunk, n, held = uuid.uuid4().int >> 65, 0, 0
                n, held = n + 1, held + len(stream)
                chunks.append(chunk)
                streams.append(stream)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), batch.column(0), pa.array([remainder(x, modulus) > 0 for x in ids], pa.bool_()), pa.array(streams, pa.binary())],
                names=["chunk", "doc_id", "training", "stream"],
            )

    return docs.select("doc_id", text).mapInArrow(run, f"chunk long, doc_id {kind}, training boolean, stream binary")


def _pieces(streams: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbours of about CODED_BYTES."""
    first, held = 0, 0
    for k, x in enumerate(streams):
        held += len(x)
        if held >= CODED_BYTES:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(streams):
        yield first, len(streams)


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """(chunk, streams, training) of neighbouring rows of one chunk, of about PIECE_BYTES."""
    own, streams, training, held = None, [], [], 0
    for batch in batches:
        for chunk, t, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if streams and (chunk != own or held >= PIECE_BYTES):
                yield own, streams, training
                streams, training, held = [], [], 0
            own, held = chunk, held + len(x)
            streams.append(x)
            training.append(t)
    if streams:
        yield own, streams, training


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct gram of a chunk once, with its count in training texts."""
    own, codes, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(codes), 100_000):
            c = codes[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), own)), pa.array(c), pa.array(counts[a : a + 100_000])], names=["chunk", "code", "n"])

    for chunk, streams, training in _by_chunk(batches):
        if chunk != own:
            yield from rows()
            own, codes, counts = chunk, codes[:0], counts[:0]
        for of_training in (True, False):
            code, _ = grams([x for x, t in zip(streams, training, strict=True) if t == of_training], END)
            gram, n = np.unique(code, return_counts=True)
            codes, inverse = np.unique(np.concatenate([codes, gram]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n * of_training]), len(codes)).astype(np.int64)
    yield from rows()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a chunk once, with its count in training texts."""
    own, counts = None, Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for a in range(0, len(words), 100_000):
            w = words[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(w), pa.int64()), pa.array(w, pa.binary()), pa.array([counts[x] for x in w], pa.int64())], names=["chunk", "word", "n"])

    for chunk, streams, training in _by_chunk(batches):
        if chunk != own:
            yield from rows()
            own, counts = chunk, Counter()
        for x, t in zip(streams, training, strict=True):
            if t:
                counts.update(x.split())
            else:
                counts.update(dict.fromkeys(x.split(), 0))
    yield from rows()


def _packed(chunk: np.ndarray, code: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per chunk with its grams' codes (sorted, as differences) and lengths."""
    if len(chunk):
        order = np.lexsort((code, chunk))
        chunk, code, value = chunk[order], code[order], value[order]
        ends = [*(np.nonzero(chunk[1:] != chunk[:-1])[0] + 1).tolist(), len(chunk)]
        starts = [0, *ends[:-1]]
        rows = [(chunk[a], np.diff(code[a:b], prepend=0).tobytes(), value[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "codes", "lengths"])


def _unpacked(codes: list[bytes], lengths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of _packed() rows of one chunk, sorted, and their lengths."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in codes])
    order = np.argsort(code)
    return code[order], np.frombuffer(b"".join(lengths))[order]


def coded(table: DataFrame) -> DataFrame:
    """(chunk, codes, lengths), as _packed(), of the grams of (code, n, chunks): log10 of the probability of a gram's last byte, for each of its chunks."""
    low = table.filter("n > 0").groupBy(F.col("code").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    pairs = np.zeros((256, 256))
    for row in low:
        pairs[divmod(row["pair"], 256)] = row["n"]
    shared = table.sparkSession.sparkContext.broadcast(pairs)

    def lengths(parts: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        whole = pa.Table.from_batches(parts)
        code = whole.column("code").to_numpy()
        value = code_lengths(code, whole.column("n").to_numpy(), code, shared.value)
        at = 0
        for part in parts:
            chunks = part.column("chunks")
            own = pc.list_parent_indices(chunks).to_numpy() + at
            yield chunks.flatten().to_numpy(), code[own], value[own]
            at += part.num_rows

    def modelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for triple in by_pair(batches):
            done.append(triple)
            n += len(triple[0])
            if n >= PACKED:
                yield from _packed(*map(np.concatenate, zip(*done, strict=True)))
                done, n = [], 0
        if done:
            yield from _packed(*map(np.concatenate, zip(*done, strict=True)))

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            cuts = [0, *(np.nonzero(pair[1:] != pair[:-1])[0] + 1).tolist(), len(pair)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and held[-1].column("pair")[-1].as_py() != pair[a]:
                        yield from lengths(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from lengths(held)

    # all contexts of two bytes and more that end in the same two bytes are neighbours
    pair = F.shiftright("code", 8).bitwiseAND(0xFFFF)
    rows = table.select(pair.alias("pair"), "code", "n", "chunks").repartition("pair").sortWithinPartitions("pair")
    return rows.mapInArrow(modelled, "chunk long, codes binary, lengths binary")


def scored(docs: DataFrame, text: str = "text", modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    prepare(docs.sparkSession)
    rows = staged(chunked(docs, text, modulus), "ppm-streams")
    streams = rows.select("chunk", "training", "stream")
    ends = rows.filter("training").count()
    every = F.collect_list("chunk").alias("chunks")
    words = streams.mapInArrow(_word_counts, "chunk long, word binary, n long").groupBy("word").agg(F.sum("n").alias("n"), every)
    words = staged(words, "ppm-words")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    n, v = tokens + ends, kinds + (ends > 0)
    below = n + 0.1 * (v + 1)
    table = streams.mapInArrow(_gram_counts, "chunk long, code long, n long").groupBy("code").agg(F.sum("n").alias("n"), every)
    table = staged(table, "ppm-grams")
    none = lambda kind: F.lit(None).cast(kind)
    told = coded(table).select("chunk", "codes", "lengths", none("binary").alias("word"), none("long").alias("n"))
    told = told.unionByName(words.select(F.explode("chunks").alias("chunk"), none("binary").alias("codes"), none("binary").alias("lengths"), "word", "n"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, lengths = _unpacked(right.column("codes").drop_null().to_pylist(), right.column("lengths").drop_null().to_pylist())
        numbers = {w: k for k, w in enumerate(right.column("word").drop_null().to_pylist())}
        count = right.column("n").drop_null().to_numpy()
        base = np.log10((count + 0.1) / below)
        texts = left.column("stream").to_pylist()
        score, known, plain, sizes = np.zeros(len(texts)), np.full(len(texts), int(ends > 0)), np.full(len(texts), math.log10((ends + 0.1) / below)), np.ones(len(texts), np.int64)
        for k, x in enumerate(texts):
            own = np.fromiter(map(numbers.__getitem__, x.split()), np.int64)
            sizes[k] += len(own)
            known[k] += np.count_nonzero(count[own])
            plain[k] += base[own].sum()
        for a, b in _pieces(texts):
            code, of = grams(texts[a:b], END)
            own, inverse = np.unique(code, return_inverse=True)
            score[a:b] = np.bincount(of, lengths[np.searchsorted(codes, own)][inverse], b - a)
        pa.default_memory_pool().release_unused()  # the next chunk's tables come beside this one's
        columns = [left.column("doc_id"), pa.array(sizes), pa.array(known, pa.int64()), pa.array(plain), pa.array(score)]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.select("chunk", "doc_id", "stream").groupBy("chunk").cogroup(told.groupBy("chunk"))
    out = out.applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", (remainder_col(F.col("doc_id"), modulus) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
