"""Incremental secret scan over a ledger of content-addressed blobs.

Every historical version of a text is a blob named by its SHA-256. A blob is scanned once for each
version of the rules; the ledger remembers which pairs have been done and what they held, and a join
gives the findings back to every path that ever had the blob. Copies are dropped within each task
before texts are shuffled, so that a group of copies adds one text per task at most; where findings
go back to paths, the paths of a blob that very many have are dealt out over several tasks.

Defined results: a null text is the empty blob; repeated rows each get the blob's findings; a null
path is kept; an empty table gives an empty result. Texts of any length are scanned whole; columns
besides path and text play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free, prepare, spread_join, staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters of group (0: the whole match) that a match must have."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    base: bool = True


#: The order is that of spans which begin at one place.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"[0-9a-f]+", 32),
    Rule("pem", 2, r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(?s:.*?)(?:-----END \1-----|\Z)", 27, base=False),  # a cut key runs to the end
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 40, base=False),
)
#: Patterns that match the same after a test for fewer, longer places: a run that is too short fails either way.
_QUICK = {r"[0-9a-f]+": r"[0-9a-f]{32,}", r"AKIA[A-Z0-9]+": r"AKIA[A-Z0-9]{12,}", r"gh[pousr]_[A-Za-z0-9]+": r"gh[pousr]_[A-Za-z0-9]{36,}"}
FINDINGS = "array<struct<start:int,end:int,kind:string>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) in code points, ordered; leftmost, not overlapping within a rule."""
    out = []
    for k, rule in enumerate(rules):
        for m in _compiled(rule).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


_patterns: dict[Rule, re.Pattern] = {}


def _compiled(rule: Rule) -> re.Pattern:
    if rule not in _patterns:
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        _patterns[rule] = re.compile(_QUICK.get(rule.pattern, rule.pattern), flags)
    return _patterns[rule]


def blob_id(text: Column) -> Column:
    """The content's address."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(
    versions: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings per row of versions, the new ledger).

    The first has path, blob and spans (in order, over all rules). The ledger has blob, kind,
    version and spans; give it to the next call, which then scans the pairs it lacks and no others.
    """
    found, entries = _found(versions, path, text, rules, ledger)
    return found, entries if ledger is None else ledger.unionByName(entries)


def scan_into(versions: DataFrame, folder: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scan() with a ledger that is kept as Parquet in a folder (a URI that all executors reach): read if it is there, then added to."""
    spark = versions.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    found, entries = _found(versions, path, text, rules, spark.read.parquet(folder) if there else None)
    found = staged(found, "secret-findings")
    entries.write.mode("append").parquet(folder)
    return found


def _found(versions: DataFrame, path: str, text: str, rules: tuple[Rule, ...], ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(findings per row, what the ledger lacks)."""
    prepare(versions.sparkSession)
    paths = staged(versions.select(F.col(path), blob_id(F.col(text)).alias("blob")), "secret-paths")
    texts = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        _once_per_task, "blob string, text string"
    )
    if ledger is not None:
        done = ledger.join(
            F.broadcast(versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")),
            ["kind", "version"],
            "left_semi",
        )
        done = done.groupBy("blob").agg(F.collect_set("kind").alias("done"))
        texts = texts.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        texts = texts.filter(F.size(F.array_except(F.array(*[F.lit(r.kind) for r in rules]), "done")) > 0)
    else:
        texts = texts.withColumn("done", F.array().cast("array<string>"))
    fresh = _scanned(texts, rules)
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    entries = fresh.select("blob", F.explode("scanned").alias("kind"), "spans").select(
        "blob",
        "kind",
        kinds[F.col("kind")].alias("version"),
        F.filter("spans", lambda s: s["kind"] == F.col("kind")).alias("spans"),
    )
    book = entries if ledger is None else ledger.unionByName(entries)
    if ledger is None:
        held = fresh.filter(F.size("spans") > 0).select("blob", "spans")
    else:
        current = [(r.kind, r.version, k) for k, r in enumerate(rules)]
        order = versions.sparkSession.createDataFrame(current, "kind string, version int, nth int")
        held = (
            book.join(F.broadcast(order), ["kind", "version"])
            .filter(F.size("spans") > 0)
            .select("blob", "nth", F.explode("spans").alias("s"))
            .groupBy("blob")
            .agg(F.sort_array(F.collect_set(F.struct("s.start", "nth", "s.end", "s.kind"))).alias("x"))
            .select("blob", F.transform("x", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
        )
    found = spread_join(paths, held, "blob").select(
        path, "blob", F.coalesce("spans", F.array().cast(FINDINGS)).alias("spans")
    )
    return found, entries


def blobs_with_secrets(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs that hold any."""
    prepare(versions.sparkSession)
    texts = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_once_per_task, "blob string, text string")
    return _scanned(texts.withColumn("done", F.array().cast("array<string>")), rules).filter(F.size("spans") > 0).select("blob", "spans")


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, scanned, spans) of (blob, text, done): each blob once, for the rules whose kinds are not in done."""
    fresh = texts.repartition("blob").mapInArrow(_scanner(rules), f"blob string, scanned array<string>, spans {FINDINGS}")
    return staged(fresh, "secret-scan")


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of the task once, with its address."""
    seen: set[bytes] = set()
    for batch in batches:
        names, keep = [], []
        for k, text in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
            digest = hashlib.sha256(text)
            if digest.digest() not in seen:
                seen.add(digest.digest())
                names.append(digest.hexdigest())
                keep.append(k)
        new = batch.column(0).take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), new], names=["blob", "text"])


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            blobs, scanned, spans = [], [], []
            for blob, text, done in zip(*(batch.column(k).to_pylist() for k in ("blob", "text", "done")), strict=True):
                if blob in seen:
                    continue
                seen.add(blob)
                todo = tuple(r for r in rules if r.kind not in done)
                blobs.append(blob)
                scanned.append([r.kind for r in todo])
                spans.append([{"start": a, "end": b, "kind": todo[k].kind} for a, b, k in find(text, todo)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array(scanned, pa.list_(pa.string())), pa.array(spans, _FOUND)],
                names=["blob", "scanned", "spans"],
            )

    return run


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scan()'s findings as counts and span lists, one row per path."""
    base = [r.kind for r in rules if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [_count(k).alias(f"n_{k}") for k in base]
    return found.select(
        *[c for c in found.columns if c not in ("blob", "spans")],
        *counts,
        F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each span of a secret replaced by [kind]; n_chars, where there is one, follows.

    The findings come from scan(); they are joined back by content, and texts without any stay as
    they are. Overlapping spans are replaced as one.
    """
    blob, spans = free(docs, "_blob"), free(docs, "_spans")
    address = docs.withColumn(blob, blob_id(F.col(text)))
    held = blobs_with_secrets(docs, text, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = spread_join(address, held, blob)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["end"].alias("at"),
        ),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    clean = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, 2147483647)),
    )
    out = joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(clean))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(kind))
        out = out.withColumn("n_chars", n)
    return out.select(*docs.columns)
