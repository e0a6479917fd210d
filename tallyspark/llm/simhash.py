"""Near-duplicate documents by SimHash, found through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialised, prepare, utf8
from tallyspark.llm.components import connected_components

WIDTH = 3
RADIUS = 3
SEED = 42
CROWDED = 50_000  # larger buckets are dealt anew by more bits


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Bit masks such that any at most ``radius`` bit positions are all left out by some mask.

    Each position carries a non-zero vector of ``radius + 1`` bits; the mask of a vector v takes the positions whose
    vector is not orthogonal to v. ``radius`` vectors span at most ``radius`` dimensions, so some v is orthogonal to them all.
    """
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if bin((i % size + 1) & v).count("1") % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that add one of ``radius + 1`` blocks of the free bits each: a pair within the radius agrees in one block."""
    blocks = radius + 1
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[b::blocks]) for b in range(blocks)]


def links_within(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect the same values as all pairs within ``radius`` differing bits do.

    Each value taken up is held only against those not reached yet, so a dense group costs little more than its size.
    """
    rest, out = values.copy(), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            near = np.bitwise_count((rest ^ one).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                out += [(int(one), int(x)) for x in found]
                todo.extend(found)
                rest = rest[~near]
    return out


def _bucket_links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        kept: list[np.ndarray] = []
        last = None

        def flush() -> list[tuple[int, int]]:
            group = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            return links_within(group, radius) if len(group) > 1 else []

        def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            mask, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key = fp & mask
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            edges: list[tuple[int, int]] = []
            bounds = [0, *new.tolist(), len(fp)]
            for s, e in zip(bounds[:-1], bounds[1:]):
                if s == e:
                    continue
                here = (int(mask[s]), int(key[s]))
                if here != last:
                    edges += flush()
                    kept, last = [], here
                kept.append(fp[s:e])
            if edges:
                yield batch(edges)
        if edges := flush():
            yield batch(edges)

    return link


def near_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct values ``fp`` as all pairs within ``radius`` bits would.

    Buckets are the values under each covering mask. Crowded buckets are dealt anew, up to twice, by one more block of free
    bits (for a radius of 3, that leaves 2**16 possible values to a bucket), and no pair is lost.
    """
    masks = covering_masks(radius)
    rows = fingerprints.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp")
    key = F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    ready, level = None, {m: finer_masks(m, radius) for m in masks}
    for deeper in (True, True, False):
        rows = rows.select("mask", "fp", key)
        crowded = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("mask", "key")
        if not deeper or (crowded := materialised(crowded)).isEmpty():
            ready = rows if ready is None else ready.union(rows)
            break
        calm = rows.join(crowded, ["mask", "key"], "left_anti").select("mask", "fp", "key")
        ready = calm if ready is None else ready.union(calm)
        finer = F.create_map(*[x for m, fs in level.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in fs]))])
        rows = rows.join(crowded, ["mask", "key"], "left_semi").select(F.explode(finer[F.col("mask")]).alias("mask"), "fp")
        level = {f: finer_masks(f, radius) for fs in level.values() for f in fs}
    dealt = ready.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "fp")
    return dealt.mapInArrow(_bucket_links(radius), "u long, v long")


def _fingerprint_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            names = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps)], names=[*names, "fp"])

    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, tie, fp)`` for every row; ``tie`` is a hash of the text."""
    prepare(docs.sparkSession)
    text = utf8(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("_text"))
    return rows.mapInArrow(_fingerprint_rows(width), "doc_id long, tie long, fp long")


def rooted(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint of ``marked``; linked ones share a root."""
    nodes = marked.select("fp").distinct()
    stars = connected_components(near_links(nodes, radius))
    return nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: documents chained by fingerprints within ``radius`` bits share the
    smallest ``doc_id`` as ``component_id``.

    Equal fingerprints are folded before any bucket is built, so copies cost one row. A null text is empty, an empty text
    has fingerprint 0 and links like any other; rows with a null id keep it and never name a component (its id is null if
    no member has one); repeated rows each get a row; an empty table gives none. Other columns are not read.
    """
    marked = materialised(fingerprints(docs, id_col, text_col, width))
    roots = materialised(rooted(marked, radius))
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp")
    named = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(roots.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def text_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: text hashes of different texts whose fingerprints lie within ``radius`` bits; they chain the same texts as
    all such pairs do, at one link for each text of a fingerprint and those of ``near_links``."""
    marked = materialised(fingerprints(docs, id_col, text_col, width).select("tie", "fp").distinct())
    least = marked.groupBy("fp").agg(F.min("tie").alias("least"))
    same = marked.join(least, "fp").where("tie <> least").select(F.col("tie").alias("a"), F.col("least").alias("b"))
    ends = [least.select(F.col("fp").alias(fp), F.col("least").alias(tie)) for fp, tie in (("u", "a"), ("v", "b"))]
    apart = near_links(marked.select("fp").distinct(), radius).distinct().join(ends[0], "u").join(ends[1], "v").select("a", "b")
    return same.unionByName(apart)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, tie)`` of one row of each component: the smallest id (null last), then the smallest text hash."""
    marked = materialised(fingerprints(docs, id_col, text_col, width))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    firsts = marked.groupBy("fp").agg(F.min(order).alias("first")).join(rooted(marked, radius), "fp")
    return firsts.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.tie")


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
