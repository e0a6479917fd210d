"""Divergence of sources: how far the word shares of each source lie from those of the others and of its language.

Words are counted by single-pass in-memory indexing: a task gathers block postings until they fill its memory, spills them as
term-sorted runs cut by hash shard, and the runs of a shard are merged by a heap into frequencies.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialised, prepare

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Postings that a task holds before it spills a run.
BLOCK_POSTINGS = 500_000
#: Text bytes for each hash shard; its postings are fewer, since a run holds a term once for each source.
SHARD_BYTES = 16 << 20
#: Runs of a shard merged at once.
FAN = 128
#: Terms for each piece of the pair sums, terms held against each other at once, and numbers in a block of sums.
PIECE_TERMS, TERMS_AT_ONCE, SUMS = 20_000, 4096, 1 << 22
RUN = "lang string, shard int, run long, terms binary, documents binary, sizes binary, sources array<string>, source binary, counts binary"
#: A-Z to a-z, other letters and bytes beyond ASCII as they are, the rest to blanks.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Block:
    """Postings of the documents read since the last spill."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, Counter]] = {}
        self.documents: dict[str, Counter] = {}
        self.postings = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = text.translate(LETTERS).split()
        if not terms:
            return
        held = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before = len(held)
        held.update(terms)
        self.postings += len(held) - before
        self.documents.setdefault(lang, Counter()).update(set(terms))

    def spill(self, shards: int) -> Iterator[tuple]:
        """Rows of one run: for each language and shard its terms in order, with documents and counts by source."""
        run = uuid.uuid4().int >> 65
        for lang, documents in self.documents.items():
            terms = sorted(documents)
            shard = np.array([zlib.crc32(t) % shards for t in terms], np.int64)
            order = np.argsort(shard, kind="stable")
            terms = [terms[i] for i in order.tolist()]
            place = {t: i for i, t in enumerate(terms)}
            names = sorted(self.counts[lang])
            held = [self.counts[lang][s] for s in names]
            at = np.concatenate([np.fromiter(map(place.__getitem__, h), np.int64, len(h)) for h in held])
            source = np.repeat(np.arange(len(held), dtype=np.int64), list(map(len, held)))
            count = np.concatenate([np.fromiter(h.values(), np.int64, len(h)) for h in held])
            sort = np.lexsort((source, at))
            at, source, count = at[sort], source[sort], count[sort]
            df = np.fromiter(map(documents.__getitem__, terms), np.int64, len(terms))
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                lo, hi = np.searchsorted(at, [a, b])
                yield segment(lang, int(shard[order[a]]), run, terms[a:b], df[a:b], at[lo:hi] - a, names, source[lo:hi], count[lo:hi])
        self.__init__()


def segment(lang, shard, run, terms, documents, at, names, source, count) -> tuple:
    """One run's part of a shard as a row: postings sorted by term, sources numbered within the row."""
    used, source = np.unique(source, return_inverse=True)
    sizes = np.bincount(at, minlength=len(terms)).astype(np.int64)
    return lang, shard, run, b" ".join(terms), documents.tobytes(), sizes.tobytes(), [names[i] for i in used.tolist()], source.astype(np.int64).tobytes(), count.tobytes()


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in RUN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """Term-sorted runs of ``docs(lang, source, text)``, the text as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist()):
                block.add(lang, source, text)
                if block.postings >= BLOCK_POSTINGS:
                    yield _run_batch(list(block.spill(shards)))
        yield _run_batch(list(block.spill(shards)))

    return docs.select("lang", "source", "text").mapInArrow(build, RUN)


def merged(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """``(terms, documents, place, names, source, counts)`` of all run segments of ``table``: a heap holds the next term of each
    run, so equal terms come one after the other; postings of a term and source are summed."""
    words = [t.split(b" ") for t in table.column("terms").to_pylist()]
    sizes = [np.frombuffer(s, np.int64) for s in table.column("sizes").to_pylist()]
    names = sorted(set().union(*table.column("sources").to_pylist()))
    number = {s: i for i, s in enumerate(names)}
    terms: list[bytes] = []
    places = [np.zeros(len(w), np.int64) for w in words]
    last = None
    for term, run, i in heapq.merge(*[zip(w, [r] * len(w), range(len(w))) for r, w in enumerate(words)]):
        if term != last:
            terms.append(term)
            last = term
        places[run][i] = len(terms) - 1
    documents = np.zeros(len(terms), np.int64)
    for p, d in zip(places, table.column("documents").to_pylist()):
        documents[p] += np.frombuffer(d, np.int64)
    place = np.concatenate([np.repeat(p, s) for p, s in zip(places, sizes)])
    source = np.concatenate(
        [np.array([number[n] for n in own], np.int64)[np.frombuffer(s, np.int64)] for own, s in zip(table.column("sources").to_pylist(), table.column("source").to_pylist())]
    )
    count = np.concatenate([np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()])
    order = np.lexsort((source, place))
    place, source, count = place[order], source[order], count[order]
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
    return terms, documents, place[first], names, source[first], np.add.reduceat(count, first)


def _merge_runs(table: pa.Table) -> pa.Table:
    terms, documents, place, names, source, count = merged(table)
    row = segment(table.column("lang")[0].as_py(), table.column("shard")[0].as_py(), uuid.uuid4().int >> 65, terms, documents, place, names, source, count)
    return pa.Table.from_batches([_run_batch([row])])


def _frequencies(table: pa.Table) -> pa.Table:
    terms, documents, place, names, source, count = merged(table)
    starts = np.searchsorted(place, np.arange(len(terms) + 1))
    keep = np.flatnonzero(documents >= LEAST_DOCUMENTS)
    held = [slice(a, b) for a, b in zip(starts[keep].tolist(), starts[keep + 1].tolist())]
    columns = {
        "lang": pa.array([table.column("lang")[0].as_py()] * len(keep), pa.string()),
        "term": pa.array([terms[i].decode() for i in keep.tolist()], pa.string()),
        "documents": pa.array(documents[keep], pa.int64()),
        "total": pa.array([int(count[s].sum()) for s in held], pa.int64()),
        "sources": pa.array([[names[i] for i in source[s].tolist()] for s in held], pa.list_(pa.string())),
        "counts": pa.array([count[s] for s in held], pa.list_(pa.int64())),
    }
    return pa.table(columns)


def frequencies(docs: DataFrame) -> DataFrame:
    """``(lang, term, documents, total, sources, counts)`` of every term in at least ``LEAST_DOCUMENTS`` documents of its language.

    Hash shards follow the size of the texts. Where a shard has more than ``FAN`` runs, some runs of it at a time are
    merged into longer ones first, so no task holds more than about ``FAN`` runs of one shard.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = materialised(runs(docs, max(1, -(-size // SHARD_BYTES))))
    while (most := held.groupBy("lang", "shard").count().agg(F.max("count")).first()[0] or 0) > FAN:
        some = F.pmod(F.xxhash64("run"), F.lit(-(-2 * most // FAN))).alias("some")
        held = materialised(held.groupBy("lang", "shard", some).applyInArrow(_merge_runs, RUN))
    schema = "lang string, term string, documents long, total long, sources array<string>, counts array<long>"
    return materialised(held.groupBy("lang", "shard").applyInArrow(_frequencies, schema))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / whole)``, exact for totals below 2**53: three digits of the quotient at a time."""
    rest, out = np.broadcast_arrays(count + 1, whole)[0].copy(), np.zeros(1, np.int64)
    for _ in range(3):
        high, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + high
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(groups: list[tuple[str, int]], kept: int, rows: Iterator[tuple[list[int], list[int]]], first: range, whole: bool) -> np.ndarray:
    """Sums over terms of the divergence of each source of ``first`` from each source, where ``groups`` are (source, total).

    Where a term occurs in neither source its value depends on their totals alone, and this base counts for every kept
    term (if ``whole``). Each term then adds its correction: what changes where the first source has it, where the second
    has it, and where both have it. Corrections of the first two kinds depend on the source and count only, so they are
    made once for each count; those of the third kind are streamed, a bounded number of terms at a time.
    """
    total = np.array([n for _, n in groups], np.int64) + kept
    none = shares(np.zeros(len(groups), np.int64), total) if kept else np.ones(len(groups), np.int64)
    mine = slice(first.start, first.stop)
    base = divergence(none[mine, None], none[None])
    out = base * kept if whole else np.zeros_like(base)
    single: list[Counter] = [Counter() for _ in groups]

    def both(sources: list[list[int]], counts: list[list[int]]) -> None:
        size = np.array(list(map(len, sources)), np.int64)
        source, count = np.concatenate(sources).astype(np.int64), np.concatenate(counts).astype(np.int64)
        p = shares(count, total[source])
        start = np.cumsum(size) - size
        # every posting of the first sources against all postings of its term
        term = np.repeat(np.arange(len(size)), size)
        left = np.flatnonzero((source >= first.start) & (source < first.stop))
        many = size[term[left]]
        ends = np.cumsum(many)
        for lo, hi in _cuts(ends, SUMS):
            l, m = left[lo:hi], many[lo:hi]
            a = np.repeat(l, m)
            b = np.repeat(start[term[l]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            s, t = source[a], source[b]
            change = divergence(p[a], p[b]) - divergence(p[a], none[t]) - divergence(none[s], p[b]) + divergence(none[s], none[t])
            np.add.at(out, (s - first.start, t), change)

    some: list[tuple[list[int], list[int]]] = []
    for sources, counts in rows:
        for s, c in zip(sources, counts):
            single[s][c] += 1
        some.append((sources, counts))
        if len(some) == TERMS_AT_ONCE:
            both(*map(list, zip(*some)))
            some = []
    if some:
        both(*map(list, zip(*some)))
    for s, seen in enumerate(single):
        if not seen:
            continue
        times, values = np.fromiter(seen.values(), np.int64, len(seen)), np.fromiter(seen, np.int64, len(seen))
        p = shares(values, total[s])
        for lo in range(0, len(p), TERMS_AT_ONCE):
            some_p, some_times = p[lo : lo + TERMS_AT_ONCE, None], times[lo : lo + TERMS_AT_ONCE, None]
            if s in first:
                out[s - first.start] += ((divergence(some_p, none[None]) - base[s - first.start]) * some_times).sum(axis=0)
            out[:, s] += ((divergence(none[None, mine], some_p) - base[:, s]) * some_times).sum(axis=0)
    return out


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes, with running sums ``ends``, add up to about ``most``."""
    lo = 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lo, hi
        lo = hi


def pairs(words: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two different sources of a language.

    ``words`` are frequencies, ``groups(lang, source, n, kept, n_lang)`` totals. Terms are dealt into pieces of bounded size,
    and the first sources of a language into blocks, so that no task holds more than ``SUMS`` sums (or one row of them).
    """
    terms = words.count()
    pieces = max(1, -(-terms // PIECE_TERMS))
    blocks = F.ceil(F.count("*") * F.count("*") / F.lit(SUMS)).cast("int")
    cut = groups.groupBy("lang").agg(F.least(blocks, F.count("*").cast("int")).alias("blocks"))
    every = cut.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    every = every.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    sides = groups.select("lang", "source", "n", "kept").join(every, "lang")
    dealt = words.join(cut, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "block", F.pmod(F.xxhash64("term"), F.lit(pieces)).cast("int").alias("piece"), "sources", "counts")

    def sums(key: tuple, held: pa.Table, own: pa.Table) -> pa.Table:
        lang, block, piece = (k.as_py() for k in key)
        known = sorted(zip(own.column("source").to_pylist(), own.column("n").to_pylist()))
        number = {s: i for i, (s, _) in enumerate(known)}
        n, cuts = len(known), own.column("blocks")[0].as_py()
        first = range(n * block // cuts, n * (block + 1) // cuts)
        rows = (([number[s] for s in r["sources"]], r["counts"]) for b in held.to_batches(TERMS_AT_ONCE) for r in b.to_pylist())
        out = pair_sums(known, own.column("kept")[0].as_py(), rows, first, piece == 0)
        names = [s for s, _ in known]
        told = [(names[a], names[b], int(out[a - first.start, b])) for a in first for b in range(n) if a != b]
        kinds = (pa.string(), pa.string(), pa.int64())
        columns = [pa.array([lang] * len(told), pa.string()), *[pa.array([r[i] for r in told], k) for i, k in enumerate(kinds)]]
        return pa.table(columns, names=["lang", "source", "item", "value"])

    key = ["lang", "block", "piece"]
    told = dealt.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(sums, "lang string, source string, item string, value long")
    return told.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def _share(count: str, total: str) -> str:
    return f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} + kept AS DECIMAL(20,0))"


def term_values(words: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every term that a source uses more than its language does."""
    postings = words.select("lang", "term", "total", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n_term"))).alias("at"))
    found = postings.select("lang", "term", "total", "at.source", "at.n_term").join(groups, ["lang", "source"])
    found = found.withColumns({"p": F.expr(_share("n_term", "n")), "q": F.expr(_share("total", "n_lang"))}).where("p > q")
    return found.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int | None = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every source against each other one of its language (``pair``), and the
    ``top`` terms that it uses more than its language does (``term``; all of them if ``top`` is None).

    Null languages, sources and texts are ''. Equal rows are documents of their own. A language without kept terms has
    pairs of value 0; a source alone in its language has none. An empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    words = frequencies(named.withColumn("text", F.col("text").cast("binary")))
    totals = words.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))).alias("at"))
    totals = totals.groupBy("lang", "at.source").agg(F.sum("at.n").alias("n"))
    whole = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang"))
    every = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = materialised(every.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "kept", "n_lang")]))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    near = pairs(words, groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    used = term_values(words, groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("term"))
    if top is not None:
        used = used.where(F.col("rank") <= top)
    return near.unionByName(used).select("lang", "source", "part", "item", "value", "rank")


def divergence_query(spark: SparkSession, folder: str) -> DataFrame:
    return audit(spark.read.parquet(f"{folder}/documents.parquet"))


DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d),
k AS MATERIALIZED (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
c AS MATERIALIZED (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN k USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
s AS MATERIALIZED (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS c, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
l AS (SELECT lang, t, 1 + {UNIT}::HUGEINT * (sum(c) + 1) // (sum(sum(c)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM s GROUP BY lang, t),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT s.lang, s.source, 'term', s.t, CAST((p - q) * (p - q) // q AS BIGINT) FROM s JOIN l USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM y QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
