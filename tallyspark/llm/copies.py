"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import materialised, prepare, tasks_for, utf8
from tallyspark.llm.components import connected_components
from tallyspark.llm.repeats import PART_BYTES, bucket_bits, short_keys
from tallyspark.session import written

WIDTH = 5
SEED = 42
#: Similarity of copies as a fraction; pairs are verified in whole numbers.
OVER, UNDER = 4, 5
#: Sets that each bucket's members are held against, by round; the last round holds all that are still apart against each other.
PIVOTS = (1, 4, 32, None)
DRAWS = 1 << 30
#: Buckets of up to so many members have no pair left after the rounds with pivots; in larger ones sketches rule pairs out.
CROWD = max(p for p in PIVOTS if p)
#: Shingles of a set for each 64 bits of its sketch, and most such words of a sketch.
SKETCH_SHINGLES, SKETCH_WORDS = 16, 32
#: Shingles of a set that are held against another's at once, as a power of two.
PART_BITS = 11
SENT = "bucket int, part int, names binary, counts binary"
ANSWER = "part int, names binary, counts binary"
MARK = "tie long, first struct<last:boolean,doc_id:long,tie:long>, node long, n long, keys array<long>, places array<int>, sketch array<long>, level int, part int, s array<long>"


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles of ``text``; a shorter text is one shingle, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())), np.uint64, n))


def node_of(hashes: np.ndarray) -> int:
    """Signed 64-bit number of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def level_of(n: int) -> int:
    """Bits by which a pair whose larger set has ``n`` shingles is cut into parts."""
    return (max(0, n - 1) >> PART_BITS).bit_length()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the number of hashes by their low bits, as 64-bit words: two sets differ in as many hashes as their
    sketches do in bits, or more. The number of words is a power of two; halves folded by XOR are the shorter sketch."""
    words = min(SKETCH_WORDS, 1 << max(0, -(-len(hashes) // SKETCH_SHINGLES) - 1).bit_length())
    at = (hashes & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view("<i8")


def prefix(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared shingles among the rarest of a set, and their places in the order of rarity.

    Two alike sets have more than a share ``OVER / UNDER`` of each in common, so that the rarest of their common shingles
    is among the rarest ``n - ceil(n * OVER / UNDER) + 1`` of both, in any order that all sets follow. One that no other
    set has makes no pair.
    """
    n = len(hashes)
    first = np.lexsort((hashes, counts))[: n + OVER * n // -UNDER + 1]
    places = np.flatnonzero(counts[first] > 1)
    return hashes[first[places]], places


def _short_counts(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many of the sets each shingle is, by its leading ``bits`` and 32 more: what is told of it between tasks."""
    return np.unique(short_keys(np.concatenate([np.zeros(0, np.uint64), *sets]), bits), return_counts=True)


def _distinct_sets(table: pa.Table) -> dict[int, np.ndarray]:
    sets = (shingles(t) for t in table.column("text").to_pylist())
    return {node_of(s): s for s in sets}


def _sending(bits: int):
    def send(table: pa.Table) -> pa.Table:
        names, counts = _short_counts(list(_distinct_sets(table).values()), bits)
        bucket = (names >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(0, np.int64)
        cuts = list(zip(edges.tolist(), edges[1:].tolist()))
        part = table.column("part")[0].as_py()
        columns = [
            pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()),
            pa.array([part] * len(cuts), pa.int32()),
            pa.array([(names[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for a, b in cuts], pa.binary()),
            pa.array([counts[a:b].astype("<u4").tobytes() for a, b in cuts], pa.binary()),
        ]
        return pa.table(columns, names=["bucket", "part", "names", "counts"])

    return send


def _count_bucket(table: pa.Table) -> pa.Table:
    """For each part the names of it that are in several sets, with the number of sets over all parts."""
    bucket = np.uint64(table.column("bucket")[0].as_py())
    names = [np.frombuffer(n, "<u4") for n in table.column("names").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(np.concatenate(names), kind="stable")
    name = np.concatenate(names)[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    total = np.zeros(len(name), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(name))))
    out, at = [], 0
    for part, own in zip(table.column("part").to_pylist(), names):
        here = total[at : at + len(own)]
        at += len(own)
        several = here > 1
        if several.any():
            full = own[several].astype(np.uint64) | bucket << np.uint64(32)
            out.append((part, full.astype("<u8").tobytes(), here[several].astype("<u8").tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "names", "counts"])


def _marking(bits: int):
    def mark(table: pa.Table, told: pa.Table) -> pa.Table:
        names = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(n, "<u8") for n in told.column("names").to_pylist()]])
        counts = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(c, "<u8") for c in told.column("counts").to_pylist()]])
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        rows, seen = [], set()
        for tie, first, text in zip(*(table.column(c).to_pylist() for c in ("tie", "first", "text"))):
            s = shingles(text)
            node = node_of(s)
            many = np.ones(len(s), np.uint64)
            if len(names) and len(s):
                short = short_keys(s, bits)
                at = np.minimum(np.searchsorted(names, short), len(names) - 1)
                known = names[at] == short
                many[known] = counts[at[known]]
            keys, places = prefix(s, many)
            rows.append((tie, first, node, len(s), keys.view(np.int64), places.astype(np.int32), sketch(s) if len(keys) else None, None, None, None))
            if len(keys) and node not in seen:
                seen.add(node)
                for level in {level_of(len(s)), level_of(len(s) * UNDER // OVER)}:
                    part = (s >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(s), np.int64)
                    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
                    rows += [(tie, None, node, len(s), None, None, None, level, int(part[a]), s[a:b].view(np.int64)) for a, b in zip(edges, edges[1:])]
        first = pa.struct([("last", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64())])
        kinds = (pa.int64(), first, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        columns = ["tie", "first", "node", "n", "keys", "places", "sketch", "level", "part", "s"]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=columns)

    return mark


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each different text, with its set's number, size, rare shared shingles and first row; and the sets of those
    that have any, in parts.

    Texts are shuffled once by hash (repeated ones meet a task's own copies before that) and once into parts of a few
    megabytes. Each part tells every bucket of shingles in how many of its sets they are, and hears of those in several.
    """
    spark = docs.sparkSession
    text = utf8(F.col(f"`{text_col}`"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = bucket_bits(size // 4)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    texts = rows.groupBy("tie").agg(F.min(order).alias("first"), F.first("text").alias("text"))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(parts)).cast("int")).groupBy("part")
    told = dealt.applyInArrow(_sending(bits), SENT).groupBy("bucket").applyInArrow(_count_bucket, ANSWER)
    return dealt.cogroup(told.groupBy("part")).applyInArrow(_marking(bits), MARK)


def near(n_a: Column, n_b: Column, place_a: Column, place_b: Column) -> Column:
    """Whether sets of these sizes can be alike, and can be if their rarest common shingle has these places."""
    common = F.least(n_a - place_a, n_b - place_b)
    return (UNDER * F.least(n_a, n_b) >= OVER * F.greatest(n_a, n_b)) & ((OVER + UNDER) * common >= OVER * (n_a + n_b))


def few_differ(n_a: Column, n_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Whether sets of these sizes can be alike with these sketches, whose bits differ in no more places than the sets do.
    Sets of near sizes have as many words or twice as many. One without a sketch can be alike."""

    def folded(a: Column, b: Column) -> Column:
        half = F.size(b)
        return F.when(F.size(a) > half, F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)

    bits = F.zip_with(folded(sketch_a, sketch_b), folded(sketch_b, sketch_a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return F.coalesce((OVER + UNDER) * differ <= (UNDER - OVER) * (n_a + n_b), F.lit(True))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of ``pairs(u, v, n_u, n_v)`` that are alike: common shingles are counted part by part."""
    most = F.greatest("n_u", "n_v")
    level = F.when(most <= 1 << PART_BITS, 0).otherwise(F.length(F.bin(F.shiftright(most - 1, PART_BITS))))
    cut = pairs.withColumn("level", level).withColumn("part", F.explode(F.expr("sequence(0, shiftleft(1, level) - 1)")))
    left = sets.select(F.col("node").alias("u"), "level", "part", F.col("s").alias("a"))
    right = sets.select(F.col("node").alias("v"), "level", "part", F.col("s").alias("b"))
    both = cut.join(left, ["u", "level", "part"]).join(right, ["v", "level", "part"])
    counted = both.select("u", "v", "n_u", "n_v", F.size(F.array_intersect("a", "b")).alias("common"))
    alike = (OVER + UNDER) * F.sum("common") >= OVER * (F.col("n_u") + F.col("n_v"))
    return counted.groupBy("u", "v", "n_u", "n_v").agg(alike.alias("alike")).where("alike").select("u", "v")


def _distinct_parts(found: DataFrame) -> DataFrame:
    """The stored sets, each once: those that several parts stored are the one of the smallest text hash. The sets stay in
    the tasks that made them, as few are stored twice."""
    stored = found.where(F.col("level").isNotNull())
    owners = written(stored.groupBy("node").agg(F.min("tie").alias("owner"), F.max("tie").alias("most")).where("owner < most").select("node", "owner"))
    return stored.join(owners, "node", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("tie"))).select("node", "level", "part", "s")


def _pairs_of_texts(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs ``(u, v, n_u, n_v)`` of the sets of ``candidates(a, b)``, text hashes, whose sizes let them be alike."""
    texts = found.where(F.col("level").isNull()).select("tie", F.struct("node", "n").alias("end"))
    ends = [texts.select(F.col("tie").alias(c), F.col("end").alias(f"end_{c}")) for c in ("a", "b")]
    both = candidates.join(ends[0], "a").join(ends[1], "b").select(F.least("end_a", "end_b").alias("x"), F.greatest("end_a", "end_b").alias("y"))
    pairs = both.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.n").alias("n_u"), F.col("y.n").alias("n_v"))
    return pairs.where((F.col("u") != F.col("v")) & near(F.col("n_u"), F.col("n_v"), F.lit(0), F.lit(0))).distinct()


def _with_sketches(entries: DataFrame, found: DataFrame, tasks: int) -> DataFrame:
    """Members of buckets, those of crowded ones with the sketch of their set. Few buckets are crowded, so the others' rows stay short."""
    crowded = entries.where(F.col("size") > CROWD)
    nodes = crowded.select("node").distinct()
    known = found.where(F.size("keys") > 0).select("node", "sketch").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
    crowded = materialised(crowded.join(known, "node").select(*entries.columns, "sketch").coalesce(tasks))
    rest = entries.where(F.col("size") <= CROWD).withColumn("sketch", F.lit(None).cast("array<long>"))
    return rest.unionByName(crowded).coalesce(tasks)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: DataFrame | None = None) -> DataFrame:
    """``(doc_id, tie)`` of one row of each group of chained copies: the smallest id (null last), then the smallest text hash.

    Pairs of text hashes ``candidates(a, b)``, as SimHash finds them, are verified and joined before the first round, which
    then has only what they leave apart to look for. Equal sets are folded first. Sets that share one of their rare shingles are in one bucket; sizes and the place of the
    shingle rule most pairs out before their sets are looked at, in crowded buckets sketches of the sets most others. In each
    round the members of a bucket that are not yet in one group are held against a few of them: first against the smallest,
    then against some drawn by hash (all, if the bucket is not crowded), at last whatever is outside of a crowded bucket's
    largest group against all of it. A group of many copies is joined after few rounds,
    so its pairs are never listed, and no pair that could join two groups is left out.
    """
    prepare(docs.sparkSession)
    found = materialised(marked(docs, id_col, text_col))
    heads = found.where(F.col("level").isNull()).groupBy("node").agg(F.min("first").alias("first"))
    sets = _distinct_parts(found)
    at = found.where(F.size("keys") > 0).select("node", "n", F.explode(F.arrays_zip("keys", "places")).alias("at"))
    entries = at.select(F.col("at.keys").alias("bucket"), "node", "n", F.col("at.places").alias("place")).dropDuplicates(["bucket", "node"])
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    entries = materialised(entries.join(sizes, "bucket"))
    tasks = tasks_for(entries.count())
    entries = _with_sketches(entries, found, tasks)

    links = roots = None
    if candidates is not None:
        links = materialised(verified(_pairs_of_texts(found, candidates), sets).coalesce(tasks))
        roots = connected_components(links)
    for few in PIVOTS:
        held = entries if few else entries.where(F.col("size") > CROWD)
        state = held.withColumn("root", F.col("node")) if roots is None else held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = state.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.mode("root").alias("major")).where("lo < hi")
        state = materialised(state.join(apart.select("bucket", "major"), "bucket").coalesce(tasks))
        if state.isEmpty():
            break
        if few == 1:
            chosen = F.col("node") == F.col("least")
        elif few:
            chosen = F.pmod(F.xxhash64("node"), F.lit(DRAWS)) * F.col("size") < few * DRAWS
        else:
            chosen = F.col("root") != F.col("major")
        pivots, others = (
            some.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "place", "sketch", "root")]) for x, some in (("a", state.where(chosen)), ("b", state))
        )
        fits = near(F.col("n_a"), F.col("n_b"), F.col("place_a"), F.col("place_b"))
        fits = fits & few_differ(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"))
        pairs = pivots.join(others, "bucket").where((F.col("root_a") != F.col("root_b")) & fits)
        ends = [F.struct(F.col(f"node_{x}").alias("node"), F.col(f"n_{x}").alias("n")) for x in "ab"]
        pairs = pairs.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
        pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.n").alias("n_u"), F.col("y.n").alias("n_v")).distinct()
        new = materialised(verified(pairs.coalesce(tasks), sets).coalesce(tasks))
        links = new if links is None else links.union(new)
        roots = connected_components(links)
    grouped = heads if roots is None else heads.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node"))
    return grouped.groupBy("node").agg(F.min("first").alias("first")).select("first.doc_id", "first.tie")
