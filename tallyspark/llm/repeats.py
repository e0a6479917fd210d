"""Which 64-bit names occur in more than one part of a corpus, found bucket by bucket.

Documents are dealt into parts of a few megabytes. Every part sends its distinct names, cut by bucket (leading bits of the
name) into packed arrays; every bucket is sorted by itself, in bounded memory, and answers each part with those of its
names that other parts have too. Rows stay few and large, and a name that fills half the corpus still sends one entry per part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, utf8

PART_BYTES = 4 << 20
BUCKET_NAMES = 1 << 20
SENT = "bucket int, part int, names binary, tags binary, runs binary"
ANSWER = "part int, stage int, names binary, mine binary"
_SENT_NAMES = ["bucket", "part", "names", "tags", "runs"]
_ANSWER_NAMES = ["part", "stage", "names", "mine"]


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows ``(part, doc_id, tie, data)`` and the bytes of all texts. ``tie`` orders rows that share an id.

    Parts are dealt by id and text, so neither a hot id nor null ids crowd one part; the number of parts grows with the data.
    """
    spark = prepare(docs.sparkSession)
    data = utf8(F.col(f"`{text_col}`"))
    size = docs.agg(F.sum(F.octet_length(data))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), data.alias("data")).withColumn("tie", F.xxhash64("data"))
    part = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("int")
    return rows.select(part.alias("part"), "doc_id", "tie", "data"), size


def bucket_bits(names: int) -> int:
    """Leading bits that cut so many names into buckets of about ``BUCKET_NAMES``."""
    return max(4, (max(1, names) // BUCKET_NAMES).bit_length())


class Part:
    """The documents of a part, in order of id, as one array of bytes with a blank after each."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        keys = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        ties = table.column("tie").to_numpy()
        order = np.lexsort((ties, keys))
        texts = table.column("data").to_pylist()
        self.number = table.column("part")[0].as_py() if len(table) else 0
        self.ids = [ids[int(i)].as_py() for i in order]
        self.keys, self.ties = keys[order], ties[order]
        self.texts = [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1].astype(np.int64)
        self.data = np.frombuffer(b" ".join(self.texts) + b" ", np.uint8)


def packed(part: int, names: np.ndarray, bits: int, short: bool = False, tags: np.ndarray | None = None) -> list[tuple]:
    """Rows to send: ``names`` (distinct) cut by their leading ``bits``; with ``short`` only 32 more bits of each.

    ``tags`` is a row of two numbers for each name, the same for long stretches of them; it is sent in runs.
    """
    bucket = (names >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, names = bucket[order], names[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
        if s == e:
            continue
        here = names[s:e]
        values = (here & np.uint64(0xFFFFFFFF)).astype("<u4") if short else here.astype("<u8")
        tag = run = b""
        if tags is not None:
            t = tags[order[s:e]]
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]).any(axis=1)]))
            tag, run = t[first].astype("<i8").tobytes(), np.diff(np.append(first, e - s)).astype("<i4").tobytes()
        rows.append((int(bucket[s]), part, values.tobytes(), tag, run))
    return rows


def sent_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_SENT_NAMES)


def short_keys(names: np.ndarray, bits: int) -> np.ndarray:
    """What ``packed(short=True)`` tells of a name: its leading bits and its last 32."""
    return (names >> np.uint64(64 - bits)) << np.uint64(32) | (names & np.uint64(0xFFFFFFFF))


def shared_names(sent: DataFrame, stage: int, short: bool = False) -> DataFrame:
    """Answers ``(part, stage, names, mine)``: the names of a part that other parts have too, and those of them for which
    it comes first (by tag if tags were sent, else by part number). One bucket is sorted at a time."""

    def settle(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, blobs, tags, runs = 0, [], [], [], []
        for b in group:
            for k, p, n, t, r in zip(*(b.column(c).to_pylist() for c in _SENT_NAMES)):
                bucket = k
                parts.append(p)
                blobs.append(np.frombuffer(n, "<u4" if short else "<u8"))
                if t:
                    tags.append(np.repeat(np.frombuffer(t, "<i8").reshape(-1, 2), np.frombuffer(r, "<i4"), axis=0))
        values = np.concatenate(blobs)
        owner = np.repeat(np.array(parts, np.int64), [len(b) for b in blobs])
        if tags:
            tag = np.concatenate(tags)
            order = np.lexsort((owner, tag[:, 1], tag[:, 0], values))
        else:
            order = np.lexsort((owner, values))
        values, owner = values[order], owner[order]
        same = values[1:] == values[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        first = shared & np.concatenate([[True], ~same])
        full = values.astype(np.uint64) | (np.uint64(bucket) << np.uint64(32)) if short else values
        full, owner, first = full[shared], owner[shared], first[shared]
        order = np.argsort(owner, kind="stable")
        full, owner, first = full[order], owner[order], first[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        out = []
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)]):
            if s < e:
                out.append((int(owner[s]), stage, full[s:e].astype("<u8").tobytes(), np.packbits(first[s:e]).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=_ANSWER_NAMES)

    return sent.groupBy("bucket").applyInArrow(settle, ANSWER)


def answered(answers: pa.Table, stage: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names that the answers of a stage hold, and for each whether this part comes first."""
    names, mine = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for s, n, m in zip(*(answers.column(c).to_pylist() for c in ("stage", "names", "mine"))):
        if s == stage:
            names.append(np.frombuffer(n, "<u8"))
            mine.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(names[-1])).astype(bool))
    names, mine = np.concatenate(names), np.concatenate(mine)
    order = np.argsort(names)
    return names[order], mine[order]


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def with_answers(parts: DataFrame, answers: DataFrame, work: Callable[[Part, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(part, answers of the part)`` for every part; the dealt documents are shuffled once for all such steps."""

    def each(docs: pa.Table, told: pa.Table) -> pa.Table:
        return work(Part(docs), told)

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(each, schema)


def alone(parts: DataFrame, work: Callable[[Part], pa.Table], schema: str) -> DataFrame:
    def each(docs: pa.Table) -> pa.Table:
        return work(Part(docs))

    return parts.groupBy("part").applyInArrow(each, schema)
