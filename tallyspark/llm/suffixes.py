"""Repeated byte strings: blockwise suffix sorting to a fixed depth over a difference cover."""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import Powers, mix, prefix_sums, span_hashes
from tallyspark.llm.repeats import SENT, Part, alone, answered, bucket_bits, dealt, is_in, packed, sent_table, shared_names, short_keys, with_answers
from tallyspark.llm.sketches import BYTE_VALUES

LENGTH = 400
MARKED = 64  # one suffix in so many is a mark
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_POWERS = Powers(0x8EBC6AF09C88C6E3)
SAMPLES, STRETCHES, SUFFIXES = 1, 2, 3


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """A modulus of at most half of ``length`` and residues whose differences cover it.

    The residues are the partial sums of Colbourn and Ling's six runs of steps; 1 and residue 0 for a short length.
    """
    r = -1
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= length // 2:
        r += 1
    if r < 0:
        return 1, np.zeros(1, np.int64)
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.array(list(accumulate(steps, initial=0)), np.int64)


class Suffixes:
    """The suffixes of a part's documents, to a depth of ``length`` bytes, and what decides whether one is repeated.

    Two equal strings of ``length`` bytes have a shift below the cover's modulus at which both are sampled, and the sampled
    strings of ``length - modulus + 1`` bytes there are equal. So only a suffix near a repeated sample can be repeated.
    """

    def __init__(self, part: Part, length: int):
        self.part, self.length = part, length
        self.modulus, cover = difference_cover(length)
        self.sums = prefix_sums(BYTE_VALUES[part.data], _POWERS)
        n = len(part.data)
        doc = np.repeat(np.arange(len(part.sizes)), part.sizes + 1)
        self.place = np.arange(n) - part.starts[doc]
        self.left = part.sizes[doc] - self.place  # bytes to the end of the document
        sampled = np.zeros(self.modulus, bool)
        sampled[cover] = True
        self.depth = length - self.modulus + 1
        self.samples = np.flatnonzero(sampled[self.place % self.modulus] & (self.left >= self.depth))

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(span_hashes(self.sums, starts, ends, _POWERS))

    def sample_names(self) -> np.ndarray:
        return self.names(self.samples, self.samples + self.depth)

    def candidates(self, shared: np.ndarray, bits: int) -> np.ndarray:
        """Starts of the suffixes with a repeated sample less than the modulus ahead."""
        names = self.sample_names()
        ranks, rank, times = np.unique(names, return_inverse=True, return_counts=True)
        repeated = (is_in(short_keys(ranks, bits), shared) | (times > 1))[rank]
        near = np.zeros(len(self.place) + 1, np.int64)
        np.add.at(near, np.maximum(self.samples[repeated] - self.modulus + 1, 0), 1)
        np.add.at(near, self.samples[repeated] + 1, -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= self.length))

    def stretches(self, starts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of candidates from one mark to the next, both included, with the names of all bytes their suffixes reach.

        A mark is chosen by its own ``length`` bytes, so equal texts are cut alike.
        """
        marks = np.flatnonzero(mix(names) % np.uint64(MARKED) == 0)
        run = np.cumsum(np.concatenate([[0], (np.diff(starts) != 1).astype(np.int64)])) if len(starts) else starts
        a, b = marks[:-1], marks[1:]
        joined = run[a] == run[b]
        a, b = a[joined], b[joined]
        span = self.names(starts[a], starts[b] + self.length) + (b - a).astype(np.uint64)
        return a, b, mix(span)


def _inside(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a run from ``a`` to ``b``, both included."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, a, 1)
    np.add.at(steps, b + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _settled(s: Suffixes, answers: pa.Table, bits: int):
    """Candidate starts and names, which of them lie in a repeated stretch, and which must be sorted for all others' sake."""
    starts = s.candidates(answered(answers, SAMPLES)[0], bits)
    names = s.names(starts, starts + s.length)
    a, b, spans = s.stretches(starts, names)
    shared, mine = answered(answers, STRETCHES)
    found, first, which, times = np.unique(spans, return_index=True, return_inverse=True, return_counts=True)
    elsewhere = is_in(found, shared)
    repeated = elsewhere | (times > 1)
    settled = _inside(len(starts), a[repeated[which]], b[repeated[which]])
    speaks = first[repeated & (~elsewhere | is_in(found, shared[mine]))]
    return starts, names, settled, _inside(len(starts), a[speaks], b[speaks])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``: every byte of a ``length``-byte string that starts anywhere
    else as well is removed.

    1. Samples at the difference cover are named and ranked, bucket by bucket; one that occurs once has no rank. Suffixes
       without a ranked sample ahead are unique and never sorted.
    2. Long ties are resolved by rank first: stretches between marked suffixes are ranked in the same way, and all suffixes
       in a repeated stretch are settled at once. One place of each repeated stretch speaks for all of them.
    3. The suffixes left, and those that speak, are sorted to ``length`` bytes, one bucket at a time, by 64-bit names of
       their bytes. Neighbours with the same name are repeated.

    Documents are shuffled once; a task holds a part of a few megabytes or one bucket. A null text is empty; texts shorter
    than ``length`` lose nothing; rows that share an id, or are equal, count as different documents; an empty table gives
    no rows. Other columns are not read.
    """
    parts, size = dealt(docs, id_col, text_col)
    sample_bits, bits = bucket_bits(size // 10), bucket_bits(size // 4)

    def send_samples(part: Part) -> pa.Table:
        return sent_table(packed(part.number, np.unique(Suffixes(part, length).sample_names()), sample_bits, short=True))

    samples = shared_names(alone(parts, send_samples, SENT), SAMPLES, short=True)

    def send_stretches(part: Part, answers: pa.Table) -> pa.Table:
        s = Suffixes(part, length)
        starts = s.candidates(answered(answers, SAMPLES)[0], sample_bits)
        _, _, spans = s.stretches(starts, s.names(starts, starts + length))
        return sent_table(packed(part.number, np.unique(spans), bits))

    stretches = shared_names(with_answers(parts, samples, send_stretches, SENT), STRETCHES)
    told = samples.unionByName(stretches)

    def send_suffixes(part: Part, answers: pa.Table) -> pa.Table:
        _, names, settled, speaks = _settled(Suffixes(part, length), answers, sample_bits)
        return sent_table(packed(part.number, np.unique(names[~settled | speaks]), bits))

    suffixes = shared_names(with_answers(parts, told, send_suffixes, SENT), SUFFIXES)

    def keep(part: Part, answers: pa.Table) -> pa.Table:
        starts, names, settled, _ = _settled(Suffixes(part, length), answers, sample_bits)
        _, which, times = np.unique(names, return_inverse=True, return_counts=True)
        repeated = settled | (times[which] > 1) | is_in(names, answered(answers, SUFFIXES)[0])
        at = starts[repeated]
        removed = _inside(len(part.data), at, at + length - 1).view(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], removed, [0]])))
        out, e = [], 0
        for doc, text, n, start in zip(part.ids, part.texts, part.sizes.tolist(), part.starts.tolist()):
            gone, spans, kept, last = 0, 0, hashlib.sha256(), 0
            while e < len(edges) and edges[e] < start + n:
                a, b = int(edges[e]) - start, int(edges[e + 1]) - start
                kept.update(text[last:a])
                gone, spans, last, e = gone + b - a, spans + 1, b, e + 2
            kept.update(text[last:])
            out.append((doc, n, gone, spans, kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_answers(parts, told.unionByName(suffixes), keep, KEPT)


def suffix_query(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{folder}/documents.parquet"))


SUFFIX_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS x FROM d),
n AS (SELECT r, x, md5(substr(h, CAST(2 * x + 1 AS BIGINT), {2 * LENGTH})) AS name FROM s),
g AS (SELECT r, x FROM (SELECT r, x, count(*) OVER (PARTITION BY name) AS k FROM n) WHERE k > 1),
e AS (SELECT r, x, x - lag(x) OVER (PARTITION BY r ORDER BY x) AS gap FROM g),
i AS (SELECT r, x, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY x) AS k FROM e),
m AS (SELECT r, k, min(x) AS a, max(x) + {LENGTH} AS b FROM i GROUP BY r, k),
k AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM m
      UNION ALL SELECT r, max(b), NULL FROM m GROUP BY r),
t AS (SELECT k.r, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, length(h)) - a) AS BIGINT)), '' ORDER BY a) AS kept
      FROM k JOIN d ON k.r = d.r GROUP BY k.r),
c AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM m GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r"""
