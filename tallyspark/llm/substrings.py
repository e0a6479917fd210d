"""Repeated token windows: rolling Rabin-Karp hashes of every fixed-length window, counted in Spark."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import Powers, mix, prefix_sums, span_hashes
from tallyspark.llm.repeats import SENT, Part, alone, answered, bucket_bits, dealt, is_in, packed, sent_table, shared_names, short_keys, with_answers
from tallyspark.llm.sketches import word_bounds, word_hashes

WINDOW = 20
KEPT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
_TOKENS = Powers(0xC2B2AE3D27D4EB4F)
SEEN, LATER = 1, 2


def windows(part: Part, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, the first word of every window, and the windows' hashes, in order of document and place."""
    starts, ends = word_bounds(part.data)
    doc = np.searchsorted(part.starts, starts, side="right") - 1
    at = np.arange(max(0, len(starts) - length + 1))
    at = at[doc[at] == doc[at + length - 1]]
    return starts, ends, at, mix(span_hashes(prefix_sums(word_hashes(part.data), _TOKENS), at, at + length, _TOKENS))


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, n_spans, kept_sha256)``: words covered by a window that also starts earlier are removed.

    Windows are counted in two rounds. First every part sends a short form of its windows' hashes, and learns which occur in
    other parts as well; then only those are sent whole, with the documents they stand in, and the earliest place of each
    is kept. Overlapping windows merge into maximal removed runs (``n_spans``). Windows are compared by 64-bit hashes.

    A null text has no words; fewer words than ``length`` lose nothing. Null ids come before all others; rows that share an
    id count as documents one after the other, in an order fixed by their text. An empty table gives no rows. Other
    columns are not read.
    """
    parts, size = dealt(docs, id_col, text_col)
    bits = bucket_bits(size // 6)

    def send_short(part: Part) -> pa.Table:
        _, _, _, names = windows(part, length)
        return sent_table(packed(part.number, np.unique(names), bits, short=True))

    seen = shared_names(alone(parts, send_short, SENT), SEEN, short=True)

    def send_whole(part: Part, answers: pa.Table) -> pa.Table:
        starts, _, at, names = windows(part, length)
        known, _ = answered(answers, SEEN)
        some = is_in(short_keys(names, bits), known)
        names, first = np.unique(names[some], return_index=True)
        doc = np.searchsorted(part.starts, starts[at[some][first]], side="right") - 1
        order = np.argsort(first)
        tags = np.stack([part.keys[doc], part.ties[doc]], axis=1) if len(names) else np.zeros((0, 2), np.int64)
        return sent_table(packed(part.number, names[order], bits, tags=tags[order]))

    later = shared_names(with_answers(parts, seen, send_whole, SENT), LATER)

    def keep(part: Part, answers: pa.Table) -> pa.Table:
        starts, ends, at, names = windows(part, length)
        known, mine = answered(answers, LATER)
        _, first = np.unique(names, return_index=True)
        again = np.ones(len(names), bool)
        again[first] = False
        removed = _covered(len(starts), at[again | is_in(names, known[~mine])], length)
        bounds = np.searchsorted(starts, np.append(part.starts, len(part.data)))
        out = []
        for d, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            gone = removed[s:e]
            words = part.texts[d].split()
            n = int(gone.sum())
            if n:
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)) if n else 0
            out.append((part.ids[d], e - s, n, spans, hashlib.sha256(b" ".join(words)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])

    return with_answers(parts, later, keep, KEPT)


def substring_query(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{folder}/documents.parquet"))


SUBSTRING_SQL = f"""
WITH w AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS pos, ws FROM w),
n AS (SELECT r, pos, md5(array_to_string(ws[pos:pos + {WINDOW - 1}], ' ')) AS name FROM s),
g AS (SELECT r, pos FROM (SELECT r, pos, row_number() OVER (PARTITION BY name ORDER BY r, pos) AS k FROM n) WHERE k > 1),
p AS (SELECT DISTINCT r, unnest(range(pos, pos + {WINDOW})) AS pos FROM g),
c AS (SELECT r, count(*) AS removed, list(pos) AS gone, count(*) FILTER (WHERE lone) AS spans
      FROM (SELECT r, pos, coalesce(pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) > 1, true) AS lone FROM p) GROUP BY r),
i AS (SELECT r, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
t AS (SELECT i.r, string_agg(word, ' ' ORDER BY i.pos) AS kept FROM i ANTI JOIN p ON i.r = p.r AND i.pos = p.pos GROUP BY i.r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c ON w.r = c.r LEFT JOIN t ON w.r = t.r"""
