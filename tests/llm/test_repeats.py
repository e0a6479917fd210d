"""Operators that find repeated strings, windows and near-duplicates, against brute force."""

import hashlib
from collections import Counter

import duckdb
import pytest
import xxhash
from oracle import connect, difference

from tallyspark.llm import queries, repeats, simhash, substrings, suffixes


def kept_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [6, 60, 400])
def test_every_byte_of_a_repeated_string_goes(frame, sample, length, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 4000)
    got = [tuple(r) for r in suffixes.deduplicated(frame(sample), length=length).collect()]
    assert Counter(got) == Counter(kept_bytes(sample, length))


@pytest.mark.parametrize("length", [1, 25, 26, 72, 73, 400, 1000])
def test_cover_has_every_difference(length):
    modulus, cover = suffixes.difference_cover(length)
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))
    assert modulus <= max(1, length // 2)


def kept_words(rows, length):
    def key(r):
        return (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63))

    seen, out = set(), []
    for doc, text in sorted(rows, key=key):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [1, 4, 20])
def test_later_windows_go(frame, sample, length, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 4000)
    got = [tuple(r) for r in substrings.deduplicated(frame(sample), length=length).collect()]
    assert Counter(got) == Counter(kept_words(sample, length))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(rows, radius):
    """Fingerprint and group number of every row."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [(prints[i], find(i)) for i in range(len(rows))]


def plain_components(rows, radius):
    roots = plain_roots(rows, radius)
    ids = {}
    for (doc, _), (_, root) in zip(rows, roots):
        ids.setdefault(root, []).append(doc)
    least = {r: min((d for d in docs if d is not None), default=None) for r, docs in ids.items()}
    return [(doc, f - (1 << 64) * (f >> 63), least[root]) for (doc, _), (f, root) in zip(rows, roots)]


@pytest.mark.parametrize("radius,crowded", [(3, 50_000), (3, 2), (12, 3)])
def test_components_are_those_of_all_pairs(frame, sample, radius, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    masks = 3 if radius == 3 else 5
    got = [tuple(r) for r in simhash.near_duplicates(frame(sample), radius=min(radius, masks)).collect()]
    assert Counter(got) == Counter(plain_components(sample, min(radius, masks)))


def test_masks_leave_out_any_positions_within_the_radius():
    from itertools import combinations

    masks = simhash.covering_masks(3)
    assert all(any(not (m >> a | m >> b | m >> c) & 1 for m in masks) for a, b, c in combinations(range(64), 3))


def test_chains_and_dense_groups_keep_their_links():
    import numpy as np

    values = np.array([0, 1, 3, 7, 15, 31, 63, 127, 3 << 40, (3 << 40) + 1, -1], np.int64)
    edges = simhash.links_within(values, 1)
    assert len(edges) == 8 and {frozenset(e) for e in edges} >= {frozenset((3 << 40, (3 << 40) + 1))}


def test_one_row_of_each_component_is_kept(frame, sample):
    kept = simhash.representatives(frame(sample)).collect()
    assert len(kept) == len({root for _, root in plain_roots(sample, 3)})


@pytest.mark.parametrize("work", [suffixes.deduplicated, substrings.deduplicated, simhash.near_duplicates, simhash.representatives])
def test_empty_tables_give_no_rows(frame, work):
    assert work(frame([])).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, small, name):
    assert difference(connect(small), queries.QUERIES[name](spark, small), queries.ORACLES[name]) == ""


def test_simhash_query_against_all_pairs(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op3_simhash"](spark, small).collect()}
    assert got == {(d, f % (1 << 64), c) for d, f, c in plain_components(rows, 3)}
