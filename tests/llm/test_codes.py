"""Byte-level BPE, vector codes and the source audit, against a public library, brute force and SQL."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyspark.llm import bytebpe, divergence, queries, vectorcodes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.ByteBpe(RANKS, PATTERN)


@pytest.fixture(scope="module")
def plain(bpe):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


ODD = ["", " ", "a\U00012550b ՘՘x 1\U0003d027y", "=" * 3001, "日本日本日本 aaaa " * 50, "<|endoftext|> x", "a\u0085  b\x1c\x1fc", "na" * 500 + " \n\n\t x", "🙂" * 9]


def test_ids_are_those_of_the_public_library(bpe, plain, sample):
    texts = ODD + [t or "" for _, t in sample]
    assert [i.tolist() for i in bpe.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_every_code_point_is_split_alike(bpe):
    # ranks that join a last byte with what follows in the same piece show the class of a code point
    ranks = {bytes([b]): b for b in range(256)}
    for x in b"a1!":
        ranks.update({bytes([b, x]): len(ranks) + i for i, b in enumerate(range(256))})
    told = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x80, 0x40000) if not 0xD800 <= c < 0xE000]
    text = "\n".join(f"{chr(c)}a\n{chr(c)}1\n{chr(c)}!" for c in points)
    mine = [i for piece in bpe.split(text) for i in bytebpe.ranked_merge(piece.encode(), ranks)]
    assert mine == told.encode_ordinary(text)


def test_merges_by_rank_and_position(bpe, plain):
    import random

    rng = random.Random(4)
    parts = ["a", "b", "ab", "ba", "the", "he", "n", "an", "na", "  ", "=", "--", "日", "本", "é", "\x00"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    assert [i.tolist() for i in bpe.encode(words)] == [plain.encode_ordinary(w) for w in words]
    assert all(bytebpe.ranked_merge(w.encode(), bpe.ranks) == plain.encode_ordinary(w) for w in words if len(bpe.split(w)) == 1)


def test_pieces_are_forgotten_within_bounds(bpe, plain, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHED_PIECES", 20)
    small = bytebpe.ByteBpe(RANKS, PATTERN)
    for i in range(30):
        text = " ".join(f"w{j}x" for j in range(i, i + 9))
        assert small.encode([text])[0].tolist() == plain.encode_ordinary(text)
        assert len(small.known) <= 40


def test_offsets_and_split_characters(bpe, plain):
    text = "añ🙂 日本 b🙂🙂"
    ids = bpe.encode([text])[0]
    starts, ends = bpe.offsets(text, ids)
    at = 0
    for i, s, e in zip(ids.tolist(), starts.tolist(), ends.tolist()):
        raw = bpe.bytes_of[i]
        assert raw in text[s:e].encode() and len(text[:s].encode()) <= at < len(text[:e].encode())
        at += len(raw)
    assert "".join(bpe.token_texts(ids.tolist())) == bpe.decode(ids.tolist()) == text
    cut = bpe.encode(["🙂"])[0].tolist()
    assert len(cut) > 1 and bpe.decode(cut[:-1]) == "�" and bpe.token_texts(cut) == [""] * (len(cut) - 1) + ["🙂"]


def test_round_trips_of_rows(frame, plain, sample):
    rows = sample + [(i, t) for i, t in enumerate(ODD)]
    want = []
    for doc, text in rows:
        ids = plain.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    docs = frame(rows)
    assert Counter(map(tuple, bytebpe.round_trips(docs, RANKS, PATTERN).collect())) == Counter(want)
    tokens = bytebpe.encoded(docs, RANKS, PATTERN)
    assert Counter((r.doc_id, r.text) for r in bytebpe.decoded(tokens, RANKS, PATTERN).collect()) == Counter((d, t or "") for d, t in rows)
    assert bytebpe.encoded(frame([]), RANKS, PATTERN).count() == bytebpe.round_trips(frame([]), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("k, width, most, scale", [(256, 16, 200, 1), (40, 2, 4, 1), (256, 16, 2, 1), (1, 4, 9, 1), (6, 0, 1, 1), (50, 3, 9, 10**30)])
def test_search_finds_the_nearest_entry(k, width, most, scale):
    rng = np.random.default_rng(k)
    entries, points = rng.integers(-most, most + 1, (k, width)), rng.integers(-most, most + 1, (700, width))
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    kind = object if scale > 1 else float
    code, error = vectorcodes.Codebook(entries.astype(kind) * scale).nearest(points.astype(kind) * scale)
    assert code.tolist() == far.argmin(axis=1).tolist()
    assert list(map(int, error)) == [int(x) * scale * scale for x in far.min(axis=1)]


def plain_codes(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept.sort(key=key)
    vectors = [[vectorcodes._whole(float(x)) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[tuple(v[p * width // 4 : (p + 1) * width // 4]) for v in vectors] for p in range(4)]
    books = [c[:256] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda part, book: min((far(part, e), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            codes = [nearest(x, books[p])[1] for x in cut[p]]
            for e in set(codes):
                own = [x for x, c in zip(cut[p], codes) if c == e]
                books[p] = [*books[p][:e], tuple(sum(c) // len(own) for c in zip(*own)), *books[p][e + 1 :]]
    out = []
    for i, (vec, _, label) in enumerate(kept):
        found = [nearest(cut[p][i], books[p]) for p in range(4)]
        out.append((vec, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found), label))
    sums = Counter()
    for _, _, error, label in out:
        sums[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((v, c, e, sums[la], sha) for v, c, e, la in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, _label int"


def test_vectors_are_coded_as_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype("f4")], i % 3 or None) for i in range(300)]
    rows += [(i, [0.5] * 8, 7) for i in range(300, 340)] + [(5, [1.0, -1.0], 1), (None, [0.25] * 6, None), (None, [], 4)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] * 8, 1)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    assert Counter(map(tuple, vectorcodes.compressed(frame).collect())) == plain_codes(rows)


def test_vectors_few_huge_and_none(spark):
    few = [(3, [1e30, -2.5, 0.1, 7.0], 1), (2, [3e37, 1.0, 2.0, -1e-9], None)]
    frame = spark.createDataFrame([(i, np.float32(v).tolist(), la, "x", 1, 2) for i, v, la in few], VECTORS)
    assert Counter(map(tuple, vectorcodes.compressed(frame).collect())) == plain_codes([(i, np.float32(v).tolist(), la) for i, v, la in few])
    assert vectorcodes.compressed(frame.where("vec_id > 9")).count() == 0


def audited(frame):
    return Counter(map(tuple, divergence.audit(frame).collect()))


def audit_sql(frame):
    con = duckdb.connect()
    documents = frame.select("text", "lang", "source").toPandas()  # noqa: F841
    return Counter(con.execute(f"WITH documents AS (SELECT * FROM documents) {queries.ORACLES['op13_divergence'].replace('WITH d AS', 'SELECT * FROM (WITH d AS', 1)})").fetchall())


def corpus(spark, sample):
    rng = np.random.default_rng(2)
    texts = [t for _, t in sample] + ["Ab aB ab É é naïve x1y 日本", "the a of " * 400, "ab " * 5000] * 4
    langs, sources = ["xx", "yy", None], ["s1", "s2", "s3", "s4", "", None]
    rows = [(i, t, langs[rng.integers(3)], sources[rng.integers(6) if i % 3 else 0], 1, "p") for i, t in enumerate(texts)]
    rows += [(900, "once", "zz", "a", 1, "p"), (901, "more", "zz", "b", 1, "p"), (902, None, "ww", "only", 1, "p"), (903, "1 2", "xx", "bare", 1, "p")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value long, part string")


def test_audit_equals_sql(spark, sample):
    docs = corpus(spark, sample)
    assert audited(docs) == audit_sql(docs)
    assert divergence.audit(docs.where("doc_id < 0")).count() == 0


def test_audit_does_not_depend_on_its_bounds(spark, sample, monkeypatch):
    docs = corpus(spark, sample).repartition(9)
    whole = audited(docs)
    for name, small in {"FAN": 2, "BLOCK_POSTINGS": 60, "SHARD_BYTES": 4000, "PIECE_TERMS": 40, "SUMS": 12, "TERMS_AT_ONCE": 7}.items():
        monkeypatch.setattr(divergence, name, small)
    assert audited(docs) == whole


def test_shares_are_exact():
    for count, whole in [(0, 1), (0, 3), (2**52, 2**52 + 1), (10**12, 3 * 10**12 + 7), (5, 6)]:
        got = divergence.shares(np.array([count]), np.array([whole]))
        assert got.tolist() == [1 + 10**9 * (count + 1) // whole]
