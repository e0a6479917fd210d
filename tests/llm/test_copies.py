"""The pipeline's near copies against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
import numpy as np
from tallyspark.llm import copies, simhash


def plain_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def plain_groups(texts):
    sets = plain_sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a & b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def check(rows, kept):
    groups = {}
    for row, root in zip(rows, plain_groups([t for _, t in rows])):
        groups.setdefault(root, set()).add(row)
    assert len(kept) == len(set(kept)) == len(groups)
    for members in groups.values():
        (one,) = members & set(kept)
        assert one[0] == min((d for d, _ in members if d is not None), default=None)


def test_edited_copies_at_every_similarity_and_no_others_go(spark, frame, small):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    rows = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        rows.append((10 * i, " ".join(body)))
        for j in range(1, 4):
            new = body[:]
            for at in rng.sample(range(len(new)), max(1, len(new) * rng.randint(1, 4) // 100)):
                new[at] = rng.choice(words)
            rows.append((10 * i + j, " ".join(new)))
    sets = plain_sets([t for _, t in rows])
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b]
    assert sum(0.8 <= x < 0.85 for x in alike) > 5 and sum(0.7 <= x < 0.8 for x in alike) > 5
    check(rows, [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), small).collect()])


def test_copies_in_odd_rows_are_those_of_all_pairs(spark, frame, sample, small):
    check(sample, [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(sample), small).collect()])


def test_copies_in_the_given_documents_are_those_of_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()])


def test_dense_groups_and_long_texts_are_those_of_all_pairs(spark, frame, small):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    rows = []
    # most pairs of a group lie close to the threshold, so that its rounds go on; common passages make no copies
    for size, edits, n in ((160, 1, 70), (60, 3, 4), (5000, 20, 6)):
        body = [rng.choice(words) for _ in range(size)]
        for _ in range(n):
            new = body[:]
            for at in rng.sample(range(size), rng.randint(0, 2 * edits) if size < 1000 else rng.randint(20, 130)):
                new[at] = rng.choice(words)
            rows.append((len(rows), " ".join(new)))
        rows += [(len(rows) + i, " ".join(body[: size // 2] + [rng.choice(words) for _ in range(size // 4)])) for i in range(8)]
    check(rows, [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), small).collect()])


def test_fingerprints_within_three_bits_find_copies_by_themselves(spark, frame, small, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    rows = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(300)]
        new = body[:]
        for at in rng.sample(range(300), 1 + i % 3):
            new[at] = rng.choice(words)
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(new))]
    # the repeated shingle alone decides these fingerprints, and the other shingles make no copies
    rows += [(1000 + i, " ".join(["aa"] * 900 + [rng.choice(words) for _ in range(60)])) for i in range(2)]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    near = [bin(a ^ b).count("1") <= 3 for a, b in zip(prints[::2], prints[1::2])]
    assert 10 < sum(near) < 39 and near[-1]
    links = {frozenset((r.a, r.b)) for r in simhash.text_links(frame(rows)).collect()}
    ties = dict(frame(rows).selectExpr("doc_id", "xxhash64(cast(text as binary))").collect())
    assert links == {frozenset((ties[rows[2 * i][0]], ties[rows[2 * i + 1][0]])) for i, x in enumerate(near) if x}
    monkeypatch.setattr(copies, "PIVOTS", ())  # without the search by shared shingles
    out = corpus_pipeline.drop_near_duplicates(spark, frame(rows), small)
    assert {r.doc_id for r in out.collect()} == {d for d, _ in rows} - {2 * i + 1 for i, x in enumerate(near[:-1]) if x}


def test_sets_of_texts_in_several_parts_are_counted_once(spark, frame, small):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    rows = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(100)]
        other = body[:30] + [rng.choice(words) for _ in range(70 if i % 2 else 3)] + body[33:]
        rows += [(10 * i + j, sep.join(some)) for j, (sep, some) in enumerate([(" ", body), ("  ", body), ("\n", body), (" ", other), ("\t", other)])]
    check(rows, [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), small).collect()])


def test_pairs_are_verified_in_parts():
    sizes = list(range(1, 9000, 7))
    assert all(copies.level_of(n) == 0 for n in sizes if n <= 2048) and copies.level_of(2049) == 1 and copies.level_of(8193) == 3
    # the larger of two alike sets sets the level, and the smaller is stored at it
    assert all(copies.level_of(m) in {copies.level_of(n), copies.level_of(n * 5 // 4)} for n in sizes for m in range(n, n * 5 // 4 + 1, 3))


def test_crowded_buckets_of_unlike_texts_make_few_pairs(spark, frame, small, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    body = [[rng.choice(words) for _ in range(13)] for _ in range(8)]
    variants = [[[rng.choice(words) for _ in range(5)] for _ in range(2)] for _ in range(8)]
    # two texts differ in two passages or more and stay below 0.8; 64 texts share each passage, so that all shingles are common
    codes = [c for c in range(256) if bin(c).count("1") % 2 == 0]
    rows = [(c, " ".join(w for i in range(8) for w in body[i] + variants[i][c >> i & 1])) for c in codes]
    rows += [(1000 + i, t.replace(" ", " x ", 1)) for i, (_, t) in enumerate(rows[:5])]
    held, verified = [], copies.verified

    def counted(pairs, sets):
        held.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(copies, "verified", counted)
    check(rows, [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), small).collect()])
    assert sum(held) < 1500, held


def test_sketches_rule_no_alike_pair_out(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for n in (1, 2, 15, 16, 17, 31, 33, 100, 128, 129, 256, 260, 500, 513, 600, 3000):
        for m in sorted({n, n * 9 // 10, n * 4 // 5}):
            for share in (0.0, 0.5, 0.7, 0.889, 0.95, 1.0):
                a, common = rng.integers(0, 1 << 63, n, dtype=np.uint64), min(m, -(-int(share * (n + m)) // 2))
                b = np.concatenate([a[:common], rng.integers(0, 1 << 63, m - common, dtype=np.uint64)])
                pairs.append((n, m, common, copies.sketch(a).tolist(), copies.sketch(b).tolist()))
    df = spark.createDataFrame(pairs, "n_a long, n_b long, common long, sketch_a array<long>, sketch_b array<long>")
    rows = [(r, r.fits) for r in df.withColumn("fits", copies.few_differ(*(df[c] for c in ("n_a", "n_b", "sketch_a", "sketch_b")))).collect()]
    alike = [9 * r.common >= 4 * (r.n_a + r.n_b) for r, _ in rows]
    assert sum(alike) > 50 and all(fits for (_, fits), x in zip(rows, alike) if x)
    # sketches of sets up to 500 tell those that share 0.7 of their hashes or less
    far = [fits for r, fits in rows if 100 <= r.n_a <= 600 and 2 * r.common <= 0.72 * (r.n_a + r.n_b)]
    assert len(far) > 50 and not any(far)
