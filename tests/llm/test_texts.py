"""Operators that score, search and pack texts, against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import decontamination, licenses, packing, pii, quality, queries, sketches, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        yield doc, text, text[: len(text) - half] + following[:half], following


@pytest.mark.parametrize("together", [2000, 5])
def test_edited_fingerprints(frame, sample, together, monkeypatch):
    monkeypatch.setattr(sketches, "ROWS_TOGETHER", together)
    sketch = sketches.sketch
    want = [
        (d, len(t), hashlib.sha256(e.encode()).hexdigest(), sketches.encode(sketch(t)), sketches.encode(sketch(e)), sketches.resemblance(sketch(t), sketch(e)), sketches.resemblance(sketch(t), sketch(n)))
        for d, t, e, n in edits(sample)
    ]
    assert Counter(tuple(r)[:7] for r in sketches.edited_fingerprints(frame(sample)).collect()) == Counter(want)


def test_fingerprint_query_against_brute_force(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op1_fingerprints"](spark, small).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    for doc, text, edited, following in edits(rows):
        r = got.pop(doc)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(shingles, (text, edited, following))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.15 and abs(r.near_next - len(a & c) / len(a | c)) < 0.15
        assert abs(r.distinct_shingles / len(a) - 1) < 0.3
    assert not got


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(3000)]
    whole, front, back = " ".join(words), " ".join(words[:2000]), " ".join(words[1996:])
    a, b = sketches.sketch(front), sketches.sketch(back)
    assert np.array_equal(sketches.merge(a, b), sketches.sketch(whole))
    assert np.array_equal(sketches.decode(sketches.encode(a)), a)
    assert abs(sketches.containment(a, sketches.sketch(whole)) - 1) < 0.15 and abs(sketches.containment(sketches.sketch(whole), a) - 2 / 3) < 0.15
    parts = spark.createDataFrame([(1, front), (1, back), (1, back), (2, ""), (3, "a b")], "k int, text string")
    made = parts.select("k", sketches.fingerprint_column(parts.text).alias("fingerprint"))
    got = dict(map(tuple, sketches.merged(made, ["k"]).collect()))
    assert got == {1: sketches.encode(sketches.sketch(whole)), 2: "", 3: sketches.encode(sketches.sketch("a b"))}


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op5_toxicity"](spark, folder).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held_out(r.doc_id) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in tested) / len(tested) > 0.9


def test_toxicity_never_reads_held_out_labels(spark, frame):
    docs = frame([(i, ("bad awful " if i % 2 else "good kind ") + "word " * (i % 5)) for i in range(60)] + [(None, "bad"), (7, None), (8, "")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, (i % 2) ^ held_out(i)) for i in range(60)], "doc_id long, toxic int")
    score = lambda y: sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.scored(docs, toxicity.train(docs, y)).collect())
    assert score(labels) == score(turned)
    assert len(score(labels.limit(0))) == docs.count()
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    return sequences


def test_packing_query_round_trip(spark, small):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    rows = queries.QUERIES["op6_packing"](spark, small).collect()
    sequences = check_packing(rows, texts)
    assert len(sequences) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_of_odd_texts(frame, sample, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    check_packing(packing.pack(frame(sample), TOKENIZER).collect(), sample)
    assert packing.pack(frame([]), TOKENIZER).collect() == []


def test_plan_places_every_piece_once_and_fits_best():
    rng = random.Random(2)
    for capacity in (10, 64):
        counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
        free, seen = {}, Counter()
        for length, first, n, each, sequence, offset in packing.plan_slots(counts, capacity):
            for t in range(n):
                seen[length, first + t] += 1
                s = sequence + t // each
                assert capacity - free.get(s, capacity) == offset + t % each * length
                assert not any(length <= f < free.get(s, capacity) for f in free.values())
                free[s] = free.get(s, capacity) - length
        assert seen == {(n, t): 1 for n, c in counts.items() for t in range(c)} and min(free.values()) >= 0


def test_words_over_the_cache_limit(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    words, tokenizer = packing.WordIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in ("a b c", "c d e f a", "x" * 100 + " a", "a a a", "q w e r t y a b", ""):
        assert words(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_leaks_found_are_those_of_every_pair(spark, small, monkeypatch):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{small}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op7_decontamination"](spark, small).collect()}
    words = {i: decontamination.words_of(t) for i, t in items}
    assert got >= {(d, i) for d, t in docs for i, w in words.items() if b" ".join(w) in b" ".join(decontamination.words_of(t))}
    share = lambda w, t: len(set(zip(w, w[1:], w[2:])) & set(zip(t, t[1:], t[2:]))) / max(1, len(set(zip(w, w[1:], w[2:]))))
    texts = {d: decontamination.words_of(t) for d, t in docs}
    assert all(share(words[i], texts[d]) > 0.5 for d, i in got)
    # bounds skip blocks, never a leak: scoring every pair finds the same
    monkeypatch.setattr(decontamination, "SHARD_UNITS", 7)
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    again = decontamination.contaminated(spark.read.parquet(f"{small}/documents.parquet"), benchmark)
    assert {(r.doc_id, r.item_id) for r in again.collect()} == got


def test_other_items_have_no_say_in_a_leak(spark, frame):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    item, other = " ".join(word() for _ in range(12)).split(), " ".join(word() for _ in range(128))
    docs = frame([(gap, " ".join([*item[:6], *[word() for _ in range(gap)], *item[6:]])) for gap in (0, 3, 40, 100, 125, 400)])
    found = []
    for rows in ([(1, " ".join(item))], [(1, " ".join(item)), (2, other)]):
        benchmark = spark.createDataFrame(rows, "item_id long, text string")
        found.append({(r.doc_id, r.item_id, r.first_word, r.question_overlap) for r in decontamination.contaminated(docs, benchmark).collect()})
    assert found[0] == found[1] and 0 in {d for d, *_ in found[0]}


def test_leaks_in_odd_rows(spark, frame):
    item = "Which small river runs north past the old mill of grey stone? The answer is the Esk near Brampton village"
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "... !!"), (None, "one"), (5, "word " * 400)], "item_id long, text string")
    fill = "lorem ipsum dolor " * 90
    rows = [(1, fill + item.upper() + fill), (2, fill), (None, item), (3, None), (4, ""), (5, item.replace("grey", "red")), (6, item[: len(item) // 2])]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(rows), benchmark).collect()}
    assert got == {(1, 1), (None, 1), (5, 1)}
    assert decontamination.contaminated(frame([]), benchmark).collect() == []
    assert decontamination.contaminated(frame(rows), benchmark.limit(0)).collect() == []


def plain_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0, 10 <= len(d) <= 15)[k]
            out += [(m.start(), k, m.end())] * good
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    pieces = ["4539148803436467", "4539 1488 0343 6467", "+1 (988) 555-2485", "1.2.3.4", "256.1.1.1", "a.b@c.d-e.com", "x@y", "12", "@a.b", "1.2.3.4.5.6.7.8", "é", "\n", "+", "(", "-"]
    for _ in range(3000):
        text = rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randrange(7)))
        assert pii.base_spans(text) == plain_spans(text)
        text = "".join(rng.choice("a@.-+ 0149()%é\n") for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain_spans(text)


def test_pii_query_keeps_base_spans(spark, small):
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    for r in queries.QUERIES["op8_pii"](spark, small).collect():
        base = plain_spans(rows.pop(r.doc_id))
        text = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert set(text) <= set(r.spans.split(","))
    assert not rows


def test_field_carries_labels_to_alike_tokens(spark, frame):
    texts = [(i, f"call +1 (98{i % 10}) 555-24{i:02d} or mail ann{i}@mail.example.com from 10.0.{i}.7 in year {1990 + i}") for i in range(40)]
    docs = frame(texts + [(None, None), (1, ""), (2, "9" * 5000 + "@" * 50), (3, "+1 (269) 555-3296 4539148803436467 and again +1 (269) 555-3296.")])
    field = pii.train(docs)
    text = "write to +44 20 7946 0958 or short 20-7946-0958, year 2024"
    spans = field.spans(text, pii.base_spans(text))
    assert (9, 3, 25) in spans and not any(text[s:e] == "2024" for s, _, e in spans)
    got = pii.personal_data(docs, field=field)
    assert got.count() == docs.count() and pii.personal_data(docs.limit(0)).collect() == []
    masked = docs.select(pii.redacted(spark, docs.text, field).alias("t")).where("t LIKE 'call%'").first().t
    assert "@" not in masked and "[EMAIL]" in masked and "[PHONE]" in masked and "[IP]" in masked


def test_labels_reach_every_repeat_and_numbers_in_groups(spark, frame):
    texts = [(i, f"call +1 (98{i % 10}) 555-24{i:02d} or mail ann{i}@mail.example.com from 10.0.{i}.7 in year {1990 + i}, again +1 (98{i % 10}) 555-24{i:02d}") for i in range(40)]
    texts += [(100 + i, f"part {100 + i}-{3000 + i}") for i in range(2)]  # such a word alone is no phone number
    field = pii.train(frame(texts))

    def found(text):
        return [text[s:e] for s, _, e in field.spans(text, pii.base_spans(text))]

    assert found("ask 555-3296 there " * 50) == []
    assert found("+1 (269) 555-3296" + " ask 555-3296 there" * 50) == ["+1 (269) 555-3296"] + ["555-3296"] * 50
    assert found("ask 555-3296 there " * 50 + "+1 (269) 555-3296") == ["555-3296"] * 50 + ["+1 (269) 555-3296"]
    text = "write to +44 20 7946 0958 or " + "ring 7946 0958 in 2024 " * 20
    t = pii.tokens_of(text, pii.base_spans(text))
    joined = {j for i, j in [*t.skip, *t.held] if i == 0}
    groups = [i for i, (s, e) in enumerate(t.spans) if text[s:e] in ("7946", "0958")][2:]
    assert len(groups) == 40 and all(i in joined or any(a == i or b == i for a, b in t.skip) for i in groups)
    assert {i for i in groups} <= {j for _, j in t.held} | {j for i, j in t.skip if t.fixed[i]}
    assert not any(text[slice(*t.spans[j])] == "2024" for _, j in t.held)


def test_field_labels_texts_without_an_exact_pattern(spark, frame):
    rows = [(i, f"call +1 (98{i % 10}) 555-24{i:02d} in year {1990 + i}") for i in range(40)] + [(50, "ask 555-3296 in 2024"), (51, "none in 2024"), (52, None)]
    docs = frame(rows)
    field = pii.train(frame(rows[:40]))
    got = {r.doc_id: r for r in pii.personal_data(docs, field=field).collect()}
    assert (got[50].n_phone, got[50].spans) == (0, "phone:4:12") and got[51].spans == got[52].spans == ""
    masked = {r.doc_id: r.t for r in docs.select("doc_id", pii.redacted(spark, docs.text, field).alias("t")).collect()}
    assert masked[50] == "ask [PHONE] in 2024" and masked[51] == "none in 2024" and masked[52] is None


def test_messages_run_until_they_settle():
    rng = np.random.default_rng(5)
    k, n = pii.OTHER + 1, 60
    strong = np.log(np.eye(k) + 1e-3)
    field = pii.SkipChainField({}, np.zeros(k), strong, np.zeros((k, k)))
    t = pii.Tokens([(0, 1)] * n, [2] + [pii.OTHER] * (n - 1), [True] + [False] * (n - 1), [()] * n, [(i, i + 1) for i in range(n - 1)], [])
    step = np.exp(strong) / np.exp(strong).sum(1, keepdims=True)
    assert np.allclose(field.marginals(t)[-1], np.linalg.matrix_power(step, n - 1)[2], atol=1e-3)
    loops = pii.SkipChainField({}, np.zeros(k), 9 * rng.normal(size=(k, k)), 9 * rng.normal(size=(k, k)))
    t = pii.Tokens([(0, 1)] * n, [pii.OTHER] * n, [False] * n, [()] * n, [(i, i + 1) for i in range(n - 1)], [(i, j) for i in range(n) for j in range(i + 2, n, 7)])
    assert np.isfinite(loops.marginals(t)).all()


def test_messages_give_exact_marginals_on_a_chain():
    rng = np.random.default_rng(4)
    k = pii.OTHER + 1
    field = pii.SkipChainField({}, np.zeros(k), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    t = pii.Tokens([(0, 1)] * 3, [0, pii.OTHER, pii.OTHER], [True, False, False], [()] * 3, [(0, 1)], [(1, 2)])
    joint = np.exp(field.chain[0][:, None] + field.skip)
    joint /= joint.sum()
    got = field.marginals(t)
    assert np.allclose(got[1], joint.sum(1), atol=1e-3) and np.allclose(got[2], joint.sum(0), atol=1e-3)


def test_gumbel_sample_prefers_target_texts(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op9_quality"](spark, folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    keep = lambda y: np.mean([rows[d].selected for d, q in labels if q == y])
    assert len(rows) == 1000 and sum(r.selected for r in rows.values()) == 800 and keep(1) > 0.8 > 0.4 > keep(0)
    edge = sorted((r.gumbel_key for r in rows.values()), reverse=True)[799]
    assert all(r.selected == (r.gumbel_key >= edge) for r in rows.values())


def test_log_ratios_against_counts(spark, frame, sample):
    docs = frame(sample)
    rows = docs.selectExpr("coalesce(text, '') AS text", "coalesce(doc_id % 2 = 0, false) AS target")
    counts = np.zeros((2, quality.BUCKETS))
    for r in rows.collect():
        for row in ([0, 1] if r.target else [1]):
            counts[row] += np.bincount(quality.ngram_buckets(r.text), minlength=quality.BUCKETS)
    target, raw = counts
    target, raw = target + 1000 * raw / raw.sum(), raw + 1
    assert np.allclose(quality.log_ratios(rows), np.log((target + 1e-9) / target.sum()) - np.log(raw / raw.sum()))


def test_quality_of_odd_rows(spark, frame, sample):
    ids = spark.createDataFrame([(0,), (7,), (None,)], "doc_id long")
    assert quality.resampled(frame(sample), ids, keep=0.25).where("selected").count() >= len(sample) // 4
    assert quality.resampled(frame(sample), ids.limit(0)).count() == len(sample)
    assert quality.resampled(frame([]), ids).collect() == []


def test_kth_largest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 10)
    monkeypatch.setattr(quality, "BINS", 7)
    values = [1e9, -5.0, *[3.0] * 50, *[i / 7 for i in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 40, 77, 200, len(values)):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_edited_notices_line_after_line_keep_their_label(frame):
    line = "This work is licensed under a Creative Commons license\n"
    rows = [(n, "x y z " * 5 + line * n) for n in (1, 2, 3, 4, 50)] + [(100, ("licensed under a house rule " + "w " * 5) * 30), (101, "creative commons attribution " * 40)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.licenses(frame(rows)).collect()}
    assert all(got[n] == ("cc-by", 6 / 7) for n in (1, 2, 3, 4, 50))
    assert got[100] == got[101] == ("", 0.0)
    # parts of a notice far apart are no notice, though stray triples chain their diagonals
    words = licenses.NOTICES[8][1].split()
    parts = ["v " * 9 + " ".join(words[i : i + 3]) for i in range(7)]
    assert licenses.licenses(frame([(1, " ".join(parts))])).first().labels == ""


def test_license_phrases_and_notices(frame):
    mit = licenses.NOTICES[0][1]
    near = mit.replace("to any person ", "to any other living person ").replace("free of charge", "free, of charge")
    rows = [
        (1, "Under the MIT License, and under the\nmit-license; Under the MIT"),
        (2, "x " * 3000 + "CC BY-NC 4.0 cc by nc cc by nc"),
        (3, near.upper()),
        (4, mit[:40]),
        (5, None),
        (6, ""),
        (None, "Apache License, Version 2.0 éunder the mit license"),
        (7, "K under the mıt license K"),
        (7, "K under the mıt license K"),
    ]
    got = Counter(tuple(r) for r in licenses.licenses(frame(rows)).collect())
    assert got[1, 12, 2, 0, 5, "mit", "mit", 1.0] == 1
    assert got[2, 3011, 3, 3000, 3008, "cc-by-nc", "cc-by-nc", 1.0] == 1
    assert got[5, 0, 0, None, None, "", "", 0.0] == 1 and got[6, 0, 0, None, None, "", "", 0.0] == 1
    assert got[None, 9, 1, 0, 0, "apache-2", "apache-2", 1.0] == 1
    assert got[7, 6, 0, None, None, "", "", 0.0] == 2
    third = next(r for r in got if r[0] == 3)
    assert third[2:7] == (0, None, None, "", "mit") and 0.6 <= third[7] < 1
    assert next(r for r in got if r[0] == 4)[6] == ""
    assert licenses.licenses(frame([])).collect() == []


def test_licenses_of_repeated_notices_equal_sql(spark, frame):
    rng = random.Random(8)
    lines = [text for _, text in licenses.NOTICES] + ["This work is licensed under a Creative Commons license", "under the mit license", "of the software", "x y z"]
    rows = []
    for i in range(120):
        words = " ".join(rng.choice(lines[-4:] if i % 2 else lines) for _ in range(rng.randint(1, 9))).split()
        for _ in range(rng.randint(0, 1 + len(words) // 20)):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, " ".join(words)))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = Counter(duckdb.sql(licenses.LICENSE_SQL).fetchall())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert Counter(tuple(r[c] for c in names) for r in licenses.licenses(frame(rows)).collect()) == want
    # a repeated altered notice keeps its label, though its chain is long
    (row,) = licenses.licenses(frame([(1, "\n".join(lines[-4:-3] * 3))])).collect()
    assert row["labels"]
