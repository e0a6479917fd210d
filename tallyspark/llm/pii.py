"""Personal data: exact patterns, and a skip-chain conditional random field that carries their labels to similar tokens."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)  # the label of tokens that are no personal data
SAMPLE = 3000  # documents with a digit or an at sign that the field is trained on
SETTLED = 1e-4  # messages that move less have settled
CERTAIN = 0.9
SMOOTHING = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at each later one, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MARKED = re.compile(r"[^\s]*[0-9@][^\s]*")

Span = tuple[int, int, int]  # start, kind number, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: all local characters before it that no earlier match took, and a dotted name after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        else:
            end = max(end, at)
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by start and then kind; leftmost and not overlapping within a kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


@dataclass
class Tokens:
    """Tokens with a digit or an at sign, their labels by the exact patterns, and the edges between them."""

    spans: list[tuple[int, int]]
    labels: list[int]
    fixed: list[bool]
    features: list[tuple[str, ...]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]  # from the last alike token
    held: Sequence[tuple[int, int]] = ()  # from the first alike token that an exact pattern holds; not counted in training


def _features(word: str, before: str, after: str) -> tuple[str, ...]:
    digits = _NOT_DIGIT.sub("", word)
    n = len(digits)
    size = str(n) if n < 5 else "5-7" if n < 8 else "8-13" if n < 14 else "14-19" if n < 20 else "20+"
    parts = word.strip(".,;:!?\"'()[]").split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    return (
        f"digits={size}",
        f"at={min(word.count('@'), 2)}",
        f"dots={min(word.count('.'), 4)}",
        f"hyphen={'-' in word}",
        f"plus={word.startswith('+')}",
        f"bracket={'(' in word or ')' in word}",
        f"letters={any(c.isalpha() for c in word)}",
        f"quad={quad}",
        f"luhn={14 <= n <= 19 and luhn(digits)}",
        f"before={'plus' if before.startswith('+') else 'bracket' if before.endswith(')') else 'digit' if before[-1:].isdigit() else '-'}",
        f"after={'bracket' if after.startswith('(') else 'digit' if after[:1].isdigit() else '-'}",
    )


def _keys(word: str) -> set[str]:
    """Tokens with a key in common are alike: the same word, the same last digits, or a mail name."""
    out = set()
    digits = _NOT_DIGIT.sub("", word)
    if len(digits) >= 7:
        out.add("d:" + digits[-7:])
    plain = word.strip(".,;:!?\"'()[]<>").lower()
    if len(plain) >= 4:
        out.add("w:" + plain)
    if "@" in plain:
        out.add("w:" + plain.split("@")[0])
    return out


def _number_edges(text: str, base: list[Span], t: Tokens) -> Iterator[tuple[int, int]]:
    """Edges from the first token of an exact number (7 digits or more) to the tokens that spell its end in groups.

    The digits of neighbouring tokens without letters are one row; where the row up to a token ends like a number, the
    tokens within the common end are joined to it.
    """
    numbers: dict[str, tuple[str, int]] = {}
    i = 0
    for s, kind, e in base:
        digits = _NOT_DIGIT.sub("", text[s:e])
        while i < len(t.spans) and t.spans[i][1] <= s:
            i += 1
        if kind and len(digits) >= 7 and i < len(t.spans):
            numbers.setdefault(digits[-7:], (digits, i))
    if not numbers:
        return
    words = [text[s:e] for s, e in t.spans]
    plain = [not any(c.isalpha() or c == "@" for c in w) for w in words]
    joined = {j for i, j in t.chain if plain[i] and plain[j]}
    i = 0
    while i < len(words):
        stop = i + 1
        while stop in joined:
            stop += 1
        parts = [_NOT_DIGIT.sub("", w) if plain[i] else "" for w in words[i:stop]]
        row, end, starts = "".join(parts), 0, []
        for j, part in enumerate(parts):
            starts.append(end)
            end += len(part)
            if end >= 7 and row[end - 7 : end] in numbers:
                digits, first = numbers[row[end - 7 : end]]
                same = 7
                while same < min(end, len(digits)) and row[end - same - 1] == digits[-same - 1]:
                    same += 1
                while j >= 0 and starts[j] >= end - same:
                    yield first, i + j
                    j -= 1
        i = stop


def tokens_of(text: str, base: list[Span]) -> Tokens:
    out = Tokens([], [], [], [], [], [])
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    keys: list[set[str]] = []
    at = 0
    for m in _MARKED.finditer(text):
        s, e = m.span()
        word, i = m.group(), len(out.spans)
        while at < len(base) and base[at][2] <= s and all(b[2] <= s for b in base[at : at + 4]):
            at += 1
        label = next((k for a, k, b in base[at : at + 8] if a < e and s < b), None)
        before = text[max(0, s - 24) : s].rstrip().rpartition(" ")[2]
        after = text[e : e + 2].strip()
        out.spans.append((s, e))
        out.labels.append(OTHER if label is None else label)
        out.fixed.append(label is not None)
        out.features.append(_features(word, before, after))
        if i and not text[out.spans[-2][1] : s].strip():
            out.chain.append((i - 1, i))
        keys.append(_keys(word))
        for key in keys[-1]:
            if key in last and (last[key], i) not in out.skip[-4:]:
                out.skip.append((last[key], i))
            last[key] = i
            if label is not None:
                first.setdefault(key, i)
    far = {(first[key], i) for i, ks in enumerate(keys) for key in ks if key in first}
    far.update(_number_edges(text, base, out))
    near = set(out.skip)
    out.held = sorted((i, j) for i, j in far if not out.fixed[j] and (min(i, j), max(i, j)) not in near)
    return out


@dataclass(frozen=True)
class SkipChainField:
    """Log potentials: by feature and label, by label pair along the chain, and along skip edges."""

    feature: dict[str, np.ndarray]
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, t: Tokens) -> np.ndarray:
        """Label probabilities by loopy sum-product messages, sent until they settle; labels of exact patterns are held."""
        unary = np.array([self.bias + sum((self.feature[f] for f in fs if f in self.feature), np.zeros(OTHER + 1)) for fs in t.features])
        for i, held in enumerate(t.fixed):
            if held:
                unary[i] = -50.0
                unary[i, t.labels[i]] = 0.0
        edges = [*t.chain, *t.skip, *t.held]
        if edges:
            kinds = np.array([self.chain] * len(t.chain) + [self.skip] * (len(t.skip) + len(t.held)))
            a, b = np.array(edges).T
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.concatenate([kinds, kinds.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(source), OTHER + 1))
            belief, live, rounds = unary.copy(), np.arange(len(source)), 0
            while len(live):
                out = belief[source[live]] - sent[back[live]]
                new = np.logaddexp.reduce(out[:, :, None] + table[live], axis=1)
                # messages that swing are damped more and more, so all settle
                pace = 0.5 ** (1 + rounds // (100 + len(source)))
                step = pace * (new - new.max(axis=1, keepdims=True) - sent[live])
                sent[live] += step
                np.add.at(belief, target[live], step)
                moved = live[np.abs(step).max(axis=1) > SETTLED]
                stirred = np.zeros(len(unary), bool)
                stirred[target[moved]] = True
                again = stirred[source]
                again[moved] = True
                live, rounds = np.flatnonzero(again), rounds + 1
            np.add.at(unary, target, sent)
        unary = np.exp(unary - unary.max(axis=1, keepdims=True))
        return unary / unary.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and those the field adds, by start and then kind; added ones never touch a base span."""
        t = tokens_of(text, base)
        if all(t.fixed):
            return base
        p = self.marginals(t)
        added: list[Span] = []
        for i, (s, e) in enumerate(t.spans):
            k = int(p[i].argmax())
            if t.fixed[i] or k == OTHER or p[i, k] < CERTAIN:
                continue
            while s < e and not (text[s].isalnum() or text[s] in "+("):
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            if added and added[-1][1] == k and not text[added[-1][2] : s].strip(" ()-."):
                added[-1] = (added[-1][0], k, e)
            elif s < e:
                added.append((s, k, e))
        return sorted(base + [x for x in added if not any(a < x[2] and x[0] < b for a, _, b in base)])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (features, label) and of label pairs along edges; the names come from a fixed, small set."""
    counts: dict[tuple[str, str], int] = defaultdict(int)
    for b in batches:
        for text in b.column("text").to_pylist():
            t = tokens_of(text, base_spans(text))
            for fs, y in zip(t.features, t.labels):
                counts["token " + str(y), " ".join(fs)] += 1
            for kind, edges in (("chain", t.chain), ("skip", t.skip)):
                for i, j in edges:
                    counts[kind, f"{t.labels[i]} {t.labels[j]}"] += 1
    kind, what, n = ([k[0] for k in counts], [k[1] for k in counts], list(counts.values()))
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(what, pa.string()), pa.array(n, pa.int64())], names=["kind", "what", "n"])


def fit(rows: list[tuple[str, str, int]], steps: int = 300) -> SkipChainField:
    """Piecewise training: token potentials by logistic regression, edge potentials by smoothed log count ratios."""
    k = OTHER + 1
    edges = {"chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    tokens = []
    for kind, what, n in sorted(rows):
        if kind.startswith("token "):
            tokens.append((int(kind[6:]), what.split(" "), n))
        else:
            i, j = map(int, what.split())
            edges[kind][i, j] += n / 2
            edges[kind][j, i] += n / 2
    # alike tokens are alike in kind until the data say otherwise; a chain edge starts out neutral
    potentials = {}
    for kind, prior in (("chain", np.zeros((k, k))), ("skip", 20 * SMOOTHING * np.eye(k))):
        c = edges[kind] + SMOOTHING + prior
        potentials[kind] = np.log(c / c.sum()) - np.log(c.sum(1, keepdims=True) / c.sum()) - np.log(c.sum(0, keepdims=True) / c.sum())
    names = {f: i for i, f in enumerate(sorted({f for _, fs, _ in tokens for f in fs}))}
    x = np.zeros((len(tokens), len(names) + 1))
    y = np.zeros((len(tokens), k))
    for r, (label, fs, n) in enumerate(tokens):
        x[r, [names[f] for f in fs]] = 1
        x[r, -1] = 1
        y[r, label] = n
    w = np.zeros((len(names) + 1, k))
    total = max(1.0, y.sum())
    for _ in range(steps if len(tokens) else 0):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * (x.T @ (p * y.sum(1, keepdims=True) - y) / total + 1e-4 * w)
    return SkipChainField({f: w[i] for f, i in names.items()}, w[-1] if len(tokens) else np.eye(k)[OTHER] * 5, potentials["chain"], potentials["skip"])


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SkipChainField:
    """Field trained on at most ``sample`` different texts that have a digit or an at sign, labelled by the exact patterns.

    They are those with the smallest hashes. The hashes are compared first, so only the texts taken are moved.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    edge = texts.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = texts.where(F.col("h") <= F.lit(edge).cast("long")).groupBy("h").agg(F.min("text").alias("text"))
    rows = picked.mapInArrow(_statistics, "kind string, what string, n long")
    return fit([tuple(r) for r in rows.groupBy("kind", "what").agg(F.sum("n").alias("n")).collect()])


FOUND = "struct<n:array<long>,base:string,spans:array<struct<start:int,kind:int,end:int>>>"


def found(spark: SparkSession, text: Column, field: SkipChainField) -> Column:
    """Struct of base counts by kind, the base digest, and all spans."""
    sent = spark.sparkContext.broadcast(field)

    @F.arrow_udf(FOUND)
    def search(texts: pa.Array) -> pa.Array:
        counts, digests, spans = [], [], []
        for t in texts.to_pylist():
            base = base_spans(t)
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in sent.value.spans(t, base)])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.list_(pa.int64())), pa.array(digests, pa.string()), pa.array(spans, kinds)], names=["n", "base", "spans"]
        )

    return search(F.coalesce(text, F.lit("")))


def redacted(spark: SparkSession, text: Column, field: SkipChainField) -> Column:
    """``text`` with every span replaced by its kind in square brackets; overlapping spans are one, named by the first."""
    sent = spark.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is not None:
                parts, at = [], 0
                for s, k, e in sent.value.spans(t, base_spans(t)):
                    if s >= at:
                        parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return mask(text)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SkipChainField | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    Null and empty texts have no spans (the digest is that of an empty string); ids may be null or repeat; an empty table
    gives no rows. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    field = field or train(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), found(spark, F.col(f"`{text_col}`"), field).alias("f"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("f.spans", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]))
    return rows.select(
        "doc_id", *[F.col("f.n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)], F.col("f.base").alias("base_sha256"), F.array_join(text, ",").alias("spans")
    )


def pii_query(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{folder}/documents.parquet"))
