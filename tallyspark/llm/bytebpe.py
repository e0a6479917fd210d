"""Byte-level BPE: texts to token ids with character offsets, and ids back to bytes and text, by a table of ranked byte strings."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

CACHED_PIECES = 300_000
LONG_PIECE = 64
#: Letters and digits newer than Unicode 16, which the public rank-file library does not know.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, from lines of base64 text and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ranked_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: the neighbours that join to the smallest rank are joined first, the leftmost of them before others."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for i in range(n):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        # an offer is stale when one of its two parts has been joined since
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, -1
        if c < n:
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class ByteBpe:
    """Encoder and decoder of one rank file.

    The tokenizer gets one merge for each way in which two known strings make a known string, in the order of the made
    string's rank. It ranks two ways to make the same string one after the other, where ranks alone take the leftmost
    first; only a piece that holds some three bytes twice can hold both, and such a piece is merged again by rank.
    Pieces are tokenised when first met. There are two generations of them: when the new one is full it becomes the old
    one, from which pieces still in use are taken over, so memory is bounded. Long pieces are not kept.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.ranks = read_ranks(path)
        letters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        table = {b: c for b, c in enumerate(letters)}
        spelled = {token: token.decode("latin-1").translate(table) for token in self.ranks}
        merges = []
        for token in sorted(self.ranks, key=self.ranks.get):
            for i in range(1, len(token)):
                if token[:i] in spelled and token[i:] in spelled:
                    merges.append((spelled[token[:i]], spelled[token[i:]]))
        vocabulary = {spelled[t]: r for t, r in self.ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # decoding reads the vocabulary back through the reversed byte table
        self.bytes_of = {i: bytes(map(self.byte_of.__getitem__, s)) for s, i in vocabulary.items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, raw in self.bytes_of.items():
            self.sizes[i] = len(raw)
        self.pieces = regex.compile(pattern)
        newer = "".join("-".join(f"\\U{int(x, 16):08X}" for x in span.split("-")) for span in NEWER.split())
        self.newer, self.first = regex.compile(f"[{newer}]"), chr(int(NEWER.split()[0].split("-")[0], 16))
        # in these texts the new characters are neither letters nor digits
        old = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        self.strict = regex.compile(old.replace(r"\p{L}+", rf"(?:(?![{newer}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{newer}])\p{{N}})+"))
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if not text.isascii() and max(text) >= self.first and self.newer.search(text):
            return self.strict.findall(text)
        return self.pieces.findall(text)

    def _learn(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            ids = e.ids
            raw = w.encode()
            if len(ids) > 1 and len(raw) > 3 and len({raw[i : i + 3] for i in range(len(raw) - 2)}) < len(raw) - 2:
                ids = ranked_merge(raw, self.ranks)
            self.known[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        lists = [self.split(t) for t in texts]
        words = set().union(*lists) if lists else set()
        unknown = words.difference(self.known)
        if len(self.known) + len(unknown) > CACHED_PIECES:
            self.known, self.old = {}, self.known
            unknown = words
        taken = [w for w in unknown if w in self.old]
        self.known.update((w, self.old[w]) for w in taken)
        self._learn(list(unknown.difference(taken)))
        look = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(look, ws)), "<u4") for ws in lists]
        for w in unknown:
            if len(w) > LONG_PIECE:
                del self.known[w]
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each token and the one behind its last; tokens that share a character both cover it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[ids])
        return character[ends - self.sizes[ids]], character[ends - 1] + 1

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``. Characters split over tokens are joined; one that the ids hold in part is U+FFFD."""
        return self.decode_bytes(ids).decode(errors="replace")

    def token_texts(self, ids: list[int]) -> list[str]:
        """The text that each token adds: a character split over tokens comes with the token that completes it."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
        return [reader.decode(self.bytes_of[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of a rank file, one for each worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, starts, ends)``: tokens of every whole text with their spans in code points, end exclusive.

    A null or empty text has empty arrays; rows that share an id are encoded each; an empty table gives no rows. Other
    columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        kind = pa.list_(pa.int32())
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = bpe.encode(texts)
            spans = [bpe.offsets(t, i) for t, i in zip(texts, ids)]
            columns = [[i.astype(np.int32) for i in ids], [s.astype(np.int32) for s, _ in spans], [e.astype(np.int32) for _, e in spans]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, kind) for c in columns]], names=["doc_id", "ids", "starts", "ends"])

    return _input(docs, id_col, text_col).mapInArrow(rows, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, bytes, text)`` of id lists; null lists are empty, a part of a character is U+FFFD in ``text``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            raw = [bpe.decode_bytes(i or []) for i in b.column("ids").to_pylist()]
            columns = [b.column("doc_id"), pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "bytes", "text"])

    prepare(tokens.sparkSession)
    lists = tokens.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return lists.mapInArrow(rows, "doc_id long, bytes binary, text string")


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text, encoded and decoded where it lies.

    The ids stay in their task: only digests leave it. Nulls, repeated ids and empty tables as in ``encoded``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        spelled = list(map(str, range(len(bpe.sizes))))
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for ids in bpe.encode(b.column("text").to_pylist()):
                ids = ids.tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = [b.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bytebpe_query(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trips(spark.read.parquet(f"{folder}/documents.parquet"), ranks, public_tokenizers.PATTERN)
