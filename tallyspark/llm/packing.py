"""Best-fit packing of documents into fixed-length token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import os
import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.bytebpe import byte_characters
from tallyspark.llm.common import materialised, prepare

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 600_000
LONG_WORD = 64
MARKS = string.punctuation
#: The character that stands for each byte of letters beyond ASCII.
SPELLED = {b: c for b, c in enumerate(byte_characters()) if b > 127}
RANKED_TOGETHER = 100_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTable(dict):
    """Ids of words as little-endian unsigned 32-bit bytes; a word is tokenised when first looked up.

    A word of letters in small case is one unit, whose bytes go to the model as the characters that stand for them. Other
    words are led back to such: the tokenizer drops case, and marks after letters are a unit of their own. What is left
    passes through the whole tokenizer.
    """

    def __init__(self, tokenizer, old: dict[str, bytes]):
        self.encode, self.tokenize, self.old = tokenizer.encode, tokenizer.model.tokenize, old

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            ids = self._ids(w)
        if len(w) <= LONG_WORD:
            self[w] = ids
        return ids

    def _ids(self, w: str) -> bytes:
        stem = w.rstrip(MARKS)
        if stem.isalpha():
            # letters whose small form is not letters, or depends on their neighbours, are left to the tokenizer
            small = stem.lower()
            if small.isascii() or (small.isalpha() and "Σ" not in stem and is_normalized("NFC", stem) and is_normalized("NFC", small)):
                if len(stem) < len(w):
                    return self[stem] + self[w[len(stem) :]]
                if small != stem:
                    return self[small]
                spelled = w if w.isascii() else w.encode().decode("latin-1").translate(SPELLED)
                return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        return array("I", self.encode(w, add_special_tokens=False).ids).tobytes()


class WordIds:
    """Ids of texts. The tokenizer drops white space and no token spans it, so a text's ids are those of its words in turn.

    There are two generations of words: when the new one is full it becomes the old one, from which words still in use are
    taken over, so memory is bounded and frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.known = WordTable(self.tokenizer, {})

    def __call__(self, text: str) -> bytes:
        # other kinds of white space stay inside a word, where the tokenizer itself drops them
        for blank in "\t\n\x0b\x0c\r":
            if blank in text:
                text = text.replace(blank, " ")
        if len(self.known) > CACHED_WORDS:
            self.known.old = {}
            self.known = WordTable(self.tokenizer, self.known)
        return b"".join(map(self.known.__getitem__, text.split(" ")))


_WORDS: dict[str, WordIds] = {}


def words_by(path: str) -> WordIds:
    """The table of the tokenizer at ``path``, one for each worker process."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _piece_rows(path: str, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("_text").to_pylist()):
                ids = words_by(path)(text) + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut only where longer than ``capacity``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return rows.mapInArrow(_piece_rows(tokenizer, capacity), PIECE_SCHEMA)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first_rank, n, per_sequence, first_sequence, offset)`` rows.

    Pieces of ``length`` with rank ``first_rank + t``, ``t < n``, go to sequence ``first_sequence + t // per_sequence`` at
    ``offset + (t % per_sequence) * length``. Sequences with the same room are one range of numbers, so the work depends on
    the number of different lengths, never on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0
    out = []

    def keep(free: int, first: int, n: int) -> None:
        if n > 0 and free > 0:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
            else:
                free, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = free // length
            took = min(left, n * each)
            out.append((length, rank, took, each, first, capacity - free))
            full, rest = divmod(took, each)
            keep(free - each * length, first, full)
            if rest:
                keep(free - rest * length, first + full, 1)
            keep(free, first + full + bool(rest), n - full - bool(rest))
            left, rank = left - took, rank + took
    return out


def best_fit(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (written once) with ``sequence_id`` and ``offset``.

    The driver sees one count per length, ``capacity`` at most. Pieces are ranked within their length by a count per
    (length, salt) and a row number inside it, with salts enough that a common length is never ranked by one task.
    """
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count("*")).collect()}
    salts = max(16, sum(counts.values()) // RANKED_TOGETHER)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(inside) - 1).join(bases, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row"))
    plan = spark.createDataFrame(
        plan_slots(counts, capacity), "length long, _first long, _took long, _each long, _sequence long, _offset long"
    )
    # a few rows per length and at most `capacity` lengths
    slots = F.broadcast(plan)
    taken = ranked.join(slots, "length").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_took")))
    turn = F.col("_rank") - F.col("_first")
    return taken.select(
        *parts.columns,
        (F.col("_sequence") + F.floor(turn / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + turn % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece with its sequence and offset.

    A null or empty text is a single end id; rows with a null or repeated id are packed like any other; an empty table
    gives no rows. Other columns are not read.
    """
    return best_fit(materialised(pieces(docs, tokenizer, id_col, text_col, capacity)), capacity)


def packing_query(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), path)
