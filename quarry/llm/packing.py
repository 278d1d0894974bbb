"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens. The driver sees the histogram of lengths only (at most
`capacity` rows, whatever the input): per bin, a bitset subset-sum over the lengths that are left finds the
fullest combination that fits, and it is taken as often as the counts allow. The plan (patterns by length) is
broadcast; a piece finds its place by its rank among pieces of its length, counted in salted groups.

Edge cases: null or empty text is the end token alone; the string of a control token in a text is ordinary text unless
`added_as_text` is false; repeated rows and repeated ids are packed once per row
(ties in rank go by id, piece and checksum); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 2


class TokenBytes:
    """Little-endian 32-bit ids of a text under a byte-level BPE vocabulary.

    Where all white space of a text is single spaces and line ends between words, the vocabulary's split rule never joins
    what such a space divides, so words are encoded by themselves and short ones are remembered; any other text
    is encoded whole. A text that holds a string of the vocabulary's added tokens goes to the tokenizer library itself,
    which takes it as ordinary text (`added_as_text`, the vocabulary's own advice: raw text must not make control tokens) or as
    that token. `tests/llm` holds all three against the tokenizer library's own ids.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, remembered: int = 250_000, longest: int = 13, added_as_text: bool = True):
        import base64
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f).get("added_tokens") or []]
        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.encode_special_tokens = added_as_text

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.remembered, self.longest = remembered, longest
        outer = self

        class Known(dict):
            def __init__(self, lead: str):
                self.lead = lead

            def __missing__(self, word: str) -> bytes:
                value = array("I", outer.encode(self.lead + word)).tobytes()
                if len(word) <= outer.longest:
                    if len(self) >= outer.remembered:
                        self.clear()
                    self[word] = value
                return value

        self.first, self.later = Known(""), Known(" ")
        self.line_end = array("I", self.encode("\n")).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split()
        spaces = len(text) - sum(map(len, words))
        if spaces != len(words) - 1 or spaces != text.count(" ") + text.count("\n"):
            return array("I", self.encode(text)).tobytes()
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]])
            out += map(self.later.__getitem__, words[1:])
            out.append(self.line_end)
        return b"".join(out[:-1])


def token_pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", added_as_text: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only one longer than capacity is cut, its first piece takes the rest."""

    def run(batches):
        import public_tokenizers

        encode = TokenBytes(public_tokenizers.path(f"{tokenizer}.json"), public_tokenizers.path(f"{tokenizer}.tiktoken"), added_as_text=added_as_text)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Minimum bin slack for one bin: the longest length that is left, and the combination that fills the rest best."""
    seed = max(counts)
    room = capacity - seed
    layers: list[tuple[int, int]] = []  # (length, sums reachable before one more of it)
    reach = 1
    full = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        for _ in range(min(counts[length] - (length == seed), room // length) if length else 0):
            if reach >> room & 1:
                break
            more = (reach | reach << length) & full
            if more == reach:
                break
            layers.append((length, reach))
            reach = more
    at, chosen = reach.bit_length() - 1, {seed: 1}
    for length, before in reversed(layers):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + 1
            at -= length
    return chosen


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) for all lengths: each pattern is taken as often as its counts allow."""
    left, plan = dict(counts), []
    while left:
        pattern = fullest(left, capacity)
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def pack(pieces: DataFrame, capacity: int = 1024, salts: int | None = None) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, taken, first_bin = [], {}, 0
    for pattern, times in pack_lengths(histogram, capacity):
        at = 0
        for length in sorted(pattern, reverse=True):
            need, low = pattern[length], taken.get(length, 0)
            slots.append((length, low, low + need * times, need, first_bin, at))
            taken[length] = low + need * times
            at += need * length
        first_bin += times
    plan = spark.createDataFrame(slots, "length long, low long, high long, need long, first_bin long, at long")
    salts = salts or max(16, min(4096, sum(histogram.values()) // 20_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "before")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.alias("p").join(F.broadcast(plan).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    q = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first_bin") + F.floor(q / F.col("need"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(q, F.col("need")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", added_as_text: bool = True) -> DataFrame:
    return pack(stored(token_pieces(docs, capacity, tokenizer, added_as_text), "pieces"), capacity)
