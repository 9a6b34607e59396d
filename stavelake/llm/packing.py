"""Packing of token sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, stored, table

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids as the tokenizers library gives them for `json_path` without added special tokens.

    Texts in scripts below U+0500 take the faster rank-based encoder of the same vocabulary (`ranks_path`), whose ids
    are equal there (tested); other texts, and texts that it refuses, go through the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: self.exact.token_to_id(SPECIAL)})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or max(text) < "Ԁ"):
            try:
                return np.asarray(self.fast.encode(text, allowed_special="all"), "<u4")
            except BaseException as e:
                if "Panic" not in type(e).__name__ and not isinstance(e, ValueError):
                    raise
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(df: DataFrame, json_path: str, ranks_path: str | None, pattern: str, most: int = 1024, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every row's ids and an end id, cut at multiples of `most`."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                at, rows = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), most):
                        piece = ids[s : s + most]
                        at.append(i)
                        rows.append((s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                made = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *[pa.array(made[:, k]) for k in range(4)]], names=["doc_id", *PIECES.names])

    return df.mapInArrow(run, T.StructType([df.schema["doc_id"], *PIECES.fields]))


def packing_patterns(histogram: dict[int, int], most: int = 1024) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, copies), ...]) for each packing pattern.

    Lengths are placed longest first, each into the patterns with the fewest tokens so far; a pattern of which only a
    part of the packs is needed is split in two. When nothing has room, new packs take as many copies as fit. The work
    and the result follow the number of distinct lengths, not of pieces.
    """
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-room, serial, count, content)
    done, serial = [], 0

    def put(room: int, count: int, content: list[tuple[int, int]]) -> None:
        nonlocal serial
        serial += 1
        if room:
            heapq.heappush(packs, (-room, serial, count, content))
        else:
            done.append((count, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0 and packs and -packs[0][0] >= length:
            room, _, count, content = heapq.heappop(packs)
            take = min(count, left)
            if take < count:
                put(-room, count - take, content)
            grown = [*content[:-1], (length, content[-1][1] + 1)] if content[-1][0] == length else [*content, (length, 1)]
            put(-room - length, take, grown)
            left -= take
        fit = most // length
        for copies, count in ((fit, left // fit), (left % fit, 1)):
            if copies and count and left > 0:
                put(most - copies * length, count, [(length, copies)])
    return done + [(count, content) for _, _, count, content in packs]


def _ranges(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, packs, first sequence, offset): which ranks of a length fill which slots."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, content in patterns:
        offset = 0
        for length, copies in content:
            first = used.get(length, 0)
            used[length] = first + count * copies
            out.append((length, first, used[length], count, sequence, offset))
            offset += length * copies
        sequence += count
    return out


def deals(counts: dict[int, int], deal_rows: int = 250_000, groups: int = 1024, least: int = 64) -> dict[int, int]:
    """Number of groups each length is dealt into, so that a group has about a `groups`-th of all rows, but at least
    `least` rows and at most `deal_rows`. A common length is thus spread over tasks in small tables too."""
    size = min(deal_rows, max(least, sum(counts.values()) // groups))
    return {n: -(-c // size) for n, c in counts.items()}


def packed(pieces: DataFrame, most: int = 1024, deal_rows: int = 250_000) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; `pieces` is a written table with a `row` number, which is dropped.

    The driver sees the histogram only (at most `most` rows). Pieces get a rank within their length: each length is
    dealt by row number into groups (`deals`), ranked there, and moved up by the rows of the groups before it, so neither
    a length nor a repeated id is one task. Patterns join back by length and rank range. Both
    lookups are small: at most `most` lines, and one for each group.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    deal = spark.createDataFrame(list(deals(counts, deal_rows).items()), "length long, deals long")
    slots = spark.createDataFrame(_ranges(packing_patterns(counts, most)), "length long, first long, end long, packs long, sequence long, at long")
    dealt = pieces.join(F.broadcast(deal), "length").withColumn("deal", F.pmod(F.xxhash64("row"), F.col("deals"))).drop("deals")
    before = dealt.groupBy("length", "deal").count()
    before = before.select("length", "deal", (F.sum("count").over(Window.partitionBy("length").orderBy("deal")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "deal").orderBy("row")) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "deal"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "deal")
    joined = ranked.join(F.broadcast(slots.withColumnRenamed("length", "slot")), F.expr("length = slot and rank >= first and rank < end"))
    seq, off = F.expr("sequence + (rank - first) % packs"), F.expr("at + (rank - first) div packs * length")
    return joined.withColumns({"sequence_id": seq, "offset": off}).drop("rank", "row", "slot", "first", "end", "packs", "sequence", "at")


def pack_documents(df: DataFrame, json_path: str, ranks_path: str | None, pattern: str, most: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ids in sequences of at most `most` tokens, one row for each piece.

    A null or empty text is one end id. Very long texts become many full pieces. Repeated rows are packed each. Pieces of
    one length are ranked in the order they are written. A null id is kept. Other columns are dropped. Empty tables give none.
    """
    pieces = token_pieces(df, json_path, ranks_path, pattern, most, id_col, text)
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return packed(pieces, most).withColumnRenamed("doc_id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = pack_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
