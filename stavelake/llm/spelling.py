"""Spelling variants: vocabulary words one edit apart by a bit-sliced position index, and the commoner form of each."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, chunks, stored, table

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands its counts on.
HELD = 200_000
#: Rows of a bucket on average, and most rows of one block's index in it.
BUCKET_ROWS, BLOCK_ROWS = 4096, 8192


def count_words(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = 7, least_n: int = 2, every: int | None = 31) -> DataFrame:
    """(word, n): runs of letters of whole texts in small letters, with at least `least_chars` code points and `least_n` uses.

    Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z become small. With `every`, a run whose checksum with its row's id
    `every` divides loses one code point, as the checksum says, before it is counted. A null id reads as no signs. Null
    and empty texts have no words; repeated rows count each. Tasks count first, so a common word is a row for each task.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for part in chunks(batch, "text"):
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    start = zlib.crc32(f"{i or ''}:".encode())
                    for word, n in Counter(RUN.findall((t or "").encode().translate(LOWER).decode())).items():
                        if len(word) < least_chars:
                            continue
                        if every and not (h := zlib.crc32(word.encode(), start)) % every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_chars:
                                continue
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class PositionIndex:
    """Words of m or m + 1 letters by bit: one set of words for each (position, letter), as whole numbers.

    Bit k is the k-th word by falling count, then in code-point order, so the lowest bit of a set is its best word.
    """

    def __init__(self, words: list[tuple[str, int]], m: int, low: int, high: int) -> None:
        self.words, self.m, self.low = sorted(words, key=lambda w: (-w[1], w[0])), m, low
        self.sets: dict[tuple[int, str], int] = defaultdict(int)
        self.short, self.long, self.all = 0, 0, (1 << len(words)) - 1
        for k, (word, _) in enumerate(self.words):
            bit = 1 << k
            if len(word) == m:
                self.short |= bit
            else:
                self.long |= bit
            for i in range(low, min(len(word), high)):
                self.sets[i, word[i]] |= bit

    def near(self, word: str, start: int, stop: int, apart: int | None = None) -> int:
        """The words whose only difference to `word` is one error from letter `start` on and, if `stop` is short of its end, before it.

        All sets move together, a letter at a time: `zero` has met no error; `other` has read one letter as another;
        `more` has one letter of its own more, so looks a position ahead; `less` one letter less, so a position behind.
        With `apart`, words that agree in so many first letters are left out.
        """
        get, m, even = self.sets.get, self.m, len(word) == self.m
        zero, other, more, less, same = self.all, 0, self.all, 0, 0
        for i in range(start, stop):
            if i == apart:
                same = zero
            c = word[i]
            here = get((i, c), 0)
            if even:
                other = other & here | zero & ~here
                zero &= here
                more = more & get((i + 1, c), 0) | zero
            else:
                less = (less & get((i - 1, c), 0) if less else 0) | zero
                zero &= here
            if not (zero or other or more or less):
                return 0
        if apart == stop:
            same = zero
        found = other & self.short | more & self.long if even else less & self.short
        return found & ~same


def near_in_block(rows: list[tuple[str, int, int]], m: int, head: bool) -> Iterator[tuple[str, int, int, str, int]]:
    """(word, n, near words, best of them, its n) for the query words of one block that have any.

    All words of the block agree in their first m // 2 letters (`head`), or in their last m - m // 2. A pair whose
    letters agree so on both sides is met in the first kind only. Roles: bit 1 is in the index, bit 2 is a query.
    """
    a = m // 2
    index = PositionIndex([(w, n) for w, n, role in rows if role & 1], m, *((a, m + 2) if head else (0, a + 1)))
    for word, n, role in rows:
        if role & 2:
            found = index.near(word, a, len(word)) if head else index.near(word, 0, a + len(word) - m, a)
            if found:
                best = index.words[(found & -found).bit_length() - 1]
                yield word, n, found.bit_count(), *best


def blocks(words: DataFrame, least_chars: int, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (bucket, m, head, key, i, j, word, n, role): words that may be one edit apart share a key in some class.

    Of two words one edit apart, the shorter with m letters, either the first m // 2 letters agree or the last
    m - m // 2 do. Words of m letters are in the classes m and m - 1, with two keys in each. A block of more than
    `block_rows` words is dealt into slices: every slice of queries meets every slice of the index, in a tile of its own.
    """
    sides = [F.struct((F.length("word") - d).alias("m"), F.lit(h).alias("head")) for d in (0, 1) for h in (True, False)]
    rows = words.select("word", "n", F.inline(F.array(*sides))).where(F.col("m") >= least_chars)
    rows = rows.withColumn("key", F.expr("if(head, left(word, m div 2), right(word, m - m div 2))"))
    place = ["m", "head", "key"]
    large = rows.groupBy(*place).count().where(F.col("count") > block_rows).select(*place, F.ceil(F.col("count") / block_rows).cast("int").alias("k"))
    rows = rows.join(large, place, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    tile = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    slot, every = F.pmod(F.xxhash64("word"), F.col("k")), F.sequence(F.lit(0), F.col("k") - 1)
    tiles = F.when(F.col("k") == 1, F.array(tile(F.lit(0), F.lit(0), 3))).otherwise(
        F.concat(F.transform(every, lambda j: tile(slot, j, 1)), F.transform(every, lambda i: tile(i, slot, 2)))
    )
    rows = rows.select(*place, "word", "n", F.inline(tiles))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(max(1, 4 * words.count() // bucket_rows))))


FOUND = "word string, n long, n_near long, best string, best_n long"


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n): a row for each word of `blocks` and each tile that has near words of it."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([(c, "ascending") for c in ("m", "head", "key", "i", "j")])
        cols = [batch[c].to_pylist() for c in ("m", "head", "key", "i", "j", "word", "n", "role")]
        at, made = list(zip(*cols[:5])), []
        lo = 0
        while lo < len(at):
            hi = lo + 1
            while hi < len(at) and at[hi] == at[lo]:
                hi += 1
            if hi - lo > 1:
                made += near_in_block(list(zip(*(c[lo:hi] for c in cols[5:]))), cols[0][lo], cols[1][lo])
            lo = hi
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("word", "n", "n_near", "best", "best_n"), zip(*made) if made else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))})

    return rows.groupBy("bucket").applyInArrow(run, FOUND)


def spelling_forms(words: DataFrame, times: int = 10, least_chars: int = 7, **plan) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of `words(word, n)`, a written table with each word once.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word with the largest
    n, of equal ones the first in code-point order, if that n is at least `times` the word's own; root follows forms to
    the last. A word's near words are counted in sets, so no pair of words is ever a row: each word is at most one row for
    each tile that it is in. Forms at least double n (`times` is 2 or more), so paths are short and doubling them ends after six rounds.
    Words shorter than `least_chars`, and empty tables, have no near words.
    """
    if times < 2:
        raise ValueError("times is 2 or more")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    found = none.unionByName(near_words(blocks(words, least_chars, **plan)))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("down"), "best")))
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    fits = -F.col("b.down") >= times * F.col("n")
    out = stored(out.select("word", F.when(fits, F.col("b.best")).alias("form"), "n", "n_near", F.when(fits, -F.col("b.down")).alias("form_n")), "forms")
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").head(1):
            break
        roots = roots.select("word", "root")
    out = out.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(stored(count_words(table(spark, sf_dir, "documents")), "words"))
