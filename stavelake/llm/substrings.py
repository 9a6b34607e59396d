"""Substring dedup: suffix automata of shards of repeated text, matching statistics of documents, removal of long spans."""

from __future__ import annotations

import gc
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, stored, table

#: Words of an anchor. Every window has the anchor with the least hash of all in it, so equal windows have equal anchors.
GRAM = 6
MIX, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Longer words stand in automata under a digest, so that memory follows the number of words.
LONG_WORD = 32
#: Pieces of a shard on average; distinct texts that a task remembers.
SHARD_ROWS, REMEMBERED = 2000, 100_000
#: Anchors in more texts than a HOT_SHARE-th of all (text, anchor) pairs, and FEW at least, are hot: fewer than HOT_SHARE.
HOT_SHARE, FEW = 1000, 64


class SuffixAutomaton:
    """The suffix automaton of a set of word sequences, with the number of places at which each state's words end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, times: int = 1) -> list[int]:
        """Put in a sequence that occurs `times` times; returns the state of each of its prefixes."""
        following, link, length, count = self.next, self.link, self.length, self.count
        last, states = 0, []
        for c in words:
            p, new = last, -1
            size = length[p] + 1
            if c not in following[p]:
                new = len(length)
                following.append({})
                length.append(size)
                link.append(0)
                count.append(0)
                while p >= 0 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
            if p >= 0:  # the state of p's longest words and c: the next one if it has just these, else a copy for them
                own = q = following[p][c]
                size = length[p] + 1
                if length[q] != size:
                    own = len(length)
                    following.append(dict(following[q]))
                    length.append(size)
                    link.append(link[q])
                    count.append(0)
                    link[q] = own
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = own
                        p = link[p]
                if new >= 0:
                    link[new] = own
                else:
                    new = own
            count[new] += times
            states.append(new)
            last = new
        return states

    def repeated(self) -> list[int]:
        """For each state, the length of its longest suffix that ends at two places or more, once all sequences are in."""
        length, link, count = self.length, self.link, list(self.count)
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for v in reversed(order):
            count[link[v]] += count[v]
        best = [0] * len(length)
        for v in order:
            best[v] = length[v] if count[v] > 1 else best[link[v]]
        return best

    def matches(self, words: list) -> Iterator[int]:
        """Matching statistics: for each word, the length of the longest factor of the automaton that ends with it."""
        following, link, length = self.next, self.link, self.length
        v = size = 0
        for c in words:
            while v and c not in following[v]:
                v = link[v]
                size = length[v]
            to = following[v].get(c)
            if to is not None:
                v, size = to, size + 1
            yield size


def spans(statistics: Iterator[int], window: int) -> list[tuple[int, int]]:
    """Maximal stretches [from, to) of words that lie in a match of at least `window` words."""
    out: list[tuple[int, int]] = []
    for at, n in enumerate(statistics):
        if n >= window:
            low = at - n + 1
            while out and out[-1][1] >= low:
                low = min(low, out.pop()[0])
            out.append((low, at + 1))
    return out


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs without U+0020 and U+0009 to U+000D, in UTF-8."""
    return text.encode().split() if text else []


def token(word: bytes) -> bytes:
    """The word, or a digest of a long one after a sign that no word has."""
    return word if len(word) <= LONG_WORD else b"\t" + xxhash.xxh3_128_hexdigest(word).encode()


def tokens(text: str | None) -> list[bytes]:
    """The words of a text as automata see them."""
    words = split_words(text)
    return list(map(token, words)) if words and len(max(words, key=len)) > LONG_WORD else words


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word groups whose places fit beside the upper bits of their hashes.
PLACES = 1 << 24
#: An odd number and its inverse modulo 2^64.
BASE = 0x100000001B3
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; a task keeps those of its longest texts up to a million bytes."""
    if len(POWERS[0]) >= n:
        return POWERS[0][:n], POWERS[1][:n]
    made = [np.cumprod(np.full(max(n, 1 << 16), b, np.uint64)) * np.uint64(pow(b, -1, 1 << 64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    if n <= 1 << 20:
        POWERS[:] = made
    return made[0][:n], made[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text, all at once: a word's polynomial out of sums over the text, moved to its own start."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    h = (sums[end] - sums[first]) * down[first]
    return (h ^ (h >> np.uint64(29))) * FINAL


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    done, out = 1, h
    while 2 * done <= width:
        out, done = np.minimum(out[: len(out) - done], out[done:]), 2 * done
    return np.minimum(out[: len(h) - width + 1], out[width - done :])


def anchors(text: str | None, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, end) of each anchor of a text: the windows that start at first to end - 1 have it as their least.

    An anchor is the word group of a window whose hash has the least upper bits, the first of several. So it follows from the
    window's words alone, each window has one, and no anchor has more than window - GRAM + 1 windows.
    """
    w = word_hashes(text.encode()) if text else np.zeros(0, np.uint64)
    if len(w) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, window)
    h = np.zeros(len(w) - gram + 1, np.uint64)
    for j in range(gram):
        h = h * MIX + w[j : j + len(h)]
    h = (h ^ (h >> np.uint64(31))) * FINAL
    width = window - gram + 1
    if len(h) <= PLACES:  # the place in the low bits: of equal upper bits the first wins
        low = np.uint64(PLACES - 1)
        best = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)
    else:
        upper = h & ~np.uint64(PLACES - 1)
        best = np.lib.stride_tricks.sliding_window_view(upper, width).argmin(1) + np.arange(len(h) - width + 1)
    first = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1])
    return h[best[first]].view(np.int64), first, np.append(first[1:], len(best))


def text_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(key, h, c): how often each anchor comes in the texts of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [np.unique(anchors(t, window)[0], return_counts=True) for t in part.column("text").to_pylist()]
                sizes = [len(h) for h, _ in found]
                made = [pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(np.repeat(np.arange(len(found)), sizes))), *made], names=["key", "h", "c"])

    return rows.select("key", "text").mapInArrow(run, "key long, h long, c long").groupBy("key", "h").agg(F.sum("c").alias("c"))


def hot_windows(rows: DataFrame, hot: set[int], window: int, most: int) -> list[list[bytes]]:
    """The windows of hot anchors that come more than `most` times. There are at most the windows of an anchor, times the
    hot anchors' share, so at most (window - GRAM + 1) * HOT_SHARE of them, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(sorted(hot), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                count: Counter[bytes] = Counter()
                for text in part.column("text").to_pylist():
                    h, first, end = anchors(text, window)
                    found = np.flatnonzero(np.isin(h, wanted)).tolist()
                    words = tokens(text) if found else []
                    for i in found:
                        own = words[first[i] : end[i] + window - 1]
                        count.update(b" ".join(own[s : s + window]) for s in range(end[i] - first[i]))
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], names=["words", "c"])

    counted = rows.select("text").mapInArrow(run, "words binary, c long").groupBy("words").agg(F.sum("c").alias("c"))
    return [bytes(r.words).split(b" ") for r in counted.where(F.col("c") > most).select("words").collect()]


def passages(windows: list[list[bytes]]) -> list[list[bytes]]:
    """Sequences that have exactly these windows: those that overlap in all but a word are chained."""
    after: dict[tuple, list[tuple]] = {}
    for w in map(tuple, windows):
        after.setdefault(w[:-1], []).append(w)
    ends = {tuple(w[1:]) for w in windows}
    left, out = {tuple(w) for w in windows}, []
    for w in sorted(left, key=lambda w: (w[:-1] in ends, w)):
        if w in left:
            left.discard(w)
            chain = list(w)
            while (step := next((x for x in after.get(w[1:], ()) if x in left), None)) is not None:
                left.discard(step)
                chain.append(step[-1])
                w = step
            out.append(chain)
    return out


PIECES = "place long, key long, digest binary, words binary, starts array<int>"


def pieces(rows: DataFrame, window: int, hot: set[int], automaton) -> DataFrame:
    """Texts with the list `hs` of their repeated anchors, as pieces for the shards: (place, key, digest, words, starts).

    A piece is the words of all windows of one anchor, and the places of the text at which they start; equal windows of
    the corpus meet at one place. Documents run through the broadcast automaton first where an anchor is hot: what it
    matches is decided (no words; starts holds from and to), and the windows that are left go each by itself, under a
    place of their own. Of equal texts a task sends two, as more would not change what is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = np.array(sorted(hot), np.int64), Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                out: list[tuple] = []
                for key, text, hs in zip(*(part.column(c).to_pylist() for c in ("key", "text", "hs"))):
                    if not hs:
                        continue
                    digest = xxhash.xxh3_128_digest(text.encode())
                    sent[digest] += 1
                    if sent[digest] > 2:
                        continue
                    words = tokens(text)
                    h, first, end = anchors(text, window)
                    known, own = np.isin(h, np.array(hs, np.int64)), {}
                    is_hot = np.isin(h, held)
                    for i in np.flatnonzero(known & ~is_hot).tolist():
                        own.setdefault((int(h[i]), b" ".join(words[first[i] : end[i] + window - 1])), []).append(int(first[i]))
                    for i in np.flatnonzero(known & is_hot).tolist():
                        lo, n = int(first[i]), int(end[i] - first[i])
                        here = words[lo : lo + n + window - 1]
                        known_here = list(automaton.value.matches(here))
                        for a, b in spans(known_here, window):
                            out.append((int.from_bytes(digest[:8], "big", signed=True), key, digest, None, [lo + a, lo + b]))
                        for s in range(n):
                            if known_here[s + window - 1] < window:
                                one = b" ".join(here[s : s + window])
                                own.setdefault((xxhash.xxh3_64_intdigest(one) - 2**63, one), []).append(lo + s)
                    out += [(place, key, digest, piece, starts) for (place, piece), starts in own.items()]
                if len(sent) > REMEMBERED:
                    sent.clear()
                cols = list(zip(*out)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["place", "key", "digest", "words", "starts"])

    return rows.mapInArrow(run, PIECES)


def repeated_spans(shard: pa.Table, window: int) -> pa.Table:
    """(key, digest, found): the pieces of a shard that hold repeated windows, as from, to, from, to and so on.

    The automaton of the shard's different pieces knows how often each sequence ends in the shard, so at each word of a
    piece the longest suffix that also ends elsewhere is the matching statistic against all the rest.
    """
    keys, digests, words, starts = (shard[c].to_pylist() for c in ("key", "digest", "words", "starts"))
    times: Counter[bytes] = Counter()
    for w, at in zip(words, starts):
        if w is not None:
            times[w] += len(at)
    automaton, numbers = SuffixAutomaton(), {}
    gc.disable()  # the automaton makes no cycles, and has too many parts to look through again and again
    states = {w: automaton.add([numbers.setdefault(x, len(numbers)) for x in w.split(b" ")], n) for w, n in times.items()}
    best = automaton.repeated()
    found = {w: spans((best[v] for v in path), window) for w, path in states.items()}
    gc.enable()
    out = []
    for key, digest, w, at in zip(keys, digests, words, starts):
        flat = at if w is None else [s + x for s in at for span in found[w] for x in span]
        if flat:
            out.append((key, digest, flat))
    cols = list(zip(*out)) or [[]] * 3
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("key", "digest", "found"), cols, (pa.int64(), pa.binary(), pa.list_(pa.int32())))})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, hot_share: int = HOT_SHARE, few: int = FEW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) for every row: whole texts without the words of repeated windows.

    A window is `window` consecutive words of one text. It is repeated if its words also start anywhere else, in the same
    text too; all its words go, wherever it stands, judged on the input. kept: the other words, joined by one space.

    Windows are found by anchors, which cut a text into overlapping pieces; a piece whose anchor comes once is in no
    repeat and goes nowhere. The others meet by anchor, in shards of about `shard_rows` pieces; the suffix automaton of
    a shard decides them. Anchors with a large share of all rows, of which there are fewer than `hot_share`, would
    gather too much at one place: their common windows, a bounded list, make one automaton that is broadcast, and
    documents run through it where they are. Words themselves are compared, not hashes (of words over 32 bytes a
    digest of 128 bits); hashes only bring them together.

    Null and empty texts have no words and an empty rest. Rows with equal texts repeat each other. Null and repeated ids
    are kept as they come, and a very long text is many pieces. Other columns are dropped. Empty tables give none.
    """
    if window < 2:
        raise ValueError("window is 2 or more")
    spark = df.sparkSession
    # equal texts have one key; a shared key of two texts costs a look and changes nothing, as digests are compared
    key = F.when(F.col(text).isNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(text))
    rows = df.select(key.alias("key"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    pairs = stored(text_anchors(rows, window), "anchors")
    total = pairs.count()
    most = max(few, total // hot_share)
    again = pairs.groupBy("h").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where("c > 1").select("h", "n")
    hot_rows = stored(again.where(F.col("n") > most).select("h"), "hot")
    hot = {r.h for r in hot_rows.collect()}
    automaton = SuffixAutomaton()
    if hot:
        for passage in passages(hot_windows(rows, hot, window, most)):
            automaton.add(passage)
    sent = spark.sparkContext.broadcast(automaton)
    marked = pairs.select("key", "h").join(F.broadcast(hot_rows.withColumn("hot", F.lit(True))), "h", "left")
    cold = marked.where("hot is null").join(again.where(F.col("n") <= most).select("h").hint("merge"), "h")
    flags = stored(marked.where("hot").unionByName(cold).groupBy("key").agg(F.collect_list("h").alias("hs")), "repeated")
    size = flags.agg(F.sum(F.size("hs"))).first()[0] or 0
    found = pieces(rows.join(flags.hint("merge"), "key", "left"), window, hot, sent)
    shard = F.pmod(F.xxhash64("place"), F.lit(max(1, size // shard_rows))).alias("shard")
    spread = found.select(shard, *[c for c in found.columns if c != "place"]).groupBy("shard")
    gone = spread.applyInArrow(lambda t: repeated_spans(t, window), "key long, digest binary, found array<int>")
    gone = gone.groupBy("key").agg(F.collect_set(F.struct("digest", "found")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for text, found in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    words, n = split_words(text), 0
                    if found:
                        keep, digest = np.ones(len(words), bool), xxhash.xxh3_128_digest(text.encode())
                        for x in found:
                            if x["digest"] == digest:
                                for a, b in zip(x["found"][::2], x["found"][1::2]):
                                    keep[a:b] = False
                        n = len(words) - int(keep.sum())
                        if n:
                            words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    kept = b" ".join(words)
                    out.append((len(words) + n, n, hashlib.sha256(kept).hexdigest(), kept.decode()))
                cols = list(zip(*out)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = rows.join(gone.hint("merge"), "key", "left").mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.withColumnRenamed("id", id_col)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, w, unnest(range(1, len(w) - 33)) as s from d),
k as (select r, s, md5(array_to_string(w[s:s + 34], ' ')) as h from s),
p as (select r, s from k where h in (select h from k group by h having count(*) > 1)),
gone as (select distinct r, s + o.o as i from p, (select unnest(range(35)) as o) o),
e as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select r, count(*) as n, string_agg(word, ' ' order by i) as t from e anti join gone using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""
