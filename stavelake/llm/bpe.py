"""BPE encoding by backtracking over Aho-Corasick longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import field, map_texts, table

END = 0x1000  # added to the last sign of a word: the two forms of a byte are different signs
NEVER = np.iinfo(np.int64).max
KNOWN_PLANES = 0x32000  # code points from here on are not looked up one by one
#: Words of a task whose ids are kept; beyond this the memory of words starts anew.
KEPT_WORDS = 300_000


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: visible Latin-1 signs for themselves, others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Encoder of a tokenizers file with word-end BPE over bytes, lower-cased NFC text and a pattern of words.

    A token sequence is the word's BPE exactly when every token is one and every pair of neighbours is compatible, that
    is, when no merge across their border comes before the merges that made them. So the encoder takes the longest
    match at each place and goes back to the next shorter one where a pair is not compatible or an end can't be reached.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # letters and cases that Python's tables don't know yet: the library itself cuts texts that hold them
        self.exact = Tokenizer.from_file(path)
        self.unsure = np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(KNOWN_PLANES + 1)), bool, KNOWN_PLANES + 1)
        self.unsure[KNOWN_PLANES] = True
        # space never reaches a word, so the file's \s is spelled as White_Space, which regex's own \s exceeds
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        signs = byte_signs()
        suffix = spec["model"]["end_of_word_suffix"]
        self.at = signs
        self.byte_of = {c: b for b, c in enumerate(signs)}

        def key(token: str) -> str:
            return token[: -len(suffix) - 1] + chr(ord(token[-len(suffix) - 1]) + END) if token.endswith(suffix) and token != suffix else token

        size = max([*vocab.values(), *self.special.values()]) + 1
        self.machine = ahocorasick.Automaton()
        self.ids: dict[str, int] = {}
        self.length = np.zeros(size, np.int64)
        for token, i in vocab.items():
            k = key(token)
            self.ids[k] = i
            self.length[i] = len(k)
            self.machine.add_word(k, i)
        self.machine.make_automaton()
        self.keys = {i: k for k, i in self.ids.items()}
        # how each token was made: rank of its merge, its halves
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = np.empty(len(spec["model"]["merges"]), np.int64)
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = key(a), key(b)
            made = self.ids[a + b]
            pairs[rank] = self.ids[a] * size + self.ids[b]
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, self.ids[a], self.ids[b]
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank, self.size = pairs[order], order, size
        self.pair_ok: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}  # ids of words, as little-endian 32-bit integers
        self.rank_of = dict(zip(pairs.tolist(), range(len(pairs))))
        self.made = list(zip(self.rank.tolist(), self.left.tolist(), self.right.tolist()))
        self.long = self.length.tolist()
        # decoding: all token texts in one byte string, with the space that joins tokens, and where each starts
        texts = [b""] * size
        for token, i in chain(vocab.items(), self.special.items()):
            texts[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens; NEVER if there is none."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)
        return np.where(self.pairs[at] == k, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair-compatibility table, made on demand for arrays of pairs.

        Both tokens are undone from their last merge on. At every stage the two tokens at the border must not merge
        before the next merge that takes one of them away; of equal merges the left one comes first.
        """
        good = np.ones(len(a), bool)
        a, b = a.copy(), b.copy()
        up_a, up_b = np.full(len(a), NEVER), np.full(len(a), NEVER)  # ranks of the merges that take a and b away
        live = np.arange(len(a))
        while len(live):
            x, y, ra, rb = a[live], b[live], up_a[live], up_b[live]
            across = self.merge_rank(x, y)
            good[live[(across < ra) & (across <= rb) & (across != NEVER)]] = False
            later_a = self.rank[x] > self.rank[y]  # undo the later merge first
            undo_a, undo_b = later_a, ~later_a & (self.rank[y] >= 0)
            up_a[live[undo_a]], a[live[undo_a]] = self.rank[x[undo_a]], self.right[x[undo_a]]
            up_b[live[undo_b]], b[live[undo_b]] = self.rank[y[undo_b]], self.left[y[undo_b]]
            live = live[(undo_a | undo_b) & good[live]]
        return good

    def learn_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs are compatible, one look for each different pair."""
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        return self.compatible(keys // self.size, keys % self.size)[back]

    def _pair(self, a: int, b: int) -> bool:
        """As `compatible`, for one pair."""
        key = a * self.size + b
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        if len(self.pair_ok) > 4 * KEPT_WORDS:
            self.pair_ok.clear()
        made, rank_of, size = self.made, self.rank_of, self.size
        up_a = up_b = NEVER
        good = True
        while True:
            across = rank_of.get(a * size + b, NEVER)
            if across != NEVER and across < up_a and across <= up_b:
                good = False
                break
            rank_a, rank_b = made[a][0], made[b][0]
            if rank_a > rank_b:
                up_a, a = rank_a, made[a][2]
            elif rank_b >= 0:
                up_b, b = rank_b, made[b][1]
            else:
                break
        self.pair_ok[key] = good
        return good

    def backtrack(self, word: str) -> list[int]:
        """Ids of one word in signs. Each place is given up once at most, so the work is linear in the word."""
        size, long = len(word), self.long
        options: list[list[int]] = [[] for _ in word]  # tokens from each place on, the longest last
        for end, i in self.machine.iter(word):
            options[end - long[i] + 1].append(i)
        dead = bytearray(size + 1)
        out: list[int] = []
        tries = [options[0]]
        at = 0
        while at < size:
            left = tries[-1]
            while left:
                i = left.pop()
                end = at + long[i]
                if not dead[end] and (not out or self._pair(out[-1], i)):
                    out.append(i)
                    at = end
                    if at < size:
                        tries.append(options[at].copy())
                    break
            else:
                dead[at] = 1
                tries.pop()
                at -= long[out.pop()]
        return out

    def _encode_words(self, words: list[str]) -> None:
        """Learn the ids of words that are new: longest matches of all at once, and backtracking where they fail."""
        signs = [self._signs(w) for w in words]
        ids = np.array([i for _, i in self.machine.iter_long("".join(signs))], np.int64)
        ends = np.cumsum(self.length[ids])
        borders = np.cumsum([len(s) for s in signs])
        stops = np.searchsorted(ends, borders) + 1
        if ends[-1] != borders[-1] or (ends[stops - 1] != borders).any():
            raise ValueError("the vocabulary lacks a byte")
        inner = np.ones(len(ids), bool)
        inner[stops - 1] = False
        inner = np.flatnonzero(inner)
        fails = inner[~self.learn_pairs(ids[inner], ids[inner + 1])]
        bad = set(np.searchsorted(stops, fails, "right").tolist())
        raw, memory, start = ids.astype("<u4").tobytes(), self.memory, 0
        for k, (w, stop) in enumerate(zip(words, (4 * stops).tolist())):
            memory[w] = np.array(self.backtrack(signs[k]), "<u4").tobytes() if k in bad else raw[start:stop]
            start = stop

    def _signs(self, word: str) -> str:
        at = self.at
        s = "".join([at[b] for b in word.encode()])
        return s[:-1] + chr(ord(s[-1]) + END)

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Words of each part between special tokens, and the ids of these."""
        for part in self.split_special.split(text):
            if part in self.special:
                yield self.special[part]
            elif part.isascii():
                yield self.words.findall(part.lower())
            elif self._newer(part):
                cut = self.exact.pre_tokenizer.pre_tokenize_str(self.exact.normalizer.normalize_str(part))
                yield [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in cut]
            else:
                # signs are lower-cased one by one
                yield self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def _newer(self, text: str) -> bool:
        """Whether a text holds code points that Python's Unicode tables have no entry for, or that lie beyond them."""
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return bool(self.unsure[np.minimum(cps, KNOWN_PLANES)].any())

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        cut = [list(self.pieces(t)) for t in texts]
        words = set().union(*[p for parts in cut for p in parts if isinstance(p, list)])
        fresh = words.difference(self.memory)
        if len(self.memory) + len(fresh) > KEPT_WORDS:
            self.memory.clear()
            fresh = words
        fresh = list(fresh)
        for i in range(0, len(fresh), 50_000):
            self._encode_words(fresh[i : i + 50_000])
        get = self.memory.__getitem__
        return [np.frombuffer(b"".join([b"".join(map(get, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in parts]), "<u4") for parts in cut]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, special tokens included: slices of one byte string, joined by spaces."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        total = int(sizes.sum())
        if not total:
            return b""
        shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return self.blob[shift + np.arange(total)].tobytes()[:-1]


COLUMNS = [field("n_tokens", T.LongType()), field("ids_sha256", T.StringType()), field("decoded_sha256", T.StringType())]


def token_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`df` with token count and digests of the ids and of the decoded text of every whole text; one pass, no shuffle.

    Null and empty texts have no ids. Very long words and texts are encoded whole, and code points of any Unicode version
    as the library takes them. Repeated rows are encoded each.
    Columns of the same names are replaced, others stay. Empty tables give none.
    """

    def make():
        bpe = WordBPE(path)

        def digests(texts: list[str | None]) -> list[pa.Array]:
            ids = bpe.encode_batch([t or "" for t in texts])
            return [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([sha256(bpe.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
            ]

        return digests

    return map_texts(df, make, COLUMNS, text, most=2 << 20)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the ids of every whole text as an array of ints; null and empty texts have an empty one."""

    def make():
        bpe = WordBPE(path)
        return lambda texts: [pa.array([x.astype(np.int32) for x in bpe.encode_batch([t or "" for t in texts])], pa.list_(pa.int32()))]

    return map_texts(df, make, [field(out, T.ArrayType(T.IntegerType()))], text, most=2 << 20)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of an id column; null and empty id lists give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        for b in batches:
            texts = [bpe.decode_bytes(np.array(x or [], np.int64)).decode() for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    df = df.drop(out)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, field(out, T.StringType())]))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, P.path("word_bpe_49k.json")).select("doc_id", *[c.name for c in COLUMNS])
