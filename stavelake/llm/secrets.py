"""Secret scans: base patterns, and a linear-chain conditional random field over tokens, decoded by Viterbi."""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, map_texts, stored, table

# The base patterns, with the least length of the part that counts.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
CUES = ("passw", "secret", "token", "api")  # each name of `assign` holds one of them, in either case
HEX_RUN = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so this finds those that count and skips the rest
CRF = "crf"
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
SHAPES, WORDS, FILES = 4096, 2048, 16
RADIX = np.uint64(0x100000001B3)
SIGNS = "!@:%#$&*^~?+/_.=-"


def base_spans(text: str, runs: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base match of a whole text, by start and then by kind as listed.

    A text without any of the names in CUES has no `assign` match, which a plain search tells sooner than the pattern;
    `runs` is false where it is known that no run of letters and digits has 24 signs.
    """
    out, low = [], text.lower()
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        if kind == "assign" and not any(c in low for c in CUES) or kind == "hex" and not runs:
            continue
        for m in (HEX_RUN if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def classes() -> np.ndarray:
    """Sign classes of code points below 256: 0 gap, 1 lower, 2 upper, 3 digit, 4 joining sign, 5 other sign; 6 beyond."""
    out = np.full(257, 5, np.uint8)
    for i in range(256):
        c = chr(i)
        out[i] = 0 if c.isspace() else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isdigit() and i < 128 else 4 if c in "+/_.=-" else 6 if c.isalpha() else 5
    out[256] = 6
    return out


SIGN = np.array([k in (4, 5) for k in range(7)])
WORDY = np.array([k in (1, 2, 3, 6) for k in range(7)])
#: Counts of small letters, capitals and digits add up side by side in one number, 21 bits for each.
SIDE_BY_SIDE = np.array([0, 1, 1 << 21, 1 << 42, 0, 0, 0], np.int64)
FIELD = (1 << 21) - 1
STEPS = np.searchsorted([1, 2, 4, 8, 12, 20, 32], np.arange(33), "right")
TOGETHER = 1 << 16
HEAD = 6  # signs of a token that its word hash reads, beside its length


class Tokens(NamedTuple):
    """Tokens of texts laid end to end: which text each is in, where it starts and ends in it, and its features."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    file: np.ndarray

    def place(self) -> np.ndarray:
        """Places of the tokens in a row where two blanks stand before each text and after the last."""
        return np.arange(len(self.owner)) + 2 * (self.owner + 1)


def tokens(texts: list[str], table: np.ndarray) -> Tokens:
    """Tokens of whole texts: runs of letters and digits, or one sign of any other kind.

    shape: length, counts of digits, capitals and small letters, and changes between them, in coarse steps; of a sign,
    which one it is and whether it touches a token before and after;
    word: a hash of the lower-cased token's first HEAD signs and its length, up to 63;
    file: what share of the whole text's signs are digits and other signs.
    """
    joined = "\n".join(texts)
    if joined.isascii():
        cps = np.frombuffer(joined.encode(), np.uint8)
        kind = table[cps]
    else:
        cps = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        kind = table[np.minimum(cps, 256)]
    if not len(cps):
        return Tokens(*[np.empty(0, np.int64)] * 6)
    sign, wordy = SIGN[kind], WORDY[kind]
    first, last = sign | wordy, sign | wordy
    on = wordy[1:] & wordy[:-1]
    first[1:] &= ~on
    last[:-1] &= ~on
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return Tokens(*[np.empty(0, np.int64)] * 6)
    length = ends - starts
    total = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(SIDE_BY_SIDE[kind], out=total[1:])
    count = total[ends] - total[starts]
    small, capital, digit = count & FIELD, (count >> 21) & FIELD, count >> 42
    changed = np.zeros(len(cps), np.int32)
    np.cumsum(kind[1:] != kind[:-1], out=changed[1:])
    turns = changed[ends - 1] - changed[starts]
    part = lambda x: (x > 0).view(np.int8) + (4 * x >= length) + (x >= length)
    shape = ((((STEPS[np.minimum(length, 32)] * 4 + part(digit)) * 4 + part(capital)) * 4 + part(small)) * 8 + np.minimum(STEPS[np.minimum(turns, 32)], 4)) % SHAPES
    # no run of letters has a shape below 512, as its length is one step at least
    at = np.flatnonzero(sign[starts])
    where = starts[at]
    full = np.concatenate([[0], kind, [0]])
    shape[at] = ((full[where] != 0) * 2 + (full[where + 2] != 0)) * 64 + cps[where] % 64
    low = np.concatenate([np.where(kind == 2, cps + cps.dtype.type(32), cps), np.zeros(HEAD, cps.dtype)])
    word = np.minimum(length, 63).astype(np.uint64)
    for j in range(HEAD):
        word *= RADIX
        word += low[starts + j] * (length > j)
    word = ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(WORDS)
    edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
    owner = np.searchsorted(edges, starts, "right") - 1
    tops = np.minimum(edges, len(cps))
    signs, lots = np.zeros((2, len(cps) + 1), np.int64)
    np.cumsum(sign, out=signs[1:])
    np.cumsum(kind != 0, out=lots[1:])
    lot = np.maximum(np.diff(lots[tops]), 1)
    digits, others = np.diff(total[tops] >> 42), np.diff(signs[tops])
    bucket = np.searchsorted([0.01, 0.05, 0.2], digits / lot) * 4 + np.searchsorted([0.02, 0.1, 0.3], others / lot)
    return Tokens(owner, starts - edges[owner], ends - edges[owner], shape, word.astype(np.int64), bucket[owner])


def feature_rows(made: Tokens) -> np.ndarray:
    """Weight rows of each token: own shape, the two words before, the word after, the shapes beside, the file."""
    if not len(made.owner):
        return np.empty((7, 0), np.int64)
    at = made.place()
    w, s = np.zeros((2, at[-1] + 3), np.int64)
    w[at], s[at] = made.word, made.shape
    rows, low = [made.shape], SHAPES
    for x, size in ((w[at - 1], WORDS), (w[at - 2], WORDS), (w[at + 1], WORDS), (s[at - 1], SHAPES), (s[at + 1], SHAPES)):
        rows.append(x + low)
        low += size
    rows.append(made.file + low)
    return np.stack(rows)


WEIGHTS = SHAPES * 3 + WORDS * 3 + FILES


@dataclass
class SecretModel:
    """Weights of features by tag, and of tag pairs (from, to); a secret cannot go on where none began."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.take(self.weights, rows[0], axis=0)
        for r in rows[1:]:
            out += np.take(self.weights, r, axis=0)
        return out

    def tags(self, scores: np.ndarray) -> np.ndarray:
        """The best tag sequence, exactly as Viterbi over the whole text gives it.

        Take a path that goes through a token inside a secret and put the token outside. Two moves change, and if the
        next token went on with the secret it has to begin one, which changes a third. A token whose score for
        `outside` leads by more than all that can cost, by all moves around it, is outside on every best path; such
        tokens cut the text, and Viterbi runs over what lies between them.
        """
        n = len(scores)
        out = np.full(n, OUTSIDE)
        m = self.moves
        ends, goes_on = [], []
        for a, x in ((a, x) for a in range(3) for x in (BEGIN, INSIDE)):
            here = m[a, x] - m[a, OUTSIDE]
            ends += [here, *[here + m[x, b] - m[OUTSIDE, b] for b in (BEGIN, OUTSIDE)]]
            again = here + m[x, INSIDE] - m[OUTSIDE, BEGIN]
            goes_on += [again, *[again + m[INSIDE, b] - m[BEGIN, b] for b in range(3)]]
        lead = scores[:, OUTSIDE] - scores[:, :OUTSIDE].max(1)
        anew = np.append(scores[1:, INSIDE] - scores[1:, BEGIN], -np.inf)
        loose = np.flatnonzero(lead <= np.maximum(max(ends), max(goes_on) + anew) + 1e-9)
        if not len(loose):
            return out
        into = [m[:, k].tolist() for k in range(3)]
        for run in np.split(loose, np.flatnonzero(np.diff(loose) > 1) + 1):
            lo, hi = int(run[0]), int(run[-1]) + 1
            rows = scores[lo:hi].tolist()  # plain numbers: a run has a few tokens, and arrays of three cost more
            x, y, z = (rows[0][k] + into[k][OUTSIDE] for k in range(3))
            back = []
            for row in rows[1:]:
                step, best = [], []
                for k in range(3):
                    p, q, r = x + into[k][0], y + into[k][1], z + into[k][2]
                    at = 0 if p >= q and p >= r else 1 if q >= r else 2
                    step.append(at)
                    best.append((p, q, r)[at] + row[k])
                x, y, z = best
                back.append(step)
            last = [x, y, z]
            if hi < n:
                last = [v + into[OUTSIDE][k] for k, v in enumerate(last)]
            tag = last.index(max(last))
            out[hi - 1] = tag
            for t in range(hi - 2, lo - 1, -1):
                tag = back[t - lo][tag]
                out[t] = tag
        return out

    def spans(self, text: str, table: np.ndarray, least: int = 12) -> list[tuple[int, int]]:
        """Code-point spans of tagged secrets of at least `least` signs that mix digits with letters."""
        return self.spans_of([text], tokens([text], table), least)[0]

    def spans_of(self, texts: list[str], made: Tokens, least: int = 12) -> list[list[tuple[int, int]]]:
        """As `spans`, for texts laid end to end. What stands between two texts is outside, so none reads another."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(made.owner):
            return out
        at = made.place()
        scores = np.full((at[-1] + 3, 3), [-1e6, -1e6, 0.0])
        scores[at] = self.scores(feature_rows(made))
        tags = self.tags(scores)
        place = np.full(len(tags), -1)
        place[at] = np.arange(len(at))
        for i in np.flatnonzero(tags == BEGIN):
            j = i
            while tags[j + 1] == INSIDE:
                j += 1
            owner, s, e = made.owner[place[i]], int(made.start[place[i]]), int(made.end[place[j]])
            value = texts[owner][s:e]
            if e - s >= least and re.search("[0-9]", value) and re.search("[A-Za-z]", value):
                out[owner].append((s, e))
        return out


def fit(rows: np.ndarray, gold: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> SecretModel:
    """Maximum likelihood by Adam over windows of equal length: rows (features, windows, tokens), gold (windows, tokens)."""
    banned = np.zeros((3, 3))
    banned[OUTSIDE, INSIDE] = -1e9
    weights, moves = np.zeros((WEIGHTS, 3)), np.zeros((3, 3))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    n, t = gold.shape
    one = np.eye(3)[gold]
    seen = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    for step in range(1, steps + 1 if n else 0):
        e, go = sum(np.take(weights, r, axis=0) for r in rows), np.exp(moves + banned)
        e = np.exp(e - e.max(2, keepdims=True)).transpose(1, 0, 2).copy()
        # forward and backward sums, scaled to add up to one at every token
        fore, back, scale = np.empty((t, n, 3)), np.ones((t, n, 3)), np.ones((t, n, 1))
        for k in range(t):
            fore[k] = e[k] * (fore[k - 1] @ go) if k else e[k]
            scale[k] = fore[k].sum(1, keepdims=True)
            fore[k] /= scale[k]
        e /= scale
        for k in range(t - 2, -1, -1):
            back[k] = (e[k + 1] * back[k + 1]) @ go.T
        mean = (fore * back).transpose(1, 0, 2)
        pair = go * (fore[:-1].reshape(-1, 3).T @ (e * back)[1:].reshape(-1, 3)) - seen
        delta = ((mean - one) / n).reshape(-1, 3)
        slope = np.stack([sum(np.bincount(r.ravel(), delta[:, c], WEIGHTS) for r in rows) for c in range(3)], 1) + decay * weights
        for x, g, (m, v) in zip((weights, moves), (slope, pair / n + decay * moves), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SecretModel(weights.astype(np.float32).astype(np.float64), moves + banned)


def value_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values that the base patterns find in a whole text, longest first where they start alike."""
    out = [m.span(2) for m in KINDS["assign"][0].finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted({*out, *[(s, e) for s, e, kind in base_spans(text) if kind != "assign"]}, key=lambda x: (x[0], -x[1]))


def gold_tags(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of tokens: every token that overlaps a span is in the secret; the first begins it, anew for each span."""
    tags = np.full(len(starts), OUTSIDE)
    for s, e in spans:
        at = np.arange(np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left"))
        new = at[tags[at] == OUTSIDE]
        tags[new] = INSIDE
        if len(new) and new[0] == at[0]:
            tags[at[0]] = BEGIN
    return tags


def made_secret(rng: random.Random) -> tuple[str, str, str]:
    """(before, value, after) of an invented secret: values of several parts, under any name, in quotes, URLs or blocks."""
    lower, both = string.ascii_lowercase, string.ascii_letters + string.digits

    def run(signs: str, least: int, most: int) -> str:
        return "".join(rng.choices(signs, k=rng.randint(least, most)))

    form = rng.random()
    if form > 0.8:  # keys that stand alone, with or without a short mark of who gave them out
        mark = rng.choice(["", f"{run(lower, 2, 6)}{rng.choice('_-')}", f"{run(lower, 2, 5)}{rng.choice('_-')}{run(lower, 3, 5)}{rng.choice('_-')}"])
        pool = rng.choice([both, both, both + 3 * string.digits, string.ascii_uppercase + string.digits, "0123456789ABCDEF"])
        blocks = [run(pool, 24, 44)] if rng.random() < 0.6 else [run(rng.choice([string.digits, pool, pool]), 8, 40) for _ in range(rng.randint(1, 3))] + [run(pool, 20, 40)]
        before = rng.choice(["", "", f"{run(lower, 2, 9)} ", f"{run(lower, 2, 9)}: ", f"{run(lower, 2, 9)}: {run(lower, 3, 8)} "])
        return before, mark + rng.choice("-_.").join(blocks) + f"{rng.choice('aQx' if pool is both else 'ABC')}{rng.randint(0, 9)}", ""
    if form < 0.12:
        width = rng.choice([24, 32, 40, 64])
        lines = ["".join(rng.choices(both + "+/", (62 * [1] + 2 * [0.5]), k=width)) for _ in range(rng.randint(2, 4))]
        return rng.choice(["-----BEGIN PRIVATE KEY-----\n", f"{run(lower, 3, 8)}:\n", f"{run(lower, 3, 8)} = "]), "\n".join(lines), "\n"
    signs, quote = SIGNS, rng.choice(["", "", '"', "'"])
    if form < 0.24:
        before, after, signs = f"{run(lower, 3, 6)}://{run(lower, 3, 8)}:", f"@{run(lower, 3, 8)}.{run(lower, 2, 3)}/", "!:%#$&*+_.=-"
    else:
        name = rng.choice(["token", "password", run(lower, 2, 9), f"{run(lower, 2, 6)}_{run(lower, 2, 6)}"])
        name = name.upper() if rng.random() < 0.4 else name
        before, after = f"{name}{rng.choice(['=', '=', ' = ', ': ', ':'])}{quote}", quote
        if quote and rng.random() < 0.15:
            signs = " "
    mixed = [both, both + 3 * string.digits, string.ascii_uppercase + string.digits, lower + string.digits, string.hexdigits[:16]]
    parts = [run(rng.choice([*mixed, both, lower, string.digits]), 2, 9) for _ in range(rng.randint(2, 7))]
    if sum(map(len, parts)) < 10 or rng.random() < 0.4:
        parts = [run(rng.choice(mixed), 12, rng.choice([20, 40]))]
    value = parts[0] + "".join(rng.choice(signs) + x for x in parts[1:])
    return before, value + f"{rng.choice('aQx')}{rng.randint(0, 9)}" + (rng.choice(["!", "#", "$", "%", "=", "=="]) if signs == SIGNS and rng.random() < 0.3 else ""), after


def made_decoy(rng: random.Random) -> str:
    """What looks like a secret and is none: settings with plain values, dates, addresses, numbers, names with digits."""
    word, n = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 10))), rng.randint(1, 9999)
    number = lambda k: "".join(rng.choices(string.digits, k=k))
    uuid = "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12))
    return rng.choice([
        number(rng.randint(6, 16)), f"{number(4)} {number(4)} {number(4)} {number(4)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", uuid, f"{word}: {uuid}", f"IMG_{number(8)}_{number(6)}.jpg",
        f"get{word.title()}By{word[::-1].title()}{n % 10}", f"{word}-{word[::-1]}-{word[:4]}-{n}", f"{word.upper()}_{word[::-1].upper()}_{n % 100}", f"{word * 3}{n % 10}", f"DE{number(2)} {number(4)} {number(4)} {number(2)}",
        f"{word} = {word[::-1]}", f"{word}: {n}", f"{word}={n}", f'{word}="{word[::-1]} {word}"', f"20{n % 90 + 10}-0{n % 9 + 1}-1{n % 10}T1{n % 10}:2{n % 10}:3{n % 10}Z",
        f"https://www.{word}.com/{word[::-1]}/{n}.html", f"{word}.{n}@{word[::-1]}.org", f"v{n % 10}.{n % 7}.{n % 5}-{word}{n % 3}", f"+{n % 90 + 10} {n}-{n * 7}", f"{word}{n}", f"{word}_{n}", f"/{word}/{word[::-1]}/{word}{n % 10}.txt",
    ])


def with_made(text: str, seed: int) -> tuple[str, list[tuple[int, int]], int]:
    """A text with an invented secret at its first base match, or else in a gap, and a decoy; the values' spans, the decoy's place."""
    rng = random.Random(crc32(text.encode("utf-8", "replace"), seed))
    gaps = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    found = next((m for m in KINDS["assign"][0].finditer(text) if m.end(2) - m.start(2) >= 6), None)
    lo, hi = found.span() if found else (rng.choice(gaps),) * 2
    if found and text[hi : hi + 1] in ("'", '"') and text[hi - len(found[2]) - 1] == text[hi]:
        hi += 1
    before, value, after = made_secret(rng)
    head = text[:lo] + (" " if not found else "") + before
    made = head + value + after + text[hi:]
    spans = [(s, e) for s, e in value_spans(made) if e <= len(head) - len(before) or s >= len(head) + len(value)]
    decoy = len(made) + 1
    return f"{made} {made_decoy(rng)} {text[:400]}", sorted([*spans, (len(head), len(head) + len(value))]), decoy


def train_secrets(df: DataFrame, text: str = "text", sample_rows: int = 3000, windows: int = 6000, around: int = 10) -> SecretModel:
    """Fit the field on windows of tokens from at most about `sample_rows` texts (a documented bound, chosen by hash).

    The base patterns label the tokens: those of the value are the secret. As their values are of few forms, each text
    comes four times more, each time with an invented secret of another form, mostly without a name that the base knows, and a
    decoy. Windows lie around both ends of secrets, around those of invented ones, and around decoys or anywhere else; at
    most `windows` reach the driver. Repeated texts count once and null texts not; without texts the field tags nothing.
    """
    n = df.count()
    sample = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample_rows))) == 0)).distinct()
    wide = 2 * around + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes()
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []

                def cut(t: str, spans: list[tuple[int, int]], kind: int, decoy: int | None = None) -> None:
                    made = tokens([t], table)
                    starts = made.start
                    if len(starts) < wide:
                        return
                    tags = gold_tags(starts, made.end, spans)
                    first = np.flatnonzero(tags == BEGIN)
                    last = np.flatnonzero((tags != OUTSIDE) & (np.append(tags[1:], OUTSIDE) != INSIDE))
                    mids = [(kind, i) for i in np.unique([*first[:4], *last[:4]]).tolist()]
                    mids += [(0, i) for i in ([int(np.searchsorted(starts, decoy))] if decoy else np.linspace(around, len(starts) - around - 1, 2).astype(int).tolist())]
                    rows = feature_rows(made)
                    for which, mid in mids:
                        lo = min(max(0, mid - around), len(starts) - wide)
                        out.append((which, np.concatenate([rows[:, lo : lo + wide].ravel(), tags[lo : lo + wide]])))

                for t in part.column("text").to_pylist():
                    cut(t, value_spans(t), 1)
                    for seed in range(4):
                        made, spans, decoy = with_made(t, seed)
                        cut(made, spans, 2, decoy)
                flat = np.concatenate([np.empty(0, np.int64), *[w for _, w in out]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * (8 * wide), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), lists], names=["secret", "w"])

    made = stored(sample.mapInArrow(run, "secret int, w array<int>"), "windows")
    most = {1: windows // 6, 2: windows // 2, 0: windows // 3}
    got = [np.array(r.w) for s, k in most.items() for r in made.where(F.col("secret") == s).orderBy(F.xxhash64("w")).limit(k).collect()]
    flat = np.array(got, np.int64).reshape(len(got), 8, wide)
    return fit(flat[:, :7].transpose(1, 0, 2), flat[:, 7])


def solid(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the stretches that spans, sorted by start, cover together."""
    starts, ends = [], []
    for s, e, _ in spans:
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def all_spans(texts: list[str | None], model: SecretModel, table: np.ndarray) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each whole text; tagged secrets join, whole, unless base spans hold all of them.

    Short texts go through the field together, about TOGETHER signs at a time.
    """
    rank = {k: i for i, k in enumerate([*KINDS, CRF])}
    for some in together([t or "" for t in texts]):
        made = tokens(some, table)
        longest = np.zeros(len(some), np.int64)
        np.maximum.at(longest, made.owner, made.end - made.start)
        for t, most, found in zip(some, longest, model.spans_of(some, made)):
            base = base_spans(t, most >= 24)
            starts, ends = solid(base)
            more = [(s, e, CRF) for s, e in found if not ((k := bisect_right(starts, s)) and ends[k - 1] >= e)]
            yield base, sorted(base + more, key=lambda x: (x[0], rank[x[2]]))


def together(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in lists of about TOGETHER signs; a longer text is a list by itself."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


COLUMNS = [*[field(f"n_{k}", T.LongType()) for k in KINDS], field("base_sha256", T.StringType()), field("spans", T.StringType())]


def scan_secrets(df: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """`df` with counts of base matches, their digest, and all spans of every whole text; one pass without a shuffle.

    Null and empty texts have none. Very long texts are read whole. Repeated rows are scanned each. Spans that start
    alike come in the order of kinds, the field's last. Columns of the same names are replaced, others stay. Empty tables
    give none. The model (half a MB) goes to every task.
    """
    parts = (model.weights.astype(np.float32), model.moves)

    def make():
        own, table = SecretModel(parts[0].astype(np.float64), parts[1]), classes()

        def scan(texts: list[str | None]) -> list[pa.Array]:
            rows = list(all_spans(texts, own, table))
            counts = [pa.array([sum(k == kind for _, _, k in base) for base, _ in rows], pa.int64()) for kind in KINDS]
            digests = [sha256(joined(base).encode()).hexdigest() for base, _ in rows]
            return [*counts, pa.array(digests, pa.string()), pa.array([joined(every) for _, every in rows], pa.string())]

        return scan

    return map_texts(df, make, COLUMNS, text)


def redact_secrets(df: DataFrame, model: SecretModel, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every span of a secret replaced by `mark`; overlapping spans become one mark.

    Null stays null, and texts without a secret stay as they are, whatever their length. Rows and columns stay too.
    """
    parts, names = (model.weights.astype(np.float32), model.moves), df.columns

    def make():
        own, table = SecretModel(parts[0].astype(np.float64), parts[1]), classes()

        def clean(t: str | None, spans: list[tuple[int, int, str]]) -> str | None:
            out, at = [], 0
            for s, e, _ in spans:
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return "".join([*out, t[at:]]) if out else t

        return lambda texts: [pa.array([clean(t, every) for t, (_, every) in zip(texts, all_spans(texts, own, table))], pa.string())]

    new = "clean_text"
    while new in names:
        new += "_"
    out = map_texts(df, make, [field(new, T.StringType())], text)
    return out.withColumn(text, F.col(new)).select(*names)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs, train_secrets(docs)).select("doc_id", *[c.name for c in COLUMNS])
