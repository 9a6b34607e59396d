import hashlib
import random
import re
from collections import Counter

import pytest

from stavelake.llm import substrings
from stavelake.llm.substrings import OP12_SQL, SuffixAutomaton, anchors, op12_substrings, passages, remove_repeats, spans, split_words, token, word_hashes


def brute(rows, window=35):
    """By the definition: every window of every row, counted as it is."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_whole_query_against_brute_force(spark, sf, docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(op12_substrings(spark, sf)) == want and sum(x[2] > 0 for x in want) > 10 and OP12_SQL


def corpus(seed, n=120):
    """Random texts over few words with shared passages, periodic stretches, near copies and copies."""
    rng = random.Random(seed)
    passage = [[f"p{k}w{rng.randint(0, 5)}" for _ in range(rng.randint(3, 60))] for k in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice([rng.choice(passage), ["a", "b"] * rng.randint(0, 30), [f"u{rng.random()}" for _ in range(rng.randint(0, 50))], [rng.choice("xy") for _ in range(20)]])
        texts.append(rng.choice(["  ", " ", "\n", "\t "]).join(w))
    return [(i, t) for i, t in enumerate(texts + texts[:10] + [texts[5]] * 20 + [texts[7] + " tail"] * 30)]


@pytest.mark.parametrize("window", [35, 8])
@pytest.mark.parametrize("plan", [{}, {"few": 3, "hot_share": 10**6, "shard_rows": 5}])
def test_shared_passages_against_brute_force(spark, window, plan):
    """The second plan makes most repeated anchors hot, so that the broadcast automaton and lone windows decide."""
    rows = corpus(window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(remove_repeats(df, window=window, **plan)) == brute(rows, window)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(remove_repeats(odd)) == brute(rows)
    out = remove_repeats(none)
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]


def test_long_words_and_clashing_names(spark):
    long = [f"{'x' * 100_000}{i}" for i in range(2)]
    rows = [(1, " ".join(long * 20)), (None, " ".join(long * 18)), (None, None), (2, " ".join([long[0]] * 34)), (3, "  \x1c\x85 a")]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, key int, h int, kept string")
    assert got(remove_repeats(df)) == brute(rows)


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(200):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 5))]
        times = [rng.randint(1, 2) for _ in seqs]
        automaton = SuffixAutomaton()
        paths = [automaton.add(s, n) for s, n in zip(seqs, times)]
        best, ends = automaton.repeated(), Counter()
        for s, n in zip(seqs, times):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    ends[tuple(s[i:j])] += n
        for s, path in zip(seqs, paths):
            assert [best[v] for v in path] == [max([0, *(n for n in range(1, e + 1) if ends[tuple(s[e - n : e])] > 1)]) for e in range(1, len(s) + 1)]
        probe = [rng.randint(0, 3) for _ in range(15)]
        assert list(automaton.matches(probe)) == [max([0, *(n for n in range(1, e + 1) if ends[tuple(probe[e - n : e])])]) for e in range(1, 16)]


@pytest.mark.parametrize("places", [1 << 24, 1 << 8])
def test_anchors_follow_the_words_of_a_window(monkeypatch, places):
    monkeypatch.setattr(substrings, "PLACES", places)
    rng = random.Random(2)
    words = [str(rng.randint(0, 3)) for _ in range(300)] + ["same"] * 100
    h, first, end = anchors(" \n".join(words), 20)
    own = {}
    for x, lo, hi in zip(h, first, end):
        for s in range(lo, hi):
            assert own.setdefault(tuple(words[s : s + 20]), x) == x
    assert sorted(s for lo, hi in zip(first, end) for s in range(lo, hi)) == list(range(381))
    for s in (0, 100, 380):
        assert anchors("  " + "\t".join(words[s : s + 20]) + " ", 20)[0].tolist() == [own[tuple(words[s : s + 20])]]
    assert max(end - first) <= 30 and len(anchors(" x" * 34, 35)[0]) == len(anchors(None, 35)[0]) == 0


def test_word_hashes_tell_words_apart():
    rng = random.Random(5)
    words = ["".join(rng.choice("abü\x00\x1f") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    own = {}
    for w, h in zip(words, word_hashes(" ".join(words).encode())):
        assert own.setdefault(w, h) == h
    assert len(set(own.values())) == len(own)


def test_passages_have_exactly_their_windows():
    rng = random.Random(3)
    text = [b"%d" % rng.randint(0, 2) for _ in range(300)]
    windows = rng.sample(sorted({tuple(text[i : i + 6]) for i in range(295)}), 80)
    made = passages([list(w) for w in windows])
    assert {tuple(p[i : i + 6]) for p in made for i in range(len(p) - 5)} == set(windows) and sum(len(p) - 5 for p in made) == 80
    assert spans([0, 0, 3, 3, 0, 0, 3], 3) == [(0, 7)] and spans([0, 0, 3, 0, 4], 3) == [(0, 5)]
    assert split_words("a\x1fb c\x0bd　e") == [b"a\x1fb", b"c", b"d\xe3\x80\x80e"] and token(b"y" * 33).startswith(b"\t")
