import random
import re
import zlib
from collections import Counter

import pytest

from stavelake.llm.common import stored
from stavelake.llm.spelling import PositionIndex, count_words, op13_spelling, spelling_forms


def brute_words(rows):
    """Word counts by the rule as it is stated, letter by letter."""
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_forms(words, times=10):
    by = {}
    for w in words:  # words with a deletion in common, or one apart by a deletion
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    out, form = {}, {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_query_against_brute_force(spark, sf, docs):
    want = brute_forms(brute_words((r.doc_id, r.text) for r in docs.collect()))
    assert len(want) > 500 and any(x[3] for x in want.values()) and as_dict(op13_spelling(spark, sf)) == want


@pytest.mark.parametrize("rows", [8192, 5])
def test_many_near_words_ties_and_chains(spark, rows):
    """Words over few letters have hundreds of near words; with five rows to a slice every block is dealt into tiles."""
    rng = random.Random(rows)
    words = {"".join(rng.choice("abü") for _ in range(rng.randint(7, 10))): 10 ** rng.randint(0, 6) + rng.randint(2, 3) for _ in range(1500)}
    words |= {"a" * n: n for n in range(7, 12)}
    df = stored(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    assert as_dict(spelling_forms(df, block_rows=rows, bucket_rows=200)) == brute_forms(words)


def test_index_finds_each_kind_of_error():
    words = [("abcdefg", 5), ("abcdefgh", 4), ("abcxefg", 3), ("xabcdefg", 2), ("bcdefgh", 9)]
    index = PositionIndex(words, 7, 0, 9)
    named = lambda bits: {w for k, (w, _) in enumerate(index.words) if bits >> k & 1}
    assert named(index.near("abcdefg", 0, 7)) == {"abcdefgh", "abcxefg", "xabcdefg"}
    assert named(index.near("abcdefgh", 0, 8)) == {"abcdefg", "bcdefgh"}
    assert named(index.near("xbcdefg", 0, 7)) == {"abcdefg", "xabcdefg"}
    assert index.words[0][0] == "bcdefgh"


def test_words_of_odd_rows(odd, none):
    want = brute_words((r.doc_id, r.text) for r in odd.collect())
    assert {r.word: r.n for r in count_words(odd).collect()} == want
    assert count_words(none).count() == 0
    assert {r.word: r.n for r in count_words(odd, every=None, least_chars=3, least_n=1).where("word = 'the'").collect()}["the"] > 100


def test_no_words_and_clashing_names(spark, none):
    words = stored(count_words(none), "words")
    assert spelling_forms(words).count() == 0
    rows = [(1, "Zebraaa zebraaa ZEBRAAA ÀÉÎÕÜñÿ×÷ ÀÉÎÕÜñÿ×÷", "w", 3), (None, "zebraab " * 40, "x", 4), (None, None, "y", 5), (2, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    got = as_dict(spelling_forms(stored(count_words(df, every=None), "words")))
    assert got == {"zebraaa": ("zebraab", "zebraab", 3, 1, 40), "zebraab": (None, "zebraab", 40, 1, None), "ÀÉÎÕÜñÿ×÷": (None, "ÀÉÎÕÜñÿ×÷", 2, 0, None)}
    with pytest.raises(ValueError):
        spelling_forms(words, times=1)
