import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from stavelake.llm.packing import Encoder, deals, pack_documents, packed, packing_patterns

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def check(rows, texts, most=1024):
    exact = Encoder(ARGS[0], None, "").exact
    ids = {i: np.append(np.array(exact.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4") for i, t in texts.items()}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return ids, by


def test_every_id_once_and_little_padding(docs):
    rows = pack_documents(docs, *ARGS).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids, by = check(rows, texts)
    covered = Counter()
    for r in rows:
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    assert sum(map(len, ids.values())) / (1024 * len(by)) > 0.97


def test_odd_rows(odd, none):
    rows = pack_documents(odd, *ARGS).collect()
    check(rows, {r.doc_id: r.text for r in odd.collect()})
    assert [(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id in (3, 4)] == [(0, 1, 1)] * 2
    assert sum(r.start == 0 for r in rows if r.doc_id == 2) == 2
    assert pack_documents(none, *ARGS).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_each_length(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(40)}
    got = Counter()
    for count, content in packing_patterns(hist, 64):
        assert sum(n * k for n, k in content) <= 64
        for n, k in content:
            got[n] += count * k
    assert got == hist


@pytest.mark.parametrize("counts", [{}, {7: 1}, {1024: 18_000, 3: 35_000}, {1024: 10**6, 5: 1}, {1024: 9 * 10**9, **{n: 10**7 for n in range(1, 1024)}}])
def test_groups_of_a_length_are_small_and_few(counts):
    got, total = deals(counts), sum(counts.values())
    assert all(counts[n] / got[n] <= max(64, min(250_000, total / 1024)) for n in counts)
    assert sum(got.values()) <= len(counts) + max(1024, total / 250_000) + 1


def test_a_common_length_keeps_its_ranks_over_groups(spark):
    """Of 5,000 pieces 4,000 have one length, so they are dealt into many groups."""
    lengths = [8] * 4000 + [3] * 1000
    pieces = spark.createDataFrame([(i, n, i) for i, n in enumerate(lengths)], "doc_id long, length long, row long")
    by = {}
    for r in packed(pieces, 16).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, by.values())) == 5000
    for parts in by.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 16
    assert len(by) == 2200


def test_fast_ids_equal_the_library():
    both, rng = Encoder(*ARGS), random.Random(3)
    alpha = "abz ABZ'sñé.,-09 \n\t\x00\x1f\x85\xa0ΣǅҰ漢🙂"
    for n in range(3000):
        t = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 30))) + ("<|endoftext|> x" if n % 50 == 0 else "")
        assert both(t).tolist() == both.exact.encode(t, add_special_tokens=False).ids
