"""Quality rules as a short-circuit cascade: rules run by rejection per cost, as estimated on a sample."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]")
SYMBOLS = "#*$%&|<>"


class Text:
    """One text with measures that are made when a rule first asks for them, and kept."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = WORD.findall(self.text)
        self.n_words = len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len("".join(self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of three words that the text has twice or more, the first one included."""
        width = 3
        windows = list(zip(*[self.words[i:] for i in range(width)]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        total = end = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                total += i + width - max(i, end)
                end = i + width
        return total

    def base(self) -> tuple[int, int, int, int, int]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words

    def share_of_lines(self, found: Callable[[str], bool]) -> float:
        return sum(map(found, self.lines)) / max(1, len(self.lines))


#: Each rule rejects a text when it is true. Bounds are wide, after published web filters: prose stays.
RULES: dict[str, Callable[[Text], bool]] = {
    "word_length": lambda t: not 2 <= t.word_chars / max(1, t.n_words) <= 15,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 6 * len(t.lines),
    "letterless_words": lambda t: 10 * sum(1 for w in t.words if not LETTER.search(w)) > 3 * t.n_words,
    "bullets": lambda t: t.share_of_lines(lambda x: x.lstrip().startswith(("•", "-", "*"))) > 0.9,
    "ellipses": lambda t: t.share_of_lines(lambda x: x.rstrip().endswith(("...", "…"))) > 0.3,
    "shouting": lambda t: 2 * sum(1 for w in t.words if len(w) > 1 and w.isupper()) > t.n_words,
    "one_word": lambda t: 2 * max(Counter(t.words).values(), default=0) > t.n_words > 0,
}


def base_failed(base: tuple[int, int, int, int, int], least_words: int = 50, most_repeat: int = 50) -> bool:
    return base[0] < least_words or 100 * base[4] > most_repeat * base[0]


def rule_order(df: DataFrame, rules: dict[str, Callable[[Text], bool]], text: str = "text", least_words: int = 50, most_repeat: int = 50, sample_rows: int = 1000) -> list[str]:
    """Rule names by rejection per second, as estimated on at most about `sample_rows` different texts, chosen by hash.

    Only texts that pass the base count, as the cascade sees no others, and each further rule is judged by the texts that
    the rules before it leave. The driver gets the time of each rule and how many texts each set of rules rejects. The
    order changes cost, never the verdict; of equal rules the first one listed comes first.
    """
    n = df.count()
    sample = df.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample_rows))) == 0).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t for t in map(Text, f["text"]) if not base_failed(t.base(), least_words, most_repeat)]
            out, masks = [], [0] * len(texts)
            for k, rule in enumerate(rules.values()):
                began = time.perf_counter()
                hits = [bool(rule(t)) for t in texts]
                out.append((1 << k, 0, time.perf_counter() - began))
                masks = [m | (hit << k) for m, hit in zip(masks, hits)]
            out += [(m, c, 0.0) for m, c in Counter(masks).items()]
            yield pd.DataFrame(out, columns=["mask", "texts", "seconds"])

    sums = sample.mapInPandas(run, "mask long, texts long, seconds double").groupBy("mask").agg(F.sum("texts").alias("texts"), F.sum("seconds").alias("seconds")).collect()
    names, order, passed = list(rules), [], 0
    seconds = {r["mask"]: max(r["seconds"], 1e-9) for r in sums}
    while len(order) < len(names):
        left = [k for k in range(len(names)) if not passed >> k & 1]
        rate = {k: sum(r["texts"] for r in sums if r["mask"] >> k & 1 and not r["mask"] & passed) / seconds.get(1 << k, 1e-9) for k in left}
        best = max(left, key=lambda k: (rate[k], -k))
        order.append(names[best])
        passed |= 1 << best
    return order


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = [*[field(n, T.LongType()) for n in MEASURES], field("base_failed", T.BooleanType()), field("kept", T.BooleanType())]


def judge_quality(df: DataFrame, text: str = "text", rules: dict[str, Callable[[Text], bool]] = RULES, least_words: int = 50, most_repeat: int = 50, sample_rows: int = 1000) -> DataFrame:
    """`df` with the base measures of every whole text, `base_failed`, and `kept`.

    A text that passes the base (words, and percent of repeated words) goes through the cascade and stops at the first
    rule that rejects it. Null and blank texts have no words and fail the base. Repeated rows are judged each. Columns
    of the same names are replaced, others stay. Empty tables give none. One pass, no shuffle.
    """
    order = rule_order(df, rules, text, least_words, most_repeat, sample_rows)

    def make():
        steps = [rules[name] for name in order]

        def judge(texts: list[str | None]) -> list[pa.Array]:
            rows = []
            for x in texts:
                t = Text(x)
                m = t.base()
                failed = base_failed(m, least_words, most_repeat)
                rows.append((*m, failed, not failed and not any(rule(t) for rule in steps)))
            kinds = [pa.int64()] * len(MEASURES) + [pa.bool_()] * 2
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return judge

    return map_texts(df, make, COLUMNS, text)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs).select("doc_id", *[c.name for c in COLUMNS])


OP4_SQL = r"""
with t as (select row_number() over () as n, doc_id, coalesce(text, '') as x from documents),
w as (select n, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select n, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws from t)),
v as (select n, i, word || ' ' || lead(word) over a || ' ' || lead(word, 2) over a as win from w window a as (partition by n order by i)),
r as (select n, i from (select *, count(*) over (partition by n, win) as c from v where win is not null) where c > 1),
rep as (select n, count(distinct j) as n_repeat_words from (select n, unnest([i, i + 1, i + 2]) as j from r) group by n),
one as (select n, max(c) as top from (select n, word, count(*) as c from w group by n, word) group by n),
ws as (select n, count(*) as n_words, sum(length(word)) as word_chars, sum(cast(not regexp_matches(word, '[\p{L}\p{Nl}\p{No}]') as int)) as bare,
  sum(cast(length(word) > 1 and word = upper(word) and word <> lower(word) as int)) as loud from w group by n),
l as (select n, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as ls, x, doc_id from t),
m as (select l.n, doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(x, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(bare, 0) as bare, coalesce(loud, 0) as loud, coalesce(top, 0) as top, greatest(len(ls), 1) as n_lines, len(ls) as n_all,
  len(list_filter(ls, lambda y: regexp_matches(y, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]*[•*-]'))) as bullets,
  len(list_filter(ls, lambda y: regexp_matches(y, '([.][.][.]|…)[\s\x0B\x1C-\x1F\x{85}\p{Z}]*$'))) as dots
  from l left join ws using (n) left join rep using (n) left join one using (n)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > 3 * n_words or 10 * n_dup_lines > 6 * n_all
    or 10 * bare > 3 * n_words or bullets / n_lines > 0.9 or dots / n_lines > 0.3 or 2 * loud > n_words or 2 * top > n_words) as kept
from b
"""
