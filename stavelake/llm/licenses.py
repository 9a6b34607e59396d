"""License scans by diagonal voting: word pairs of texts meet those of templates, and offsets vote. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .license_texts import TEMPLATES

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LONG = 16  # words of a template from which on pairs of plain words are no seeds

# The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Words that say nothing of a license: pairs of two of them are in every text.
PLAIN = set("a all an and any are as at be by for from in is it its may not of on or other out shall so such that the these this to under with without you your".split())


#: How a seed pair lies: word by word, over a word that the text lacks, over a word that the text has more.
PLAIN_PAIR, LESS, MORE = 0, 1, 2


def faults_of(words: int, least: float) -> int:
    """How many words may be missing or added: none of up to three, one of up to ten, then two or a share of the words."""
    return 0 if words < 4 else 1 if words <= 10 else max(2, int((1 - least) * words))


def template_pairs(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(h, first, second, template, at, kind) of every seed pair, and (label, base, seeds, words, faults, need, keys) of its template.

    Seeds are word pairs, but not of two plain words in a long template; words: how many words lie in a seed; faults: how
    many words may be missing or added; need: how many seeds a span has that holds so; keys: places of
    numbers and of words in capitals, which must not be missing. In short templates the words on both sides of one that
    may be missing are seeds too, and a key at either end, which is in one pair only, seeds the pair over an added word. The sentinel pair, which no text has, belongs to
    template -1. About a thousand rows, whatever the corpus.
    """
    rows = [(" ", " ", -1, 0, PLAIN_PAIR, "", False, 1, 1, 0, 1, [])]
    for i, (label, text, is_base) in enumerate([(*t, True) for t in base] + [(*t, False) for t in templates]):
        words = text.split()
        low, n = [w.lower() for w in words], len(words)
        at = [j for j in range(n - 1) if n < LONG or not {low[j], low[j + 1]} <= PLAIN]
        held = len({j + d for j in at for d in (0, 1)})
        faults = faults_of(held, least)
        keys = [j for j, w in enumerate(words) if not is_base and (w.isupper() or w.isdigit())]
        less = [j for j in range(n - 2) if faults and (n < LONG or {0, n - 1} & {j, j + 2} & set(keys))]
        more = [j for key, j in ((n - 1, n - 2), (0, 0)) if faults and key in keys]
        pairs = [(j, j + 1, PLAIN_PAIR) for j in at] + [(j, j + 2, LESS) for j in less] + [(j, j + 1, MORE) for j in more]
        rows += [(low[j], low[k], i, j, kind, label, is_base, len(at), held, faults, len(at) if is_base else (held - faults + 1) // 2, keys) for j, k, kind in pairs]
    made = spark.createDataFrame(rows, "first string, second string, template int, at int, kind int, label string, base boolean, seeds int, words int, faults int, need int, keys array<int>")
    return made.withColumn("h", F.xxhash64("first", "second"))


def lead_words(templates: list[tuple[str, str]]) -> list[str]:
    """Words after which a text's next word but one counts as well: those beside a key at the end of a template."""
    ends = [w for _, t in templates for a, key in ((t.split()[-2:-1], t.split()[-1:]), (t.split()[:1], t.split()[:1])) for w in a if key[0].isupper() or key[0].isdigit()]
    return sorted({w.lower() for w in ends})


def best_chain(hits: Column) -> Column:
    """The best chain of words (pos, at) of one span: struct(held words, first place, last place, places in the template).

    An alignment: the words of a chain rise both in the text and in the template. Of equal chains the later one in the
    text wins.
    """

    def grow(done: Column, x: Column) -> Column:
        before = F.filter(done, lambda y: (y.at < x.at) & (y.pos < x.pos))
        grown = F.transform(before, lambda y: F.struct((y.held + 1).alias("held"), y.first.alias("first"), x.pos.alias("pos"), x.at.alias("at"), F.concat(y.path, F.array(x.at)).alias("path")))
        alone = F.struct(F.lit(1).alias("held"), x.pos.alias("first"), x.pos.alias("pos"), x.at.alias("at"), F.array(x.at).alias("path"))
        return F.concat(done, F.array(F.array_max(F.concat(grown, F.array(alone)))))

    return F.aggregate(hits, F.array().cast("array<struct<held:int,first:int,pos:int,at:int,path:array<int>>>"), grow, F.array_max)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text: str = "text", base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8, reach: int = 8) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of whole texts.

    Every word pair of a text gets a hash and is joined to the templates' seed pairs (a list of fixed size, broadcast).
    Hits vote for the diagonal (position in the text less position in the template). Diagonals at most `reach` apart
    are merged around the one with most votes, so words may be missing or added, but a span does not drift further.
    Merged spans with votes enough are verified by aligning their hits: a chain that rises in text and template has to
    hold all key words of the template and all of its words but a few (`faults_of`), where each word
    added inside it counts as one that is missing. The share is that of held words among those and the added ones. Of spans that overlap in the text the one with the higher share, then the longer, names it. Base phrases need all
    their pairs on one diagonal. score is the best share among the method's own labels, 0 without any.

    Null and empty texts have no words; their labels are empty strings and their word numbers null. Rows with the same
    id and text are told apart only by their number, and come back as often as they came. Pairs are made and joined
    row by row, so a very long text needs memory for its own words only. Equal spans of different labels all name their
    place. Other columns are dropped. Empty tables give none.
    """
    made = template_pairs(df.sparkSession, base, templates, least)
    seeds = F.broadcast(made.select("h", "first", "second", "template", "at", "kind").hint("broadcast"))
    about = F.broadcast(made.drop("h", "first", "second", "at", "kind").distinct())
    # a text that starts or ends in a gap has an empty word there
    words = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP, -1)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), words.alias("words"))
    size, lead = F.size("words"), (F.get("words", F.lit(0)) == "").cast("int")
    n = size - lead - F.when(size > 1, (F.get("words", size - 1) == "").cast("int")).otherwise(0)
    each = rows.select("id", "key", "words", lead.alias("lead"), n.alias("n_words"), F.posexplode_outer("words").alias("i", "word"))
    # the last word has none after it: it stands for the row itself and meets the sentinel
    last = F.col("i") + 1 == size
    a, b = F.when(last, " ").otherwise(F.col("word")), F.when(last, " ").otherwise(F.get("words", F.col("i") + 1))
    pair = lambda c, wide: F.struct(c.alias("b"), F.lit(wide).alias("wide"))
    both = F.when(F.col("word").isin(lead_words(templates)) & (F.col("i") + 2 < size), F.array(pair(b, False), pair(F.get("words", F.col("i") + 2), True)))
    tried = each.select("id", "key", "n_words", (F.col("i") - F.col("lead")).alias("pos"), a.alias("a"), F.inline(both.otherwise(F.array(pair(b, False)))))
    # the hash is the only join key, so a look costs one number; the words themselves are held against each other then
    same = F.nullif("a", "first").isNull() & F.nullif("b", "second").isNull()
    hits = tried.join(seeds, F.xxhash64("a", "b") == F.col("h")).where(same & (F.col("wide") == (F.col("kind") == MORE)))
    doc = ["id", "key", "n_words"]
    sentinel, mine = F.col("template") < 0, (F.col("template") >= 0) & ~F.col("base")
    hits = hits.select(*doc, "template", (4 * F.col("at") + F.col("kind")).alias("at"), F.when(sentinel, 0).otherwise(F.col("pos") - F.col("at")).alias("diagonal"))
    # votes: places of the template that have a hit on the diagonal; the sentinel counts how often the row came
    votes = hits.groupBy(*doc, "template", "diagonal").agg(F.count("*").alias("rows"), F.collect_set("at").alias("ats"))
    votes = votes.repartition(*doc).join(about, "template").withColumn("n", F.size("ats"))  # all that follows is by text
    around = Window.partitionBy(*doc, "template").orderBy("diagonal").rangeBetween(-reach, reach)
    left = (-F.col("diagonal")).alias("left")
    votes = votes.withColumn("sum", F.sum("n").over(around)).withColumn("most", F.max(F.struct("n", left)).over(around))
    votes = votes.withColumn("near", F.max("sum").over(around)).where(sentinel | F.col("base") & (F.col("n") == F.col("seeds")) | mine & (F.col("near") >= F.col("need")))
    word = lambda pos, at: F.struct((F.col("diagonal") + pos).cast("int").alias("pos"), at.cast("int").alias("at"))
    at, kind = (lambda x: F.floor(x / 4)), (lambda x: x % 4)
    second = lambda x: word(at(x) + 1 + (kind(x) == MORE).cast("int"), at(x) + 1 + (kind(x) == LESS).cast("int"))
    pairs = F.flatten(F.transform("ats", lambda x: F.array(word(at(x), at(x)), second(x))))
    spans = votes.withColumn("hits", F.array_distinct(F.flatten(F.collect_list(F.when(mine, pairs)).over(around))))
    spans = spans.where(~mine | (F.col("most") == F.struct("n", left)) & (F.col("sum") >= F.col("need")))
    spans = spans.withColumn("c", F.explode(F.array(F.when(mine, best_chain(F.array_sort("hits"))))))  # made once
    added = F.greatest(F.col("c.pos") - F.col("c.first") - F.col("c.at") + F.get("c.path", F.lit(0)), F.lit(0))
    good = (F.size(F.array_except("keys", "c.path")) == 0) & (F.col("words") + added - F.col("c.held") <= F.col("faults"))
    spans = spans.withColumn("share", F.when(good, F.col("c.held") / (F.col("words") + added))).where(~mine | good)
    start, end = F.coalesce("c.first", "diagonal"), F.coalesce("c.pos", F.col("diagonal") + 1)
    spans = spans.select(*doc, "template", "label", "base", "rows", start.alias("start"), end.alias("end"), "share", F.col("c.held").alias("held"))
    # stretches of own spans that overlap; within one, a span that overlaps a better one goes
    own = F.col("own")
    spans = spans.withColumn("own", F.col("share").isNotNull())
    place = Window.partitionBy(*doc, "own").orderBy("start", "end", "template")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(own & (F.col("start") <= F.coalesce(before, F.lit(-1))), 0).otherwise(1))
    spans = spans.withColumn("stretch", F.when(own, F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    sets = spans.groupBy(*doc, "own", "stretch").agg(
        F.max("rows").alias("rows"), F.sum(F.col("base").cast("long")).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("low"), F.max(F.when(F.col("base"), F.col("start"))).alias("high"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_list(F.when(own, F.struct("share", "held", "start", "end", "label"))).alias("all"), F.max(F.when(F.col("template") == -1, F.col("rows"))).alias("times"),
    )
    better = lambda x, y: (y.start <= x.end) & (y.end >= x.start) & ((y.share > x.share) | ((y.share == x.share) & (y.held > x.held)))
    sets = sets.withColumn("fit", F.filter("all", lambda x: ~F.exists("all", lambda y: better(x, y))))
    names = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.concat(*[F.collect_list(x) for x in c])))), ",")
    out = sets.groupBy(*doc).agg(
        F.max("times").alias("rows"),
        F.sum(F.when(~F.col("own"), F.col("n_base"))).alias("n_base"),
        F.min("low").cast("long").alias("first_word"),
        F.max("high").cast("long").alias("last_word"),
        names("base_labels").alias("base_labels"),
        names("base_labels", F.transform("fit", lambda x: x.label)).alias("labels"),
        F.coalesce(F.max(F.array_max(F.transform("fit", lambda x: x.share))), F.lit(0.0)).alias("score"),
    )
    out = out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
