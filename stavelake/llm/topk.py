"""Exact top-k inner products: exhaustive term-at-a-time accumulation over blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LIMIT = 2**62


def _ragged(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column."""
    col = col.combine_chunks()
    lengths = np.diff(col.offsets.to_numpy())
    return np.repeat(np.arange(len(col)), lengths), col.flatten().to_numpy(zero_copy_only=False)


def best_in_block(queries: pa.Table, cands: pa.Table, k: int, cells: int = 1 << 21) -> pa.Table:
    """Each query row's k best candidates of one block, by score and then by the lesser id.

    Postings of the block are gathered by term; each query row scatters its weight times a term's postings into a dense
    score array; a partition of the scores picks the best. `cells` bounds the score array: queries go in strips.
    """
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "query_row", "vec_id", "score")})
    if not len(queries) or not len(cands):
        return empty
    cands = cands.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    ids, qids = cands["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    rows_of, qrows = cands["row"].to_numpy(), queries["row"].to_numpy()
    (crow, cterm), (qrow, qterm) = _ragged(cands["terms"]), _ragged(queries["terms"])
    cweight, qweight = _ragged(cands["weights"])[1].astype(np.int64), _ragged(queries["weights"])[1].astype(np.int64)
    peak = max((int(abs(int(x))) for w in (cweight, qweight) if len(w) for x in (w.max(), w.min())), default=0)
    width = max(1, int(np.bincount(qrow).max())) if len(qrow) else 1
    big = peak * peak * width * 4 >= LIMIT // max(1, len(ids))
    kind = object if big else np.int64
    order = np.lexsort((crow, cterm))
    crow, cterm, cweight = crow[order], cterm[order], cweight[order].astype(kind)
    qweight = qweight.astype(kind)
    strip = max(1, cells // len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(qids), strip):
        own, own_rows = qids[at : at + strip], qrows[at : at + strip]
        scores = np.zeros((len(own), len(ids)), kind)
        lo, hi = np.searchsorted(qrow, [at, at + len(own)])
        terms = qterm[lo:hi]
        for term in np.unique(terms):
            i, j = np.searchsorted(cterm, [term, term + 1])
            if i == j:
                continue
            mine = np.flatnonzero(terms == term) + lo
            rows, part = qrow[mine] - at, np.multiply.outer(qweight[mine], cweight[i:j])
            if j - i == len(ids) and len(mine) == len(own):
                scores += part
            else:
                np.add.at(scores, np.ix_(rows, crow[i:j]), part)
        if big:
            for r, q in enumerate(own):
                clipped = [max(-(2**63), min(2**63 - 1, int(x))) for x in scores[r]]  # saturated scores tie
                best = sorted((c for c in range(len(ids)) if rows_of[c] != own_rows[r]), key=lambda c: (-clipped[c], c))[:k]
                out.append((np.full(len(best), q), np.full(len(best), own_rows[r]), ids[best], np.array([clipped[c] for c in best], np.int64)))
            continue
        key = scores * len(ids) + (len(ids) - 1 - np.arange(len(ids)))  # greater is better, and no two are equal
        key[own_rows[:, None] == rows_of[None, :]] = np.iinfo(np.int64).min
        take = min(k, len(ids))
        best = np.argpartition(key, len(ids) - take, axis=1)[:, len(ids) - take :]
        rows = np.repeat(np.arange(len(own)), take)
        best = best.ravel()
        fine = rows_of[best] != own_rows[rows]
        rows, best = rows[fine], best[fine]
        out.append((own[rows], own_rows[rows], ids[best], scores[rows, best]))
    return pa.table({n: pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i, n in enumerate(empty.column_names)})


def weighted_terms(df: DataFrame, id_col: str, weights: Column) -> DataFrame:
    """A written table (row, vec_id, terms, weights): a row's number, and the non-zero weights of a vector of longs."""
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), weights.alias("w")).where("vec_id is not null")
    pairs = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p.x != 0)
    made = df.select(F.monotonically_increasing_id().alias("row"), "vec_id", pairs.alias("p"))
    return stored(made.select("row", "vec_id", F.col("p.i").alias("terms"), F.col("p.x").alias("weights")), "terms")


def whole_vector(c: Column) -> Column:
    """True if a vector is not null and all its components are finite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(False))


def top_k(queries: DataFrame, cands: DataFrame, k: int = 5, query_rows: int = 8192, cand_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) over rows of one table of `weighted_terms`.

    Both sides are dealt into blocks by row number, so no repeated id makes a block large; every pair of a query block
    and a candidate block is one task's work, with memory bounded by the blocks. Blocks of equal size on both sides copy
    the fewest rows. They keep k rows for each query; a ranking over those merges them. Every query row is a query by
    itself, and every row but its own is a candidate, so an id that repeats is answered as often as it comes and may
    find itself. Ties go to the lesser id; rows of one id have no order. Rows without an id are left out. A vector
    without weights scores 0. Components past 64 bits saturate, and so do scores. Empty tables give none.
    """
    n_q, n_c = queries.count(), cands.count()
    q_blocks, c_blocks = -(-max(1, n_q) // query_rows), -(-max(1, n_c) // cand_rows)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = queries.withColumn("qb", block(q_blocks)).withColumn("cb", spread(c_blocks))
    right = cands.withColumn("cb", block(c_blocks)).withColumn("qb", spread(q_blocks))
    names = ["row", "vec_id", "terms", "weights"]
    partial = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        lambda q, c: best_in_block(q.select(names), c.select(names), k), "query_id long, query_row long, vec_id long, score long"
    )
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(whole_vector(F.col("embedding")))
    terms = weighted_terms(rows, "vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    return top_k(terms.where("vec_id % 50 = 0"), terms)


OP2_SQL = """
with e as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score
  from e q join e c on q.n <> c.n where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
