"""Full-text, vector and hybrid retrieval over document and embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import partitions

#: Rows of a block of vectors, and of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 256

TOKEN = r"[a-z0-9_]+"


def tokens(c: Column) -> Column:
    """Distinct lower-cased tokens of letters, digits and '_' (ASCII); an empty array for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))), F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: one row per distinct token of each document."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token"))


def idf(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """ln(N / df) per token; `n_docs` has one row, n."""
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_docs)).select("token", "df", F.log(F.col("n").cast("double") / F.col("df")).alias("idf"))


def query_tokens(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(TOKEN, text.lower())))


def expand_tokens(toks: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    """Query tokens and the synonyms of each, in order and without repeats."""
    return list(dict.fromkeys(t for q in toks for t in [q, *synonyms.get(q, [])]))


def fts(df: DataFrame, key: str, text: str, query: str, strict_bonus: float = 1.0, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Documents that hold any query token: key, score = sum of the idf of the tokens hit, plus the bonus if all are.

    Only documents with a hit leave the scan: the filter on tokens comes before the grouping, and the document
    frequencies are counted from the same hits. An empty query gives no row.
    """
    asked = query_tokens(query)
    wide = expand_tokens(asked, synonyms or {})
    if not wide:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    hit = df.select(key, F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, wide))).alias("_hit"), F.lit(1).alias("_one"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    found = hit.where(F.size("_hit") > 0)
    post = found.select(key, F.explode("_hit").alias("token"))
    scored = post.join(F.broadcast(idf(post, n)), "token")  # one row per query token
    out = scored.groupBy(key).agg(F.sum("idf").alias("_s"), F.count(F.when(F.col("token").isin(asked), 1)).alias("_n"))
    return out.select(key, (F.col("_s") + F.when(F.col("_n") == len(asked), strict_bonus).otherwise(0.0)).alias("score"))


def top_k(df: DataFrame, score: str, key: str, k: int, desc_key: bool = False) -> DataFrame:
    """The k best rows with their rank; ties go by key. Each task keeps k rows before the last sort."""
    few = df.orderBy(F.col(score).desc(), F.col(key).desc() if desc_key else F.col(key)).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key).desc() if desc_key else F.col(key))).cast("bigint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def valid_vector(v: Column, size: int) -> Column:
    return (F.size(v) == size) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def similar_to(df: DataFrame, key: str, vector: str, query: list[float], at_least: float = -2.0) -> DataFrame:
    """Cosine similarity to one query vector: key, similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = dot(F.col(vector), q) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(q, q))
    return df.select(key, s.alias("similarity")).where(F.col("similarity") >= at_least)


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows packed into blocks of about `size`, by a hash of the key: one row per block with keys and vectors."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([keys, pa.array([flat.tobytes()], pa.binary())], names=[f"{name}_keys", f"{name}_vecs"])

    return df.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(run, f"{name}_keys array<{kind}>, {name}_vecs binary")


def _similar_pairs(base: DataFrame, queries: DataFrame, key: str, vector: str, size: int, pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """query, key, similarity of the pairs that `pick` takes of each block: places in the queries and in the rows, from
    their similarities (-inf for a query with itself) and the rows' keys.

    Queries and rows meet in blocks: each block of rows is sent to one cell, each block of queries to all cells, and one
    matrix product of two blocks gives their similarities. So what is shuffled is rows + queries x cells, never pairs.
    """
    ok = lambda d: d.where(F.col(vector).isNotNull() & (F.size(vector) == size))
    b = _blocks(ok(base), key, vector, BLOCK, "b")
    q = _blocks(ok(queries), key, vector, QUERY_BLOCK, "q")
    kind = base.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        for batch in batches:
            for i in range(batch.num_rows):
                qk, bk = np.asarray(batch.column(0)[i].as_py()), np.asarray(batch.column(2)[i].as_py())
                qv, bv = (np.frombuffer(batch.column(j)[i].as_py(), np.float32).reshape(-1, size).astype(np.float64) for j in (1, 3))
                sims = unit(qv) @ unit(bv).T
                sims[qk[:, None] == bk[None, :]] = -np.inf
                at, to = pick(sims, bk)
                s = sims[at, to]
                fine = np.isfinite(s)
                kind = batch.column(0).type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(qk[at][fine], kind), pa.array(bk[to][fine], kind), pa.array(s[fine])], names=["query", "key", "similarity"])

    # each block of rows goes to one cell, each block of queries to all of them
    cells = max(partitions(base.sparkSession), base.sparkSession.sparkContext.defaultParallelism)
    b = b.withColumn("cell", F.pmod(F.xxhash64("b_keys"), F.lit(cells)).cast("int"))
    q = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return q.join(b, "cell").select("q_keys", "q_vecs", "b_keys", "b_vecs").mapInArrow(run, f"query {kind}, key {kind}, similarity double")


def vector_top_k(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, size: int) -> DataFrame:
    """Exact cosine neighbours of every query: query, key, rank, similarity; a query isn't its own neighbour.

    k of each query go on from each block. `queries` is a stated part of the rows (such as every hundredth). Vectors of
    another size than `size` are left out. Ties go by key.
    """

    def best(sims: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.broadcast_to(keys, sims.shape), -np.round(sims, 9)), axis=1)[:, :k]
        return np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()

    pairs = _similar_pairs(base, queries, key, vector, size, best)
    w = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "key")
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def vector_at_least(base: DataFrame, queries: DataFrame, key: str, vector: str, least: float, size: int) -> DataFrame:
    """All rows whose cosine similarity to a query is at least `least`: query, key, similarity; a query isn't its own.

    The result has as many rows as there are such pairs. Vectors of another size than `size` are left out.
    """
    return _similar_pairs(base, queries, key, vector, size, lambda sims, keys: np.nonzero(sims >= least))


def rrf(rankings: list[tuple[DataFrame, float]], key: str, constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: key, score = sum of weight / (constant + rank) over the rankings that have the key."""
    parts = [r.select(key, (F.lit(float(w)) / (F.lit(constant) + F.col("rank"))).alias("_s")) for r, w in rankings]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).agg(F.sum("_s").alias("score"))


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """Rank over all rows by score, ties by key: global, so for results of a search, not for whole tables."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))).cast("bigint"))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's tokens that the document has; 0 if either is empty."""
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), 0.0).otherwise(F.size(F.array_intersect(query, doc)) / F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def lexical_rank(df: DataFrame, name: str, text: str, query: str, k: int) -> DataFrame:
    """name, score: overlap with the query + overlap / |query| + 4 if the query is part of the name; ties name DESC."""
    toks = query_tokens(query)
    q = F.array(*map(F.lit, toks))
    n = F.size(F.array_intersect(q, tokens(F.concat_ws(" ", F.regexp_replace(name, r"[._]", " "), text))))
    score = n + n / float(len(toks)) + F.when(F.contains(F.lower(name), F.lit(query.lower())), 4.0).otherwise(0.0)
    return top_k(df.select(name, score.cast("double").alias("score")), "score", name, k, desc_key=True)


def margin_abstain(hits: DataFrame, score: str, margin: float) -> DataFrame:
    """The best hit and its lead over the next; kept only if the lead is at least the margin (no next: always)."""
    w = Window.orderBy(F.col("rank"))
    d = hits.where("rank <= 2").withColumn("lead", F.col(score) - F.lead(score).over(w))
    return d.where("rank = 1").withColumn("accepted", F.coalesce(F.col("lead") >= margin, F.lit(True)))


def recall_and_mrr(hits: DataFrame, truth: DataFrame, query: str, key: str) -> DataFrame:
    """recall (share of queries with a true hit) and mrr (mean of 1 / best true rank); misses count as 0."""
    best = hits.join(truth, [query, key], "left_semi").groupBy(query).agg(F.min("rank").alias("_r"))
    per = truth.select(query).distinct().join(best, query, "left")
    return per.agg(F.avg(F.when(F.col("_r").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))).alias("mrr"))
