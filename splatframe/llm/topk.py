"""Exact top-k inner products by the three-phase uniform threshold.

The components are cut into ``PARTS`` parts. A part's inner product is a partial score, and a score is the sum of the partial scores. Every
task knows one part only: that of a block of candidates and of a block of queries.

1. *Gather.* Each task sends, for each query, the list of its ``LIST`` best partial scores. What other parts a listed candidate has is
   looked up, and the k-th best of the sums, over all blocks, is the query's cutoff: *k* candidates reach it, so it is safe.
2. *Collect.* Each task gets the cutoffs c with its queries, and sends all entries with a partial score of ``c / PARTS`` or more. A candidate without
   such an entry sums up to less than c. Of the others, parts that weren't sent count as just under that threshold, and candidates whose sum
   then stays under c are dropped.
3. *Resolve.* For the rest, and only for these, the tasks score the parts that weren't sent. Sums are then whole, and exact.

Candidates and queries of a block meet again and again under the names of their blocks; messages are rows of a query and a block of
candidates, which hold arrays. Neither side is collected or broadcast. Blocks of queries (a stated set, a fiftieth of the rows) meet all blocks
of candidates, so a candidate's parts are sent once for every ``QUERIES`` queries, and a query's once for every ``ROWS`` candidates.

Scores are integers and are exact: doubles multiply them where all sums stay below 2**53, int64 does elsewhere.

Defined results: vectors that are null or hold null or non-finite components take no part. Vectors of different lengths are compared on the shorter
length. Rows repeated with the same id and vector count once; rows of one id with several vectors are queries and candidates each, and none is a
candidate of its own id. Rows with a null id take no part. Scores that may be beyond int64 raise an error. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

K, PARTS, SCALE = 5, 2, 256
#: Entries of a local list that phase 1 sends (at least k are sent).
LIST = 64
#: Rows of a block of candidates and of queries.
ROWS, QUERIES = 8192, 8192
#: Queries of a block that are scored at once.
STEP = 128
#: The cutoff of a query with fewer than k candidates: all are wanted.
LOWEST = -(1 << 62)


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: neither null nor with null, infinite or NaN components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vec, ``floor(scale * x)`` of each component x as a double, of the rows that take part."""
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("bigint"))
    return vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", vec.alias("vec")).dropDuplicates(["vec_id", "vec"])


def _matrix(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    """The vectors as rows of a matrix, filled with zeros: int64, or doubles that hold the integers if *exact*."""
    kind = np.float64 if exact else np.int64
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False).astype(kind)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


_LISTS = "cb int, query bigint, part int, keys array<bigint>, scores array<bigint>"


def _lists(cb: int, part: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    queries, keys, scores = zip(*rows, strict=True) if rows else ((), (), ())
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
    flat = lambda xs: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(xs) if xs else np.zeros(0), pa.int64(), safe=False))
    n = len(rows)
    return pa.table({"cb": pa.array([cb] * n, pa.int32()), "query": pa.array(queries, pa.int64()), "part": pa.array([part] * n, pa.int32()), "keys": flat(keys), "scores": flat(scores)})


def _task(exact: bool, best: int = 0, parts: int = 1):
    """For ``cogroup().applyInArrow``: one part of a block of candidates against that of a block of queries.

    Queries come with the keys that are asked for (``asked``), or with a ``cutoff``, or with neither: then the *best* are listed.
    """

    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _lists(0, 0, [])
        cb, part = queries.column("cb")[0].as_py(), queries.column("part")[0].as_py()
        candidates, queries = candidates.sort_by("key").combine_chunks(), queries.sort_by("key").combine_chunks()
        c_keys, c_ids, q_keys, q_ids = (t.column(n).to_numpy() for t in (candidates, queries) for n in ("key", "vec_id"))
        c, q = candidates.column("piece").combine_chunks(), queries.column("piece").combine_chunks()
        width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in (c, q))
        c, q = _matrix(c, width, exact), _matrix(q, width, exact)
        rows = []
        if "asked" in queries.column_names:
            asked = queries.column("asked").combine_chunks()
            flat, at = asked.values.to_numpy(zero_copy_only=False), asked.offsets.to_numpy()
            for i, query in enumerate(q_keys):
                keys = flat[at[i] : at[i + 1]]
                rows.append((query, keys, (c[np.searchsorted(c_keys, keys)] @ q[i]).astype(np.int64)))
            return _lists(cb, part, rows)
        least = np.iinfo(np.int64).min if c.dtype == np.int64 else -np.inf
        for start in range(0, len(q), STEP):
            x = q[start : start + STEP] @ c.T
            own = q_ids[start : start + STEP, None] == c_ids[None, :]
            x[own] = least
            if best:
                n = min(best, x.shape[1])
                place = np.argpartition(-x, n - 1, axis=1)[:, :n]
            for i in range(len(x)):
                if best:
                    found = place[i][~own[i, place[i]]]
                else:
                    # The threshold, rounded up: what isn't sent is below it.
                    found = np.flatnonzero((x[i] >= -(-queries.column("cutoff")[start + i].as_py() // parts)) & ~own[i])
                if len(found):
                    rows.append((q_keys[start + i], c_keys[found], x[i, found].astype(np.int64)))
        return _lists(cb, part, rows)

    return run


class Search:
    """The three phases for one table; ``top_k`` runs them in turn."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int = K, parts: int = PARTS, scale: int = SCALE):
        if k < 1 or parts < 1:
            raise ValueError("k and parts must be positive")
        rows = quantised(vectors, scale).repartitionByRange("vec_id", "vec").sortWithinPartitions("vec_id", "vec")
        # Keys grow with ids, so they break ties as ids do.
        self.rows = cut(rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "vec", F.coalesce(is_query, F.lit(False)).alias("query")))
        largest = F.array_max(F.transform("vec", F.abs))
        n, n_queries, width, c_most, q_most = self.rows.agg(
            F.count(F.lit(1)), F.count_if("query"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(largest), F.lit(1)), F.coalesce(F.max(F.when(F.col("query"), largest)), F.lit(1))
        ).first()
        most = max(1, c_most) * max(1, q_most) * max(1, width)
        if most >= -LOWEST:
            raise ValueError("inner products of these vectors don't fit in 64 bits")
        self.k, self.parts, self.exact = k, parts, most < 1 << 53
        self.c_blocks, self.q_blocks = max(1, -(-n // ROWS)), max(1, -(-n_queries // QUERIES))
        edges = [width * p // parts for p in range(parts + 1)]
        self._pieces = F.array(*(F.slice("vec", a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)))
        self.queries = self.rows.where("query").select(*(F.col(c).alias(c) for c in ("key", "vec_id", "vec")))  # columns of its own, for joins with rows

    def _block(self, count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(count)).cast("int")

    def _run(self, queries: DataFrame, **how) -> DataFrame:
        """A pass over the blocks. *queries*: key, vec_id, vec, cb (and part), and what the tasks need with them."""
        every = F.explode(F.sequence(F.lit(0), F.lit(self.q_blocks - 1)))
        candidates = self.rows.select("key", "vec_id", "vec", self._block(self.c_blocks, 1).alias("cb"), every.alias("qb")).select("key", "vec_id", "cb", "qb", F.posexplode(self._pieces).alias("part", "piece"))
        queries = queries.withColumn("qb", self._block(self.q_blocks, 2))
        if "part" in queries.columns:
            queries = queries.withColumn("piece", F.get(self._pieces, F.col("part"))).drop("vec")
        else:
            queries = queries.select("*", F.posexplode(self._pieces).alias("part", "piece")).drop("vec")
        on = ("cb", "qb", "part")
        return candidates.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(_task(self.exact, parts=self.parts, **how), _LISTS)

    def _everywhere(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(self.c_blocks - 1))))

    def gather(self) -> DataFrame:
        """Phase 1: the lists of the best partial scores."""
        return self._run(self._everywhere(self.queries), best=max(self.k, LIST))

    def collect(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: the lists of all entries at or over the threshold."""
        asked = self.queries.join(cutoffs, F.col("key") == F.col("query"), "left").select("key", "vec_id", "vec", F.coalesce("cutoff", F.lit(LOWEST).cast("bigint")).alias("cutoff"))
        return self._run(self._everywhere(asked))

    def missing(self, lists: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
        """cb, query, part, asked: the keys whose partial score wasn't sent, of those candidates that may still reach the cutoff."""
        parts = self.parts

        def make(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    keys, at = np.unique(np.concatenate([x["keys"] for x in row["lists"]]).astype(np.int64), return_inverse=True)
                    known, seen, begin = np.zeros(len(keys), np.int64), np.zeros((parts, len(keys)), bool), 0
                    for x in row["lists"]:
                        i = at[begin : begin + len(x["keys"])]
                        begin += len(i)
                        known[i] += np.array(x["scores"], np.int64)
                        seen[x["part"], i] = True
                    alive = np.ones(len(keys), bool)
                    if row["cutoff"] is not None and row["cutoff"] > LOWEST:
                        under = -(-row["cutoff"] // parts) - 1
                        alive = known + (~seen).sum(0) * under >= row["cutoff"]
                    for p in range(parts):
                        asked = keys[alive & ~seen[p]]
                        if len(asked):
                            out.append((row["cb"], row["query"], p, asked))
                if out:
                    cb, query, part, asked = zip(*out, strict=True)
                    yield pa.record_batch({"cb": pa.array(cb, pa.int32()), "query": pa.array(query, pa.int64()), "part": pa.array(part, pa.int32()), "asked": pa.array([a.tolist() for a in asked], pa.list_(pa.int64()))})

        grouped = lists.groupBy("cb", "query").agg(F.collect_list(F.struct("part", "keys", "scores")).alias("lists"))
        if cutoffs is None:
            grouped = grouped.withColumn("cutoff", F.lit(None).cast("bigint"))
        else:
            grouped = grouped.join(cutoffs.withColumnRenamed("query", "of"), F.col("query") == F.col("of"), "left").drop("of")
        return grouped.mapInArrow(make, "cb int, query bigint, part int, asked array<bigint>")

    def lookup(self, missing: DataFrame) -> DataFrame:
        """Phase 3 (and the end of phase 1): the lists of just the partial scores that are asked for."""
        return self._run(missing.join(self.queries, F.col("query") == F.col("key")).select("key", "vec_id", "vec", "cb", "part", "asked"))

    def whole(self, lists: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
        """query, candidate, score: the *k* best of each query and block, of the candidates whose parts are all there."""
        k, parts = self.k, self.parts

        def make(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    keys, at, count = np.unique(np.concatenate([x["keys"] for x in row["lists"]]).astype(np.int64), return_inverse=True, return_counts=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, at, np.concatenate([x["scores"] for x in row["lists"]]).astype(np.int64))
                    keys, total = keys[count == parts], total[count == parts]
                    first = np.lexsort((keys, -total))[:k]
                    out += [(row["query"], key, score) for key, score in zip(keys[first].tolist(), total[first].tolist(), strict=True)]
                if out:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query", "candidate", "score"])

        grouped = lists.groupBy("cb", "query").agg(F.collect_list(F.struct("keys", "scores")).alias("lists"))
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "candidate")
        rows = grouped.mapInArrow(make, "query bigint, candidate bigint, score bigint")
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def cutoffs(self, lists: DataFrame) -> DataFrame:
        """query, cutoff: the k-th best of the whole scores of the candidates listed."""
        found = self.whole(lists.unionByName(self.lookup(self.missing(lists))))
        return found.groupBy("query").agg(F.when(F.count(F.lit(1)) == self.k, F.min("score")).alias("cutoff"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the *k* best of all other vectors for each that satisfies *is_query*."""
    search = Search(vectors, is_query, k, parts, scale)
    cutoffs = cut(search.cutoffs(cut(search.gather())))
    lists = cut(search.collect(cutoffs))
    found = search.whole(lists.unionByName(search.lookup(search.missing(lists, cutoffs))))
    of, to = (search.rows.select(F.col("key").alias(f"{n}_key"), F.col("vec_id").alias(n)) for n in ("query_id", "vec_id"))
    named = found.join(of, F.col("query") == F.col("query_id_key")).join(to, F.col("candidate") == F.col("vec_id_key"))
    return named.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The five best for every row whose vec_id is divisible by 50, against all rows."""
    return top_k(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
