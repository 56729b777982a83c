"""Mixing sources to target weights by a splitting tree, in DataFrame operations only.

* **Targets.** The mix takes 150 % of all words. Sources share them by weight, at most twice a source's own words each;
  the excess goes to the others by weight until none is above. That is a water level: sources in
  order of cap per weight are full until the level of the rest stays under their cap.
* **Permuted blocks.** Each source's documents lie on a line in the order of a seeded hash, which permutes them. A document's place is the sum of the words before it.
  The line, repeated as often as needed (twice at most), is cut into blocks of ``BLOCK_WORDS`` words.
* **Quotas.** A source with target *t* gives the words ``[0, t)`` of its line, so its quota is an exact number of blocks, of which the last one may be shorter.
* **Splitting tree.** A node holds a quota of blocks for every source and a range of shards. Its left child gets blocks in proportion to its
  shards, and how many of them are of each source is drawn from the multivariate hypergeometric distribution: source by source,
  by inversion with a seeded uniform number. What is left goes to the right. So quotas add up exactly at every node. The blocks themselves aren't listed: a child's are the next ones
  of its source's permuted blocks, so a leaf, which is a shard, has a range of them, disjoint from all others.
* **Draw.** A document is taken as often, and as far, as the leaves' ranges cover its words; each such piece goes to its leaf's shard.
* **Shuffle.** Within a shard the pieces are ordered by a seeded hash, their position.

Everything is a function of seed and data, so reruns agree. The tree has a row for each source and node; sources are drawn in
groups of ``FAN``, groups in groups of groups, so no list is longer than that. Sums along the lines and along the sources are taken in two levels.

Defined results: a null text has size 0; a null source is a source of its own, the last. A source without words has target 0. Documents of size 0 are taken 0 words.
Repeated rows are separate documents. An empty table gives no rows. Other columns aren't read by ``mix``; ``mixed_documents`` keeps
them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, quoted, running, stored, whole_row

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
SEED = 31
SHARDS = 16
BLOCK_WORDS = 65536
#: Sources that are drawn one after another.
FAN = 256


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _by_source() -> list[Column]:
    """The order of sources: by code point, null last."""
    return [F.col("source").isNull(), F.col("source")]


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source of *sized* (source, size): source, source_size, source_docs, place (its number), source_start (words of the sources before it), target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    rows = running(totals, _by_source(), {"place": F.lit(1), "source_start": F.col("source_size")})
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    per = F.col("cap") / F.col("weight")
    rows = cut(running(rows, [per, F.col("weight"), *_by_source()], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}))
    size, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = F.lit(size) * F.lit(float(share)) - F.col("cap_before")
    rows = rows.withColumn("level", left / (F.lit(weight) - F.col("weight_before")))
    # A source is full if the level that it and those after it would share reaches its cap.
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    first = rows.where(~F.col("full")).agg(F.min(F.struct(per, "weight", "level")).alias("first")).first()["first"]
    level = F.lit(None if first is None else float(first["level"])).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(level * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", "source_docs", "place", "source_start", target.alias("target"))


_LOG_FACTORIALS = [math.lgamma(n + 1) for n in range(16)]


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(F.lit(2 * math.pi) * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < len(_LOG_FACTORIALS), F.get(F.array(*map(F.lit, _LOG_FACTORIALS)), F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of *drawn* out of *population* are *marked*, for a uniform number *u* in [0, 1): the least count whose
    cumulated probability is over *u*, within ten standard deviations of the mean."""
    other = population - marked
    low, high = F.greatest(F.lit(0).cast("bigint"), drawn - other), F.least(drawn, marked)
    n = F.greatest(population, F.lit(1)).cast("double")
    mean = drawn * (marked / n)
    reach = F.sqrt(mean * (other / n) * ((population - drawn) / F.greatest(n - 1, F.lit(1.0)))) * 10 + 10
    first, last = F.greatest(low, F.floor(mean - reach)).cast("bigint"), F.least(high, F.ceil(mean + reach)).cast("bigint")
    whole = _log_factorial(marked) + _log_factorial(other) + _log_factorial(drawn) + _log_factorial(population - drawn) - _log_factorial(population)

    def step(state: Column, x: Column) -> Column:
        p = F.exp(state["whole"] - _log_factorial(x) - _log_factorial(marked - x) - _log_factorial(drawn - x) - _log_factorial(other - drawn + x))
        picked = F.coalesce(state["picked"], F.when(state["sum"] + p > u, x))
        return F.struct(state["whole"].alias("whole"), F.when(state["picked"].isNull(), state["sum"] + p).otherwise(state["sum"]).alias("sum"), picked.alias("picked"))

    start = F.struct(whole.alias("whole"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("picked"))
    found = F.aggregate(F.sequence(first, last), start, step, lambda s: s["picked"])
    # Rounding may leave the sum just under u.
    return F.when(first >= last, last).otherwise(F.coalesce(found, F.least(F.greatest(F.round(mean).cast("bigint"), low), high)))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _draw(kids: Column, seed: int, *names: Column) -> Column:
    """An array of (kid, x): how many of ``drawn`` blocks are of each of *kids* (kid, quota), one after another."""
    empty = F.array().cast("array<struct<kid:bigint,x:bigint>>")
    start = F.struct(F.aggregate(kids, F.lit(0).cast("bigint"), lambda s, k: s + k["quota"]).alias("population"), F.col("drawn").alias("drawn"), empty.alias("out"))

    def step(state: Column, kid: Column) -> Column:
        x = hypergeometric(state["population"], kid["quota"], state["drawn"], _uniform(F.lit(seed), *names, kid["kid"]))
        done = lambda x: F.struct((state["population"] - kid["quota"]).alias("population"), (state["drawn"] - x).alias("drawn"), F.concat(state["out"], F.array(F.struct(kid["kid"].alias("kid"), x.alias("x")))).alias("out"))
        return F.transform(F.array(x), done)[0]

    return F.aggregate(kids, start, step, lambda s: s["out"])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """The splitting tree over *quotas* (place, quota): place, shard, first, quota, the leaves' ranges of each source's blocks (empty ones are left out)."""
    big = lambda c: F.col(c).cast("bigint")
    rows = cut(quotas.select(big("place").alias("place"), big("quota").alias("quota"), F.lit(0).cast("bigint").alias("first"), F.lit(0).alias("lo"), F.lit(shards).alias("hi")).where("quota > 0"))
    most = rows.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    depth = 1
    while FAN**depth <= most:
        depth += 1
    width, level = shards, 0
    group = lambda n: F.floor(F.col("place") / FAN**n).cast("bigint")
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        inner, drawn = rows.where("hi - lo > 1"), None
        for n in reversed(range(depth)):
            kids = inner.select("lo", "hi", group(n + 1).alias("group"), group(n).alias("kid"), "quota", "first")
            if n:
                kids = kids.groupBy("lo", "hi", "group", "kid").agg(F.sum("quota").alias("quota"), F.lit(None).cast("bigint").alias("first"))
            lists = kids.groupBy("lo", "hi", "group").agg(F.sort_array(F.collect_list(F.struct("kid", "quota", "first"))).alias("kids"), F.sum("quota").alias("all"))  # at most FAN
            if drawn is None:
                lists = lists.withColumn("drawn", F.floor(F.col("all") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("bigint"))
            else:
                lists = lists.join(drawn.select("lo", "hi", F.col("kid").alias("group"), "drawn"), ["lo", "hi", "group"])
            each = F.zip_with("kids", _draw(F.col("kids"), seed + level, F.lit(n), F.col("lo"), F.col("hi")), lambda k, d: F.struct(k["kid"].alias("kid"), k["quota"].alias("quota"), k["first"].alias("first"), d["x"].alias("drawn")))
            drawn = lists.select("lo", "hi", F.explode(each).alias("k")).select("lo", "hi", "k.*")
        left = F.struct(F.col("kid").alias("place"), F.col("drawn").alias("quota"), F.col("first").alias("first"), F.col("lo").alias("lo"), mid.alias("hi"))
        right = F.struct(F.col("kid").alias("place"), (F.col("quota") - F.col("drawn")).alias("quota"), (F.col("first") + F.col("drawn")).alias("first"), mid.alias("lo"), F.col("hi").alias("hi"))
        rows = cut(drawn.select(F.explode(F.array(left, right)).alias("k")).select("k.*").where("quota > 0").unionByName(rows.where("hi - lo <= 1")))
        width, level = -(-width // 2), level + 1
    return rows.select("place", F.col("lo").alias("shard"), "first", "quota")


def split_blocks(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """*blocks* (source, block), dealt out to the shards: adds shard. Leaves take ranges of each source's blocks in a seeded order."""
    counts = running(blocks.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), _by_source(), {"place": F.lit(1), "before": F.col("quota")})
    counts = cut(counts)
    leaves = split_quotas(counts.select("place", "quota"), shards, seed)
    line = running(blocks, [*_by_source(), F.xxhash64(F.lit(seed), "source", "block"), F.col("block")], {"n": F.lit(1)})
    line = line.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    ranges = leaves.groupBy(F.col("place").alias("at")).agg(F.collect_list(F.struct("first", "quota", "shard")).alias("ranges"))  # at most one a shard
    n = F.col("n") - F.col("before")
    mine = F.filter("ranges", lambda r: (r["first"] <= n) & (n < r["first"] + r["quota"]))[0]["shard"]
    return line.join(ranges, F.col("place") == F.col("at")).select("source", "block", mine.alias("shard"))


def sizes(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, mark (its place among its source's documents is by this hash of id and text) and rid, which names the row."""
    rid = F.col("rid") if "rid" in documents.columns else F.monotonically_increasing_id()
    return cut(documents.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark"), rid.alias("rid")))


def draws(sized: DataFrame, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS, **rules) -> DataFrame:
    """Per row of *sized* (as of ``sizes``): rid, doc_id, source, size, source_size, target, start (its place on its source's line) and pieces, an array of
    pass (0 or 1), from_word, words, block (the first), shard, position."""
    sources = cut(targets(sized, **rules))
    drawn = F.round("target").cast("bigint")
    leaves = split_quotas(sources.select("place", F.ceil(drawn / block_words).alias("quota")), shards, seed + 1000)
    ranges = leaves.groupBy(F.col("place").alias("at")).agg(F.sort_array(F.collect_list(F.struct("first", "quota", "shard"))).alias("ranges"))  # at most one a shard
    told = sources.join(ranges, F.col("place") == F.col("at"), "left").select(F.col("source").alias("of"), "source_size", "source_start", "target", "ranges")
    line = running(sized, [*_by_source(), F.col("mark"), F.col("doc_id"), F.col("rid")], {"start": F.col("size")})
    rows = line.join(told, F.col("source").eqNullSafe(F.col("of"))).withColumn("start", F.col("start") - F.col("source_start"))

    def of_pass(p: int) -> Column:
        begin = p * F.col("source_size") + F.col("start")
        end = F.least(begin + F.col("size"), drawn)

        def piece(r: Column) -> Column:
            low, high = F.greatest(begin, r["first"] * block_words), F.least(end, (r["first"] + r["quota"]) * block_words)
            order = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2000), "doc_id", "mark", F.lit(p), low - begin), 1)
            return F.struct(F.lit(p).alias("pass"), (low - begin).alias("from_word"), (high - low).alias("words"), F.floor(low / block_words).alias("block"), r["shard"].alias("shard"), order.alias("position"))

        met = F.filter("ranges", lambda r: (begin < (r["first"] + r["quota"]) * block_words) & (end > r["first"] * block_words) & (end > begin))
        return F.coalesce(F.transform(met, piece), F.array().cast("array<struct<pass:int,from_word:bigint,words:bigint,block:bigint,shard:int,position:bigint>>"))

    pieces = F.flatten(F.array(*map(of_pass, range(rules.get("cap", CAP)))))
    return rows.select("rid", "doc_id", "source", "size", "source_size", "target", "start", pieces.alias("pieces"))


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mix, a row per document and piece: the columns of ``draws`` with pass, from_word, words, block, shard and position.
    A document that isn't taken has one row with null there."""
    return draws(sizes(documents), **how).withColumn("piece", F.explode_outer("pieces")).select("*", "piece.*").drop("piece", "pieces")


def mixed_sizes(documents: DataFrame) -> DataFrame:
    """Per row of *documents*: doc_id, size, source_size, target (its source's), taken (the words of its pieces), shards, and the pieces with their positions there."""
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
    shards = F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    return draws(sizes(documents)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"), "pieces")


def first_words(text: Column, count: Column) -> Column:
    """*text* up to the end of its *count*-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), count.cast("int")), "")


def mixed_documents(documents: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """The documents that the mix takes, with their own columns, in the order of shard and position: one that is taken twice has two rows.

    A document that the border of two blocks cuts goes to the shard of its first piece. The last document of a source's draw may be taken in part: its text,
    and n_chars with it, end at the last word taken.
    """
    rows = stored(documents.select(F.monotonically_increasing_id().alias("rid"), whole_row(documents).alias("row")), "mix")
    drawn = draws(sizes(rows.select("rid", "row.doc_id", "row.source", "row.text")), shards, **how)
    of_pass = lambda p: F.filter("pieces", lambda x: x["pass"] == p)
    passes = F.array(*map(of_pass, range(how.get("cap", CAP))))
    drawn = drawn.select(F.col("rid").alias("of"), "size", F.explode(F.filter(passes, lambda x: F.size(x) > 0)).alias("p"))
    words = F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["words"])
    drawn = drawn.select("of", "size", words.alias("words"), F.col("p")[0]["shard"].alias("shard"), F.col("p")[0]["position"].alias("position"))
    # Partition by partition, and in each row by row, the result has the order of shard and position.
    slices = max(1, -(-int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    at = F.col("shard") * slices + F.floor(F.col("position") / F.lit(float(1 << 63)) * slices)
    taken = rows.join(drawn, F.col("rid") == F.col("of")).repartitionById(shards * slices, F.least(at, F.lit(shards * slices - 1)).cast("int")).sortWithinPartitions("shard", "position")
    part = F.col("words") < F.col("size")
    text = F.when(part, first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(part, F.length(text).cast("bigint")).otherwise(F.col("row.n_chars"))} if "n_chars" in documents.columns else {"text": text}
    return taken.select(*(new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in documents.columns))


#: doc_id, size, source_size and target (to six places) of ``mixed_sizes`` in DuckDB's SQL; ``taken`` is drawn, which SQL can't express.
TARGETS_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW filling AS (ORDER BY 2 * source_size / weight, weight, source NULLS LAST)
),
aimed AS (
  SELECT *, CASE WHEN level * weight >= 2 * source_size THEN 2 * source_size ELSE least(2 * source_size, weight * (SELECT arg_min(level, 2 * source_size / weight) FROM levels WHERE level * weight < 2 * source_size)) END AS target FROM levels
)
SELECT s.doc_id, s.size::BIGINT AS size, a.source_size, round(a.target, 6) AS target FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
"""
