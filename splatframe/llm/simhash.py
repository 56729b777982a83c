"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most two bits share at least six
bytes position by position. Postings of a single (position, byte) would hold a 256th of the corpus each, so the index combines four positions:
the fourteen sets of four positions whose numbers' xor is zero. Of these, any six positions contain three, and these three cover all six; so what two
fingerprints share adds up from the postings alone.

* Equal fingerprints are first reduced to one by a map-side combined aggregate.
* Each distinct fingerprint is posted under its fourteen sets. A list over ``LIST`` combines one more position, as often as needed: it is
  replaced by the lists of its positions and each of the others. Positions are few, so a fingerprint has 98 postings at most.
* The pairs within a list are tallied: the union of the positions of all lists that a pair shares counts its shared positional bytes. Pairs that reach
  ``SHARED`` (six) are retained, and verified bit by bit.
* A list of six positions that is still too long splits by the bits of the two bytes that are left: each member joins the 17 values within one bit of
  its own there. Two members are within two bits exactly if they meet in one, and at most 17 do. So no list is paired beyond its bound, and no link is lost.

Components come from alternating large-star and small-star rounds on the links, all of it distributed; each
round is cut off in the shared folder. Fingerprints of very many documents are salted where documents meet their components.

Defined results: a null text counts as empty, without words, with fingerprint zero; all such
documents are one component. Repeated rows keep their own rows. A null doc_id is linked but never
names a component unless it is all there is. An empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import by_chunk, cut, quoted, stored, whole_row, with_field

#: The sets of four byte positions that are posted. Every choice of six positions contains three of these, which cover it.
POSITIONS = tuple(p for p in itertools.combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0)
BYTES, BITS, SEED, WIDTH = 8, 2, 42, 3
#: The least number of positional bytes that fingerprints within ``BITS`` bits share.
SHARED = BYTES - BITS
#: The bound on the lists that are paired; longer ones combine more positions.
LIST = 64
#: A fingerprint is salted if it has more documents than this and than one in ``PART`` of all; so at most ``PART`` fingerprints are.
CHUNK, PART = 256, 10_000

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of *width* words, repeats included; of the whole sequence if it's shorter."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    rows = [words] if len(words) < width else zip(*(words[i:] for i in range(width)), strict=False)
    h = xxhash.xxh64_intdigest
    return np.array([h(b" ".join(s), seed) for s in rows], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set if it is in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fp(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
    fps = np.array([majority(shingle_hashes(t)) for t in texts.to_pylist()], np.uint64)
    return batch.append_column("fp", pa.array(fps.view(np.int64)))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, and fp, the fingerprint's 64 bits as a signed integer."""
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(by_chunk(lambda batch: _fp(batch, batch.column("text")), 1024), with_field(rows, "fp", LongType())).drop("text")


def _kept(mask: Column) -> Column:
    """The bits of a 64-bit value that belong to the byte positions in *mask*."""
    return sum((F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(_signed(255 << 8 * i))).otherwise(F.lit(0).cast("bigint")) for i in range(1, BYTES)), F.when(mask.bitwiseAND(F.lit(1)) != 0, F.lit(255).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lists(entries: DataFrame) -> DataFrame:
    """*entries* (fp, mask) in lists of more than one: adds bytes, the positional bytes of the list, and n, its length."""
    entries = entries.withColumn("bytes", F.col("fp").bitwiseAND(_kept(F.col("mask"))))
    lengths = entries.groupBy("mask", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(entries.join(lengths, ["mask", "bytes"]))


def postings(distinct: DataFrame, longest: int = LIST) -> tuple[list[DataFrame], DataFrame]:
    """The lists that are paired, by the number of positions combined; and those of six positions that are still longer than *longest*."""
    masks = F.array(*(F.lit(sum(1 << i for i in p)) for p in POSITIONS))
    lists, paired = _lists(distinct.select("fp", F.explode(masks).alias("mask"))), []
    for _ in range(4, SHARED):
        paired.append(lists.where(F.col("n") <= longest))
        others = F.filter(F.array(*(F.lit(1 << i) for i in range(BYTES))), lambda b: F.col("mask").bitwiseAND(b) == 0)
        longer = lists.where(F.col("n") > longest).select("fp", "mask", F.explode(others).alias("b"))
        lists = _lists(longer.select("fp", F.col("mask").bitwiseOR(F.col("b")).alias("mask")).distinct())
    return [*paired, lists.where(F.col("n") <= longest)], lists.where(F.col("n") > longest)


def tallies(distinct: DataFrame, longest: int = LIST) -> DataFrame:
    """a, b and shared: pairs a < b of fingerprints that meet in a list, with the number of positional bytes that their lists have."""
    paired, dense = postings(distinct, longest)
    a = paired[0]
    for more in paired[1:]:
        a = a.unionByName(more)
    b = a.select(F.col("mask").alias("of"), F.col("bytes").alias("at"), F.col("fp").alias("b"))
    met = a.join(b, (F.col("mask") == F.col("of")) & (F.col("bytes") == F.col("at")) & (F.col("fp") < F.col("b"))).select(F.col("fp").alias("a"), "b", "mask")

    bits = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)).cast("bigint") for i in range(64)))
    free = F.filter(bits, lambda x: x.bitwiseAND(_kept(F.col("mask"))) == 0)
    near = dense.select("fp", "mask", F.explode(free).alias("bit")).select("fp", "mask", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    near = near.groupBy("mask", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 17
    close = near.select("mask", "fps", F.explode("fps").alias("a")).select("mask", "a", F.explode("fps").alias("b")).where("a < b").select("a", "b", "mask")
    return met.unionByName(close).groupBy("a", "b").agg(F.bit_count(F.bit_or("mask")).alias("shared"))


def links(distinct: DataFrame, longest: int = LIST) -> DataFrame:
    """Links (a, b) with a < b: the pairs of distinct fingerprints *fp* that lie within ``BITS`` bits."""
    retained = tallies(distinct, longest).where(F.col("shared") >= SHARED)
    return retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of *edges*: node, and root, one node of its component (the same for all of it).

    Large-star and small-star rounds alternate until a round changes nothing.
    """
    stars = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        stars = cut(small.select("e.u", "e.v").where("u != v").distinct())
        now = tuple(stars.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state:
            break
        state = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_components(prints: DataFrame) -> DataFrame:
    """*prints* (doc_id, fp and others) with component (a fingerprint of its component, the same for all of it) and component_id, the least doc_id that links lead to."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node).select("fp", "first", "root")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    linked = named.join(least, "root").select("fp", "root", "least")
    ids = distinct.join(linked, "fp", "left").select(F.col("fp").alias("of"), "n", F.coalesce("root", "fp").alias("component"), F.coalesce("least", "first").alias("component_id"))
    # A hot fingerprint's documents are dealt out by a salt, and its row is copied for each.
    bound = max(CHUNK, (distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // PART)
    salts = F.when(F.col("n") > bound, F.ceil(F.col("n") / bound)).otherwise(F.lit(1)).cast("int")
    hot = distinct.where(F.col("n") > bound).select(F.col("fp").alias("hot"), salts.alias("salts"))
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
    salted = prints.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left").withColumn("own", salt)  # at most PART rows
    return salted.join(ids, (F.col("fp") == F.col("of")) & (F.col("own") == F.col("salt"))).select(*prints.columns, "component", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, fp, component (a fingerprint of its component, the same for all of it), and component_id, the least doc_id that links lead to."""
    return _with_components(cut(fingerprints(documents)))


def near_duplicate_groups(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame) -> DataFrame:
    """The rows of *documents*, with all their columns, that stay: of each component one, that of the least doc_id (null is the last), then of the least fingerprint.

    Rows equal in both are told apart by a hash of their text, and rows equal in that by their place in the input.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), whole_row(documents).alias("row"))
    text = documents.columns.index("text")
    make = lambda batch: _fp(batch, batch.column("row").flatten()[text])
    rows = stored(rows.mapInArrow(by_chunk(make, 256), with_field(rows, "fp", LongType())), "prints")
    prints = rows.select(F.col("row.doc_id").alias("doc_id"), "fp", F.xxhash64("row.text").alias("mark"), "rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "mark", "rid"))
    kept = _with_components(prints).groupBy("component").agg(first.alias("k")).select(F.col("k.rid").alias("of"))
    return rows.join(kept, F.col("rid") == F.col("of"), "left_semi").select(*(F.col(f"row.{quoted(c)}").alias(c) for c in documents.columns))
