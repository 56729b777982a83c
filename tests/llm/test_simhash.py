import itertools
import random
import re
from collections import Counter

import pytest
import xxhash

from splatframe.llm import simhash

from . import cases


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(fps):
    """Component by brute force: {index: indices reachable}."""
    left, out = set(range(len(fps))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            for j in [j for j in left if (fps[i] ^ fps[j]).bit_count() <= 2]:
                left.discard(j)
                todo.append(j)
        out |= dict.fromkeys(seen, seen)
    return out


def test_any_six_bytes_hold_an_entry():
    for six in itertools.combinations(range(8), 6):
        assert any(set(p) <= set(six) for p in simhash.POSITIONS)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("longest", [0, 3, 64])
def test_links_join_all_near_pairs(spark, longest):
    rng = random.Random(longest)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:12]:
        near = base
        for _ in range(8):
            near ^= 1 << rng.randrange(64)
            fps.add(near)
            fps.add(near ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << 63))
    fps = sorted(fps | {0, (1 << 64) - 1, 1 << 63, 3})
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), longest)
    found = edges.collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 and r.a != r.b for r in found)
    if longest == 64:
        pairs = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
        assert {frozenset((r.a, r.b)) for r in found} == pairs
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    by_root = {}
    for f in fps:
        by_root.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    want = groups(fps)
    assert {frozenset(s) for s in by_root.values()} == {frozenset(fps[i] for i in s) for s in want.values()}


def test_components_of_a_long_chain(spark):
    n = 80
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a bigint, b bigint")
    rows = simhash.components(edges).collect()
    assert len(rows) == len({r.node for r in rows}) == n + 2
    assert len({r.root for r in rows if r.node < 1000}) == 1 and len({r.root for r in rows}) == 2


def test_query_against_brute_force(spark):
    docs = cases.documents(spark)
    rng = random.Random(9)
    base = cases.words(rng, 400, 5000).split()
    more = []
    for i in range(40):
        w = base[:]
        w[rng.randrange(len(w))] = f"x{i}"
        more.append((200 + i, " ".join(w), "en", "src0", 1))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, cases.SCHEMA))
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    want = Counter()
    for i, reach in groups(fps).items():
        want[rows[i].doc_id, f"{fps[i]:016x}", min((rows[j].doc_id for j in reach if rows[j].doc_id is not None), default=None)] += 1
    assert Counter(map(tuple, simhash.near_duplicate_groups(docs).collect())) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c: 1 for _, _, c in want})
    assert simhash.near_duplicate_groups(cases.empty(spark)).count() == 0
    assert simhash.representatives(cases.empty(spark)).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(12)
    text = lambda: cases.words(rng, 60, 5000)
    nulls, repeated, several = ([text() for _ in range(n)] for n in (6, 4, 3))
    rows = [(None, t) for t in nulls] + [(None, nulls[0]), (None, nulls[0])]
    rows += [(5, t) for t in repeated] + [(5, repeated[0]), (None, repeated[1]), (4, repeated[2])]
    rows += [(10 + i, t) for i, t in enumerate(several)] + [(9, several[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], cases.SCHEMA)
    assert len(groups([fingerprint(t) for t in {t for _, t in rows}])) == 13
    want = [(None, t) for t in nulls] + [(4 if n == 2 else 5, t) for n, t in enumerate(repeated)] + [(9, several[0]), (11, several[1]), (12, several[2])]
    assert Counter((r.doc_id, r.text) for r in simhash.representatives(docs).collect()) == Counter(want)


def test_tallies_add_up_from_the_postings(spark):
    for six in itertools.combinations(range(8), 6):
        inside = [p for p in simhash.POSITIONS if set(p) <= set(six)]
        assert len(simhash.POSITIONS) == 14 and len(inside) == 3 and set().union(*inside) == set(six)
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(200):
        fps.add(base ^ sum(rng.randrange(1, 256) << 8 * i for i in rng.sample(range(8), rng.randrange(1, 5))))
    rows = {(r.a, r.b): r.shared for r in simhash.tallies(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), 1000).collect()}
    for a, b in itertools.combinations(sorted(map(signed, fps)), 2):
        same = sum((a ^ b) >> 8 * i & 255 == 0 for i in range(8))
        assert rows.get((a, b), 0) == same if same >= 6 else rows.get((a, b), 0) < 6


def test_lists_are_bounded_whatever_the_group(spark):
    rng = random.Random(10)
    dense = {(rng.getrandbits(16) << 8) | (7 << 40) for _ in range(3000)}
    near = {5 << 56 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(2000)}
    fps = sorted(map(signed, dense | near))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    assert simhash.tallies(df).count() <= len(fps) * 14 * simhash.LIST
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    array = __import__("numpy").array(fps)
    want = {(f, int(g)) for f in fps for g in array[[(x & (1 << 64) - 1).bit_count() <= 2 for x in (array ^ f).tolist()]] if f < g}
    assert got == want


def test_hot_fingerprints_are_salted(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    docs = spark.createDataFrame([(i, "the same words here" if i % 2 else f"text {i} of its own", "en", "s", 1) for i in range(200)] + [(3, "the same words here", "en", "s", 1)], cases.SCHEMA)
    rows = simhash.near_duplicate_groups(docs).collect()
    assert len(rows) == 201 and {r.component_id for r in rows if r.doc_id % 2} == {1} and sum(r.component_id == r.doc_id for r in rows if not r.doc_id % 2) == 100


def test_clashing_names_stay(spark):
    names = ["_id", "_fp", "_row_fp", "fp", "rid", "row", "of", "n", "component", "root", "a`b", "k", "salt"]
    ddl = cases.SCHEMA + "".join(f", `{n.replace('`', '``')}` string" for n in names)
    rows = [(i, "one text here" if i < 3 else f"{i} other words {i}", "en", "s", 1, *names) for i in (0, 1, 2, 3, 4, 4)]
    out = simhash.representatives(spark.createDataFrame(rows, ddl))
    assert out.columns[5:] == names and sorted(r.doc_id for r in out.collect()) == [0, 3, 4] and all(list(r)[5:] == names for r in out.collect())
