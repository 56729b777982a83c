import random

import duckdb
import pandas as pd

from splatframe.llm import chat


def brute(rows):
    convs = {}
    for c, *turn in rows:
        convs.setdefault(c, []).append(tuple(turn))
    none_first = lambda t: [(x is not None, x if x is not None else 0) for x in t]
    convs = {c: [t[1:] for t in sorted(ts, key=none_first)] for c, ts in convs.items()}
    kept = []
    for c, ts in convs.items():
        longer = any(len(o) > len(ts) and o[: len(ts)] == ts for o in convs.values())
        first = min((d for d, o in convs.items() if o == ts and d is not None), default=None)
        if not longer and first == c:
            kept.append((c, len(ts), "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in ts)))
    return sorted(kept, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(120):
        n, kind = rng.randrange(1, 7), rng.randrange(12)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {kind} {t}" if rng.random() < 0.97 else "else") for t in range(n)]
    rows += [(300, 0, None, "x"), (301, 0, "", "x"), (302, 0, "user", None), (303, 0, "user", ""), (304, None, "user", "say 1 0"), (305, 0, "user", "a" * 100_000), (None, 0, "user", "lost"), (None, 1, "user", "lost")]
    rows += [(306, 0, "user", "twice"), (306, 0, "user", "twice"), (307, 0, "user", "twice")]
    got = sorted(map(tuple, chat.maximal_conversations(spark.createDataFrame([(*r, None) for r in rows], "conv_id bigint, turn int, role string, text string, hash string")).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert chat.maximal_conversations(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")).count() == 0


def test_sql_agrees_on_nulls(spark):
    rows = [(300, 0, None, "x"), (300, 1, "user", "y"), (301, 0, None, "x"), (302, 0, "user", None), (302, 1, None, None), (303, 0, "user", None), (304, None, "user", "say"), (304, 0, "user", "do"), (305, None, "user", "say")]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    conversations["turn"] = conversations["turn"].astype("Int64")
    want = duckdb.sql(chat.ORACLE).fetchall()
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) == brute(rows)


def test_many_turns(spark):
    rows = [(c, t, "user", f"say {t}") for c in (1, 2) for t in range(3000 - c)]
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 2999)]
