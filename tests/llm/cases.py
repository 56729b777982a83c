"""Small documents with what tables may hold: nulls, empty and long texts, repeated rows, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use themselves, or might.
NAMES = (
    *("size", "fp", "shard", "score", "target", "bucket", "start", "length", "rank", "verdict", "slot", "said", "judged", "rid", "row", "hash", "mark", "first", "group", "window", "offset"),
    *("own", "salt", "of", "pieces", "position", "words", "component", "root", "url", "head", "made", "c0", "_id", "_size", "_taken", "_words", "_part", "_fp", "_row_fp", "_mark", "_bucket", "_run_0", "a`b"),
)
EXTRA = "".join(f", `{n.replace('`', '``')}` bigint" for n in NAMES)


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}{rng.choice(['', '.', ',', 'é', 'ß'])}" for _ in range(n))


def documents(spark, n: int = 60, extra: bool = True):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 200)), "en", f"src{i % 4}", 1) for i in range(n)]
    rows += [
        (n, None, None, None, None),
        (n + 1, "", "en", "src0", 0),
        (n + 2, " \t\n ", "en", None, 4),
        (n + 3, words(rng, 30_000, 9000), "en", "src1", 1),
        (n + 4, "one", "en", "empty", 3),
        (n + 5, rows[3][1], "en", "src2", 1),
        (n + 6, rows[3][1], "en", "src2", 1),
        (n + 7, "a  b\r\n\x0bc\u00a0d \x1c e <|endoftext|>\n\nthe\u0301 it's  Ünïcode 漢字 😀 123", "xx", "src3", 1),
    ]
    rows += [rows[7], rows[7], (None, "no id here at all", "en", "src0", 1), (None, None, None, None, None)]
    rows = [(*r, *[None] * len(NAMES)) if extra else r for r in rows]
    return spark.createDataFrame(rows, SCHEMA + (EXTRA if extra else ""))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
