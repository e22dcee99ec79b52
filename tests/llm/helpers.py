"""Small tables with every odd case, for all operators."""

import random

from pyspark.sql import functions as F

CLASHES = (
    "id", "bucket", "h", "line", "score", "spans", "token", "component", "vec", "blob", "take_tokens", "__score", "__spans", "n_dropped", "dropped", "key", "take", "n",
    "row_key", "gone", "kept", "units", "words", "r", "toxic", "group", "windows", "b", "guest", "sig", "shard", "epoch", "n_tokens", "domain", "quota",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null ids, texts, languages and sources, empty, blank, equal, repeated and very long texts."""
    rng = random.Random(5)
    long = sentence(rng, 20_000)
    return [
        (None, "a text without an id that is long enough to be a line of its own", "en", "src1", 1),
        (1, None, None, None, None), (2, "", "en", "src1", 0), (3, " \t\n ", "en", "src2", 4), (4, "word", "en", "src0", 4), (5, "word", "de", "src0", 4),
        (6, "Größe 日本語 \U0001f600 ünï", "de", "src1", 3), (7, long, "en", "src0", len(long)), (8, long, "en", "src0", len(long)), (9, long + " tail", "en", "src2", len(long) + 5),
        (10, "same same same same same same same same", "en", "src1", 9), (10, "same same same same same same same same", "en", "src1", 9), (11, "x" * 5000, "en", "src1", 5000), (12, "12345 !!! 678", "fr", "src2", 3),
    ]


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    """Random documents of several lines, with exact and near copies and shared lines."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    shared = sentence(rng, 12)
    for i in range(n):
        lines = [sentence(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6))]
        if rows and i % 7 == 0:
            lines = rng.choice(rows)[1].split("\n")
        elif rows and i % 5 == 0:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = "edited"
            lines = " ".join(words).split("\n")
        elif i % 11 == 0:
            lines.insert(0, shared[: rng.randint(len(shared) - 2, len(shared))])
        rows.append((i * 3, "\n".join(lines), rng.choice(["en", "de"]), f"src{rng.choice([0, 0, 0, 1, 2, 3])}", len("\n".join(lines))))
    return rows


def table(spark, rows, clashing: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES if clashing else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


class Groups(dict):
    """Union-find whose root is the smallest member."""

    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
