"""Small tables and brute-force versions for the tests of this folder."""

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
# Further columns whose names the operators use themselves.
CLASHING = "kept BOOLEAN, length INT, part STRING, key STRING, h STRING, band INT, offset STRING, set STRING, n INT"


def documents(spark, texts, ids=None, langs=None, clashing=False):
    rows = []
    for k, text in enumerate(texts):
        doc_id = k if ids is None else ids[k]
        rows.append((doc_id, text, (langs or ["en"] * len(texts))[k], f"src{k % 3}", len(text or "")))
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        for column in CLASHING.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


class Groups:
    """Union-find."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
