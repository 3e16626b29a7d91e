"""Running numbers against a plain count, with one group of a third of all rows, null groups, ties and no rows."""

import random
from collections import defaultdict

from storyloom.plans.numbering import numbered


def test_numbers_follow_the_order_within_each_group(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "a", "b", "c", None]), r.randrange(10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "w string, o long, i long").repartition(7)
    seen = defaultdict(list)
    for w, o, _ in rows:
        seen[w].append(o)
    got = defaultdict(list)
    for x in numbered(df, ["o"], ["w"]).collect():
        got[x.w].append((x.n, x.o))
    assert {w: sorted(v) for w, v in got.items()} == {w: list(enumerate(sorted(v), 1)) for w, v in seen.items()}
    every = sorted((x.n, x.o) for x in numbered(df, ["o"]).collect())
    assert every == list(enumerate(sorted(o for _, o, _ in rows), 1))
    assert numbered(df.limit(0), ["o"], ["w"]).count() == 0
    ties = numbered(df.selectExpr("'x' AS w", "1L AS o"), ["o"], ["w"], "k")
    assert sorted(x.k for x in ties.collect()) == list(range(1, 5001))
