"""A large group of near copies costs the near-duplicate stage rows and edges in proportion, not its square."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lanewise.llm import neardup
from lanewise.llm.common import Workspace, deal_apart, deal_once, label_counts

from .test_neardup import brute_components


def test_rows_of_different_labels_meet_and_a_large_label_takes_rows_in_proportion(spark):
    ws = Workspace(spark, "t")
    sizes = {("a", 0): 400, ("a", 1): 30, ("a", 2): 3, ("a", 3): 1, ("b", 4): 25, ("b", 5): 24, ("c", 6): 5, ("c", 7): 4, ("d", 8): 90}
    rows = [(key, label, 1_000 * label + k) for (key, label), n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "key string, label long, id long")
    dealt = deal_apart(df, label_counts(ws, df, "key", "label", 20, "counts"), "key", "label", ["id"], 20).collect()
    units = defaultdict(list)
    for r in dealt:
        units[r.unit].append(r)
    met = set()
    for members in units.values():
        met |= {(x.id, y.id) for x in members for y in members if x.id < y.id and x.label != y.label and (x.own == x.other or x.blk != y.blk)}
    assert met == {(x, y) for k, a, x in rows for j, b, y in rows if x < y and a != b and k == j}
    assert max(map(len, units.values())) < 5 * 20
    assert len([r for r in dealt if r.label == 0]) == 400 * 3  # the other labels are one block of small ones and two of a large one
    assert len([r for r in dealt if r.label == 8]) == 90

    sized = df.filter("label = 0").withColumn("_n", F.lit(400).cast("long"))
    once = deal_once(sized, "key", ["id"], 20).collect()
    assert {r.id for r in once} == set(range(400)) and len({r.unit for r in once}) == 20 and len(once) < 2 * 400


def near_copies(count):
    """Near copies of one text, some links of a chain away from it, texts with one common passage, and others."""
    rng = random.Random(count)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(count):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((1, 1, 2, 3, 4))):
            copy[at] = word()
        texts.append(" ".join(copy))
    for lost in (12, 18, 24, 30, 36, 42):  # each is near the one before it
        texts.append(" ".join([*base[: 150 - lost], *(f"tail{k}" for k in range(lost))]))
    passage = [word() for _ in range(60)]
    texts += [" ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(20))]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(90)) for _ in range(30)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_a_large_group_of_near_copies_is_linked_in_proportion(spark, monkeypatch):
    written = {}
    write = Workspace.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = out.count() if name.endswith("units") or name.endswith("-e0") else None
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    made = []
    for count in (150, 300):
        texts = near_copies(count)
        want, _ = brute_components(texts)
        written.clear()
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        assert {r.doc_id: r.component_id for r in neardup.near_groups(docs, 5, 40, 20).collect()} == want
        made.append((sum(n for name, n in written.items() if name.endswith("-e0")), written["units"], len(texts)))
    for edges, units, n in made:
        assert units < 3 * n and edges < 15 * n, made
