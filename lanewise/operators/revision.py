"""Comparison of two editions: pages paired, characters aligned, events classed."""

from __future__ import annotations

import difflib
import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import sequence
from .components import cut
from .sequence import ratio

# Least similarity by label and by content.
BY_LABEL, BY_CONTENT = 0.35, 0.72
EVENTS = "pair string, kind string, char string, old_reading string, new_reading string, old_index int, new_index int, context string"


def pages(rows: DataFrame) -> DataFrame:
    """One row per page: its number over all files, its label, its characters and readings in order.

    ``rows``: ``pdf_order, page, label, source_row_number, char, reading``; where ``reading``
    isn't given, neither are ``readings``.
    """
    kept = ["source_row_number", "char", *(["reading"] if "reading" in rows.columns else [])]
    found = rows.groupBy("pdf_order", "page").agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct(*kept))).alias("_r"))
    found = found.withColumn("text", F.array_join(F.transform("_r", lambda x: x["char"]), ""))
    if "reading" in kept:
        found = found.withColumn("readings", F.transform("_r", lambda x: F.coalesce(x["reading"], F.lit(""))))
    found = cut(found.drop("_r"))
    per_file = found.groupBy("pdf_order").agg(F.count(F.lit(1)).alias("n"))
    base = per_file.select("pdf_order", F.coalesce(F.sum("n").over(Window.orderBy("pdf_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a file
    inside = F.row_number().over(Window.partitionBy("pdf_order").orderBy("page"))
    return found.join(base, "pdf_order").withColumn("number", (F.col("_b") + inside - 1).cast("long")).drop("_b")


@F.pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Texts up to this length meet by several shared characters at once, and how many keys each has for one length.
SHORT, MOST_KEYS = 24, 64


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows in as many partitions as shuffles have: narrow rows that Python works on at length aren't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _numbered(pages: DataFrame) -> DataFrame:
    """``text, id``: each distinct text that isn't empty."""
    return cut(_spread(pages.filter("text <> ''").select("text").distinct(), "text").withColumn("id", F.monotonically_increasing_id()))


def _listed(texts: DataFrame) -> DataFrame:
    """``id, token``: each text's characters as numbers, repeats told apart by how often they came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for text in batch.column("text").to_pylist():
                counts = Counter(text)
                tokens.append([ord(c) << 32 | k for c, m in counts.items() for k in range(m)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens, pa.list_(pa.int64()))], ["id", "tokens"])

    return texts.select("id", "text").mapInArrow(run, "id long, tokens array<long>").select("id", F.explode("tokens").alias("token"))


def _shared_least(n: int, m: int, least: float) -> int:
    """How many characters texts of two lengths share at least if their similarity reaches ``least``."""
    return math.ceil(least * (n + m) / 2 - 1e-9)


def _at_once(n: int, m: int, least: float) -> int:
    """How many shared characters make one key for two short lengths: as many as ``MOST_KEYS`` allows."""
    shared, at_once = _shared_least(n, m, least), 1
    while at_once < shared and math.comb(max(n, m) - shared + at_once + 1, at_once + 1) <= MOST_KEYS:
        at_once += 1
    return at_once


def _short_keys(codes: np.ndarray, places: np.ndarray, others: Sequence[int], least: float, old: bool) -> np.ndarray:
    """A row of keys for each row of ``codes``, texts of one length; see :func:`_keys`.

    ``codes`` are a text's characters in an order common to all texts, ``places`` where they
    stand. What two texts share in turn has one order in both, so a key is its characters
    in the order of their places. Lengths that ask for as many shared characters and
    make as many one key, about equal ones or those on one side of it, have keys in common.
    """
    n, plans = codes.shape[1], set()
    for m in others:
        shared = _shared_least(n, m, least)
        if m <= SHORT and shared <= min(n, m):
            longer = n - m if old else m - n
            plans.add((shared, _at_once(n, m, least), (longer > 1) - (longer < -1)))
    found = [np.zeros((len(codes), 0), np.uint64)]
    for shared, k, longer in sorted(plans):
        chosen = np.array(list(combinations(range(n - shared + k), k)))
        order = np.argsort(places[:, chosen], axis=2)
        parts = np.take_along_axis(codes[:, chosen], order, axis=2).astype(np.uint64)
        key = np.full(parts.shape[:2], shared * 3 + longer + 1 << 8 | k, np.uint64)
        for j in range(k):
            key = (key ^ parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        found.append(key)
    return np.concatenate(found, axis=1).view(np.int64)


def _keys(tokens: list[int], others: list[int], least: float, old: bool) -> list[int]:
    """Keys of a text of which it has one in common with every partner whose length is one of ``others``.

    Texts that share s of their n and m characters share k of the first n - s + k and
    m - s + k in any common order. Pairs of short lengths have a k of their own; else k is 1
    and s what the shortest possible partner has.
    """
    n, found = len(tokens), []
    if n <= SHORT:
        found += _short_keys(np.array([tokens], np.int64), np.arange(n)[None], others, least, old)[0].tolist()
    own = n > SHORT
    fits = {m > SHORT for m in others if _shared_least(n, m, least) <= min(n, m)}
    # with m characters of a partner, least * (n + m) / 2 are shared, and m >= least * n / (2 - least)
    first = tokens[: n - math.ceil(n * (least / (2 - least)) - 1e-9) + 1]
    for other in fits if own else fits - {False}:
        found += [hash((*((own, other) if old else (other, own)), t)) for t in first]
    return found


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _character_ranks(sides: list[DataFrame]) -> np.ndarray:
    """For each code point its place in an order by how many texts have it; at most all code points, a number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            here, times = np.unique(np.unique(rows << 21 | _codes(texts)) & (1 << 21) - 1, return_counts=True)
            counts.update(dict(zip(here.tolist(), times.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], ["code", "n"])

    both = sides[0].select("text").unionByName(sides[1].select("text"))
    total = both.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = (total.column(c).to_numpy() for c in ("code", "n"))
    ranks = np.zeros(0x110000, np.int32)
    ranks[code[np.lexsort((code, n))]] = np.arange(len(code))
    return ranks


def _short_met(sides: list[DataFrame], lengths: list[list[int]], least: float) -> DataFrame:
    """``ia, ib`` of short texts with a key in common."""
    short = [side.filter(F.length("text") <= SHORT) for side in sides]
    ranks = sides[0].sparkSession.sparkContext.broadcast(_character_ranks(short))
    heads = []
    for side, name, others in zip(short, "ab", lengths[::-1], strict=True):

        def run(batches: Iterator[pa.RecordBatch], others: list[int] = others, name: str = name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column("id").to_numpy(), np.array(batch.column("text").to_pylist(), object)
                size = np.array([len(t) for t in texts])
                for n in np.unique(size).tolist():
                    mine = np.flatnonzero(size == n)
                    for at in range(0, len(mine), 2_000):
                        some = mine[at : at + 2_000]
                        codes = _codes(texts[some].tolist()).reshape(-1, n)
                        places = np.argsort(ranks.value[codes], axis=1, kind="stable")
                        keys = _short_keys(np.take_along_axis(codes, places, axis=1), places, others, least, name == "a")
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], keys.shape[1])), pa.array(keys.ravel())], [f"i{name}", "key"])

        heads.append(side.mapInArrow(run, f"i{name} long, key long"))
    return heads[0].join(heads[1], "key").select("ia", "ib")


def _long_met(sides: list[DataFrame], lengths: list[list[int]], least: float) -> DataFrame | None:
    """``ia, ib`` of texts with a key in common of which one at least isn't short; None if no lengths allow any."""
    pairs = [(n, m) for n in lengths[0] for m in lengths[1] if max(n, m) > SHORT and _shared_least(n, m, least) <= min(n, m)]
    if not pairs:
        return None
    listed = [cut(_listed(side.filter(F.length("text") >= min(p[k] for p in pairs)))) for k, side in enumerate(sides)]
    rare = listed[0].unionByName(listed[1]).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked, heads = [], []
    for tokens, name in zip(listed, "ab", strict=True):
        ordered = tokens.join(rare, "token").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias(f"t{name}"))
        ranked.append(cut(_spread(ordered.withColumnRenamed("id", f"i{name}"), f"i{name}").withColumn(f"n{name}", F.size(f"t{name}"))))
    for k, name in enumerate("ab"):
        other = lengths[1 - k]

        def run(batches: Iterator[pa.RecordBatch], other: list[int] = other, name: str = name) -> Iterator[pa.RecordBatch]:
            longer = [m for m in other if m > SHORT]  # short texts meet one another elsewhere
            for batch in batches:
                keys = [_keys(t, other if len(t) > SHORT else longer, least, name == "a") for t in batch.column(f"t{name}").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(f"i{name}"), batch.column(f"n{name}"), pa.array(keys, pa.list_(pa.int64()))], [f"i{name}", f"n{name}", "keys"])

        keyed = ranked[k].select(f"i{name}", f"n{name}", f"t{name}").mapInArrow(run, f"i{name} long, n{name} int, keys array<long>")
        heads.append(keyed.select(f"i{name}", f"n{name}", F.explode("keys").alias("key")))
    enough = F.least("na", "nb") * 2 >= least * (F.col("na") + F.col("nb")) - 1e-9
    met = heads[0].join(heads[1], "key").filter(enough).select("ia", "ib").distinct()
    bound = F.size(F.array_intersect("ta", "tb")) * 2 >= least * (F.col("na") + F.col("nb")) - 1e-9
    return met.join(ranked[0], "ia").join(ranked[1], "ib").filter(bound).select("ia", "ib")


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The similarity of each two texts; short ones of two lengths are worked out together."""
    na, nb = (np.array([len(t) for t in side], np.int64) for side in (a, b))
    scores, together = np.zeros(len(a)), defaultdict(list)
    for at, (n, m) in enumerate(zip(na.tolist(), nb.tolist(), strict=True)):
        if 0 < n <= SHORT and 0 < m <= SHORT:
            together[n, m].append(at)
        else:
            scores[at] = ratio(a[at], b[at])
    for (n, m), rows in together.items():
        for at in range(0, len(rows), 2_000):
            some = rows[at : at + 2_000]
            x, y = (_codes([side[i] for i in some]).reshape(len(some), -1) for side in (a, b))
            scores[some] = 2.0 * sequence.matched_short(x, y) / (n + m)
    return scores


def _close(sides: list[DataFrame], least: float) -> DataFrame:
    """``ia, ib, score`` of numbered texts whose similarity reaches ``least``; see :func:`close_texts`."""
    # a length for each row, so as many as texts have lengths
    lengths = [sorted(r[0] for r in side.select(F.length("text").alias("n")).distinct().collect()) for side in sides]
    met, longer = _short_met(sides, lengths, least), _long_met(sides, lengths, least)
    met = (met if longer is None else met.unionByName(longer)).distinct()
    texts = met.join(sides[0].select(F.col("id").alias("ia"), F.col("text").alias("a")), "ia").join(sides[1].select(F.col("id").alias("ib"), F.col("text").alias("b")), "ib")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _ratios(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            found = pa.RecordBatch.from_arrays([batch.column("ia"), batch.column("ib"), pa.array(scores)], ["ia", "ib", "score"])
            yield found.filter(pa.array(scores >= least))

    return texts.mapInArrow(run, "ia long, ib long, score double")


def close_texts(old: DataFrame, new: DataFrame, least: float = BY_CONTENT) -> DataFrame:
    """``a, b, score`` of all pairs of different sides' texts whose similarity reaches ``least``.

    Similarity is at most 2 * shared / (n + m) over shared characters with repeats, so
    partners share a fixed part of their characters and hence some of their first ones in
    any common order (:func:`_keys`); with rare characters first few texts meet there, and
    short texts of few characters meet by several at once, in the order of their places.
    Pairs with a longer text are counted whole against the bound before any is aligned.
    Nothing is lost, and texts are fetched only for what is left.
    """
    sides = [_numbered(p) for p in (old, new)]
    found = _close(sides, least).join(sides[0].select(F.col("id").alias("ia"), F.col("text").alias("a")), "ia").join(sides[1].select(F.col("id").alias("ib"), F.col("text").alias("b")), "ib")
    return found.select("a", "b", "score")


#: Rounds of mutually nearest pages before few enough leftovers, pages and what links ask for, are taken by one task.
NEAREST_ROUNDS, NEAREST_LEFT = 1, 400_000


def _asked(asking: DataFrame, offered: DataFrame, tops: DataFrame, own: str, ask: str, other: str, offer: str) -> DataFrame:
    """``kind, cls, at, score``: numbers that ask, with a score, and those offered to them, without.

    A link carries the pages of the text that has fewer to those of the other, so a text
    of many pages isn't copied for each of its links.
    """
    fewer, more, none = tops.filter("c_ask <= c_offer"), tops.filter("c_ask > c_offer"), F.lit(None).cast("double").alias("score")
    rows = [
        fewer.join(asking, ask).select(F.lit(0).alias("kind"), F.col(offer).alias("cls"), F.col(own).alias("at"), "score"),
        offered.join(fewer.select(offer).distinct(), offer).select(F.lit(0).alias("kind"), F.col(offer).alias("cls"), F.col(other).alias("at"), none),
        asking.join(more.select(ask, "score").distinct(), ask).select(F.lit(1).alias("kind"), F.col(ask).alias("cls"), F.col(own).alias("at"), "score"),
        more.join(offered, offer).select(F.lit(1).alias("kind"), F.col(ask).alias("cls"), F.col(other).alias("at"), none),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _best(asking: DataFrame, offered: DataFrame, tops: DataFrame, own: str, ask: str, other: str, offer: str) -> DataFrame:
    """``own, other, score``: for each asking page the nearest offered one of its text's best texts, the larger of two as near.

    ``tops``: ``ask, offer, score, c_ask, c_offer``, the best links with the pages of both texts.
    """
    rows = _asked(asking, offered, tops, own, ask, other, offer)
    there, by = F.when(F.col("score").isNull(), F.col("at")), Window.partitionBy("kind", "cls")
    # two running values; one that looks ahead to the end would be worked out anew for each row
    rows = rows.withColumns({"_p": F.max(there).over(by.orderBy("at")), "_q": F.min(there).over(by.orderBy(F.desc("at")))})
    best = F.when(F.col("_p").isNull() | (F.col("_q") - F.col("at") <= F.col("at") - F.col("_p")), F.col("_q")).otherwise(F.col("_p"))
    near = rows.filter("score IS NOT NULL").select(F.col("at").alias(own), best.alias(other), "score")
    top = near.groupBy(own).agg(F.max(F.struct(-F.abs(F.col(own) - F.col(other)), other, "score")).alias("_b"))
    return top.select(own, f"_b.{other}", "_b.score")


class _Numbers:
    """A text's pages that are left, by number."""

    def __init__(self, numbers: list[int]) -> None:
        self.numbers, n = sorted(numbers), len(numbers)
        self.after, self.before = list(range(n + 1)), list(range(n + 1))  # before is shifted by one: 0 is none

    @staticmethod
    def _end(way: list[int], at: int) -> int:
        while way[at] != at:
            way[at] = at = way[way[at]]
        return at

    def remove(self, number: int) -> None:
        at = bisect_left(self.numbers, number)
        self.after[at], self.before[at + 1] = at + 1, at

    def nearest(self, number: int) -> int | None:
        """The nearest, the larger of two as near."""
        at = bisect_left(self.numbers, number)
        up, down = self._end(self.after, at), self._end(self.before, at) - 1
        high = self.numbers[up] if up < len(self.numbers) else None
        low = self.numbers[down] if down >= 0 else None
        return low if high is None or (low is not None and number - low < high - number) else high


def _nearest_in_order(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """What is left of :func:`nearest_greedy`, best first, in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"kind": [], "x": [], "y": [], "score": []})])
        texts, linked = [], rows[rows["kind"] == 2]
        for kind in (0, 1):
            side = rows[rows["kind"] == kind]
            texts.append({text: _Numbers(x.tolist()) for text, x in side.groupby("y")["x"]})
        heap = []

        def push(old: int | None, new: int | None, ia: int, ib: int, score: float) -> None:
            """The best pair on a link of one page, that of the text with fewer."""
            own_old = old is not None
            found = texts[1][ib].nearest(old) if own_old else texts[0][ia].nearest(new)
            if found is not None:
                o, n = (old, found) if own_old else (found, new)
                heapq.heappush(heap, (-score, abs(o - n), -o, -n, own_old, ia, ib))

        for ia, ib, score in zip(linked["x"].tolist(), linked["y"].tolist(), linked["score"].tolist(), strict=True):
            if ia in texts[0] and ib in texts[1]:
                mine, own_old = texts[0][ia].numbers, True
                if len(mine) > len(texts[1][ib].numbers):
                    mine, own_old = texts[1][ib].numbers, False
                for number in mine:
                    push(number if own_old else None, None if own_old else number, ia, ib, score)
        used: tuple[set, set] = set(), set()
        taken = []
        while heap:
            score, _, o, n, own_old, ia, ib = heapq.heappop(heap)
            o, n = -o, -n
            if o not in used[0] and n not in used[1]:
                used[0].add(o)
                used[1].add(n)
                texts[0][ia].remove(o)
                texts[1][ib].remove(n)
                taken.append((o, n, -score))
            elif (o not in used[0]) if own_old else (n not in used[1]):
                push(o if own_old else None, None if own_old else n, ia, ib, -score)
        yield pd.DataFrame(taken, columns=["old_number", "new_number", "score"]).astype({"old_number": "int64", "new_number": "int64", "score": "float64"})

    none = F.lit(None).cast("double").alias("score")
    rows = left.select(F.lit(0).alias("kind"), F.col("old_number").alias("x"), F.col("ia").alias("y"), none)
    rows = rows.unionByName(right.select(F.lit(1).alias("kind"), F.col("new_number").alias("x"), F.col("ib").alias("y"), none))
    rows = rows.unionByName(links.select(F.lit(2).alias("kind"), F.col("ia").alias("x"), F.col("ib").alias("y"), "score"))
    return rows.coalesce(1).mapInPandas(run, "old_number long, new_number long, score double")


def nearest_greedy(left: DataFrame, right: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``old_number, new_number, score``: as :func:`sequence.greedy` on pages, without listing the pairs of equal texts.

    ``left`` has ``old_number, ia``, ``right`` has ``new_number, ib``, and ``links`` scores
    pairs of texts. A page's best pair lies at its text's best score among texts that still
    have pages, and there at the nearest number, which a sort of both sides finds. Pairs
    that are the best of both pages are taken, round by round; after ``rounds`` of them
    up to ``NEAREST_LEFT`` leftovers go in their order in one task.
    """
    rounds = NEAREST_ROUNDS if rounds is None else rounds
    live, taken, n = links, None, 0
    while True:
        sizes = [left.groupBy("ia").agg(F.count(F.lit(1)).alias("ca")), right.groupBy("ib").agg(F.count(F.lit(1)).alias("cb"))]
        live = cut(live.select("ia", "ib", "score").join(sizes[0], "ia").join(sizes[1], "ib"))
        asked = live.agg(F.sum(F.least("ca", "cb"))).first()[0]
        if asked is None:
            break
        left, right = (cut(side.join(live.select(c).distinct(), c, "left_semi")) for side, c in ((left, "ia"), (right, "ib")))
        if n >= rounds and asked + left.count() + right.count() <= NEAREST_LEFT:
            last = _nearest_in_order(left, right, live)
            return last if taken is None else taken.unionByName(last)
        tops = [live.join(live.groupBy(c).agg(F.max("score").alias("_s")), c).filter("score = _s").drop("_s") for c in ("ia", "ib")]
        of_left = _best(left, right, tops[0].withColumnsRenamed({"ca": "c_ask", "cb": "c_offer"}), "old_number", "ia", "new_number", "ib")
        of_right = _best(right, left, tops[1].withColumnsRenamed({"cb": "c_ask", "ca": "c_offer"}), "new_number", "ib", "old_number", "ia")
        chosen = cut(of_left.join(of_right.drop("score"), ["old_number", "new_number"]).select("old_number", "new_number", "score"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        left, right, n = left.join(chosen, "old_number", "left_anti"), right.join(chosen, "new_number", "left_anti"), n + 1
    if taken is None:
        return left.join(right, F.lit(False)).select("old_number", "new_number", F.lit(0.0).alias("score"))
    return taken


def pair(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old_number, new_number, score, how``: by labels that are unique on both sides, then by content.

    Content pairs are all pairs of pages left with a text, from ``BY_CONTENT`` on; the
    best score is taken first, then the smaller difference of numbers, then the larger
    old and the larger new number. Pages without text pair by label only. Pages of one
    text are one to the search, and aren't multiplied with those of another.
    """
    old, new = (cut(p.select("number", "label", "text")) for p in (old, new))
    once = lambda p, n: p.filter("coalesce(label, '') <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.min("number").alias(n), F.min("text").alias(f"{n}_text")).filter("c = 1").drop("c")
    labelled = once(old, "old_number").join(once(new, "new_number"), "label").withColumn("score", alike("old_number_text", "new_number_text")).filter(F.col("score") >= BY_LABEL)
    labelled = cut(labelled.select("old_number", "new_number", "score", F.lit("label").alias("how")))
    left = old.join(labelled.select(F.col("old_number").alias("number")), "number", "left_anti").select(F.col("number").alias("old_number"), "text")
    right = new.join(labelled.select(F.col("new_number").alias("number")), "number", "left_anti").select(F.col("number").alias("new_number"), "text")
    left, right = cut(left), cut(right)
    sides = [_numbered(p) for p in (left, right)]
    numbers = [p.join(side, "text").select(n, F.col("id").alias(i)) for p, side, n, i in ((left, sides[0], "old_number", "ia"), (right, sides[1], "new_number", "ib"))]
    content = nearest_greedy(*numbers, cut(_close(sides, BY_CONTENT)))
    return labelled.unionByName(content.withColumn("how", F.lit("content")))


def events(old: DataFrame, new: DataFrame, pairs: DataFrame, radius: int = 7) -> DataFrame:
    """Changes on paired pages: reading changed, added, removed, or uncertain where text was replaced."""
    joined = pairs.join(old.select(F.col("number").alias("old_number"), F.col("text").alias("a"), F.col("readings").alias("ra")), "old_number").join(new.select(F.col("number").alias("new_number"), F.col("text").alias("b"), F.col("readings").alias("rb")), "new_number")
    joined = joined.select(F.concat_ws(":", F.col("old_number").cast("string"), F.col("new_number").cast("string")).alias("pair"), "a", "ra", "b", "rb")

    def compare(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                around = lambda text, k: text[max(0, k - radius) : k + radius + 1]
                for kind, i, j, p, q in difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).get_opcodes():
                    if kind == "equal":
                        rows += [(r.pair, "reading_changed", r.a[i + k], r.ra[i + k], r.rb[p + k], i + k, p + k, around(r.b, p + k)) for k in range(j - i) if r.ra[i + k] != r.rb[p + k]]
                        continue
                    gone, came = ("uncertain_old", "uncertain_new") if kind == "replace" else ("removed", "added")
                    rows += [(r.pair, gone, r.a[k], r.ra[k], None, k, None, around(r.a, k)) for k in range(i, j)]
                    rows += [(r.pair, came, r.b[k], None, r.rb[k], None, k, around(r.b, k)) for k in range(p, q)]
            frame = pd.DataFrame(rows, columns=["pair", "kind", "char", "old_reading", "new_reading", "old_index", "new_index", "context"])
            yield frame.astype({"old_index": "Int32", "new_index": "Int32"})

    return joined.mapInPandas(compare, EVENTS)
