"""The expected lane: readings resolved from rules and dictionaries alone.

Input is one row per printed occurrence: ``occurrence_id, line, pos`` (from 0)
and ``char``. Nothing observed may enter here; the two lanes meet only in the
ledger. Every step is a join on the target character or on an exploded word
window, followed by the priority or longest-match aggregate; a layer that holds
several readings stops the cascade with a conflict.

The layers of :func:`resolve`, first hit wins: company position, meaning of a
whole word, handbook position, handbook rules, base reading of 一, exact and skip
rules, sandhi of 一 and 不, doubled words, positional particles and units, dictionary
words, dictionary examples, sole readings, and last the default or derived rule
that was held back. Rules, words and sole readings outside the handbook's allowed
readings of a character are passed over.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tone_class
from .components import cut
from .keyed import resolve_by_priority

# What stands before a classifier, a unit, or ends a clause.
CLASSIFIER_TRIGGERS = "〇零一二三四五六七八九十百千萬億半每這那哪幾某整各兩俩兩俩"
CLASSIFIER_PAIRS = ("是個", "當個", "來個", "添個")
UNIT_NUMERALS = "〇零一二三四五六七八九十百千萬億0123456789"
ORDINAL_NUMERALS = "〇零一二三四五六七八九0123456789"
CLAUSE_ENDS = "。！？!?；;"
INTERJECTIONS = "哎唉啊喔哦呀"
# Doubled words whose second syllable is neutral.
DOUBLED = (("媽媽", "ㄇㄚ", "˙ㄇㄚ"), ("姐姐", "ㄐㄧㄝˇ", "˙ㄐㄧㄝ"), ("弟弟", "ㄉㄧˋ", "˙ㄉㄧ"))

# Doubled words whose second syllable the handbook gives as neutral.
SECOND_NEUTRAL = (
    ("爸爸", "˙ㄅㄚ"), ("媽媽", "˙ㄇㄚ"), ("爺爺", "˙ㄧㄝ"), ("奶奶", "˙ㄋㄞ"), ("哥哥", "˙ㄍㄜ"), ("姐姐", "˙ㄐㄧㄝ"), ("弟弟", "˙ㄉㄧ"),
    ("妹妹", "˙ㄇㄟ"), ("叔叔", "˙ㄕㄨ"), ("伯伯", "˙ㄅㄛ"), ("舅舅", "˙ㄐㄧㄡ"), ("公公", "˙ㄍㄨㄥ"), ("婆婆", "˙ㄆㄛ"), ("謝謝", "˙ㄒㄧㄝ"),
)
# What around 東西, 好玩 and 看看 tells their meanings apart.
THINGS = ("吃東西", "哪些東西", "什麼東西", "買東西")
DIRECTIONS = ("東西文化", "東西走向", "東西方向", "東西橫貫")
FUN = ("好玩、有趣", "好玩而且")
TRYING = "視嚐嘗試瞧聽"
VIEWED = ("吧", "能否", "你的", "你們", "照片", "情況", "風景", "老師")
VIEWER = "你，,。！!"
# Characters whose sole dictionary reading decides nothing.
NO_SINGLE = "一不的得著了個子頭兒們麼嗎呢啊呀哇啦吧喲哦呵嘍囉和地"
# Words that may only seem to stand in a line (target, word, what follows or precedes then).
SEEMING = (("中", "中的", ""), ("比", "比鄰", "比鄰居"), ("背", "背書", "背書包"), ("轉", "轉成", "轉成功"))
COMPARED = "高低大小快慢多少長短遠近重輕粗細寬窄強弱"
BODY = ("臀部", "頭部", "肩部", "背部", "胸部", "腹部", "腰部", "腿部", "手臂", "身高", "腳掌", "膝蓋")
PASSED = "球給遞送出到回向接"
PERSONS = (
    "家人", "他人", "別人", "女人", "男人", "老人", "主人", "工人", "客人", "病人", "大人", "友人",
    "國人", "本人", "私人", "行人", "成人", "新人", "親人", "敵人", "商人", "軍人", "藝人", "名人",
)
# Strength of what a layer finds; rules have their own.
STRENGTH = {
    "company_position": 10_300, "semantic_word": 10_250, "semantic_context": 170, "handbook_position": 10_200, "handbook_constraint": 9_000, "yi_base": 1_000,
    "special_repeat": 165, "special_ya": 155, "special_fen": 150, "concise_word": 140, "special_ge": 125, "special_bu": 125, "special_yi": 110, "concise_single": 125,
    "dictionary_example": 95, "dictionary_single": 90,
}
# Findings that outweigh a character's only dictionary reading, from this strength on.
OUTWEIGHS = (
    "exact", "company_position", "handbook_position", "semantic_word", "special_repeat", "special_yi", "special_bu", "special_ge", "special_ya", "special_fen",
    "dictionary_example", "concise_word", "concise_single",
)
OUTWEIGHS_FROM = 120

VARIATION = "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"
RADIUS = 14


def without_selectors(occ: DataFrame) -> DataFrame:
    """Lines without variation selectors, positions moved to match."""
    before = F.substring("line", F.lit(1), F.col("pos"))
    return occ.withColumn("pos", F.length(F.regexp_replace(before, VARIATION, "")).cast("int")).withColumn("line", F.regexp_replace("line", VARIATION, ""))


def at(offset: int) -> Column:
    """The character ``offset`` places from the target, empty beyond the line."""
    place = F.col("pos") + 1 + offset
    return F.when(place >= 1, F.substring(F.col("line"), place, F.lit(1))).otherwise(F.lit(""))


def covers(phrase: Column) -> Column:
    """Whether some match of ``phrase`` in the line covers the target at its own character."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(phrase) - 1, F.lit(0)))
    hit = F.exists(starts, lambda r: (F.col("pos") >= r) & (F.substring(F.col("line"), F.col("pos") - r + 1, F.length(phrase)) == phrase) & (F.substring(phrase, r + 1, F.lit(1)) == F.col("char")))
    return (F.length(phrase) > 0) & hit


def rule_candidates(occ: DataFrame, rules: DataFrame) -> DataFrame:
    """Lexical rules that apply: ``occurrence_id, priority, mode, length, reading, rule_id``.

    ``rules``: ``rule_id, priority, mode, target_char, phrase, expected_reading,
    excluded_phrases array<string>``. Exact, derived and skip rules need their
    phrase around the target; an excluded phrase there blocks all but skip.
    """
    joined = occ.join(rules, occ["char"] == rules["target_char"])
    blocked = F.exists(F.coalesce("excluded_phrases", F.array().cast("array<string>")), covers)
    applies = F.when(F.col("mode").isin("exact", "derived"), covers(F.col("phrase")) & ~blocked).when(F.col("mode") == "skip", covers(F.col("phrase"))).when(F.col("mode") == "default", ~blocked)
    reading = F.when(F.col("mode") == "skip", "").otherwise(F.col("expected_reading"))
    return joined.filter(applies).select("occurrence_id", "priority", "mode", F.length("phrase").alias("length"), reading.alias("reading"), "rule_id")


def _inside(char: Column, members: str) -> Column:
    return (char != "") & F.contains(F.lit(members), char)


def _around(n_before: int, n: int) -> Column:
    """``n`` characters of the line from ``n_before`` places before the target."""
    place = F.col("pos") + 1 - n_before
    return F.when(place >= 1, F.substring(F.col("line"), place, F.lit(n))).otherwise(F.lit(""))


Positional = tuple[str, Column, Column]


def outer_rules() -> list[Positional]:
    """Positional rules above all lexical ones: (basis, condition, reading)."""
    ch, line = F.col("char"), F.col("line")
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(line, p))
    west, fun, look = (ch == "西") & (at(-1) == "東"), (ch == "好") & (at(1) == "玩"), (ch == "看") & (at(-1) == "看")
    after = F.exists(F.array(*map(F.lit, VIEWED)), lambda p: F.startswith(F.substring(line, F.col("pos") + 2, F.length(line)), p))
    found = [
        ("company_position", (ch == "寶") & (at(-1) == "寶"), F.lit("˙ㄅㄠ")),
        ("semantic_word", west & any_of(THINGS), F.lit("˙ㄒㄧ")),
        ("semantic_word", west & any_of(DIRECTIONS), F.lit("ㄒㄧ")),
        ("semantic_context", fun & ((at(2) == "的") | any_of(FUN)), F.lit("ㄏㄠˇ")),
        ("semantic_context", look & ~_inside(at(-2), TRYING) & (after | _inside(at(-2), VIEWER)), F.lit("ㄎㄢˋ")),
    ]
    return found + [("handbook_position", (ch == word[0]) & (at(-1) == word[0]), F.lit(reading)) for word, reading in SECOND_NEUTRAL]


def base_of_yi() -> Positional:
    return "yi_base", (F.col("char") == "一") & ((at(-1) == "第") | _inside(at(1), ORDINAL_NUMERALS)), F.lit("ㄧ")


def sandhi(next_tone: Column) -> list[Positional]:
    ch = F.col("char")
    return [
        ("special_yi", (ch == "一") & next_tone.isin(1, 2, 3, 4), F.when(next_tone == 4, "ㄧˊ").otherwise("ㄧˋ")),
        ("special_bu", (ch == "不") & next_tone.isNotNull(), F.when(next_tone == 4, "ㄅㄨˊ；ㄅㄨˋ").otherwise("ㄅㄨˋ")),
    ]


def inner_rules(classifier: bool) -> list[Positional]:
    """Positional rules below the lexical ones; the classifier only where it is asked for."""
    ch = F.col("char")
    found: list[Positional] = []
    for word, first, second in DOUBLED:
        c = word[0]
        found.append(("special_repeat", (ch == c) & (at(1) == c), F.lit(first)))
        found.append(("special_repeat", (ch == c) & (at(-1) == c), F.lit(second)))
    if classifier:
        found.append(("special_ge", (ch == "個") & (_inside(at(-1), CLASSIFIER_TRIGGERS) | F.concat(at(-1), ch).isin(*CLASSIFIER_PAIRS)), F.lit("ㄍㄜˋ；˙ㄍㄜ")))
    ends = (at(1) == "") | _inside(at(1), CLAUSE_ENDS)
    found.append(("special_ya", (ch == "呀") & (F.col("pos") > 0) & ~_inside(at(-1), INTERJECTIONS) & ends, F.lit("˙ㄧㄚ")))
    found.append(("special_fen", (ch == "分") & _inside(at(-1), UNIT_NUMERALS), F.lit("ㄈㄣ")))
    return found


def first_special(rules: Sequence[Positional]) -> Column:
    """A struct of the first rule that holds, null where none does."""
    result = F.lit(None).cast("struct<basis:string,reading:string>")
    for name, when, reading in reversed(rules):
        result = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("basis"), reading.alias("reading"))).otherwise(result)
    return result


def seems_only(word: Column) -> Column:
    """Whether ``word`` at the target is known to be parts of two words."""
    ch = F.col("char")
    found = F.lit(False)
    for target, name, ahead in SEEMING:
        found = found | ((ch == target) & (word == name) & (_around(0, len(ahead)) == ahead if ahead else F.lit(True)))
    shoulder = (_around(0, 3) == "比肩膀") | (_around(2, 2).isin(*BODY) & _inside(at(2), COMPARED))
    found = found | ((ch == "比") & (word == "比肩") & shoulder) | ((ch == "傳") & (word == "左傳") & _inside(at(1), PASSED))
    return found | ((ch == "和") & (word == "人和") & _around(2, 2).isin(*PERSONS))


def word_hits(occ: DataFrame, words: DataFrame, longest: int = RADIUS, blocked: DataFrame | None = None) -> DataFrame:
    """Dictionary words around each target, at the target's place in the word.

    ``words``: ``word, primary array<string>`` (one reading a character). A word
    is refused if another word of two or more characters crosses its edge without
    reaching the target: the boundary may then lie elsewhere. So are words that
    only seem to stand there, and those in ``blocked`` (``occurrence_id, word``).
    """
    lengths = sorted(r[0] for r in words.select(F.length("word")).filter(F.length("word").between(2, longest)).distinct().collect())  # at most ``longest``
    some = f"array({', '.join(map(str, lengths))})" if lengths else "cast(array() AS array<int>)"
    around = F.expr(
        f"flatten(transform({some}, n -> transform(filter(sequence(greatest(pos - {2 * longest}, 0), pos + {longest}), s -> s + n <= length(line)), "
        "s -> named_struct('s', s, 'n', n, 'w', substring(line, s + 1, n)))))"
    )
    near = occ.select("occurrence_id", "char", "line", "pos", F.explode(around).alias("x")).select("occurrence_id", "char", "line", "pos", F.col("x.s").alias("s"), F.col("x.n").alias("n"), F.col("x.w").alias("word"))
    known = near.join(words, "word")
    own = known.filter("s <= pos AND pos < s + n AND size(primary) = n").filter(~seems_only(F.col("word")))
    if blocked is not None:
        own = own.join(blocked, ["occurrence_id", "word"], "left_anti")
    covering = own.select("occurrence_id", "s", "n", F.get("primary", F.col("pos") - F.col("s")).alias("reading"))
    others = known.filter("NOT (s <= pos AND pos < s + n)").select("occurrence_id", F.col("s").alias("s2"), F.col("n").alias("n2"))
    crossing = (covering["occurrence_id"] == others["occurrence_id"]) & (F.col("s2") < F.col("s") + F.col("n")) & (F.col("s") < F.col("s2") + F.col("n2")) & ~((F.col("s2") >= F.col("s")) & (F.col("s2") + F.col("n2") <= F.col("s") + F.col("n")))
    return covering.join(others, crossing, "left_anti")


def blocked_words(occ: DataFrame, rules: DataFrame) -> DataFrame:
    """Phrases of rules whose excluded phrases stand around the target: ``occurrence_id, word``."""
    named = rules.filter((F.coalesce("phrase", F.lit("")) != "") & (F.size(F.coalesce("excluded_phrases", F.array().cast("array<string>"))) > 0))
    joined = occ.join(named.select("target_char", "phrase", "excluded_phrases"), occ["char"] == F.col("target_char"))
    return joined.filter(F.exists("excluded_phrases", covers)).select("occurrence_id", F.col("phrase").alias("word")).distinct()


def dictionary_reading(occ: DataFrame, words: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``occurrence_id, reading, conflicting`` by the longest accepted words."""
    hits = word_hits(occ, words, blocked=blocked).select("occurrence_id", F.lit(0).alias("priority"), F.lit("exact").alias("mode"), F.col("n").alias("length"), "reading")
    return resolve_by_priority(hits, ["occurrence_id"]).select("occurrence_id", "reading", "conflicting")


def example_reading(occ: DataFrame, examples: DataFrame) -> DataFrame:
    """``occurrence_id, reading, conflicting`` by the longest example around the target.

    ``examples``: ``char, example, reading``; an example that stands under several
    readings of its character is none.
    """
    sole = examples.groupBy("char", "example").agg(F.min("reading").alias("reading"), F.max("reading").alias("_high")).filter("reading = _high").drop("_high")
    hits = occ.join(sole, "char").filter(covers(F.col("example")) & ~seems_only(F.col("example")))
    hits = hits.select("occurrence_id", F.lit(0).alias("priority"), F.lit("exact").alias("mode"), F.length("example").alias("length"), "reading")
    return resolve_by_priority(hits, ["occurrence_id"]).select("occurrence_id", "reading", "conflicting")


def example_hints(occ: DataFrame, examples: DataFrame) -> DataFrame:
    """``occurrence_id, hints``: examples with the target's character anywhere in the line, for finding places only."""
    found = occ.join(examples, "char").filter(F.contains("example", F.col("char")) & F.contains("line", F.col("example")))
    hint = F.concat_ws("→", "example", "reading")
    return found.groupBy("occurrence_id").agg(F.array_join(F.array_sort(F.collect_set(hint)), "；").alias("hints"))


def constrained(characters: DataFrame, constraints: DataFrame) -> DataFrame:
    """Dictionary readings under the handbook: ``char, readings, allowed``.

    Of a character's ``readings`` those stay that the handbook's ``allowed`` has; if
    none does, or the dictionary lacks the character, the allowed ones replace them.
    """
    both = characters.select("char", "readings").join(constraints.select("char", "allowed"), "char", "full")
    kept = F.filter("readings", lambda r: F.array_contains("allowed", r))
    readings = F.when(F.col("allowed").isNull(), F.col("readings")).when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.col("allowed"))
    return both.select("char", readings.alias("readings"), "allowed")


@dataclass(frozen=True)
class Evidence:
    """What the expected lane may know; all but the first three may be missing.

    ``handbook`` has the columns of ``rules``; ``characters`` is what
    :func:`constrained` gives; ``examples`` has ``char, example, reading``.
    """

    rules: DataFrame
    words: DataFrame
    singles: DataFrame
    handbook: DataFrame | None = None
    characters: DataFrame | None = None
    examples: DataFrame | None = None


def options(reading: Column) -> Column:
    """The readings that a cell accepts."""
    parts = F.transform(F.split(F.coalesce(reading, F.lit("")), "[；;]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def accepts(actual: Column, expected: Column) -> Column:
    return F.array_contains(options(expected), F.trim(F.coalesce(actual, F.lit(""))))


def _lexical(occ: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """The rules' answer as one struct: reading, mode, strength and rule, or the conflict."""
    candidates = rule_candidates(occ, rules)
    best = resolve_by_priority(candidates, ["occurrence_id"])
    told = candidates.join(best.select("occurrence_id", F.col("reading").alias("_r"), "conflicting"), "occurrence_id")
    own = F.col("_r").isNull() | (F.col("reading") == F.col("_r"))
    rank = F.struct("priority", (F.col("mode") == "exact").cast("int").alias("exact"), F.when(F.col("mode") == "exact", F.col("length")).otherwise(0).alias("length"), "mode", "rule_id")
    rows = told.filter(own).groupBy("occurrence_id").agg(F.max(rank).alias("_b"), F.min("_r").alias("reading"), F.min("conflicting").alias("conflicting"))
    return rows.select("occurrence_id", F.struct("reading", "conflicting", "_b.mode", F.col("_b.priority").alias("strength"), "_b.rule_id").alias(name))


def _layer(found: DataFrame, name: str) -> DataFrame:
    """A layer's readings as an array: one resolves, several conflict."""
    return found.select("occurrence_id", F.split(F.coalesce("conflicting", "reading"), r"\|").alias(name))


def resolve(occ: DataFrame, evidence: Evidence, next_tone: DataFrame | None = None) -> DataFrame:
    """``occurrence_id, reading, basis, strength, conflicting``, by the module's layers.

    ``next_tone`` (``occurrence_id, tone``) is given for the occurrences themselves;
    without it this is the restricted search for the character after one under
    sandhi: it has no sandhi, base of 一 or classifier, takes a dictionary's only
    reading before a held rule, and gives up where a rule breaks the handbook.
    """
    whole = next_tone is not None
    occ = without_selectors(occ)
    none = F.lit(None)
    rows = occ.join(_lexical(occ, evidence.rules, "_l"), "occurrence_id", "left")
    if evidence.handbook is not None:
        rows = rows.join(_lexical(occ, evidence.handbook, "_h"), "occurrence_id", "left")
    else:
        rows = rows.withColumn("_h", none.cast(dict(rows.dtypes)["_l"]))
    rows = rows.join(_layer(dictionary_reading(occ, evidence.words, blocked_words(occ, evidence.rules)), "_w"), "occurrence_id", "left")
    rows = rows.join(evidence.singles.select("char", F.col("reading").alias("_s")), "char", "left")
    rows = rows.join(_layer(example_reading(occ, evidence.examples), "_x"), "occurrence_id", "left") if evidence.examples is not None else rows.withColumn("_x", none.cast("array<string>"))
    known = evidence.characters.select("char", F.col("readings").alias("_d"), F.col("allowed").alias("_a")) if evidence.characters is not None else None
    rows = rows.join(known, "char", "left") if known is not None else rows.withColumns({"_d": none.cast("array<string>"), "_a": none.cast("array<string>")})
    rows = rows.join(next_tone, "occurrence_id", "left") if whole else rows.withColumn("tone", none.cast("int"))

    fits = lambda reading: F.coalesce(F.size("_a"), F.lit(0)).isin(0, -1) | (F.size(F.array_except(options(reading), F.col("_a"))) == 0)
    rows = rows.withColumns(
        {
            "_outer": first_special(outer_rules()),
            "_base": first_special([base_of_yi()] if whole else []),
            "_inner": first_special(inner_rules(whole)),
            "_turned": first_special(sandhi(F.col("tone")) if whole else []),
            "_w": F.filter("_w", fits),
            "_fits": fits(F.col("_l.reading")),
        }
    )
    strength = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    c = F.col
    found = c("_l").isNotNull()
    under_sandhi = c("char").isin("一", "不") if whole else F.lit(False)
    one = lambda name: F.when(F.size(name) == 1, F.get(name, F.lit(0)))
    several = lambda name: F.when(F.size(name) > 1, F.array_join(name, "|"))
    broken = found & c("_l.conflicting").isNull() & ~c("_fits")
    held = c("_l.reading").isNotNull() & c("_fits") & ~c("_l.mode").isin("exact", "skip")
    alone = F.trim("line") == c("char") if whole else F.lit(False)
    # (when, reading, basis, strength, conflict)
    ladder = [
        (c("_outer").isNotNull(), c("_outer.reading"), c("_outer.basis"), None, None),
        (c("_h.conflicting").isNotNull(), None, F.lit("handbook:conflict"), c("_h.strength"), c("_h.conflicting")),
        (c("_h").isNotNull(), c("_h.reading"), c("_h.mode"), c("_h.strength"), None),
        (c("_base").isNotNull(), c("_base.reading"), c("_base.basis"), None, None),
        (c("_l.conflicting").isNotNull(), None, F.lit("rule:conflict"), c("_l.strength"), c("_l.conflicting")),
    ]
    if whole:
        ladder.append((broken & (F.size("_a") == 1), F.get("_a", F.lit(0)), F.lit("handbook_constraint"), None, None))
    else:
        ladder.append((broken, None, F.lit("none"), None, None))
    ladder += [
        (found & c("_fits") & c("_l.mode").isin("exact", "skip"), c("_l.reading"), c("_l.mode"), c("_l.strength"), None),
        (c("_turned").isNotNull(), c("_turned.reading"), c("_turned.basis"), None, None),
        (under_sandhi, None, F.lit("none"), None, None),  # never guessed from the base reading
        (c("_inner").isNotNull(), c("_inner.reading"), c("_inner.basis"), None, None),
        (F.size("_w") > 1, None, F.lit("word:conflict"), F.lit(STRENGTH["concise_word"]), several("_w")),
        (F.size("_w") == 1, one("_w"), F.lit("concise_word"), None, None),
        (F.size("_x") > 1, None, F.lit("example:conflict"), F.lit(STRENGTH["dictionary_example"]), several("_x")),
        (F.size("_x") == 1, one("_x"), F.lit("dictionary_example"), None, None),
        (c("_s").isNotNull() & ~_inside(c("char"), NO_SINGLE) & fits(c("_s")), c("_s"), F.lit("concise_single"), None, None),
    ]
    if not whole:
        ladder.append((F.size("_d") == 1, one("_d"), F.lit("dictionary_single"), None, None))
    ladder.append((held & ~alone, c("_l.reading"), c("_l.mode"), c("_l.strength"), None))
    reading, basis, power, conflict = none.cast("string"), F.lit("none"), none.cast("int"), none.cast("string")
    for when, value, name, worth, against in reversed(ladder):
        when = F.coalesce(when, F.lit(False))
        reading = F.when(when, none if value is None else value).otherwise(reading)
        basis = F.when(when, name).otherwise(basis)
        power = F.when(when, (F.element_at(strength, name) if worth is None else worth).cast("int")).otherwise(power)
        conflict = F.when(when, none if against is None else against).otherwise(conflict)
    shown = F.when(basis == "semantic_context", "semantic_word").when(basis == "yi_base", "special_yi").otherwise(basis)
    return rows.select("occurrence_id", "char", reading.alias("reading"), shown.alias("basis"), power.alias("strength"), conflict.alias("conflicting"), c("_d").alias("readings"), c("_a").alias("allowed"))


CONTEXT = ["line", "pos", "char"]


def by_context(occ: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` on each distinct place of a line once; what it finds goes to every occurrence there.

    Readings follow from ``line, pos, char`` alone, nulls included. The tables of a search
    grow with the distinct places, and only one join with the occurrences.
    """
    contexts = cut(occ.select(*CONTEXT).distinct().withColumn("occurrence_id", F.monotonically_increasing_id()))
    found = search(contexts)
    told = found.select("occurrence_id", F.struct(*(c for c in found.columns if c != "occurrence_id")).alias("_f"))
    told = told.join(contexts, "occurrence_id").select("_f", *(F.col(c).alias(f"_{c}") for c in CONTEXT))
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CONTEXT))
    return occ.select("occurrence_id", *CONTEXT).join(told, same).select("occurrence_id", "_f.*")


def decided(occ: DataFrame, evidence: Evidence) -> DataFrame:
    """:func:`resolve` in the two passes that sandhi needs: the next characters, then all."""
    return by_context(occ, lambda contexts: _decided(contexts, evidence))


def _decided(occ: DataFrame, evidence: Evidence) -> DataFrame:
    following = occ.filter(F.col("pos") + 1 < F.length("line")).filter(F.col("char").isin("一", "不"))
    following = following.select("occurrence_id", "line", (F.col("pos") + 1).alias("pos")).withColumn("char", F.substring(F.col("line"), F.col("pos") + 1, F.lit(1)))
    tones = resolve(following, evidence).select("occurrence_id", tone_class(F.col("reading")).alias("tone"))
    return resolve(occ, evidence, tones)


def materialised(found: DataFrame) -> DataFrame:
    """Adds ``expected, expected_status, kind, weak`` to what :func:`decided` gives.

    A conflict stays one. A character with one dictionary reading has that, unless
    stronger evidence outweighs it; weaker evidence against it is a conflict. Then
    comes the evidence itself, then the handbook's allowed set; a character that no
    source knows is unresolved, one with several readings ambiguous.
    """
    c = F.col
    sole = F.size("readings") == 1
    dictionary = F.get("readings", F.lit(0))
    skipped, clash = c("basis") == "skip", c("conflicting").isNotNull()
    has = c("reading").isNotNull() & ~skipped
    outweighs = F.coalesce(has & c("basis").isin(*OUTWEIGHS) & (c("strength") >= OUTWEIGHS_FROM), F.lit(False))
    against = has & ~accepts(dictionary, c("reading")) & ~outweighs
    allowed = F.coalesce(F.size("allowed"), F.lit(0)) > 0
    kind = (
        F.when(skipped, "skipped")
        .when(clash, "conflict")
        .when(sole & against, "conflict")
        .when(sole, "single")
        .when(has, "lexical")
        .when(allowed, "handbook_allowed_set")
        .when(F.coalesce(F.size("readings"), F.lit(0)) <= 0, "unresolved")
        .otherwise("ambiguous")
    )
    rows = found.withColumn("kind", kind)
    expected = (
        F.when((c("kind") == "conflict") & clash, F.replace(c("conflicting"), F.lit("|"), F.lit("；")))
        .when(c("kind") == "conflict", c("reading"))
        .when(c("kind") == "single", F.when(outweighs, c("reading")).otherwise(dictionary))
        .when(c("kind") == "lexical", c("reading"))
        .when(c("kind") == "handbook_allowed_set", F.array_join("allowed", "；"))
        .otherwise("")
    )
    status = F.when(c("kind") == "skipped", "EXCLUDED").when(c("kind").isin("single", "lexical", "handbook_allowed_set"), "RESOLVED").otherwise(F.upper("kind"))
    return rows.withColumns({"expected": expected, "expected_status": status, "weak": (c("kind") == "lexical") & (c("basis") == "derived")})


# The views that every occurrence is in exactly one of.
VIEWS = (
    "scope_skipped", "actual_missing", "rule_conflicts", "expected_uncovered", "multi_unresolved",
    "single_agrees", "single_mismatches", "lexical_agrees", "weak_lexical_mismatches", "lexical_mismatches",
)


def routed(rows: DataFrame) -> DataFrame:
    """Adds ``source_view`` to materialised rows that have ``actual``: a plain comparison of both lanes."""
    c = F.col
    same = accepts(c("actual"), c("expected"))
    view = (
        F.when(c("kind") == "skipped", "scope_skipped")
        .when(F.coalesce("actual", F.lit("")) == "", "actual_missing")
        .when(c("kind") == "conflict", "rule_conflicts")
        .when(c("kind") == "unresolved", "expected_uncovered")
        .when(c("kind") == "ambiguous", "multi_unresolved")
        .when(c("kind") == "single", F.when(same, "single_agrees").otherwise("single_mismatches"))
        .when(same, "lexical_agrees")
        .when(c("weak"), "weak_lexical_mismatches")
        .otherwise("lexical_mismatches")
    )
    return rows.withColumn("source_view", view)


def coordinate_rescue_fits(line: Column, pos: Column, char: Column) -> Column:
    """Whether a reading may be sought in the order of the page instead of the line.

    Only for lines of up to three characters, or a target at the line's edge that
    has no stop beside it.
    """
    text = F.trim(F.coalesce(line, F.lit("")))
    n = F.length(text)
    beside = lambda d: F.when(pos + d >= 0, F.substring(text, pos + d + 1, F.lit(1))).otherwise(F.lit(""))
    stops = CLAUSE_ENDS + "：:"
    edge = ((pos == 0) | (pos == n - 1)) & (pos >= 0) & (pos < n) & ~_inside(beside(1), stops) & ~_inside(beside(-1), stops)
    return F.coalesce((n > 0) & pos.isNotNull() & ((text == char) | (n <= 3) | edge), F.lit(False))


# Least strength of what a second look may find, of a rule alone, and what counts besides exact rules.
RESCUE_FROM, RESCUE_RULE_FROM = 95, 130
RESCUES = ("special_repeat", "special_yi", "special_bu", "special_ge", "dictionary_example", "concise_word", "concise_single")


def rescued(occ: DataFrame, evidence: Evidence) -> DataFrame:
    """:func:`decided`, then a second look at what it left open, in the order of the page.

    ``occ`` has ``fallback, fallback_pos`` besides: the characters around the target as they
    stand on the page, and its place among them. Looked at again are occurrences without a
    finding or with a held default, without conflict, where
    :func:`coordinate_rescue_fits`. The whole search on the page's order is taken if it is strong enough and exact, or
    of one of ``RESCUES`` where the line isn't blank; failing that, and unless that search
    ended in a conflict, a strong exact rule alone. Adds ``rescued``.
    """
    c = F.col
    first = cut(decided(occ.select("occurrence_id", "line", "pos", "char"), evidence))
    left_open = (c("reading").isNull() & (c("basis") != "skip") | (c("basis") == "default")) & c("conflicting").isNull()
    again = first.filter(left_open).select("occurrence_id").join(occ, "occurrence_id")
    again = again.filter((F.coalesce("fallback", F.lit("")) != "") & c("fallback_pos").isNotNull() & coordinate_rescue_fits(c("line"), c("pos"), c("char")))
    again = cut(again.select("occurrence_id", "char", c("line").alias("own"), c("fallback").alias("line"), c("fallback_pos").alias("pos")))

    def look(places: DataFrame) -> DataFrame:
        second = _decided(places, evidence).select("occurrence_id", c("reading").alias("r"), c("basis").alias("b"), c("strength").alias("s"), c("conflicting").alias("x"))
        return second.join(_lexical(places, evidence.rules, "_l"), "occurrence_id", "left")

    looked = again.select("occurrence_id", (F.trim(F.coalesce("own", F.lit(""))) != "").alias("has_line")).join(by_context(again, look), "occurrence_id", "left")
    whole = c("r").isNotNull() & c("x").isNull() & (c("s") >= RESCUE_FROM) & ((c("b") == "exact") | c("has_line") & c("b").isin(*RESCUES))
    ruled = c("x").isNull() & c("_l.conflicting").isNull() & (c("_l.mode") == "exact") & (c("_l.strength") >= RESCUE_RULE_FROM)
    pick = F.when(whole, F.struct(c("r").alias("reading"), c("b").alias("basis"), c("s").alias("strength"))).when(ruled, F.struct(c("_l.reading").alias("reading"), c("_l.mode").alias("basis"), c("_l.strength").cast("int").alias("strength")))
    found = looked.select("occurrence_id", pick.alias("p")).filter("p IS NOT NULL")
    names = ("reading", "basis", "strength")
    rows = first.join(found, "occurrence_id", "left")
    return rows.withColumns({n: F.when(c("p").isNotNull(), c(f"p.{n}")).otherwise(c(n)) for n in names} | {"rescued": c("p").isNotNull()}).drop("p")


def expected_lane(occ: DataFrame, rules: DataFrame, words: DataFrame, singles: DataFrame, handbook: DataFrame | None = None, characters: DataFrame | None = None, examples: DataFrame | None = None) -> DataFrame:
    """The whole lane: ``occurrence_id, expected_set, expected_status, basis``."""
    found = decided(occ, Evidence(rules, words, singles, handbook, characters, examples))
    if characters is not None:
        found = materialised(found)
        status = F.col("expected_status")
        told = F.col("expected")
    else:
        status = F.when(F.col("conflicting").isNotNull(), "CONFLICT").when(F.coalesce("reading", F.lit("")) != "", "RESOLVED").otherwise("UNRESOLVED")
        told = F.coalesce("conflicting", "reading", F.lit(""))
    options_ = F.array_join(F.array_sort(F.array_distinct(F.split(told, "[；;|]"))), "|")
    return found.select("occurrence_id", options_.alias("expected_set"), status.alias("expected_status"), "basis")
