"""Scalar rules: readings, numbers, texts, identities. SQL expressions where SQL
can say it; an Arrow function only for Unicode compatibility forms and readings."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# The letters of the phonetic alphabet and its tone marks.
LETTERS = "ㄅㄆㄇㄈㄉㄊㄋㄌㄍㄎㄏㄐㄑㄒㄓㄔㄕㄖㄗㄘㄙㄚㄛㄜㄝㄞㄟㄠㄡㄢㄣㄤㄥㄦㄧㄨㄩ"
TONES = "˙ˊˇˋ"
SAME_MARK = {"‧": "˙", "・": "˙", "\u0307": "˙", "一": "ㄧ", " ": "", "\u3000": ""}

_NOTE = re.compile("[（(][^）)]*[）)]")
_PLAIN = re.compile(f"[{LETTERS}]+")
_EDGE = re.compile(rf"([{TONES}])\1*(?P<after>[{LETTERS}]+)|(?P<before>[{LETTERS}]+)([{TONES}])\4*")
_ERHUA = re.compile(f"[{LETTERS}]+[ˊˇˋ]ㄦ")
_SYLLABLES = re.compile(f"(?:[{LETTERS}]+[{TONES}]){{2,}}[{LETTERS}]*")


def canonical_reading(value: object) -> str:
    """One spelling of a reading: the neutral tone first, other tones last; "" if it is none.

    Marks that look alike are one mark; spaces and bracketed notes go. One tone,
    however often repeated, may stand at either edge; before a final ㄦ it stays
    there. Several whole syllables in a row are kept as they are.
    """
    text = unicodedata.normalize("NFKC", str(value or "")).strip()
    text = _NOTE.sub("", "".join(SAME_MARK.get(c, c) for c in text))
    if _PLAIN.fullmatch(text) or _ERHUA.fullmatch(text) or _SYLLABLES.fullmatch(text):
        return text
    found = _EDGE.fullmatch(text)
    if not found:
        return ""
    tone, body = found[1] or found[4], found["after"] or found["before"]
    if tone == "˙":
        return tone + body
    return body[:-1] + tone + "ㄦ" if len(body) > 1 and body[-1] == "ㄦ" else body + tone


@F.pandas_udf(StringType())
def canonical_readings(values: pd.Series) -> pd.Series:
    return values.map(canonical_reading)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition, trimmed; null becomes empty."""
    return values.map(lambda v: unicodedata.normalize("NFKC", str(v or "")).strip())


def canonical_number(value: Column) -> Column:
    """Three places, half away from zero, no trailing zeros, no exponent."""
    text = F.round(value.cast("decimal(38,6)"), 3).cast("decimal(38,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns), F.lit(""))


def value_set(column: Column, marks: str = r"[|；;]") -> Column:
    """Parts of a delimited text: trimmed, blanks dropped, distinct, sorted, joined by ``|``."""
    parts = F.filter(F.transform(F.split(column, marks), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), "|")


def tone_class(reading: Column) -> Column:
    """Tone 1 to 5 of a reading, null where its options disagree or there is none."""
    one = lambda r: F.when(r.startswith("˙"), 5).when(r.contains("ˊ"), 2).when(r.contains("ˇ"), 3).when(r.contains("ˋ"), 4).when(r != "", 1)
    tones = F.array_distinct(F.transform(F.split(reading, r"[|；;/]"), lambda r: one(F.trim(r))))
    return F.when(F.size(tones) == 1, F.get(tones, F.lit(0)))


def occurrence_id(**fields: Column) -> Column:
    """A stable id from named fields: SHA-256 of their JSON in alphabetical order."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.concat(F.lit("occ_"), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


def review_id(occurrence: Column, schema: str = "2.5.0") -> Column:
    return F.concat(F.lit("rev_"), F.sha2(F.concat(F.lit(schema + "|"), occurrence), 256))


def comparator_reading(value: Column) -> Column:
    """The comparator's plainer spelling: marks unified and ASCII spaces and notes gone, tones left
    where they are, nothing composed; blank if a character is no letter or tone."""
    text = F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), "‧・一 ", "˙˙ㄧ"), "[（(][^）)]*[）)]", "")
    return F.when(text.rlike(f"^[{LETTERS}{TONES}]+$"), text).otherwise("")


def syllables(value: Column) -> Column:
    """The readable syllables of a spaced reading, in order."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[\\s\\x{3000}]+"), comparator_reading)
    return F.filter(parts, lambda x: x != "")


def outside_brackets(value: Column, marks: str = "、，,；;") -> Column:
    """Items of a list, cut at marks outside brackets however they nest; blanks dropped."""
    # each character in turn: the depth of brackets, and the text with a cut for each mark at depth 0
    opening, closing = F.lit("（("), F.lit("）)")
    has = lambda members, c: F.contains(members, c)

    def step(acc: Column, c: Column) -> Column:
        depth = F.when(has(opening, c), acc["depth"] + 1).when(has(closing, c), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        cut = has(F.lit(marks), c) & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), F.concat(acc["text"], F.when(cut, F.lit("\x00")).otherwise(c)).alias("text"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    letters = F.filter(F.split(F.coalesce(value, F.lit("")), ""), lambda c: c != "")
    items = F.split(F.aggregate(letters, start, step)["text"], "\x00")
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def page_token(value: Column) -> Column:
    """Whole numbers without a fraction ("7.0" is "7"), other texts as they are."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    number = text.try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("string")).otherwise(text)


def context_key(value: Column) -> Column:
    """A context without white space, its punctuation in one width."""
    return F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), ",.!?;:()", "，。！？；：（）"), r"[\s\x{3000}]+", "")


def version_family(value: Column) -> Column:
    """``major.minor`` of a version, null where it has fewer parts."""
    parts = F.split(value, r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", parts[0], parts[1]))


def compatible_versions(a: Column, b: Column) -> Column:
    """Equal, or of one family."""
    return F.coalesce((a == b) | (version_family(a) == version_family(b)), F.lit(False))


# Ranges of Han characters, names of annotation fonts, row numbers inside keys, style families.
HAN = "^[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]$"
ANNOTATION_FONT = "(?i)(zhuyin|zhuin|zuinn|poin|chuin|bpmf)"
ROW_NUMBER = r"(?i)(?:^|[|;,])\s*(?:excel_?row|source_?row|row)\s*[:=#]\s*\d+\s*"
STYLES = (
    ("BIAOKAI_W5", "(?i)^DFBiaoKai(?:ZhuIn|PoIn[123])-W5$"),
    ("YUAN_W3W5", "(?i)^DFYuan(?:ZhuIn|PoIn[123])-W[35]$"),
    ("YUAN_W7", "(?i)^DFYuan(?:ZhuIn|PoIn[123])-W7$"),
    ("HEI_W5", "(?i)^DFHei(?:ZhuIn|PoIn[123])-W5$"),
    ("HEI_W7", "(?i)^DFHei(?:ZhuIn|PoIn[123])-W7$"),
    ("KAICHU_MD", "(?i)^DFKaiChuIn-Md-(?:BPMF|PoIn[123])-BF$"),
)
# States as users read them.
STATE_NAMES = {
    "PASS": "正確",
    "TEXTBOOK_ERROR_CONFIRMED": "已確認教材錯誤",
    "DIFFERENCE_PENDING_CONFIRMATION": "發現差異，請確認",
    "RULE_CONFLICT": "有兩種規則互相衝突",
    "EXPECTED_AMBIGUOUS": "正確讀音尚未確定",
    "EXPECTED_UNRESOLVED": "尚未找到正確讀音依據",
    "REVIEW_PENDING": "需要人工確認",
    "ACTUAL_DECODE_ERROR": "程式可能讀錯課本注音",
    "ACTUAL_UNRESOLVED": "課本注音尚未安全辨識",
    "REGRESSION_BLOCKED": "內部回歸檢查未通過",
    "SOURCE_INVALID": "校對資料來源檢查失敗",
    "DATA_INTEGRITY_ERROR": "工作資料完整性異常",
    "EXCLUDED_OUT_OF_SCOPE": "此處不需校對",
    "EXCLUDED_NONINDEPENDENT_LAYER": "重複技術層，不重複校對",
}


def is_han(char: Column) -> Column:
    return F.coalesce(char, F.lit("")).rlike(HAN)


def is_annotation_font(font: Column) -> Column:
    return F.coalesce(font, F.lit("")).rlike(ANNOTATION_FONT)


def stable_key(value: Column) -> Column:
    """A key without source row numbers, which are no part of an occurrence's identity."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), ROW_NUMBER, "")
    return F.regexp_replace(bare, "^[|;, ]+|[|;, ]+$", "")


def first_named(value: Column, patterns: tuple[tuple[str, str], ...] = STYLES) -> Column:
    """The name of the first pattern that a text matches, else empty."""
    found = F.lit("")
    for name, pattern in reversed(patterns):
        found = F.when(F.coalesce(value, F.lit("")).rlike(pattern), name).otherwise(found)
    return found


def state_name(state: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in STATE_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.coalesce(state, F.lit(""))), state, F.lit(""))


def colour_rank(value: Column) -> Column:
    """0 for white (all of red, green and blue at 247 or more), 1 for anything visible or unknown."""
    channels = [F.shiftright(value, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0)]
    return F.when(F.least(*channels) >= 247, 0).otherwise(1)


def colour_rank_of(channels: Column) -> Column:
    """As :func:`colour_rank` for an array of channels, from 0 to 1 or to 255."""
    least, most = F.array_min(F.slice(channels, 1, 3)), F.array_max(F.slice(channels, 1, 3))
    white = F.when(most <= 1.0, least >= 0.965).otherwise(least >= 247)
    return F.when((F.size(channels) >= 3) & F.coalesce(white, F.lit(False)), 0).otherwise(1)


def safe_round(value: Column, digits: int = 3) -> Column:
    """Rounded half to even, null where it is no number."""
    return F.bround(value.try_cast("double"), digits)


def safe_text(value: Column) -> Column:
    """A cell's text without control characters other than tabs and line ends."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def split_tone(reading: Column) -> Column:
    """``base`` and ``tone`` (1 to 4, or neutral) of one syllable."""
    r = F.coalesce(reading, F.lit(""))
    last = F.when(F.endswith(r, F.lit("ˊ")), "2").when(F.endswith(r, F.lit("ˇ")), "3").when(F.endswith(r, F.lit("ˋ")), "4")
    base = F.when(F.startswith(r, F.lit("˙")), F.substring(r, F.lit(2), F.length(r))).when(last.isNotNull(), F.substring(r, F.lit(1), F.length(r) - 1)).otherwise(r)
    return F.struct(base.alias("base"), F.when(F.startswith(r, F.lit("˙")), "neutral").otherwise(F.coalesce(last, F.lit("1"))).alias("tone"))


def with_tone(base: Column, tone: Column) -> Column:
    """The other way: the syllable of a base and its tone."""
    mark = F.when(tone == "2", "ˊ").when(tone == "3", "ˇ").when(tone == "4", "ˋ").otherwise("")
    return F.when(tone == "neutral", F.concat(F.lit("˙"), base)).otherwise(F.concat(base, mark))


def annotated_readings(value: Column) -> Column:
    """Readings of a dictionary cell, distinct and in order; a part may carry the note 語 or 讀 beside its one reading."""
    parts = F.split(F.coalesce(value, F.lit("")), "[;；]")

    def one(part: Column) -> Column:
        plain = comparator_reading(part)
        found = F.regexp_extract_all(part, F.lit(f"([{LETTERS}{TONES}]+)"), F.lit(1))
        rest = F.regexp_replace(F.regexp_replace(part, f"[{LETTERS}{TONES}]+", ""), "^[ \t\r\n\"'「」『』()（）]+|[ \t\r\n\"'「」『』()（）]+$", "")
        noted = (F.size(found) == 1) & rest.isin("語", "讀")
        return F.when(plain != "", plain).when(noted, F.get(found, F.lit(0))).otherwise("")

    return F.array_distinct(F.filter(F.transform(parts, one), lambda r: r != ""))


def reading_at(word: Column, primary: Column, index: Column, char: Column) -> Column:
    """The reading at a character's place in a word, null unless word and readings fit each other there."""
    fits = (F.length(word) == F.size(primary)) & (index >= 0) & (F.substring(word, index + 1, F.lit(1)) == char)
    return F.when(fits, F.get(primary, index))


def handbook_readings(cell: Column) -> Column:
    """The readings in a handbook's cell, in order, with a neutral tone moved to the front."""
    clean = F.translate(F.coalesce(cell, F.lit("")), "一厶", "ㄧㄙ")
    found = F.regexp_extract_all(clean, F.lit("([\\x{3105}-\\x{312F}]+[˙ˊˇˋ]?)"), F.lit(1))
    return F.transform(found, lambda r: F.when(F.endswith(r, F.lit("˙")), F.concat(F.lit("˙"), F.substring(r, F.lit(1), F.length(r) - 1))).otherwise(r))


def handbook_phrase(cell: Column) -> Column:
    """A handbook's phrase: no quotes, no white space, nothing from the first stop on."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), "[「」【】]", ""), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[。；;，,：:].*$", ""), "^[、/ ]+|[、/ ]+$", "")


def phrase_target(line: Column, pos: Column, phrase: Column, char: Column) -> Column:
    """Where in a phrase the target lies, null if that is not certain.

    The one place at which the phrase stands over the target in the line, else the
    only place of the character in the phrase.
    """
    within = F.sequence(F.lit(0), F.greatest(F.length(phrase) - 1, F.lit(0)))
    same = lambda r: F.substring(phrase, r + 1, F.lit(1)) == char
    over = F.filter(within, lambda r: same(r) & (pos >= r) & (F.substring(line, pos - r + 1, F.length(phrase)) == phrase))
    only = F.filter(within, same)
    return F.when(F.size(over) == 1, F.get(over, F.lit(0))).when(F.size(only) == 1, F.get(only, F.lit(0)))


def made_id(prefix: str, **fields: Column) -> Column:
    """An id from named fields: a prefix and the SHA-256 of their JSON in alphabetical order."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.concat(F.lit(prefix), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("pos", IntegerType())]))
def nfkc_context(text: pd.Series, pos: pd.Series) -> pd.DataFrame:
    """A line in compatibility form without white space and variation selectors, and where the target is then."""

    def one(line: object, at: object) -> tuple[str, int | None]:
        if not isinstance(line, str):
            return "", None
        out, place, moved = [], None if pd.isna(at) else int(at), None
        for k, c in enumerate(line):
            form = unicodedata.normalize("NFKC", c)
            if 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or form.isspace():
                continue
            if k == place:
                moved = len(out)
            out.extend(form)
        return "".join(out), moved

    rows = [one(t, p) for t, p in zip(text, pos, strict=True)]
    return pd.DataFrame({"text": [r[0] for r in rows], "pos": pd.array([r[1] for r in rows], dtype="Int32")})
