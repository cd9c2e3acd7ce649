"""The actual lane: readings decoded from tabular glyph traces.

Input is one row per drawn glyph. Layers are dropped and merged first, then each
(font, component) is looked up through layered maps, exceptions for single places
are applied by tolerance joins, and a key counts as decoded only if all of its
occurrences agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import keyed
from .matching import is_small

# Tolerances of the place overrides, in points.
NEAR, NEAR_OTHER_KEY, NEAR_CONTEXT = 0.8, 0.15, 1.0
SHIFTED = 500


def visible_layer(traces: DataFrame) -> DataFrame:
    """Of glyphs drawn on one another the visible one: not white, most opaque, drawn last; ties to the first.

    Needs ``page, codepoint, x0, y0, x1, y1, nonwhite, opacity, seqno, ordinal``.
    """
    boxes = [F.bround(c, 0).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    rows = traces.select("*", *boxes, (-F.col("ordinal")).alias("_first"))
    kept = keyed.argmax_dedupe(rows, ["pdf_sha256", "page", "codepoint", "_x0", "_y0", "_x1", "_y1"], ["nonwhite", "opacity", "seqno", "_first"])
    return kept.select(*traces.columns)


def main_and_annotation(components: Column) -> Column:
    """The unshifted and the shifted component of a composite glyph, null unless exactly one is shifted."""
    far = F.filter(components, lambda c: F.abs(c["x"]) >= SHIFTED)
    near = F.filter(components, lambda c: F.abs(c["x"]) < SHIFTED)
    return F.when((F.size(far) == 1) & (F.size(near) >= 1), F.struct(near[0]["gid"].alias("main"), far[0]["gid"].alias("annotation")))


def font_groups(fonts: DataFrame, groups: DataFrame) -> DataFrame:
    """``font, font_group``: the first pattern in file order that a font name matches.

    ``groups``: ``group_id, font_regex, file_order``; a pattern list is small, and a
    longer one than fits a broadcast is refused.
    """
    if not is_small(groups):
        raise ValueError("too many font patterns to test each font with each")
    hits = fonts.select("font").distinct().join(F.broadcast(groups), F.expr("regexp_like(font, concat('(?i)', font_regex))"))
    return hits.groupBy("font").agg(F.min_by("group_id", "file_order").alias("font_group"))


def gated_transforms(transforms: DataFrame, exact: DataFrame) -> DataFrame:
    """Transforms that hold: marked safe, and their source still maps to the same reading.

    Gives ``font, component_id, target_sha, reading``.
    """
    safe = transforms.filter("confidence = 'safe' AND size(target_shas) > 0")
    source = exact.select(F.col("font").alias("source_font"), F.col("component_id").alias("source_component_id"), F.col("reading").alias("source_reading"))
    held = safe.join(source, ["source_font", "source_component_id"]).filter("source_reading = reading")
    return held.select(F.col("target_font").alias("font"), F.col("target_component_id").alias("component_id"), F.explode("target_shas").alias("glyph_sha"), "reading")


def decode(glyphs: DataFrame, exact: DataFrame, groups: DataFrame, page_overrides: DataFrame, corrections: DataFrame, transforms: DataFrame, outlines: DataFrame) -> DataFrame:
    """Adds ``actual`` and ``basis`` by the first layer that knows the glyph.

    Layers: page override, corrections bound to the glyph's hash, exact map, font
    group map (unanimous), gated transforms, outline signatures (unanimous).
    """
    grouped = glyphs.join(font_groups(glyphs, groups), "font", "left")
    members = exact.join(font_groups(exact, groups), "font")
    layers = [
        ("page_override", page_overrides, ["pdf_sha256", "page", "font_xref", "component_id"], "reading"),
        ("correction", corrections, ["font", "component_id", "glyph_sha"], "reading"),
        ("exact", exact, ["font", "component_id"], "reading"),
        ("font_group", members.filter("font_group IS NOT NULL"), ["font_group", "component_id"], "reading"),
        ("transform", gated_transforms(transforms, exact), ["font", "component_id", "glyph_sha"], "reading"),
        ("outline", outlines, ["outline_signature"], "reading"),
    ]
    return keyed.first_hit(grouped, layers, "actual")


def near_place(rows: DataFrame, overrides: DataFrame, tolerance: float, keys: list[str], tight: Column | None = None) -> DataFrame:
    """The first override in file order within ``tolerance`` of each row's corner.

    Rows and overrides meet on ``keys`` and a cell of both coordinates; the
    override side is copied to the neighbouring cells. ``tight`` narrows matches.
    Gives ``occurrence_id`` and the override's other columns.
    """
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    spread = overrides.withColumnRenamed("x0", "ox").withColumnRenamed("y0", "oy").withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.withColumn("_cx", cell("ox") + F.col("_dx")).withColumn("_cy", cell("oy") + F.col("_dy")).drop("_dx", "_dy")
    own = rows.select("occurrence_id", *keys, "x0", "y0", F.col("stable_key").alias("own_key")).withColumn("_cx", cell("x0")).withColumn("_cy", cell("y0"))
    near = own.join(spread, [*keys, "_cx", "_cy"]).filter((F.abs(F.col("x0") - F.col("ox")) <= tolerance) & (F.abs(F.col("y0") - F.col("oy")) <= tolerance))
    if tight is not None:
        near = near.filter(tight)
    values = [c for c in overrides.columns if c not in (*keys, "x0", "y0")]
    best = near.groupBy("occurrence_id").agg(F.min_by(F.struct(*values), "file_order").alias("_o"))
    return best.select("occurrence_id", *(F.col(f"_o.{c}").alias(c) for c in values))


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Place overrides last: the override's reading wins, the automatic one is kept beside it.

    An override of another stable key must lie within the narrower tolerance.
    """
    tight = (F.col("stable_key") == F.col("own_key")) | ((F.abs(F.col("x0") - F.col("ox")) <= NEAR_OTHER_KEY) & (F.abs(F.col("y0") - F.col("oy")) <= NEAR_OTHER_KEY))
    hit = near_place(rows, overrides, NEAR, ["pdf_sha256", "page", "char"], tight).select("occurrence_id", F.col("reading").alias("_r"))
    out = rows.join(hit, "occurrence_id", "left").withColumn("automatic", F.col("actual"))
    return out.withColumn("basis", F.when(F.col("_r").isNotNull(), "override").otherwise(F.col("basis"))).withColumn("actual", F.coalesce("_r", "actual")).drop("_r")


def override_characters(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Characters that a place override corrects; the one in the text layer is kept as ``original_char``.

    ``overrides``: ``pdf_sha256, page, char, x0, y0, corrected_char, stable_key, file_order``.
    """
    hit = near_place(rows, overrides, NEAR, ["pdf_sha256", "page", "char"]).select("occurrence_id", F.col("corrected_char").alias("_c"))
    out = rows.join(hit, "occurrence_id", "left").withColumn("original_char", F.when(F.col("_c").isNotNull(), F.col("char")))
    return out.withColumn("char", F.coalesce("_c", "char")).drop("_c")


def override_contexts(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lines and positions that a place override repairs, marked by ``context_repaired``.

    The first override within the tolerance counts; it is ignored if its own position
    doesn't hold the row's character. ``overrides``: ``pdf_sha256, page, char, x0, y0,
    context_text, target_index, stable_key, file_order``.
    """
    hit = near_place(rows, overrides, NEAR_CONTEXT, ["pdf_sha256", "page", "char"]).select("occurrence_id", F.col("context_text").alias("_t"), F.col("target_index").alias("_i"))
    out = rows.join(hit, "occurrence_id", "left")
    good = F.coalesce((F.col("_i") >= 0) & (F.substring("_t", F.col("_i") + 1, F.lit(1)) == F.col("char")), F.lit(False))
    out = out.withColumn("context_repaired", good)
    return out.withColumns({"line": F.when(good, F.col("_t")).otherwise(F.col("line")), "pos": F.when(good, F.col("_i")).otherwise(F.col("pos"))}).drop("_t", "_i")


def located_blocks(rows: DataFrame, chars: DataFrame, near_tie: float = 1.0) -> DataFrame:
    """The text block of each row: that of the nearest equal character on the page.

    Distances are dx² + 4 dy² of the centres. Characters at most ``near_tie`` beyond the
    nearest are as near; of these the one in the longest block is taken, then the nearer,
    then the first. ``rows``: ``occurrence_id, pdf_sha256, page, char, cx, cy`` and, if a
    character was corrected, ``original_char``; ``chars``: ``pdf_sha256, page, char, cx, cy,
    block_no, char_no, text``. Rows meet the characters of one page only.
    """
    sought = F.coalesce("original_char", "char") if "original_char" in rows.columns else F.col("char")
    own = rows.select("occurrence_id", "pdf_sha256", "page", sought.alias("char"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    d = F.pow(F.col("cx") - F.col("_x"), 2) + 4 * F.pow(F.col("cy") - F.col("_y"), 2)
    near = own.join(chars, ["pdf_sha256", "page", "char"]).withColumn("d", d)
    best = near.groupBy("occurrence_id").agg(F.min("d").alias("_best"))
    tied = near.join(best, "occurrence_id").filter(F.col("d") <= F.col("_best") + near_tie)
    first = F.min(F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("n"), "d", "block_no", "char_no", "text"))
    return tied.groupBy("occurrence_id").agg(first.alias("_b")).select("occurrence_id", "_b.block_no", "_b.char_no", "_b.text", F.col("_b.d").alias("distance"))


def split_excluded(rows: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and those at an excluded structure, each in its own table."""
    keys = ["pdf_sha256", "page", "char", "font_xref", "font", "glyph_id", "component_id"]
    hit = near_place(rows, exclusions.withColumn("reason", F.coalesce("reason", F.lit(""))), NEAR, keys).select("occurrence_id", "reason")
    return rows.join(hit, "occurrence_id", "left_anti"), rows.join(hit, "occurrence_id")


def hidden_duplicates(rows: DataFrame) -> DataFrame:
    """One row per place: all alike keep the last; else the one in the visible font, if it is one; else all.

    Needs ``visible_font`` beside the rows.
    """
    keys = ["pdf_sha256", "page", "char", "_bx", "_by"]
    boxed = rows.withColumn("_bx", F.bround("x0", 1)).withColumn("_by", F.bround("y0", 1))
    same = F.struct("actual", "font")
    seen = boxed.groupBy(*keys).agg((F.min(same) == F.max(same)).alias("_one"), F.max("source_row_number").alias("_last"), F.count_if(F.col("font") == F.col("visible_font")).alias("_vis"))
    kept = boxed.join(seen, keys).filter(F.when(F.col("_one"), F.col("source_row_number") == F.col("_last")).when(F.col("_vis") == 1, F.coalesce(F.col("font") == F.col("visible_font"), F.lit(False))).otherwise(True))
    return kept.select(*rows.columns)


def promoted_keys(rows: DataFrame) -> DataFrame:
    """Stable keys of which every occurrence is decoded, and to one reading."""
    return keyed.promote_if_all_equal(rows, ["stable_key"], "actual")


def decode_signatures(glyphs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Glyphs all of whose outline signatures are known: their symbols in order, then the tone.

    ``glyphs``: ``occurrence_id, style_group, signatures array, tone``; ``symbols``:
    ``style_group, signature, symbol``.
    """
    known = keyed.unanimous(symbols, ["style_group", "signature"], "symbol").filter("resolved IS NOT NULL").select("style_group", "signature", "resolved")
    parts = glyphs.select("occurrence_id", "style_group", "tone", F.size("signatures").alias("_n"), F.posexplode("signatures").alias("i", "signature")).join(known, ["style_group", "signature"])
    found = parts.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"), F.max("tone").alias("tone"), F.array_sort(F.collect_list(F.struct("i", "resolved"))).alias("_s"))
    body = F.array_join(F.transform("_s", lambda x: x["resolved"]), "")
    tone = F.coalesce("tone", F.lit(""))
    return found.filter("_k = _n").select("occurrence_id", F.when(tone == "˙", F.concat(tone, body)).otherwise(F.concat(body, tone)).alias("reading"))


def accepted_signatures(evidence: DataFrame, least_glyphs: int = 2, least_support: int = 2) -> DataFrame:
    """Signature labels of unseen families with one label and enough support.

    ``evidence``: ``family, signature, symbol, glyph_id, support``. Labels that are
    unanimous over all families go to families that use the signature without one.
    """
    facts = evidence.groupBy("family", "signature").agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi"), F.count_distinct("glyph_id").alias("g"), F.max("support").alias("s"))
    own = facts.filter((F.col("lo") == F.col("hi")) & ((F.col("g") >= least_glyphs) | (F.col("s") >= least_support))).select("family", "signature", F.col("lo").alias("symbol"))
    shared = keyed.unanimous(own, ["signature"], "symbol").filter("resolved IS NOT NULL").select("signature", F.col("resolved").alias("shared"))
    used = evidence.select("family", "signature").distinct().join(own, ["family", "signature"], "left").join(shared, "signature", "left")
    basis = F.when(F.col("symbol").isNotNull(), "own").when(F.col("shared").isNotNull(), "propagated").otherwise("none")
    return used.select("family", "signature", F.coalesce("symbol", "shared").alias("symbol"), basis.alias("basis"))


def template_support(events: DataFrame, purity: float = 0.995, support: int = 2) -> DataFrame:
    """Shape templates: the symbol of a signature that holds nearly all of its events."""
    counts = events.groupBy("signature", "symbol").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("signature").agg(F.sum("n").alias("total"), F.max(F.struct("n", "symbol")).alias("top"))
    share = F.col("top.n") / F.col("total")
    return total.filter((share >= purity) & (F.col("top.n") >= support)).select("signature", F.col("top.symbol").alias("symbol"), F.col("top.n").alias("support"), share.alias("purity"))


def key_summary(rows: DataFrame, most: int = 20) -> DataFrame:
    """Per stable key: occurrences, the first distinct characters, decoded and not."""
    chars = keyed.rollup(rows, ["stable_key"], "char", "source_row_number", most)
    facts = rows.groupBy("stable_key").agg(F.count("actual").alias("decoded"), F.count_if(F.col("actual").isNull()).alias("undecoded"), F.array_sort(F.collect_set("page")).alias("pages"))
    return chars.join(facts, "stable_key").withColumnRenamed("firsts", "chars")


def printed_page(words: DataFrame) -> DataFrame:
    """The printed page number: a number in the outer foot margin, lowest first, then nearest the edge.

    ``words``: ``pdf_sha256, page, text, x0, x1, y0, width, height, label``; a page's
    label, where it has one, wins.
    """
    foot = F.col("text").rlike(r"^\d+$") & (F.col("y0") >= 0.88 * F.col("height")) & ((F.col("x0") <= 0.22 * F.col("width")) | (F.col("x1") >= 0.78 * F.col("width")))
    edge = -F.least(F.col("x0"), F.col("width") - F.col("x1"))
    best = words.groupBy("pdf_sha256", "page").agg(F.max(F.when(F.coalesce("label", F.lit("")) != "", F.col("label"))).alias("_l"), F.max(F.when(foot, F.struct("y0", edge.alias("e"), "text"))).alias("_f"))
    return best.select("pdf_sha256", "page", F.coalesce("_l", "_f.text").alias("printed_page"))


def visible_font(rows: DataFrame, chars: DataFrame, most: float = 9.0) -> DataFrame:
    """The font of the nearest text-layer character: same page and character, dx² + 4 dy² least and at most ``most``."""
    reach = most**0.5
    cell = lambda c: F.floor(F.col(c) / F.lit(reach))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    text = chars.select("pdf_sha256", "page", "char", F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("font").alias("visible_font")).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    text = text.withColumn("_x", cell("tx") + F.col("_dx")).withColumn("_y", cell("ty") + F.col("_dy"))
    own = rows.select("occurrence_id", "pdf_sha256", "page", "char", "cx", "cy").withColumn("_x", cell("cx")).withColumn("_y", cell("cy"))
    d = F.pow(F.col("cx") - F.col("tx"), 2) + 4 * F.pow(F.col("cy") - F.col("ty"), 2)
    near = own.join(text, ["pdf_sha256", "page", "char", "_x", "_y"]).withColumn("d", d).filter(F.col("d") <= most)
    return near.groupBy("occurrence_id").agg(F.min(F.struct("d", "visible_font")).alias("_m")).select("occurrence_id", "_m.visible_font", F.col("_m.d").alias("distance"))


def context(rows: DataFrame, radius: int = 14) -> DataFrame:
    """Each occurrence's neighbouring characters on its page, and its own place among them."""
    w = Window.partitionBy("pdf_sha256", "page").orderBy("ordinal")
    near = F.array_join(F.collect_list("char").over(w.rowsBetween(-radius, radius)), "")
    return rows.select("occurrence_id", near.alias("context"), F.least(F.row_number().over(w) - 1, F.lit(radius)).alias("context_pos"))
