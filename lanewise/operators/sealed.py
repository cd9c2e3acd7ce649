"""Documents that prove themselves, evidence that can stand, and drift between two lanes' tables.

JSON is read strictly: a key that occurs twice in one object, at any depth, is named with
its path. A document is sealed by the hash of its canonical form without the seal: keys
sorted, no spaces, text as it is. Each check gives rows, one for each fault.

Cases: null documents are ``invalid``; what isn't JSON is ``invalid`` and nothing else; repeated
rows give repeated faults; ids on one side alone are faults of their own; empty tables
give none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import scalars

# The seal's key, and the kinds and state of contested glyphs.
SEAL = "manifest_integrity_sha256"
CONTESTED_KINDS = ("TTF_GLYF_SHA256", "CFF_GLYPH_SHA256")
CONTESTED_STATE = "GLYPH_TRUTH_CONFLICT"
EXACT_LEVEL = "VERIFIED_EXACT_GLYPH"
EXCLUDED_STATE, EXCLUDED_VIEW = "EXCLUDED_OUT_OF_SCOPE", "結構偵測排除"

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]')


def repeated_keys(text: str) -> list[tuple[str, str, int]]:
    """``(path of the object, key, depth)`` of each key of valid JSON that its object had before."""
    found, open_ = [], []  # of each open container: its path, its keys (None for a list), the key or index it is at
    wants_key = False
    for token in _TOKENS.findall(text):
        if token in "{[":
            path = "$"
            if open_:
                above, keys, at = open_[-1]
                path = f"{above}[{at}]" if keys is None else f"{above}.{at}"
            open_.append([path, set() if token == "{" else None, 0])
            wants_key = token == "{"
        elif token in "}]":
            open_.pop()
            wants_key = False
        elif token == ",":
            wants_key = open_[-1][1] is not None
            if not wants_key:
                open_[-1][2] += 1
        elif token != ":" and wants_key:
            top, key = open_[-1], json.loads(token)
            if key in top[1]:
                found.append((top[0], key, len(open_)))
            top[1].add(key)
            top[2], wants_key = key, False
    return found


_FAULTS = ArrayType(StructType([StructField("fault", StringType()), StructField("path", StringType()), StructField("name", StringType()), StructField("depth", IntegerType())]))
_FAULT = pa.list_(pa.struct([("fault", pa.string()), ("path", pa.string()), ("name", pa.string()), ("depth", pa.int32())]))


@F.arrow_udf(_FAULTS)
def _json_faults(texts: pa.Array) -> pa.Array:
    def of(text: str | None) -> list[dict]:
        try:
            json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return [{"fault": "invalid", "path": None, "name": None, "depth": None}]
        return [{"fault": "repeated_key", "path": p, "name": k, "depth": d} for p, k, d in repeated_keys(text)]

    return pa.array([of(t) for t in texts.to_pylist()], _FAULT)


def json_faults(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, fault, path, name, depth`` of documents that aren't JSON or repeat a key."""
    return rows.select(key, F.explode(_json_faults(column)).alias("f")).select(key, "f.*")


@F.arrow_udf(StructType([StructField("stated", StringType()), StructField("computed", StringType())]))
def _seals(texts: pa.Array) -> pa.Array:
    def of(text: str | None) -> dict:
        try:
            document = json.loads(text)
            stated = str(document.pop(SEAL, None) or "")
        except (TypeError, ValueError, AttributeError, RecursionError):
            return {"stated": None, "computed": None}
        raw = json.dumps(document, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return {"stated": stated, "computed": hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()}

    return pa.array([of(t) for t in texts.to_pylist()], pa.struct([("stated", pa.string()), ("computed", pa.string())]))


def seal_faults(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, fault, computed`` of documents whose seal is missing or isn't the hash of the rest.

    A document that isn't an object or repeats a key is ``invalid``: its hash would say nothing.
    """
    read = rows.select(key, _seals(column).alias("s"), (F.size(_json_faults(column)) > 0).alias("bad"))
    fault = F.when(F.col("bad") | F.col("s.computed").isNull(), "invalid").when(F.col("s.stated") == "", "missing_seal").when(F.col("s.stated") != F.col("s.computed"), "changed")
    return read.select(key, fault.alias("fault"), F.when(fault != "invalid", F.col("s.computed")).alias("computed")).filter("fault IS NOT NULL")


def drift(left: DataFrame, right: DataFrame, key: str, fields: Mapping[str, Column | None]) -> DataFrame:
    """``key, field, was, now``: where two tables of one key differ, field by field.

    ``fields`` names what is compared; a column given for a name says where: rows of
    ``left`` for which it is false are passed over for that field. A key on one side alone is a row
    with field ``missing`` or ``unknown``. Keys are unique on either side.
    """
    a = left.select(key, F.lit(True).alias("_a"), *(F.col(f).cast("string").alias(f"a_{f}") for f in fields), *((F.lit(True) if w is None else w).alias(f"w_{f}") for f, w in fields.items()))
    b = right.select(key, F.lit(True).alias("_b"), *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    row = lambda field, was, now: F.struct(F.lit(field).alias("field"), was.alias("was"), now.alias("now"))
    none = F.lit(None).cast("string")
    differs = [F.when(F.coalesce(F.col(f"w_{f}"), F.lit(False)) & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), row(f, F.col(f"a_{f}"), F.col(f"b_{f}"))) for f in fields]
    faults = F.when(F.col("_b").isNull(), F.array(row("missing", none, none))).when(F.col("_a").isNull(), F.array(row("unknown", none, none))).otherwise(F.array_compact(F.array(*differs)))
    return a.join(b, key, "full").select(key, F.explode(faults).alias("f")).select(key, "f.*")


def lane_drift(source: DataFrame, entries: DataFrame, geometry: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Where ledger entries no longer say what their source rows say.

    ``source``: ``occurrence_id, kind, review_id, actual, actual_evidence, exclusion_reason`` and
    the geometry; ``entries`` besides these but ``kind``: ``state, source_view``. Readings are
    compared in canonical form. A row excluded by structure must still be an entry of that
    state and view, with its reason; the others keep reading and evidence.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    read = F.col("kind") == "actual"
    was = source.withColumns({"actual": scalars.canonical_readings("actual"), "actual_evidence": blank("actual_evidence"), "exclusion_reason": blank("exclusion_reason"), "state": F.lit(EXCLUDED_STATE), "source_view": F.lit(EXCLUDED_VIEW)})
    now = entries.withColumns({"actual": scalars.canonical_readings("actual"), "actual_evidence": blank("actual_evidence"), "exclusion_reason": blank("exclusion_reason")})
    fields = {"review_id": None, "actual": read, "actual_evidence": read, "state": ~read, "source_view": ~read, "exclusion_reason": ~read} | dict.fromkeys(geometry)
    return drift(was, now, "occurrence_id", fields)


_SHA = "^[0-9a-f]{64}$"


def evidence_faults(rows: DataFrame, key: str) -> DataFrame:
    """``key, fault`` of evidence rows that can't stand.

    ``rows``: ``kind`` (override, glyf, cff, conflict), ``reading, verification_level, glyph_sha256,
    style_group, conflict_kind, status, readings``. A reading that is given must be one; exact glyphs
    need their full key; a conflict needs its kind, hash, state and two different readings.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kind, sha = F.col("kind"), F.lower(text("glyph_sha256"))
    exact = F.col("verification_level") == EXACT_LEVEL
    told = F.filter(F.array_distinct(F.transform(F.split(text("readings"), r"\|"), scalars.comparator_reading)), lambda r: r != "")
    conflict = kind == "conflict"
    faults = {
        "reading": (kind != "conflict") & (text("reading") != "") & (scalars.canonical_readings("reading") == ""),
        "glyph_sha256": (kind == "glyf") & exact & (F.length(F.coalesce("glyph_sha256", F.lit(""))) != 64),
        "exact_key": (kind == "cff") & exact & ((text("style_group") == "") | ~sha.rlike(_SHA)),
        "conflict_kind": conflict & ~text("conflict_kind").isin(*CONTESTED_KINDS),
        "conflict_sha256": conflict & ~sha.rlike(_SHA),
        "conflict_status": conflict & (text("status") != CONTESTED_STATE),
        "conflict_readings": conflict & (F.size(told) < 2),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in faults.items())))
    return rows.select(key, F.explode(found).alias("fault"))
