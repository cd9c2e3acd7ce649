"""Every contract query against its SQL on the small tables."""

from __future__ import annotations

import decimal
import difflib
import glob
import math
import os
import unicodedata

import duckdb
import pytest

from lanewise.functions import scalars
from lanewise.plans import contract

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain_forms(duck):
    rows = duck.execute("SELECT conv_id, turn, text FROM conversations").fetchall()
    return [(c, t, unicodedata.normalize("NFKC", x or "").strip(), scalars.canonical_reading(x)) for c, t, x in rows]


def turns(duck):
    return duck.execute("SELECT a.conv_id, a.turn, a.text, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1").fetchall()


def plain_ratio(a, b):
    return round(difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() if a or b else 1.0, 6)


def plain_similarity(duck):
    return [(c, t, plain_ratio(a, b)) for c, t, a, b in turns(duck)]


def plain_opcodes(duck):
    out = []
    for c, t, a, b in turns(duck):
        steps = difflib.SequenceMatcher(None, (a or "").split(), (b or "").split(), autojunk=False).get_opcodes()
        out += [(c * 1000 + t, n, *step) for n, step in enumerate(steps) if step[0] != "equal"]
    return out


def plain_pairs(duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    out = []
    for conv in {r[0] for r in rows}:
        ask, reply = ([(t, x) for c, t, who, x in rows if c == conv and who == role] for role in ("user", "assistant"))
        scored = sorted(((-plain_ratio(a, b), i, j) for i, a in ask for j, b in reply if plain_ratio(a, b) >= 0.05))
        left, right = set(), set()
        for s, i, j in scored:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                out.append((str(conv), i, j, -s))
    return out


#: What SQL can't say, in plain Python.
PLAIN = {"nfkc_canonicalise": plain_forms, "sequence_similarity": plain_similarity, "sequence_opcodes": plain_opcodes, "greedy_page_pairing": plain_pairs}


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query(spark, duck, name):
    df = contract.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in contract.ORACLES:
        assert sorted(map(tuple, rows)) == sorted(PLAIN[name](duck)) and rows
        return
    cursor = duck.execute(contract.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in rows)
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cursor.fetchall())
    assert ours == theirs
