"""Word hashes against words made to collide, and what a word cache may hold."""

from __future__ import annotations

import random
import sys

import numpy as np
import public_tokenizers

from lanewise.llm import pretoken, substring

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def folded(n, a="a", b="b"):
    """A word of 2**n letters and the one with its letters exchanged: sums of powers modulo 2**64 don't tell them apart."""
    word = a
    for _ in range(n):
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


def plain(rows):
    seen, want = set(), []
    for i, t in rows:
        w = t.split()
        own = [" ".join(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + j for k, s in enumerate(own) if s in seen for j in range(50)}
        seen.update(own)
        want.append((i, len(w), len(gone)))
    return want


def test_words_that_differ_are_not_removed(spark):
    rng = random.Random(3)
    same = [f"w{k}" for k in range(49)]
    rows = []
    for n in (6, 10, 11):
        for word in folded(n):
            rows.append((len(rows), " ".join([*same[:20], word, *same[20:]])))
    pairs = [w for n in (6, 10) for w in folded(n, "x", "y")]
    rows += [(len(rows) + k, " ".join(rng.choice(pairs) for _ in range(55))) for k in range(12)]
    rows += [(100, rows[2][1]), (101, rows[7][1])]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == plain(rows)


def test_word_hashes():
    words = [b"a" * k for k in range(1, 40)] + [b"a" * k + b"\x00" for k in range(1, 20)] + [w.encode() for n in (3, 6, 10, 12) for w in folded(n)]
    words += [b"12345678" + b"abcdefgh", b"abcdefgh" + b"12345678"]
    text = b"  ".join(words)
    for which in (0, 1):
        got = substring.word_hashes(text, which)
        assert len(got) == len(words) == len(np.unique(got))
        assert (got == np.concatenate([substring.word_hashes(w, which) for w in words])).all()
    assert not (substring.word_hashes(text, 0) == substring.word_hashes(text, 1)).any() and len(substring.word_hashes(b" ")) == 0


def test_cache_is_bounded_in_bytes():
    table = pretoken.Lookup(VOCABULARY, pretoken.id_bytes, most_bytes=200_000)
    rng = random.Random(4)
    biggest = 0
    for _ in range(150):
        long = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(3_000))
        short = " ".join("".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(200))
        text = f"{long} {short}"
        assert table.of(text, b"".join) == pretoken.id_bytes(table.vocabulary.ids(text))
        held = [*table.held.items(), *table.held.before.items()]
        biggest = max(biggest, sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for k, v in held))
        assert max(len(k) for k, _ in held) <= pretoken.LONGEST
    assert 200_000 < biggest < 500_000
