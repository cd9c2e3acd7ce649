"""Every registered query on a small folder: exact columns, types and rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lanewise.llm import decontaminate, langid, registry, urlfilter

from .brute import divergence_rows, manifest_rows, secret_rows
from .test_llm import best_fit, brute_bytes, brute_print, brute_rule, components, edit_distance_inside, words

SCHEMAS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    "op2_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_suffix_array": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_decontaminate": "doc_id bigint, item_id bigint, distance int, end_char bigint, short boolean",
    "op10_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_live bigint, n_example bigint",
    "op13_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    out = [words(rng, rng.randint(1, 120)) for _ in range(50)]
    passage = words(rng, 60)
    out += [f"{words(rng, 15)} {passage} {words(rng, 15)}" for _ in range(5)] + [out[3], out[3], passage, words(rng, 1500)]
    out += [None, "", " \n", "½ ² Ⅷ ①", "12 34", "Größe und Maß", "a  b\n c <|endoftext|> d"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def items(texts):
    return [(1, texts[5][1]), (2, texts[6][1][:60]), (3, "never said anywhere in these texts at all"), (4, None)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in base[k % 12] + rng.normal(size=16) * 0.03], "ab"[k % 2]) for k in range(60)]
    return rows + [(100, rows[0][1], None), (101, None, "a"), (102, [0.0] * 16, "a"), (103, rows[0][1], "a")]


@pytest.fixture(scope="module")
def pages():
    urls = ["http://org/x", "https://www.Example.org/es/1", "http://example.org/en/12", "http://a.com/fr/", "http://com/de/?q", "http://org\x01x/a", None, "none", "http://x.net"]
    return [(k, urls[k % len(urls)], [None, "short", "<p>é</p>" * 20, f"page {k} " * 20][k % 4]) for k in range(40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts, items, vectors, pages):
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], "src", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string").repartition(2).write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="module")
def run(spark, folder):
    def rows(name):
        found = registry.QUERIES[name](spark, folder)
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == SCHEMAS[name]
        return [tuple(r) for r in found.collect()]

    return rows


def test_every_query_is_covered():
    assert set(SCHEMAS) == set(registry.QUERIES)


def plain_score(model, text):
    """Class probabilities counted n-gram by n-gram, as the method is described."""
    raw = bytes(langid.letters(text))
    total, n = np.zeros(len(model.languages)), 0
    for order in langid.ORDERS:
        for k in range(len(raw) - order + 1):
            code = 0
            for b in raw[k : k + order]:
                code = (code * 257 + b) % 2**64
            bucket = ((code + order) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - model.bits)
            total += model.scores[:, bucket]
            n += 1
    return langid.softmax((total / max(n, 1) + model.bias) / model.temperature)


def test_op1(spark, folder, run, texts):
    model = langid.train(langid.sample(spark.read.parquet(f"{folder}/documents.parquet")))
    got = {r[0]: r for r in run("op1_language_id")}
    assert len(got) == len(texts)
    for i, text in texts:
        _, held, lang, score, rejected = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score, rejected) == ("und", 0.0, True)
        else:
            p = plain_score(model, text)
            assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max(), rel=1e-4) and rejected == (score < model.threshold)


def test_op2(run, vectors):
    good = [(i, np.array(v), y) for i, v, y in vectors if y and v and any(v)]
    linked = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    label = components([r[0] for r in vectors], linked)
    assert sorted(run("op2_embeddings")) == [(i, sum(i in p for p in linked), label[i], label[i] == i) for i, _, _ in vectors] and linked


def test_op3(run, texts):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: coder.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    places, pieces = {}, {}
    got = run("op3_packing")
    for doc_id, piece, start, length, crc, sequence, offset in got:
        assert crc == zlib.crc32(np.array(ids[doc_id][start : start + length], "<u4").tobytes())
        places.setdefault(sequence, []).append((offset, length))
        pieces.setdefault(doc_id, []).append((piece, start, length))
    for i, x in ids.items():
        n = -(-len(x) // 1024)
        first = len(x) - 1024 * (n - 1)
        assert sorted(pieces[i]) == [(k, 0 if k == 0 else first + 1024 * (k - 1), first if k == 0 else 1024) for k in range(n)]
    for held in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)])]
        assert [at for at, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024
    assert len(places) == best_fit([r[3] for r in got], 1024)


def test_op4(run, pages):
    first = {}
    for i, _, html in pages:
        first.setdefault(html or "", i)
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        response = len(raw) < 100 or first[html or ""] == i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if response else "revisit", None if response else first[html or ""]))
    assert sorted(run("op4_warc")) == want and any(w[3] == "revisit" for w in want)


def test_op5(run, texts):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in texts}
    assert sorted(run("op5_token_counts")) == [(i, len((t or "").encode()), n[i], n[i] > 1024) for i, t in texts]


def test_op6(run, texts):
    prints = {i: brute_print(t) for i, t in texts}
    label = components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(run("op6_simhash")) == [(i, f"{prints[i]:016x}", label[i]) for i, _ in texts]


def test_op7(run, texts):
    want = brute_bytes(texts)
    assert sorted(run("op7_suffix_array")) == [(i, *want[i][:3], hashlib.sha256(want[i][3]).hexdigest()) for i, _ in texts]
    assert sum(w[1] for w in want.values()) > 1000


def test_op8(run, texts):
    seen, want = set(), []
    for i, t in texts:
        w = (t or "").encode().split()
        own = [b" ".join(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + j for k, s in enumerate(own) if s in seen for j in range(50)}
        seen.update(own)
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert sorted(run("op8_substring")) == want and any(w[2] for w in want)


def test_op9(run, texts, items):
    want = set()
    for i, t in texts:
        for k, item in items:
            x, y = decontaminate.normal(item or ""), decontaminate.normal(t or "")
            if x and y and (d := edit_distance_inside(x, y)) <= int(0.05 * len(x)):
                want.add((i, k, d, len(x) < 25))
    assert {(r[0], r[1], r[2], r[4]) for r in run("op9_decontaminate")} == want and len(want) > 1


def test_op10(run, pages):
    want = []
    for i, url, _ in pages:
        host, path, rule = brute_rule(url, urlfilter.RULES)
        want.append((i, host, path, rule.text if rule else None, rule.verdict if rule else "allow"))
    assert sorted(run("op10_url_filters")) == want


def document_rows(texts):
    return [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], "src", len(t or "")) for i, t in texts]


def test_op11(run, texts):
    want = divergence_rows([(lang, source, t) for _, t, lang, source, _ in document_rows(texts)], 30, 50)
    assert sorted(run("op11_divergence")) == sorted(want)


def test_op12(run, texts):
    assert sorted(run("op12_secrets")) == sorted(secret_rows([(i, t, source, f"{source}/{lang or ''}") for i, t, lang, source, _ in document_rows(texts)]))


def test_op13(run, texts):
    rows = [(i, source, lang, n, t) for i, t, lang, source, n in document_rows(texts)]
    now = {i: t.replace("\n", "") for i, t in texts if t and zlib.crc32(str(i).encode()) % 2 == 0}
    want = manifest_rows(rows, now)
    assert sorted(run("op13_manifest")) == sorted(want) and any(not r[-1] for r in want)
