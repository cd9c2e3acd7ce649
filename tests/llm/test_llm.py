"""The ten operators and the pipeline against brute force on small fixtures.

The fixture holds nulls, empty and long texts, ties, repeated passages, exact and
near copies, and extra columns whose names the operators use inside.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lanewise.llm import decontaminate, embdedup, langid, packing, pretoken, repeats, simhash, substring, sufdedup, suffixarray, tokencount, urlfilter, warc
from lanewise.llm.common import Workspace, connected_components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ("rep", "fp", "key", "spans", "row", "n", "digest", "score", "rejected", "kept", "unit", "bucket", "n_bytes")


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 160)) for _ in range(60)]
    shared, long_one = words(rng, 70), words(rng, 5000)
    for k in range(12):
        texts.append(f"{words(rng, 20)} {shared} {words(rng, 20)}")
    texts += [texts[3]] * 4 + [texts[10] + " tail", "x" + texts[10][1:], long_one, long_one[:9000] + "!" + long_one[9000:], "ab " * 400, "ab " * 300]
    texts += ["", None, " \t\n", "one", "One", "añb çé ñ", "🙂" * 60, "1 2 3 <|endoftext|> 4", "a\x0bb\x0cc\u00a0d\u2003e", shared, None]
    for k in range(6):
        edited = texts[20].split()
        edited[k * 3 % len(edited)] = "zz"
        texts.append(" ".join(edited))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, rng_lang(i), "src0", len(t or "")) for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).select("*", *(F.lit(7).alias(c) for c in CLASHES))


def rng_lang(i):
    return None if i % 11 == 0 else ("en", "de")[i % 2]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (5, 6), (5, 6)]
    got = {r.node: r.component_id for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = components({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


# 1


def test_language_id(spark, docs, nothing):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(2, 60), "abcde" if i % 2 else "vwxyz"), ("en", "de")[i % 2]) for i in range(400)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !?", "de"), (503, "🙂", None), (504, "vwxyz " * 90_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.sample(df))
    got = {r.row.doc_id: r for r in langid.predictions(df, model, ["doc_id"]).collect()}
    unseen = [i for i, _, _ in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == ("en", "de")[i % 2] for i in unseen]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (500, 501, 502, 503))
    assert got[504].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].rejected for i in unseen) <= 2
    assert {r.lang_pred for r in langid.predictions(docs, langid.train([]), docs.columns).collect()} == {"und"}
    assert langid.predictions(nothing, model, nothing.columns).count() == 0 and langid.sample(nothing) == []


def test_language_scores_do_not_depend_on_spans(monkeypatch):
    model = langid.train([("abc abd " * 5, "a"), ("xyz xyw " * 5, "b")] * 20)
    text = words(random.Random(2), 400, "abcxyz")
    whole = model.logits(text)
    monkeypatch.setattr(langid, "_SCORE_SPAN", 100)
    assert np.allclose(whole, model.logits(text))


# 2


def vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 24))
    rows = []
    for k in range(300):
        v = base[k % 40] + rng.normal(size=24) * (0.02 if k % 3 else 0.15)
        rows.append((k, [float(x) for x in v], k % 40 % 3))
    rows += [(400 + k, rows[0][1], 0) for k in range(5)] + [(410, [2 * x for x in rows[0][1]], 0)]
    rows += [(420, None, 0), (421, [0.0] * 24, 0), (422, [1.0, None] * 12, 0), (423, [float("nan")] * 24, 0), (424, rows[0][1], None), (425, [], 0), (426, rows[0][1][:8], 0), (427, rows[0][1][:8], 0)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_groups(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("codes", F.lit(1))
    good = [(i, np.array(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    linked = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    label = components([r[0] for r in rows], linked)
    degree = {i: sum(i in p for p in linked) for i, _, _ in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.embedding_groups(df, block=block).collect()}
    assert got == {i: (degree[i], label[i], label[i] == i) for i, _, _ in rows}
    assert embdedup.embedding_groups(df.limit(0)).count() == 0


def test_large_and_small_finite_vectors_link(spark):
    a, b = [1e200, 1e200, 2e200], [1e200, 1.01e200, 2e200]
    df = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, [x * 1e-320 for x in (1.0, 1.0, 2.0)], "x"), (4, [0.0, 0.0, 0.0], "x")], "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embdedup.embedding_groups(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


@pytest.mark.parametrize("width", [16, 32, 64, 100, 384])
def test_recall_at_the_threshold(width):
    rng = np.random.default_rng(width)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, z = unit(rng.normal(size=(2000, width))), rng.normal(size=(2000, width))
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    for cosine in (0.98, 0.99):
        a, b = embdedup.codes(x), embdedup.codes(unit(cosine * x + np.sqrt(1 - cosine**2) * z))
        met = ((a[:, :, :1] == b) | (a == b[:, :, :1])).any(axis=(1, 2))
        assert met.mean() >= 0.999
    far = embdedup.codes(unit(rng.normal(size=(2000, width))))
    assert ((a[:, :, :1] == far) | (a == far[:, :, :1])).any(axis=(1, 2)).mean() < 0.1


def test_hadamard_is_orthogonal():
    h = embdedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


# 3 and 5


def true_ids(texts):
    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += room == capacity
        if room > n:
            insort(rooms, room - n)
    return bins


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 37, 1024])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        rows = packing.plan(histogram, capacity)
        held = {}
        for length, rank, count, first, each, offset in rows:
            for k in range(count):
                held.setdefault(first + k // each, []).append((offset + length * (k % each), length))
        assert sum(map(len, held.values())) == len(lengths)
        for places in held.values():
            end = 0
            for at, length in sorted(places):
                assert at == end
                end += length
            assert end <= capacity
        assert len(held) == best_fit(lengths, capacity)


def test_packing(docs, corpus, nothing):
    got = packing.pack(docs, VOCABULARY, capacity=64).collect()
    ids = {i: x + [2] for (i, _), x in zip(corpus, true_ids([t for _, t in corpus]), strict=True)}
    places, by_doc = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 64
    for i, x in ids.items():
        cut = sorted(by_doc[i])
        assert [c[0] for c in cut] == list(range(-(-len(x) // 64))) and all(c[2] == 64 for c in cut[1:]) and sum(c[2] for c in cut) == len(x)
    assert len(places) == best_fit([r.length for r in got], 64)
    assert packing.pack(nothing, VOCABULARY).count() == 0


def test_token_counts(docs, corpus, nothing):
    got = {r.doc_id: r for r in tokencount.token_counts(docs, VOCABULARY, limit=100).collect()}
    for (i, t), ids in zip(corpus, true_ids([t for _, t in corpus]), strict=True):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 100)
    assert tokencount.token_counts(nothing, VOCABULARY).count() == 0
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    pieces = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, path).collect()}
    assert pieces == {i: len(model.encode(t or "")) for i, t in corpus}


def coded_by_words(vocabulary, text):
    return [i for w in pretoken.words(text) for i in vocabulary.word_ids(w)]


def test_every_code_point_is_coded_as_the_library_codes_it():
    vocabulary = pretoken.opened(VOCABULARY)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)}x {chr(c)} {chr(c)}" for c in points]
    texts = [t for t in texts if vocabulary.exact(t)]
    assert len(texts) > 100_000
    assert [t for t, ids in zip(texts, true_ids(texts), strict=True) if coded_by_words(vocabulary, t) != ids] == []


def test_white_space_is_coded_as_the_library_codes_it():
    rng = random.Random(12)
    vocabulary = pretoken.opened(VOCABULARY)
    parts = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "\u200b", "ab", "Z", "é", "12", "'s", "!?", "_", "\u4e2d"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(30_000)] + ["", " ", "  ", " a ", "a  ", "\n ", " \n"]
    assert [t for t, ids in zip(texts, true_ids(texts), strict=True) if coded_by_words(vocabulary, t) != ids] == []


def test_coding_by_ranks_is_checked():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        model = json.load(f)["model"]
    assert pretoken.ranked_coder(tokenizer, model) is not None
    assert pretoken.ranked_coder(tokenizer, model | {"merges": model["merges"][1:] + model["merges"][:1]}) is None
    assert pretoken.ranked_coder(tokenizer, model | {"ignore_merges": True}) is None
    other = pretoken.opened(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.exact("plain text")


def test_cache_stays_bounded(monkeypatch):
    texts = [words(random.Random(k), 20) for k in range(30)] + [words(random.Random(99), 500)]
    first = {"tier": 1}
    table = pretoken.Lookup(VOCABULARY, len, first, most=50)
    monkeypatch.setattr(pretoken, "SLICE", 64)
    for text, ids in zip(texts, true_ids(texts), strict=True):
        assert table.of(text, sum) == len(ids)
        assert len(table.held) <= 50 + 64 and len(table.held.before) <= 50 + 64 and table.held["tier"] == 1


def test_frequent_words_are_those_of_all_parts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["x", "the", "of", "und", "w" * 40, f"rare{k}"]) for _ in range(60))) for k in range(90)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for fan in (2, 32):
        assert len(tokencount.frequent_words(Workspace(spark, "t"), df, most=3, fan=fan)) == 3
        got = tokencount.frequent_words(Workspace(spark, "t"), df, most=4, fan=fan)
        assert got == ["of", "the", "und", "x"]
    assert tokencount.frequent_words(Workspace(spark, "t"), df.limit(0)) == []
    tier = tokencount.Tier.of(["of", "\u00e9t\u00e9", "x"], VOCABULARY)
    assert tier.lengths() == {w: len(true_ids([" " + w])[0]) for w in ("of", "\u00e9t\u00e9", "x")}


# 4


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "é" * 80 + "</p>", "tiny"
    rows = [(k, f"http://h/{k}", big if k % 3 == 0 else small if k % 3 == 1 else f"{k}" * 150) for k in range(5, 65)]
    rows += [(70, None, None), (71, "http://x\r\ny", ""), (72, "u", big), (73, "u", "z" * 100), (74, "u", "z" * 100), (75, "u", "y" * 99), (76, "u", "y" * 99), (77, "u", "r" * 120), (77, "u", "r" * 120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))
    ws = Workspace(spark, "t")
    headers, payloads = warc.write_archive(ws, pages)
    assert payloads.count() == len({(h or "").encode() for _, _, h in rows})
    archive = warc.read_archive(headers, payloads)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    got = sorted(tuple(r) for r in warc.records(archive).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        response = len(raw) < 100 or first[h or ""] == i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if response else "revisit", None if response else first[h or ""]))
    assert got == sorted(want, key=lambda r: r[:2])
    for r in archive.collect():
        lines = bytes(r.header).split(b"\r\n")
        fields = dict(x.split(b": ", 1) for x in lines[1:-2])
        assert lines[0] == b"WARC/1.1" and lines[-2:] == [b"", b""] and int(fields[b"Content-Length"]) == len(r.payload or b"")
    warc.export_files(archive, str(tmp_path / "warc"))
    import gzip

    assert all(gzip.decompress(bytes(r.member)).endswith(b"\r\n\r\n") for r in spark.read.parquet(str(tmp_path / "warc")).collect())
    broken = payloads.withColumn("payload", F.when(F.length("payload") == 150, F.lit(b"bad")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="fails its digest"):
        warc.records(warc.read_archive(headers, broken)).collect()
    assert warc.records(warc.read_archive(*warc.write_archive(Workspace(spark, "t"), pages.limit(0)))).count() == 0


# 6


def brute_print(text, width=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + width]) for k in range(max(1, len(tokens) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [2048, 4])
def test_simhash_groups(docs, corpus, block):
    prints = {i: brute_print(t) for i, t in corpus}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    label = components(prints, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs, block=block).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints.items()}


def test_simhash_finds_every_pair_in_dense_groups(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 8)):
            x ^= 1 << b
        prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "rep long, fp binary")
    ws = Workspace(spark, "t")
    for block in (2048, 32):
        got = connected_components(ws, simhash.links(ws, df, 1, 3, block), f"c{block}")
        label = components(prints, linked)
        assert {r.node: r.component_id for r in got.collect()} == {i: label[i] for p in linked for i in p}


def test_simhash_wide(docs, nothing, corpus):
    rows = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, 5, simhash.radius_for(0.8, 8), 8).collect()}
    sets = {}
    for i, t in corpus:
        tokens = (t or "").encode().lower().split()
        sets[i] = {b" ".join(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()
    for a in sets:
        for b in sets:
            both = len(sets[a] | sets[b])
            like = len(sets[a] & sets[b]) / both if both else 1.0
            if like >= 0.9 and a < b:
                assert rows[a] == rows[b]
            if like <= 0.3 and a < b and sets[a] and sets[b]:
                assert rows[a] != rows[b]
    assert simhash.simhash_groups(nothing).count() == 0


# 7


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(800):
        text = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 50))]
        assert suffixarray.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
        order, kind = suffixarray.classes(text, 3)
        assert all((kind[k] == kind[k - 1]) == ((text[order[k] : order[k] + 3] + [0] * 3)[:3] == (text[order[k - 1] : order[k - 1] + 3] + [0] * 3)[:3]) for k in range(1, len(text)))


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = [True] * length
            seen.add(s)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("limits", [{}, {"CHUNK_CAP": 1}, {"ARRAY_CAP": 1}, {"CHUNK_PIECES": 50, "CHUNK_CAP": 3}, {"_SEGMENT": 700}])
def test_remove_repeats(docs, corpus, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(sufdedup, name, value)
    monkeypatch.setattr(sufdedup.chunk_rows, "__defaults__", (sufdedup.CHUNK_CAP,))
    monkeypatch.setattr(sufdedup.settle_pieces, "__defaults__", (sufdedup.ARRAY_CAP,))
    import pyarrow as pa

    rows = []
    for batch in [corpus]:
        rows = batch
    want = brute_bytes(rows)
    if limits:  # in this process, where the changed limits hold
        got = in_process(rows)
        assert got == {i: w[1] for i, w in want.items() if w[1]}
        return
    found = sufdedup.remove_repeats(docs, bytes, pa.binary(), "binary", ["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == want


def in_process(rows):
    """Bytes removed per document by the operator's own steps, chunk by chunk."""
    import pyarrow as pa

    buckets = 5
    plain = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])

    def ranges(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "stop")), strict=True)

    first = [c for c in repeats.gathered(sufdedup.anchors(iter([plain])), most=200)]
    spans = {}
    sent = []
    for chunk in first:
        here, send, stands = repeats.combine(chunk, False, True)
        for k in here:
            spans.setdefault(int(chunk[2][k]), []).append((int(chunk[3][k]), int(chunk[3][k]) + 1))
        sent.append([c[send] for c in chunk[:4]] + [stands])
    key, key2, doc, pos, stands = (np.concatenate(c) for c in zip(*sent, strict=True))
    for k in repeats.settle(key, key2, doc, pos, stands, False, True):
        spans.setdefault(int(doc[k]), []).append((int(pos[k]), int(pos[k]) + 1))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    near = [(i, t, [{"start": a, "stop": b} for a, b in spans[i]]) for i, t in rows if i in spans]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in near]), pa.array([r[1] for r in near]), pa.array([r[2] for r in near], kind)], ["doc_id", "text", "spans"])

    def resorted(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["bucket"])
        return iter([pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]))]) if rows else iter([])

    settled = sufdedup._settle(resorted(sufdedup._gather(iter([batch]), buckets)), buckets)
    found = {}
    for i, a, b in ranges(sufdedup._decide(resorted(settled))):
        found.setdefault(i, []).append((a, b))
    texts = dict(rows)
    return {i: sufdedup.cut_out(texts[i].encode(), np.array([x[0] for x in f]), np.array([x[1] for x in f]))[1] for i, f in found.items()}


def test_remove_repeats_of_nothing(nothing):
    import pyarrow as pa

    assert sufdedup.remove_repeats(nothing, bytes, pa.binary(), "binary", nothing.columns).count() == 0


# 8


def test_cover_holds_every_pair_of_residues():
    cover = set(substring.COVER)
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + d) % substring.PERIOD in cover and (b + d) % substring.PERIOD in cover for d in range(substring.PERIOD))


def test_dedup_substrings(docs, corpus, nothing):
    seen, want = set(), {}
    for i, t in sorted(corpus):
        w = (t or "").encode().split()
        gone, own = [False] * len(w), []
        for k in range(len(w) - 49):
            s = b" ".join(w[k : k + 50])
            if s in seen:
                gone[k : k + 50] = [True] * 50
            own.append(s)
        seen.update(own)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(docs).collect()}
    assert got == want and any(w[1] for w in want.values())
    assert substring.dedup_substrings(nothing).count() == 0


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = ("  " + words(random.Random(1), 300) + "\n").encode()
    whole = substring.word_hashes(text)
    monkeypatch.setattr(substring, "_SEGMENT", 40)
    assert np.array_equal(whole, substring.word_hashes(text)) and len(whole) == 300


# 9


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for a, c in enumerate(item, 1):
        prev, row = row, [a]
        for j, x in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != x)))
    return min(row)


def test_best_end_is_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        distance, end = decontaminate.best_end(item, text)
        assert distance == edit_distance_inside(item, text)
        assert not text or edit_distance_inside(item, text[:end]) == distance


def test_contaminated(spark):
    rng = random.Random(7)
    items = [(k, words(rng, rng.randint(8, 40))) for k in range(12)] + [(20, None), (21, ""), (22, "short"), (23, "Ünï " * 12)]
    items.append((24, items[0][1]))
    rows = []
    for k in range(60):
        inner = ""
        if k % 2 == 0:
            inner = list(items[k % 12][1].upper() if k % 4 else items[k % 12][1].replace(" ", "\n "))
            for _ in range(rng.randint(0, int(0.09 * len(inner)))):
                at = rng.randrange(len(inner))
                inner[at : at + 1] = rng.choice([[], ["q"], ["q", inner[at]]])
        rows.append((k, words(rng, 30) + " " + "".join(inner) + " " + words(rng, 30)))
    rows += [(70, None), (71, ""), (72, "ÜNÏ " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = {}
    for i, t in rows:
        for k, item in items:
            x, y = decontaminate.normal(item or ""), decontaminate.normal(t or "")
            if len(x) >= 25 and y and edit_distance_inside(x, y) <= int(0.05 * len(x)):
                want[i, k] = edit_distance_inside(x, y)
    for most in (8 << 20, 200):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench, most=most).collect()}
        assert got == want
    assert len(want) > 10 and decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# 10


def brute_rule(url, rules):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_filter_urls(spark, most):
    rng = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "com", "x.com", "b.x.com", "Ex.COM", "net", "", "org.", "xn--a.example.org:80"]
    rules = [*urlfilter.RULES, urlfilter.Rule("block", "x.com", "/"), urlfilter.Rule("allow", "b.x.com", "/fr/"), urlfilter.Rule("block", "x.com", "/fr/1"), urlfilter.Rule("block", "a.example.org", "/en/")]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12', '/fr/', '/fr/1', '/de/x', '/DE/', '/es'])}{rng.choice(['', '?a=/fr/', '#://x/'])}" for _ in range(300)]
    urls += [None, "", "nothing", "://", "http://org", "a://b://c/d"]
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df, rules, most=most).collect()}
    for i, u in rows:
        host, path, rule = brute_rule(u, rules)
        assert got[i] == (host, path, rule.text if rule else None, rule.verdict if rule else "allow"), u
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(df, [], "block").collect()} == {"block"}


# pipeline


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    bench = [(1, corpus[30][1] or "x" * 40)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns
        current.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in current.collect()}
    texts = dict(corpus)
    with_letters = {i for i, t in corpus if t and any(c.isalpha() for c in t)}
    assert set(kept["language_id"]) <= with_letters and len(kept["language_id"]) > 0.8 * len(with_letters)
    groups = {}
    for i in kept["language_id"]:
        groups.setdefault(texts[i], []).append(i)
    for same in groups.values():
        assert len(set(same) & set(kept["simhash_near_dedup"])) <= 1
    before = {i: r.text for i, r in kept["simhash_near_dedup"].items()}
    want = {i: w[3].decode("utf-8", "ignore") for i, w in brute_bytes(before.items()).items()}
    assert {i: r.text for i, r in kept["suffix_array_dedup"].items()} == {i: t for i, t in want.items() if t.strip(" ")}
    assert all(r.n_chars == len(r.text) for r in kept["suffix_array_dedup"].values())
    hit = {i for i, r in kept["suffix_array_dedup"].items() if edit_distance_inside(decontaminate.normal(bench[0][1]), decontaminate.normal(r.text)) <= int(0.05 * len(decontaminate.normal(bench[0][1])))}
    assert set(kept["benchmark_decontamination"]) == set(kept["suffix_array_dedup"]) - hit
    packed = corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept["benchmark_decontamination"])
