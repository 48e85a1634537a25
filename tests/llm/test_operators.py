"""Each corpus operator against brute force, an exact round trip or held-out accuracy, and over odd tables."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsluice.llm import common, components, embedding_dedup, jaccard_join, language_id, license_scan, mixing, packing, quality_cnn, quality_rules, queries, substring_dedup, toxicity
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def odd(spark):
    return H.with_clashes(spark.createDataFrame(H.odd_documents(), H.DOCS).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.DOCS)


def ids_of(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


ODD_IDS = sorted((r[0] for r in H.odd_documents()), key=str)


# --- shared pieces


def test_word_hashes_depend_on_words_alone():
    import pyarrow as pa

    texts = ["a bb  a\tbb", None, "", "  x ", "bb\x0bé a", "A BB", "y" * 5000 + " a"]
    hashes, counts = common.word_hashes(*common.joined(pa.array(texts)))
    assert counts.tolist() == [len(H.words(t)) for t in texts]
    names = [w for t in texts for w in H.words(t)]
    by_name = {}
    for n, h in zip(names, hashes.tolist(), strict=True):
        assert by_name.setdefault(n, h) == h
    assert len(set(by_name.values())) == len(by_name)
    lower, _ = common.word_hashes(*common.joined(pa.array(["A BB", "a bb"])), lower=True)
    assert lower[:2].tolist() == lower[2:].tolist()


def test_bucket_of_id_is_that_of_sql(spark):
    ids = np.array([0, 1, -1, 5, 2**62, -(2**63), 123456789], dtype=np.int64)
    df = spark.createDataFrame([(int(x),) for x in ids], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(97)).alias("b"))
    assert {r["i"]: r["b"] for r in df.collect()} == dict(zip(ids.tolist(), common.bucket_of_id(ids, 97).tolist(), strict=True))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(4000, 4300)] + [(1, None)]
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = H.components({x for e in real for x in e}, real)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: language


def test_language_phrases_against_a_plain_parse():
    texts = {"en": "the cat sat on the mat and the cat ran", "xx": "zug zag zog zig"}
    model = language_id.Automata.build(texts)
    for text in ["the cat", "zig zag", "the zog", "  The,, CAT!", "q"]:
        got, _, _ = model.phrases([text])
        for k, lang in enumerate(model.languages):
            train = "".join(_symbols(model, texts[lang] + "\n"))
            seq, at, n = _symbols(model, text + "\n"), 0, 0
            while at < len(seq):
                m = 0
                while at + m < len(seq) and "".join(seq[at : at + m + 1]) in train:
                    m += 1
                at += max(1, m)
                n += 1
            assert got[0, k] == n, (text, lang)


def test_language_keeps_every_learned_letter():
    # Over 62 letters in all, the most frequent ones zz's; aa and bb have the same shape and differ only in their letters, zz has over 62 letters of its own.
    spell = lambda first, word: "".join(chr(first + 7 * ord(c) % 40) for c in word)
    words = "the cat sat on the mat and then it ran far away from home".split()
    texts = {"aa": " ".join(spell(0x4E00, w) for w in words), "bb": " ".join(spell(0xAC00, w) for w in words), "en": " ".join(words) * 3, "ru": "кот сидел на окне и смотрел во двор, где шёл дождь", "zz": (" ".join(chr(0x5000 + k) + chr(0x5001 + 3 * k % 80) for k in range(80)) + " ") * 20}
    model = language_id.Automata.build(texts)
    assert model.predict(list(texts.values()))[0] == list(texts)
    assert model.predict([spell(0x4E00, "cat"), spell(0xAC00, "cat"), "дождь на окне"])[0] == ["aa", "bb", "ru"]
    for text in [*(t[:200] for t in texts.values()), "дождь the " + texts["zz"][50:90] + " ༀ " + texts["aa"][3:20]]:
        got, _, _ = model.phrases([text])
        for k, lang in enumerate(model.languages):
            train, seq = "".join(_symbols(model, texts[lang] + "\n")), "".join(_symbols(model, text + "\n"))
            at = n = 0
            while at < len(seq):
                m = 0
                while at + m < len(seq) and seq[at : at + m + 1] in train:
                    m += 1
                at += max(1, m)
                n += 1
            assert got[0, k] == n, (text, lang)


def _symbols(model, text):
    points, _ = language_id.code_points([text[:-1]])
    return [chr(200 + int(c)) for c in language_id._gaps_closed(model.symbol[points])]


def test_language_over_odd_documents(spark, odd, empty):
    texts = {"en": "some english words here and there", "de": "einige deutsche woerter hier und dort"}
    got = {r["doc_id"]: r for r in language_id.identify(odd, texts).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert ids_of(language_id.identify(odd, texts)) == ODD_IDS
    assert language_id.identify(empty, texts).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert set(language_id.training_texts(odd)) == {"en", "de", "fr"}
    assert language_id.training_texts(empty) == {}


def test_language_held_out_accuracy(spark, sf_small):
    got = queries.QUERIES["op1_language_id"](spark, sf_small)
    rows = got.join(spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


# --- 2: licences


def test_licences(spark, empty):
    mit = next(s for s, i in license_scan.SENTENCES.items() if i == "mit_grant")
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."), (2, "MIT License\n\n" + mit.replace(" of ", "\nof ") + "\n\n" + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "),
        (3, "LICENSED under cc by-nc 4.0. Released under the MIT License."), (4, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), (5, "a licence of no kind"), (6, None),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["licenses"] for k in range(1, 7)] == [["MIT"], ["MIT"], ["MIT", "CC-BY-NC-4.0"], [], [], []]
    assert got[4]["unmatched"] == ["mit_notice"] and got[2]["sentence_ids"] == ["mit_title", "mit_grant", "mit_notice"]
    assert license_scan.scan(empty).count() == 0


def test_every_licence_sentence_is_recognised(spark):
    sentences = list(license_scan.SENTENCES.items())
    ways = [lambda s: s, lambda s: f"Some words before. {s} And some after it.", lambda s: "\n".join(s.split(" ")), lambda s: "# " + "\n# ".join(s.split(" "))]
    rows = [(k * len(ways) + j, f(s)) for k, (s, _) in enumerate(sentences) for j, f in enumerate(ways) if j != 1 or s[-1] in ".!?"]
    got = {r["doc_id"]: list(r["sentence_ids"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: [sentences[d // len(ways)][1]] for d, _ in rows} == got


def test_a_version_does_not_end_a_sentence_elsewhere(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    rows = [(1, mpl + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), (2, "See v. MIT License. Thanks."), (3, "Built by v. 3 people. Released under the MIT License.")]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MPL-2.0"], 2: ["MIT"], 3: ["MIT"]}


def whole(*ids):
    text = {}
    for sentence, i in license_scan.SENTENCES.items():
        text.setdefault(i, sentence)
    return [text[i] for i in ids]


def test_whole_licences_and_their_versions(spark):
    gpl = ("gnu_no_warranty", "gpl_details", "gpl_copy")
    wanted = {
        "MIT": whole("mit_title", "mit_grant", "mit_notice", "mit_as_is", "mit_liability"), "BSD-3-Clause": whole("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_liability"),
        "BSD-2-Clause": whole("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liability"), "Apache-2.0": whole("apache2_full", "apache2_url", "apache2_as_is", "apache2_see"),
        "GPL-3.0-or-later": whole("gpl3_or_later", *gpl), "GPL-3.0-only": whole("gpl3_only", *gpl), "GPL-2.0-or-later": whole("gpl2_or_later", *gpl), "GPL-2.0-only": whole("gpl2_only", *gpl),
        "LGPL-2.1-or-later": whole("lgpl21_or_later"), "LGPL-3.0-or-later": whole("lgpl3_or_later"), "AGPL-3.0-or-later": whole("agpl3_or_later"), "MPL-2.0": whole("mpl2_title"), "0BSD": whole("zero_bsd_grant"),
    }
    rows, names = [], list(wanted)
    for k, name in enumerate(names):
        paragraphs = wanted[name]
        rows += [(10 * k, "\n\n".join(paragraphs)), (10 * k + 1, "#\n".join("# " + p.replace(", ", ",\n# ") + "\n" for p in paragraphs)), (10 * k + 2, "/*\n *\n" + " *\n".join(" * " + p + "\n" for p in paragraphs) + " */")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r["licenses"] for d, r in got.items()} == {d: [names[d // 10]] for d, _ in rows}
    assert not any(r["unmatched"] for r in got.values())


def test_licences_over_odd_documents(odd):
    assert ids_of(license_scan.scan(odd)) == ODD_IDS


# --- 3 and 7: networks


def test_toxicity_gradients():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = ["alpha beta gamma delta", "beta beta", "epsilon " * 30]
    p, vocabulary = toxicity.fit([*texts, *texts], np.array([0, 1, 0, 0, 1, 0]), rounds=1, steps=1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    reader = toxicity.Reader(pa.array(texts))
    x, _ = toxicity.inputs(p, vocabulary, reader.words)
    x = x.astype(np.float64)
    chosen = np.arange(len(reader.of))
    at, size = reader.at(chosen), reader.size[chosen]
    y = rng.integers(0, 2, len(chosen)).astype(np.float64)

    def loss():
        s, cache = toxicity.forward(p, x, at, size, keep=True)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum(), s, cache

    _, s, cache = loss()
    g, d_x = toxicity.backward(p, x, at, cache, s - y)
    for name in ("w_f", "u_f", "u_b", "b_b", "key", "query", "out"):
        flat, grad = p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()[0]
            flat[k] = old - 1e-3
            down = loss()[0]
            flat[k] = old
            assert abs((up - down) / 2e-3 - grad[k]) < 2e-2 * max(1, abs(grad[k])), name
    assert d_x.shape == x.shape


def test_windows_cover_everything():
    for size in (0, 1, 12, 24, 25, 36, 37, 1000):
        of, begin, n = toxicity.windows_of(np.array([size, 3]))
        covered = {k for o, b, m in zip(of, begin, n, strict=True) if o == 0 for k in range(b, b + m)}
        assert covered == set(range(size)) and (of == 0).sum() >= 1
        of, at = quality_cnn.chunk_starts(np.array([size, 5]))
        assert {k for a in at[of == 0] for k in range(a, min(size, a + quality_cnn.CHUNK))} == set(range(size))


@pytest.mark.parametrize("name,label,least", [("op3_toxicity", "toxic", 0.5), ("op7_quality_cnn", "quality", 0.8)])
def test_networks_rank_held_out_labels(spark, sf_small, name, label, least):
    got = queries.QUERIES[name](spark, sf_small)
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = got.join(spark.read.parquet(f"{sf_small}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r[label]], [r["score"] for r in rows if not r[label]]
    if good and bad:
        assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) >= least


def test_networks_over_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (7, 0), (10, 1), (14, 0), (None, 1), (15, None)], "doc_id long, y int")
    net = quality_cnn.train(odd, labels, label_col="y", steps=5)
    assert isinstance(net, dict)
    scores = [(r["doc_id"], r["score"]) for r in quality_cnn.classify(odd, net).collect()]
    assert sorted((d for d, _ in scores), key=str) == ODD_IDS and all(0 <= s <= 1 for _, s in scores)
    assert len({s for d, s in scores if d == 8}) == 1
    assert quality_cnn.train(odd, labels.where("y = 1"), label_col="y") == 1.0
    assert quality_cnn.train(empty, labels, label_col="y") == 0.5
    assert quality_cnn.classify(empty, net).count() == 0
    got = toxicity.train(odd, labels, label_col="y", rounds=1, steps=2)
    scores = [(r["doc_id"], r["score"]) for r in toxicity.score(odd, got).collect()]
    assert sorted((d for d, _ in scores), key=str) == ODD_IDS and all(0 <= s <= 1 for _, s in scores)
    assert {s for d, s in scores if d in (1, 2, 3)} == {next(s for d, s in scores if d == 2)}
    assert toxicity.score(empty, 0.0).count() == 0


# --- 4: packing


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    exact = Tokenizer.from_file(path)
    pieces = packing.pack(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, max_len=256).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)
    for doc, text, *_ in H.odd_documents():
        if doc is not None:
            parts = sorted(by_doc[doc], key=lambda r: r["start"])
            ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist()
            assert ids == [*exact.encode(text or "", add_special_tokens=False).ids, 1], doc
            assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts[:-1]]]).tolist()
            assert {r["doc_tokens"] for r in parts} == {len(ids)}
    assert packing.pack(empty, path).count() == 0
    assert ids_of(packing.pack(odd, path).where("start = 0")) == ODD_IDS


def test_fast_encoder_is_the_exact_one():
    encoder = packing.Encoder(open(queries.tokenizer_file(), encoding="utf-8").read())
    assert encoder.fast is not None
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2000), rng.randrange(0x4E00, 0x4F00), 32, 10, 9])) for _ in range(60)) for _ in range(300)]
    for t in [*texts, " " * 3000, "a" * 20_000, "　  x"]:
        assert encoder.ids(t) == encoder.exact.encode(t, add_special_tokens=False).ids


def test_exact_encoder_is_made_when_a_text_needs_it():
    encoder = packing.Encoder(open(queries.tokenizer_file(), encoding="utf-8").read())
    assert encoder.ids("plain text") and "exact" not in vars(encoder)
    assert encoder.ids("<|endoftext|> is a mark") == encoder.exact.encode("<|endoftext|> is a mark", add_special_tokens=False).ids


def test_packing_sends_pieces_in_small_batches(odd, monkeypatch):
    runs, map_in_arrow = [], type(odd).mapInArrow
    monkeypatch.setattr(type(odd), "mapInArrow", lambda self, f, schema: runs.append(f) or map_in_arrow(self, f, schema))
    packing.pack(odd, queries.tokenizer_file())
    text = " ".join(f"w{i}" for i in range(500))
    pool = pa.default_memory_pool()
    try:
        got = list(runs[0](iter([pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array([text] * 800)], names=["doc_id", "text"])])))
    finally:
        pa.set_memory_pool(pool)
    n = [sum(b.column(2).to_pylist()) for b in got]
    assert sum(n) == 800 * got[0].column(3)[0].as_py() and max(n) < packing.SENT + 2048


# --- 5: quality rules


def test_quality_counts(odd, empty):
    got = sorted(quality_rules.judge(odd).select("doc_id", *quality_rules.BASE, "base_failed").collect(), key=str)
    want = sorted(((d, *H.quality(t)) for d, t, *_ in H.odd_documents()), key=str)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert quality_rules.judge(empty).count() == 0


def test_quality_sketches_merge_and_adapt(spark):
    rng = random.Random(4)
    clean = [(k, " ".join(f"word{rng.randrange(10**6)}" for _ in range(60)), "en", "s1", 0) for k in range(300)]
    odd_source = [(1000 + k, " ".join(f"w{rng.randrange(10**6)}#" for _ in range(60)), "en", "code", 0) for k in range(200)]
    junk = [(2000, " ".join(f"w{rng.randrange(10**6)}##" for _ in range(60)), "en", "s1", 0), (2001, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "qq", None, 0)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame([*clean, *odd_source, *junk], H.DOCS), keep=("text", "source")).collect()}
    assert all(got[d[0]]["kept"] for d in [*clean, *odd_source]) and got[2001]["kept"]
    assert not got[2000]["kept"] and got[2000]["failed"] == ["symbol_rate"] and got[2000]["source"] == "s1"


# --- 6: substrings


def test_recompression_names_equal_passages_alike():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 3, 50, 10**6):
        inner = common.mix64(rng.integers(0, kinds, 50).astype(np.uint64))
        found, sizes = [], []
        for _ in range(3):
            sides = [common.mix64(rng.integers(0, kinds, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2)]
            words = np.concatenate([sides[0], inner, sides[1]])
            got = substring_dedup.anchors(words, np.array([len(words)]), 50)
            at = got.at - len(sides[0])
            inside = (at >= 0) & (at + got.span <= 50)
            found.append({(int(n), int(c), int(a), int(s)) for n, c, a, s in zip(got.name[inside], got.check[inside], at[inside], got.span[inside], strict=True)})
            sizes += got.words.tolist()
        assert found[0] & found[1] & found[2], kinds
        assert kinds < 50 or np.mean(sizes) > 6


def test_symbols_depend_on_their_context_alone():
    rng = np.random.default_rng(2)
    for kinds in (2, 4, 1000):
        words = common.mix64(rng.integers(0, kinds, 300).astype(np.uint64))
        whole = substring_dedup.symbols(words, np.array([300]), 50)
        for begin, end in ((0, 300), (37, 260), (100, 190)):
            part = substring_dedup.symbols(words[begin:end], np.array([end - begin]), 50)
            of = lambda x, shift, lo, hi: {(int(n), int(s) + shift, int(e) + shift, int(l) + shift, int(r) + shift) for n, s, e, l, r in zip(x.name, x.start, x.end, x.left, x.right, strict=True) if l + shift >= lo and r + shift <= hi}  # noqa: E731, E741
            assert of(whole, 0, begin, end) == of(part, begin, begin, end)


def test_substrings_against_brute_force(spark, odd, empty):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove(odd).collect()), key=str)
    assert got == H.removed([(d, t) for d, t, *_ in H.odd_documents()])
    assert substring_dedup.remove(empty).count() == 0


@pytest.mark.parametrize("kinds,seed", [(2, 1), (3, 2), (40, 3), (100_000, 4)])
def test_substrings_in_random_texts(spark, kinds, seed):
    rng = random.Random(seed)
    pool = [[f"v{rng.randrange(kinds)}" for _ in range(rng.choice([49, 50, 51, 80, 200]))] for _ in range(6)]
    rows = []
    for k in range(60):
        w = []
        for _ in range(rng.choice([1, 2, 4])):
            w += [f"v{rng.randrange(kinds)}" for _ in range(rng.choice([0, 3, 40]))] + rng.choice([*pool, ["r"] * rng.choice([10, 60, 90])])
        rows.append((rng.randrange(10**9), " ".join(w)))
    got = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == H.removed(rows)


# --- 8: mixing


def test_anchors_of_few_texts_at_a_time():
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(1000)]
    batch = pa.record_batch({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array([*texts[:-1], None], pa.string())})
    whole = substring_dedup.anchors(*common.word_hashes(*common.joined(batch.column(1))), 50)
    tracemalloc.start()
    got = substring_dedup.anchors_of(batch, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((x == y).all() for x, y in zip(got, whole, strict=True)) and peak < 100e6


def test_a_kept_text_is_sent_once(spark, monkeypatch):
    sent, pack = [], substring_dedup.packed_rows

    def packed(df):
        sent.append([f.dataType.simpleString() for f in df.schema])
        return pack(df)

    monkeypatch.setattr(substring_dedup, "packed_rows", packed)
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{passage} one", "en"), (2, f"two  {passage}", None), (3, None, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in substring_dedup.remove(df, keep=("lang", "text")).collect()}
    assert [(r["text"], r["lang"], r["kept"]) for _, r in sorted(got.items())] == [(f"{passage} one", "en", f"{passage} one"), (f"two  {passage}", None, "two"), (None, "de", "")]
    assert sent[0].count("string") == 2  # text and lang


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([], [], 1.5, 2) == []
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == pytest.approx([0, 15])


def test_mixing(spark, odd, empty):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), "en", rng.choice(["a", "a", "b", "c", None]), 0) for k in range(6000)]
    df = spark.createDataFrame(rows, H.DOCS)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.002 * target[s] + 5, s
    assert ids_of(mixing.mix(odd)) == ODD_IDS
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 1000, 500).astype(float).tolist()
    p = mixing.flight([0.3] * 500, size, mixing._coin(9), False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(150) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(0.3 * sum(size))


# --- 9: embeddings


@pytest.mark.parametrize("part", [40, 10_000])
def test_embeddings_against_brute_force(spark, part):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 24))
    rows = []
    for k in range(300):
        v = base[k % 40] + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.5])
        rows.append((int(rng.integers(0, 10**6)), (v * rng.uniform(0.1, 9)).tolist()))
    rows += [(3_000_000 + k, (base[k] * scale).tolist()) for k in range(3) for scale in (1e200, 1e-200, 5e-310)]
    rows += [(2_000_000 + k, rows[0][1]) for k in range(5)] + [(7, None), (8, []), (9, [0.0] * 24), (10, [None, *[1.0] * 23]), (11, [float("nan")] * 24), (12, [float("inf")] * 24), (13, [1.0, 2.0]), (14, [2.0, 4.0]), (None, rows[1][1])]
    df = H.with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    old, embedding_dedup.PART = embedding_dedup.PART, part
    try:
        got = embedding_dedup.near_duplicates(df, block_dims=8).collect()
    finally:
        embedding_dedup.PART = old
    links, count = [], [0] * len(rows)
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    comp = H.components(range(len(rows)), links)
    name = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[comp[k]] = min(name.get(comp[k], i), i)
    want = sorted(((i, count[k], name.get(comp[k])) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- 10: Jaccard


def test_jaccard_over_odd_documents(spark, odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(odd).collect()), key=str)
    assert got == H.jaccard([(d, t) for d, t, *_ in H.odd_documents()])
    assert jaccard_join.link(empty).count() == 0


@pytest.mark.parametrize("seed,thin", [(1, 20), (2, 10_000)])
def test_jaccard_in_small_parts(spark, seed, thin):
    rng = random.Random(seed)
    rows = {}
    for _ in range(10):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 60])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows[rng.randrange(10**6)] = " ".join(w[: max(1, int(len(w) * rng.choice([1, 1, 0.8])))])
    common_words = " ".join(f"c{k}" for k in range(40))
    for _ in range(60):
        rows[rng.randrange(10**6)] = " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([8, 10, 14, 30]))) + " " + common_words
    old, jaccard_join.PART_DOCS, jaccard_join.THIN = (jaccard_join.PART_DOCS, jaccard_join.THIN), 10, thin
    try:
        got = jaccard_join.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)).collect()
    finally:
        jaccard_join.PART_DOCS, jaccard_join.THIN = old
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == H.jaccard(list(rows.items()))


def test_jaccard_of_rows_that_share_an_id(spark):
    def text(prefix, k=40):
        return " ".join(f"{prefix}{i}" for i in range(k))

    # 7 is a copy of 3 by one row and close to 9 by another, of equal and of other size; 20 joins two groups, and 30 has no other.
    rows = [(3, text("a")), (7, text("a")), (7, text("b")), (9, text("b", 41)), (7, text("c", 90)), (12, text("c", 91)), (20, text("d")), (21, text("d", 41))]
    rows += [(20, text("e")), (19, text("e")), (30, text("f")), (30, text("g")), (30, None), (None, text("a")), (None, text("g")), (40, None), (41, "one"), (41, "two"), (42, "two")]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == H.jaccard(rows)


def test_jaccard_of_copies_in_many_tasks(spark, monkeypatch):
    """Copies make no more candidates than one of them, and texts of documents in no tree stay where they are."""
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(40)]
    texts += [[*t[:-1], "other"] for t in texts[:10]]
    one = [(k, " ".join(t)) for k, t in enumerate(texts)]
    many = [(k + 50 * v, t) for v in range(12) for k, t in one]
    members, sent = [], []
    plant, pack = jaccard_join._members, jaccard_join.packed_rows

    def planted(*args):
        out = plant(*args)
        members.append(out.count())
        return out

    def packed(df):
        sent.append(df.count())
        return pack(df)

    monkeypatch.setattr(jaccard_join, "_members", planted)
    monkeypatch.setattr(jaccard_join, "packed_rows", packed)
    alone, got = (sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()) for rows in (one, many))
    assert alone == [(k, k - 40 if k >= 40 else k) for k in range(50)]
    assert got == [(d, dict(alone)[d % 50]) for d in range(600)]
    assert members[0] == members[1] == 20
    assert sent == [20, 20]


@pytest.mark.parametrize("copies,most", [(12, 5), (24, 7)])
def test_jaccard_of_near_copies_moves_little(spark, monkeypatch, copies, most):
    """Near copies are not moved once for each two of them; those that are only close enough to some of the others are still linked."""
    rng = random.Random(7)
    rows = {}
    for base in range(20):
        words = [f"{rng.randrange(1 << 24):06x}" for _ in range(300)]
        for copy in range(copies):
            near = list(words)
            for _ in range(rng.choice([2, 3, 3, 8]) if copy else 0):
                near[rng.randrange(300)] = f"x{rng.randrange(99999):05d}"
            rows[base + 100 * copy] = " ".join(near)
    df = common.written(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4))
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    monkeypatch.setattr(jaccard_join, "SLICE_TOKENS", 1, raising=False)
    before = shuffled()
    got = jaccard_join.link(df).collect()
    moved = shuffled() - before
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == H.jaccard(list(rows.items()))
    assert moved < most * sum(map(len, rows.values()))


def test_written_leaves_no_shuffle_files(spark):
    setting = spark.conf.get(common.CLEANUP, None)
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = folder.getAllFiles().size()
    got = common.written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert got.count() == 7 and spark.conf.get(common.CLEANUP, None) == setting
    assert folder.getAllFiles().size() <= before + 6


def test_maybe_among_misses_none(spark):
    df = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id") - 9_000).alias("doc_id"), F.lit("x").alias("text"))
    for ids in (df.where("doc_id % 5 = 0"), df.where("doc_id IS NULL"), df.limit(0)):
        got = common.maybe_among(df, ids.select("doc_id"))
        assert got.columns == ["doc_id", "text", "may_"] and got.count() == 20_000
        found = {r["doc_id"] for r in got.where("may_").collect()}
        want = {r["doc_id"] for r in ids.where("doc_id IS NOT NULL").collect()}
        assert want <= found and None not in found and len(found - want) <= len(want) // 2


def test_traversal_finds_the_same_components():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**62, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            s = base.copy()
            s[rng.integers(0, len(s), len(s) // 8)] = rng.integers(0, 2**62, len(s) // 8).astype(np.uint64)
            sets.append(np.unique(s))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.similar(sets[a], sets[b], 75)]
    assert H.components(range(len(sets)), jaccard_join.traverse(sets, 75)) == H.components(range(len(sets)), want)


# --- plans


def test_native_plans_have_no_python(odd):
    rows = quality_rules.measured(odd).selectExpr("*", *[f"({up}) div greatest(n_words, 1) AS {m}" for m, (up, _, _) in quality_rules.MEASURES.items()])
    for df in (license_scan.scan(odd), rows, quality_rules.thresholds(rows, 3, 100), quality_rules.judge(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan]


def test_scoring_and_packing_do_not_shuffle(odd):
    for df in (license_scan.scan(odd), packing.pack(odd, queries.tokenizer_file()), language_id.identify(odd, {"en": "words"}), quality_cnn.classify(odd, 0.5), toxicity.score(odd, 0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")  # none but what the table itself has


def test_written_tables_are_released(spark, odd):
    from pathlib import Path

    path = Path(common.written(odd.select("doc_id")).inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and common.release(spark) >= 1 and not path.exists()


# --- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, sf_small, name):
    got = queries.QUERIES[name](spark, sf_small).toPandas()
    want = duck.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_digest_columns(spark, sf_small):
    pieces = queries.QUERIES["op4_pack"](spark, sf_small).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries.tokenizer_file())
    doc = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").first()
    ids = np.array([*exact.encode(doc["text"], add_special_tokens=False).ids, 1], "<u4")
    for r in pieces:
        if r["doc_id"] == doc["doc_id"]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in H.removed(rows)}
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op6_substring_dedup"](spark, sf_small).collect()} == want
