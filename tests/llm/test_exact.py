"""Exact identity, brute-force versions, and rows that repeat, clash or are unusual."""

import base64
import hashlib
import io
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quizforge.llm import common, decontaminate, line_quality, line_templates, packing, pieces, quality_mil, queries, sampling, simhash, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
#: Words whose polynomial hashes modulo 2**64 are the same, whatever the base.
MORSE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def test_spans_are_told_apart_by_their_bytes():
    draw = random.Random(1)
    words = [bytes(draw.choice(b"ab") for _ in range(draw.choice([1, 2, 3, 8, 9, 63, 64, 65, 70]))) for _ in range(2000)] + [MORSE.encode(), OTHER.encode()] * 2
    words += words[:50]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(size)
    ids, some = common.span_ids(data, ends - size, ends)
    seen = {}
    assert all(seen.setdefault(w, i) == i for w, i in zip(words, ids.tolist(), strict=True)) and len(set(ids.tolist())) == len(seen) == len(some)
    assert (ids[some] == np.arange(len(some))).all()


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", pieces.cut_words), ("byte_bpe_50k.json", pieces.cut_byte_level)])
def test_words_with_one_hash_have_their_own_ids(name, cut):
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), pieces.PieceEncoder(public_tokenizers.path(name), cut, most_bytes=2000)
    for texts in ([f"{MORSE} {OTHER}"], [MORSE], [OTHER], [MORSE, OTHER, MORSE]):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.encode(texts)] == want and own.counts(texts).tolist() == list(map(len, want))


def test_lines_with_one_hash_are_no_repeats(spark):
    rows = [(1, f"{MORSE}\n{OTHER}", "h"), (2, f"{MORSE}\n{MORSE} x\n{MORSE}", "h")]
    out = {r.doc_id: r for r in line_quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=1).collect()}
    assert (out[1].n_dup_lines, out[2].n_dup_lines) == (0, 1) and (out[1].n_left, out[2].n_left) == (1, 2)


def test_line_documents_are_distinct_ids(spark):
    line = " ".join(f"w{k}" for k in range(60))
    same = [(1, line, "h")] * 5
    count = lambda rows: {r.n_left for r in line_quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=3).collect()}
    assert count(same) == {60} and count([(i, line, "h") for i in range(5)]) == {0} and count([(None, line, "h")] * 5) == {0}
    assert count([(i, line, None if i < 3 else "") for i in range(5)]) == {60}


def test_line_templates_take_rows_of_one_id_as_one_document(spark):
    line = "one line of seven words in all"
    schema = "doc_id long, text string, source string"
    dropped = lambda rows: sorted(r.n_dropped for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, schema)).collect())
    assert dropped([(1, line, "x")] * 6) == [0] * 6
    assert dropped([(i, line, "x") for i in range(6)]) == [0] + [1] * 5
    assert dropped([(None, f"{line}\nown {i}", "x") for i in range(6)]) == [0] + [1] * 5
    clash = spark.createDataFrame([(i, line, "x") for i in range(6)], "doc_id long, text string, n_dropped string")
    own = line_templates.drop_recurring_lines(clash)
    assert own.columns == [*clash.columns, "n_lines", "_n_dropped"] and sorted((r.n_dropped, r._n_dropped) for r in own.collect()) == [("x", 0)] + [("x", 1)] * 5
    kept = corpus_pipeline.line_dedup(spark, clash, "")
    assert kept.columns == clash.columns and [r.n_dropped for r in kept.collect()] == ["x"]
    long = "\n".join(f"line number {chr(97 + k % 26)} {'abc'[k % 3]} {k}" for k in range(30_000))
    out = line_templates.drop_recurring_lines(spark.createDataFrame([(i, long, "x") for i in range(5)], schema)).collect()
    assert [r.n_lines for r in out] == [30_000] * 5 and sum(r.text == long for r in out) == 0


def test_token_counts_over_whole_tables(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in queries.QUERIES["op2_token_counts"](spark, SF).collect()) == want
    token_counts.append_misses(docs, cache, path)
    spark.read.parquet(cache).write.mode("append").parquet(cache + "2")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "2")  # two runs appended at once
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path, cache_path=cache + "2").collect()) == want


def edits_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_edit_distance(spark):
    draw = random.Random(7)
    items, docs = [], []
    for n in range(90):
        signs = draw.choice(["abcd ef", "abcdefghijklmnop qrst"])
        item = " ".join("".join(draw.choice(signs) for _ in range(draw.choice([9, 12, 19, 20, 25, 39, 40, 41, 70]))).split())
        chars = list(item)
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(chars))
            chars[at : at + draw.randrange(2)] = draw.choice(["x", "y", " "])
        around = ["".join(draw.choice(signs) for _ in range(draw.randrange(25))) for _ in range(2)]
        items.append((n, item))
        docs.append((n if n % 9 else None, around[0] + "".join(chars).upper() + around[1]))
    plain = lambda t: " ".join(t.lower().split(" "))
    want = set()
    for doc, text in docs:
        for n, item in items:
            e = edits_in(item, " ".join(plain(text).split()))
            if len(item) >= 8 and e <= len(item) // 10:
                want.add((doc, n, e))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (2_000_000, 300):
        got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in got if len(dict(items)[r.item_id]) >= 8} == want and want
    tiny = spark.createDataFrame([(1, "Paris?"), (2, " cat "), (3, "a")], "item_id long, text string")
    rows = [(1, "Paris?"), (2, "concatenate"), (3, "The\nCAT"), (4, "x a"), (5, "ba"), (1, "Paris?"), (None, "cat")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), tiny).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.end_byte) for r in got) == [(0, 2, 3), (1, 1, 6), (1, 1, 6), (3, 2, 7), (4, 3, 3)]


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Paris?", "x", "y"), (1, "London", "x", "y"), (None, "Paris?", "x", "y"), (None, None, "x", "y")], "doc_id long, text string, leaked_id string, item_id string")
    bench = spark.createDataFrame([(1, "paris?")], "item_id long, text string")
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == [(1, "London", "x", "y"), (None, None, "x", "y")]
    assert "Exchange" not in kept._jdf.queryExecution().toString()


def test_representatives_keep_clashing_columns(spark):
    rows = [(1, "a b c d", "2"), (2, "a b c d", "3"), (1, "a b c d", "2"), (None, "z", "4"), (5, "p q r s", "6"), (5, "k l m n", "7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r_text string").withColumns({"root": F.lit("r"), "n": F.lit("n"), "f": F.lit("f"), "k": F.lit("k")})
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(((r.doc_id or 0, r.text, r.r_text, r.root, r.n) for r in kept.collect())) == [(0, "z", "4", "r", "n"), (1, "a b c d", "2", "r", "n"), (5, "k l m n", "7", "r", "n"), (5, "p q r s", "6", "r", "n")]


def test_packing_keeps_null_ids_repeats_and_long_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["one two three", "one two three", None, "", "word and more " * 60_000]
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    out = packing.pack(docs, path).collect()
    tokens = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.length for r in out) == sum(tokens) and sorted(r.doc_tokens for r in out if r.start == 0) == tokens
    for rest in range(1, 1024):
        cuts = packing.tail_cuts(rest, 1024)
        assert sum(cuts) == rest and all(cuts) and len(cuts) <= packing.MAX_CUTS and (len(cuts) < 4 or sum(1024 / (1024 // c) - c for c in cuts) < 40)


def test_samples_have_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, sampling.labelled_sample(docs, labels, "quality", F.lit(True), text="text", rows=10).collect()), key=repr) == [(1.0, "text 0"), (1.0, None)]


def test_quality_scores_against_a_dense_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_mil.fit(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op7_attention_quality"](spark, SF).collect()}
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    for doc, text in rows.items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        x = (quality_mil.passages(data, np.array([0, len(data)]))[0] - model.mean) / model.scale
        assert len(x) == max(1, -(-len((text or "").encode().split()) // quality_mil.PASSAGE_WORDS))
        h = np.tanh(x @ w["e"] + w["eb"])
        logit = ((np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"])))) @ w["a"])[:, 0]
        share = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        p = 1 / (1 + np.exp(-((share @ h) @ w["o"][:, 0] + w["ob"][0])))
        assert abs(got[doc].score - p) < 1e-4 and got[doc].predicted == int(got[doc].score >= 0.3) and got[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_quality_learns_from_every_passage(spark):
    long = spark.createDataFrame([(1, "word " * 12_000 + "end"), (2, "x")], "doc_id long, text string")
    x = next(quality_mil._bags(iter(long.select(F.lit(1.0).alias("y"), "text").toArrow().to_batches())))
    assert sorted(len(b.as_py()) // (4 * quality_mil.FEATURES) for b in x.column(1)) == [1, 101] or len(x) == 1


def test_toxicity_weights_against_plain_ftrl(spark):
    draw = random.Random(2)
    bags = [(sorted({draw.randrange(40) for _ in range(6)}), draw.randrange(2)) for _ in range(300)]
    model = toxicity.FtrlProximal(40, alpha=1.0, l1=0.5)
    z, n, w = [0.0] * 41, [0.0] * 41, [0.0] * 41

    def weight(i):
        bound = 0.5 if i < 40 else 0
        return 0.0 if abs(z[i]) <= bound else -(z[i] - bound * (1 if z[i] > 0 else -1)) / ((1.0 + n[i] ** 0.5) / 1.0 + 0.1)

    for slots, y in bags:
        slots = [*slots, 40]
        model.learn(np.array(slots), y)
        w = [weight(i) for i in range(41)]
        g = 1 / (1 + np.exp(-sum(w[i] for i in slots))) - y
        for i in slots:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) * w[i]
            n[i] += g * g
    want = [weight(i) for i in range(41)]
    assert np.allclose(model.weights(), want, atol=1e-6) and any(x == 0 for x in want)
    docs, labels = spark.createDataFrame([(1, "bad words here"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, labels).collect()] == [(0.0, 0)] * 2


def test_toxicity_features_against_python():
    texts = ["One two, two THREE one two", "", "a", "ü-b c"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, slot = toxicity.features(data, offsets)
    for i, t in enumerate(texts):
        own = [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
        pairs = set(own) | set(zip(own, own[1:], strict=False)) | {(a, b, "skip") for a, b in zip(own, own[2:], strict=False)}
        assert (doc == i).sum() == len(pairs) and len(set(slot[doc == i].tolist())) == len(pairs)


def test_toxicity_stems_against_python():
    texts = ["Überaus, abcdefghij abcdefghix été", "", "ab", "\U0001f600\U0001f600\U0001f600 x", "abc"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    plain, (doc, slot) = toxicity.features(data, offsets), toxicity.features(data, offsets, toxicity.STEMS)
    for i, t in enumerate(texts):
        words = t.replace("Ü", "\0").lower().replace("\0", "Ü").replace(",", " ").split()
        stems = {w[:k] for w in words for k in toxicity.STEMS if len(w) >= k}
        assert (doc == i).sum() == (plain[0] == i).sum() + len(stems) and set(plain[1][plain[0] == i].tolist()) <= set(slot[doc == i].tolist())
    own = [set(slot[doc == i].tolist()) for i in range(len(texts))]
    assert len(own[0] & own[4]) == 1  # the stem abc, not the word


def test_toxicity_recall_by_language(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "toxic", "predicted").collect()
    for lang in ("en", "de", "fr", "es"):
        found = [r.predicted for r in rows if r.lang == lang and r.toxic == 1]
        assert sum(found) >= 0.7 * len(found) > 0, lang
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 0.01 * len(clean)


def warc_records(path):
    raw, out = path.read_bytes(), []
    while raw:
        inflate = zlib.decompressobj(wbits=31)
        head, block = inflate.decompress(raw).split(b"\r\n\r\n", 1)
        raw = inflate.unused_data
        out.append((warc.parse_head(head), block))
    return out


def test_warc_files_are_whole(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "u", "same"), (3, "v", "same"), (None, None, "other"), (None, None, "other"), (8, "z", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload string, last_id int").repartition(2)
    out = warc.archive_and_read(pages, folder=f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out) == [(0, "response", None), (0, "response", None), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (5, "response", None), (8, "response", None)]
    heads = []
    for archive in sorted((tmp_path / "w/members").glob("*.warc.gz")):
        own = warc_records(archive)
        index = [tuple(map(int, line.split())) for line in (archive.parent / (archive.name + ".idx")).read_text().splitlines()]
        assert len(index) == len(own)
        for (head, block), (at, size) in zip(own, index, strict=True):
            alone = zlib.decompress(archive.read_bytes()[at : at + size], wbits=31)
            assert alone.endswith(block) and int(head["Content-Length"]) == len(block) - 4
        heads += [h for h, _ in own]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows) and all(h["WARC-Date"].endswith("Z") and uuid.UUID(h["WARC-Record-ID"][10:-1]) for h in heads)
    assert {h["WARC-Refers-To-Target-URI"] for h in heads if h["WARC-Type"] == "revisit"} == {"u"}


def test_warc_over_whole_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    last = {}
    for r in pages:
        last[r.html or ""] = max(last.get(r.html or "", -1), r.page_id)
    want = set()
    for r in pages:
        raw = (r.html or "").encode()
        own = last[r.html or ""]
        want.add((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own == r.page_id else "revisit", None if own == r.page_id else own))
    assert set(map(tuple, queries.QUERIES["op9_warc"](spark, SF).collect())) == want


def test_normaliser_reads_every_member():
    record = lambda n: warc.record("response", str(uuid.UUID(int=n)), "2024-01-01T00:00:00Z", n, None, "D", 3, None, b"abc")
    pack = lambda raw: (d := zlib.compressobj(wbits=31)).compress(raw) + d.flush()
    both = pack(record(1) + record(2)[:40]) + pack(record(2)[40:]) + b"\0\0" + pack(record(3))
    assert [warc.parse_head(h)["X-Page-ID"] for h, _ in warc.inflated_records(io.BytesIO(both))] == ["1", "2", "3"]
    for broken in (both[:-5], pack(record(1)[:-2]), both + b"no gzip"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.inflated_records(io.BytesIO(broken)))


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_very_long_texts_and_clashing_columns(spark):
    text = "Some words of a very long text with line breaks\n" * 20_000
    docs = spark.createDataFrame([(1, text, "en", "s", "x"), (2, None, None, None, "x"), (None, "", "en", "s", "x")], "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicate_classes(docs).count() == line_quality.apply_rules(docs).count() == quality_mil.score(docs, labels).count() == toxicity.score(docs, labels).count() == 3
    n = len(text.encode().split())
    assert max(r.n_words for r in line_quality.apply_rules(docs).collect()) == n
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            assert out.columns == docs.columns and out.count() <= 3, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def plain_bits(hashes):
    """64 majorities over a list of hashes."""
    bits = np.array(hashes, np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    return (2 * bits.sum(axis=0) > len(hashes)).tolist()


def near_copies_taken_out(texts):
    """Of different texts by id: those that are the smallest id of their component, over all pairs that are alike in words or in a band."""
    words, wide, bands, ids = [], [], [], sorted(texts)
    for i in ids:
        own = (texts[i] or "").encode().lower().split()
        words.append(plain_bits([xxhash.xxh64_intdigest(w, 42) for w in set(own) for _ in range(min(own.count(w), 8))]))
        shingles = {b" ".join(own[j : j + 5]) for j in range(max(1, len(own) - 4))} if own else set()
        flat = np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], np.uint64)
        drawn = [common.mixed(flat + np.uint64(k)).tolist() for k in range(16)]
        wide.append(sum(map(plain_bits, drawn), []))
        least = [min(d, default=0) for d in drawn]
        bands.append({(k, least[k], least[k + 1]) for k in range(0, 16, 2)})
    words, wide = np.array(words).astype(int), np.array(wide).astype(int)
    apart = lambda m: (m[:, None] != m[None, :]).sum(axis=2)
    met = np.array([[a <= 3 for a in row] for row in apart(words)]) | np.array([[bool(x & y) for y in bands] for x in bands])
    near = met & np.array([(wide != row).sum(axis=1) <= 160 for row in wide])
    label = np.arange(len(ids))
    while (new := np.where(near, label[None, :], len(ids)).min(axis=1)).tolist() != label.tolist():
        label = new
    return {ids[k]: texts[ids[k]] for k in np.unique(label)}


@pytest.mark.parametrize("crowded", [2048, 2])
def test_near_copies_against_all_pairs(spark, monkeypatch, crowded):
    """One row of each group of near copies stays, clean texts stay, whether or not postings are crowded."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = {}
    for group in range(12):
        base = rng.choices(vocabulary, k=300)
        for copy in range(6):
            own = list(base)
            for _ in range(copy % 4):
                own[rng.randrange(300)] = rng.choice(vocabulary)
            texts[100 * group + copy] = " ".join(own)
    texts |= {5000 + i: " ".join(rng.choices(vocabulary, k=200)) for i in range(60)} | {6000: None, 6001: "two words", 6002: "|" * 9}
    rows = [(i, t, i) for i, t in texts.items()] + [(None, texts[5000], 1), (None, "no id at all", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long")
    kept = simhash.one_of_each_group(docs).collect()
    tight = {r.doc_id: r.text for r in simhash.representatives(docs).collect() if r.doc_id is not None}
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(near_copies_taken_out(tight))
    assert [r.root for r in kept if r.doc_id is None] == [2] and all(r.root == r.doc_id for r in kept if r.doc_id is not None)
    assert {*range(5000, 5060), 6000, 6001, 6002} <= {r.doc_id for r in kept}
    # Of 60 near copies nearly all go: word fingerprints over 3 bits apart are the method's miss.
    assert sum(r.doc_id is not None and r.doc_id < 1200 for r in kept) <= 20
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_pipeline_against_its_stages_by_brute_force(spark):
    """Every stage's verdict on the pipeline's own tables, worked out anew without Spark."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    item = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if r.text]
    tables = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
        tables.append({r.doc_id: r.text for r in docs.collect()})
    start, rated, lines, single, clean = tables
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op7_attention_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert rated == {i: t for i, t in start.items() if scores[i]}
    assert set(lines) <= set(rated) and all(set((t or "").split("\n")) <= set((rated[i] or "").split("\n")) for i, t in lines.items())
    fps = {i: int(simhash.fingerprints_of([simhash.shingle_hashes((t or '').encode())])[0]) for i, t in lines.items()}
    ids = np.array(sorted(fps))
    bits = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
    label = np.arange(len(ids))
    while (new := np.where(near, label[None, :], len(ids)).min(axis=1)).tolist() != label.tolist():
        label = new
    assert single == near_copies_taken_out({int(i): lines[int(i)] for i in ids[np.unique(label)]})
    plain = lambda t: " ".join(x.decode() for x in t.encode().lower().split())
    assert set(clean) <= set(single) and all(plain(x) not in plain(t or "") for t in clean.values() for x in item)
    for i in set(single) - set(clean):
        body = plain(single[i])
        assert any(plain(x) in body for x in item) or any(edits_in(plain(x), body[:4000]) <= len(plain(x)) // 10 for x in item)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
