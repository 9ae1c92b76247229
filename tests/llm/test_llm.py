"""Brute-force versions, round trips and edge cases of the ten operators and the pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quizforge.llm import decontaminate, html_blocks, line_quality, line_templates, packing, pieces, quality_mil, queries, simhash, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k_id string, fp string, row string"
EDGES = [
    (1, None, None, None, None, "x", "y", "z"), (2, "", "en", "s", 0, None, None, None), (3, "a b  c\n\nd", "en", "s", 1, "", "", ""), (3, "a b  c\n\nd", "en", "s", 1, "", "", ""),
    (None, "word " * 9000, "en", "s", 1, "", "", ""), (None, "É 中文 <|endoftext|> x", "en", "s", 1, "", "", ""), (4, "same line here now\nother", "en", "s", 1, "", "", ""),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute_fingerprint(text):
    own = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = queries.QUERIES["op4_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_bucket_links_large_and_small_agree():
    rng = np.random.default_rng(1)
    base = np.uint64(0xABCDEF0123456789)
    fps = np.unique(base ^ (rng.integers(0, 1 << 16, 400).astype(np.uint64) << np.uint64(24)))
    label = {int(f): int(f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    want = [label[int(f)] for f in fps]
    assert simhash.looked_up(fps).tolist() == want and simhash.tallied(fps).tolist() == want


def test_positional_bytes_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 40).astype(np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << draw.integers(0, 64, len(x)).astype(np.uint64))
    fps = np.unique(np.concatenate((base, flip(base), flip(flip(base)), flip(flip(flip(base))), base[0] ^ np.arange(300).astype(np.uint64))))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while (new := np.where(near, label[None, :], len(fps)).min(axis=1)).tolist() != label.tolist():
        label = new
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for crowded in (2048, 20):  # at 20 the posting of base[0] is dealt anew
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        links = simhash.index_links(distinct)
        assert all((np.uint64(r.a % (1 << 64)) in fps) and (np.uint64(r.b % (1 << 64)) in fps) for r in links.collect())
        roots = {r.fp: r.root for r in simhash.components(links).collect()}
        groups, want = {}, {}
        for f, k in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
            groups.setdefault(roots.get(f, f), set()).add(f)
            want.setdefault(k, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_line_templates_against_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    import re

    seen, lines = {}, []
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            plain = re.sub(r"[ \t\r\x0b\f]+", " ", line.lower()).strip(" ")
            toks = [re.sub(r"[^\s0-9]*[0-9]\S*", "<*>", x) for x in plain.split(" ")]
            n = len(toks)
            if n < 3 or not plain:
                continue
            cuts = [4 + (n - 4) * s // 4 if n > 4 else n for s in range(5)]
            seg = [" ".join(toks[cuts[s] : cuts[s + 1]]) for s in range(4)]
            forms = [(n, *toks[:4], -1, *seg)]
            if n >= 12:
                forms += [(n, *toks[:4], s, *(x for k, x in enumerate(seg) if k != s)) for s in range(4)]
            lines.append((i, p, forms))
            for f in forms:
                seen.setdefault(f, []).append((i, p))
    drop = {(i, p) for i, p, forms in lines for f in forms if len({d for d, _ in seen[f]}) >= 5 and (i, p) != min(seen[f])}
    want = {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in drop) for i, t in rows}
    got = {r.doc_id: r.text for r in queries.QUERIES["op1_line_templates"](spark, "/root/testdata/sf0.01").collect()}
    assert {i: t or "" for i, t in got.items()} == want and drop


def test_line_templates_generalise_fields(spark):
    line = "request {} from host alpha finished with state good after {} ms by worker one two three"
    rows = [(i, f"own text {chr(97 + i)} only here\n" + line.format(i, i * 7)) for i in range(6)] + [(9, line.format("x", "y").replace("alpha", "beta"))]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 1 and out[i].text.startswith("own text") for i in range(1, 6))


def test_line_dedup_stage_drops_long_lines_from_two_texts_on(spark):
    passage, other = (" ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) for w in ("Word", "other"))
    dated = passage + " in {}"
    rows = [
        (3, f"first own line\n{passage}"), (5, f"second own line\n{passage.upper()}  \nshort line of both"), (9, "short line of both"), (None, passage + "\nthird own line"),
        (20, other + "\na copied page"), (21, other + "\na copied page"), (30, dated.format(1999)), (31, dated.format(2004)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    # Lines in two texts lose the second; short lines, lines of another field and whole copies stay as they are.
    assert out == dict(rows) | {5: "second own line\nshort line of both", None: "third own line"}
    assert {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()} == dict(rows)


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", pieces.cut_words), ("byte_bpe_50k.json", pieces.cut_byte_level)])
def test_pieces_give_the_librarys_ids(name, cut):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    own = pieces.PieceEncoder(public_tokenizers.path(name), cut, most=300)
    signs = [*"abXYZ '  \n\t019.!\"-_éßÉÿµª²½\xa0\x85\x1c\x00streveldm|<>", "'s", "'re", "'ll", "  ", "\n\n", "…", "中", "<|endoftext|>", "<|startoftext|>", "İ", "é"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(40))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(part)] == want and own.counts(part).tolist() == list(map(len, want))


def test_token_cache_is_used_and_grows(spark, edges, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    out = token_counts.token_counts(edges, path, cache_path=cache).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in EDGES)
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == want
    n = spark.read.parquet(cache).count()
    more = spark.createDataFrame([(8, "A  B c\n\nD"), (9, "new words")], "doc_id long, text string")
    token_counts.token_counts(more, path, cache_path=cache).collect()
    assert spark.read.parquet(cache).count() == n + 1


def test_decontamination_finds_edited_passages_and_only_those(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    draw = random.Random(5)
    body = {i: t for i, t in ((r.item_id, " ".join(r.text.lower().split())) for r in items)}
    chosen = sorted(body)[:12]
    docs = []
    for n, i in enumerate(chosen):
        chars = list(body[i])
        for _ in range(int(len(chars) * 0.06) if n % 2 else 0):
            at = draw.randrange(len(chars))
            chars[at : at + draw.randrange(2)] = draw.choice("xyz")
        docs.append((i, "Some words before. " + "".join(chars).upper() + "\nand after"))
    docs += [(1000 + k, "clean text of other words only " * 40) for k in range(3)] + [(2000, None), (2001, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"), block_bytes=9000).collect()
    assert {(i, i) for i in chosen} <= {(r.doc_id, r.item_id) for r in got} and max(r.doc_id for r in got) < 1000


def test_decontamination_stage_keeps_clean_texts_under_the_same_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    rows = [(None, "clean text"), (None, "before " + item), (None, None), (1, "before " + item), (1, "clean text"), (2, "clean text"), (1, item + " after")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted((r for r in rows if r[1] in (None, "clean text")), key=repr)


def test_line_quality_counts_against_python(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(edges.select("doc_id", "text", "source"))
    own = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_quality.apply_rules(docs).collect())
    want = []
    for r in docs.collect():
        w = words(r.text)
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {t for t in set(tri) if tri.count(t) > 1} if len(tri) < 3000 else set(tri)
        repeat = {i + k for i, t in enumerate(tri) if t in often for k in range(3)}
        want.append((r.doc_id if r.doc_id is not None else -1, len(w), sum(map(len, w)), sum((r.text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)))
    assert own == sorted(want)


def test_line_quality_rejects_depleted_documents(spark):
    shared = "this shared line has many words " * 10
    rows = [(i, shared + f"\nown {i}", "h") for i in range(30)] + [(100, " ".join(f"w{k}" for k in range(80)), "h")]
    out = {r.doc_id: r for r in line_quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=20).collect()}
    assert out[100].kept and not any(out[i].kept for i in range(30)) and out[0].n_left == 2


def test_packing_is_whole(spark, edges):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edges.where("doc_id < 3").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    out = packing.pack(docs, path).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[doc])
    padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded < 0.02 * sum(map(len, ids.values()))
    assert packing.tail_cuts(1000, 1024) and sum(packing.tail_cuts(1000, 1024)) == 1000


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, label, least in (("op7_attention_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.93)):
        rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", label).collect()
        assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % (5 if label == "quality" else 3) == (0 if label == "quality" else 1) for r in rows)
        assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least


def test_html_blocks(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Big&nbsp;news</h1><p>One &amp; two.<br>More <b>te</b>xt<p>Three</p><script>var a = "<p>no</p>";</script></article><footer>&copy; x</footer></body></html>'
    assert [b[1] for b in html_blocks.blocks(page)] == ["Home", "Big news", "One & two.", "More text", "Three", "© x"]
    out = queries.QUERIES["op8_html_blocks"](spark, "/root/testdata/sf0.01").collect()
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    right = 0
    for r in out:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        right += r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert r.n_chars == len(r.text)
    assert right >= 0.98 * len(pages)


def test_html_blocks_keep_the_whole_path_and_all_words():
    deep = "<section class=comments>" + "<ol><li>" * 6 + "<p>A reader says this.</p>" + "</li></ol>" * 6 + "</section>"
    page = html_blocks.blocks(f"<main><p>Text.</p>{deep}</main><main>{'<div>' * 20}<p>Deep text.</p>")
    assert [html_blocks.container_label(p) for p, _, _ in page] == [1, 0, 1]
    # The weight of each part of the path by its place from the block, and the share of each word.
    want = np.zeros((3, html_blocks.PATH_SLOTS))
    for row, parts in enumerate((["main", "p"], ["main", "section", ".comments", *["ol", "li"] * 6, "p"], ["main", *["div"] * 20, "p"])):
        for depth, part in enumerate(reversed(parts)):
            want[row, zlib.crc32(part.encode()) % html_blocks.PATH_SLOTS] += 1 / (1 + 0.15 * depth)
    assert np.allclose(html_blocks.vectors(page)[:, : html_blocks.PATH_SLOTS], want, atol=1e-5)
    a, b = (html_blocks.vectors([(None, "word " * 40 + end, 0.0)])[0] for end in ("reply login share", "river garden stone"))
    assert not np.allclose(a, b)
    n = 20_000
    unclosed = html_blocks.blocks("<div>x" * n)
    assert len(unclosed) == n and html_blocks.vectors(unclosed[-3:]).shape == (3, html_blocks.INPUT)


def test_html_labels_rest_on_the_whole_page():
    rng = np.random.default_rng(9)
    n, lengths = html_blocks.HIDDEN, (700, 40, 1100, 0, 701, 256, 1)
    pages = [rng.random((k, html_blocks.INPUT), np.float32) for k in lengths]
    for side, at in (("f", 0), ("b", -1)):
        # A labeller whose state is set by a block with input 0 at one, here the page's first or last, and lasts.
        model = html_blocks.BlockLstm()
        model.w = {k: np.zeros_like(v) for k, v in model.w.items()}
        model.w[side][0, :n], model.w[side + "b"][:] = 40.0, np.repeat([-20.0, 20.0, 20.0, 2.0], n)
        model.w["o"][(0 if side == "f" else n) :][:n], model.w["ob"][0] = 1.0, -1.0
        for p in pages:
            p[:, 0] = 0
            p[at : at + 1 if at == 0 else None, 0] = 1
        assert [y.tolist() for y in model.label(pages)] == [[True] * k for k in lengths]
    model = html_blocks.BlockLstm()
    for p, got in zip(pages, model.label(pages), strict=True):
        if len(p):
            whole = model.logits(*html_blocks.padded([p]))[0][:, 0]
            assert (got == (whole > 0))[np.abs(whole) > 1e-4].all()


def test_html_labeller_learns_from_long_pages(spark, monkeypatch):
    body = "".join(f"<p>The story goes on in part {k} of this long page.</p>" for k in range(500))
    long = [(i, "u", f"<body><nav><a>Home {i}</a></nav><article>{body}</article><div class=replies><p>I liked part {i} of the story.</p></div></body>") for i in range(4)]
    pages = spark.createDataFrame(long, "page_id long, url string, html string")
    seen, train = [], html_blocks.train
    monkeypatch.setattr(html_blocks, "train", lambda own, **options: seen.extend(own) or train(own, **options))
    out = html_blocks.extract(pages).collect()
    # Every page is longer than 20,000 characters; what is learnt from has the opening, the middle and the end.
    assert len(seen) == 4 and all(len(x) <= html_blocks.DRAWN and y[0] == y[-1] == 0 and y[1:-1].all() and x[-1, html_blocks.PLACE] > 0.99 for x, y in seen)
    assert all(r.text.count("The story") == 500 and "Home" not in r.text and "liked" not in r.text for r in out)
    at = html_blocks.drawn(10_000)
    assert at[0] == 0 and at[-1] == 9_999 and len(set(at.tolist())) == html_blocks.DRAWN and np.diff(at).max() < 10_000 / (html_blocks.RUNS - 1)
    assert html_blocks.train([]) is None
    none = html_blocks.extract(spark.createDataFrame([(1, "u", "<nav>Home</nav><article>Text</article>")], "page_id long, url string, html string"), sample_pages=0)
    assert [r.text for r in none.collect()] == ["Text"]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "u", "same"), (3, "v", "same"), (2, "w\n x", "é\r\n\r\nWARC/1.1\r\n"), (4, None, None), (6, "y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.archive_and_read(pages, folder=f"file://{tmp_path}/w").collect()}
    assert len(out) == 6
    for i, _, h in rows:
        raw = (h or "").encode()
        assert out[i].payload_bytes == len(raw) and out[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (out[i].record_type, out[i].refers_to) for i in out} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("revisit", 6), 6: ("response", None)}
    assert bytes(out[2].payload) == rows[3][2].encode()
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_edge_rows_and_empty_tables(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "lines": line_templates.drop_recurring_lines, "tokens": lambda d: token_counts.token_counts(d, path), "near": simhash.near_duplicate_classes, "rules": line_quality.apply_rules,
        "quality": lambda d: quality_mil.score(d, labels), "no labels": lambda d: quality_mil.score(d, labels.limit(0)), "toxic": lambda d: toxicity.score(d, labels), "no toxic": lambda d: toxicity.score(d, labels.limit(0)),
    }
    for name, run in runs.items():
        assert run(edges).count() == len(EDGES), name
        assert run(empty).count() == 0, name
    assert decontaminate.leaks(edges, bench).count() == 0 and decontaminate.leaks(empty, bench.limit(0)).count() == 0
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert set(line_templates.drop_recurring_lines(edges).columns) == {*edges.columns, "n_lines", "n_dropped"}
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>x"), (1, "u", None)], "page_id long, url string, html string")
    assert html_blocks.extract(pages).count() == 3 and html_blocks.extract(pages.limit(0)).count() == 0


def test_pipeline_stores_each_stages_result(spark, monkeypatch):
    read = []
    stages = [(n, lambda s, docs, _: read.append(docs.inputFiles()) or docs.where("doc_id > 3")) for n, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 3").count()
    assert SF in read[0][0] and len(read) == 5 and all(f"/{n.replace(' ', '_')}-" in f for (n, _), files in zip(stages, read[1:], strict=False) for f in files)


def test_pipeline_stages_keep_columns_and_find_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns == docs.columns
        n = out.count()
        assert 0.5 * docs.count() < n <= docs.count()
    dup = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "x"), (2, "a b c d", "y"), (None, "z z z", "x"), (None, "q r s t u", "x"), (None, "q r s t u", "x")], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, dup, "").collect()
    assert sorted(r.text for r in kept) == ["a b c d", "q r s t u", "z z z"]
