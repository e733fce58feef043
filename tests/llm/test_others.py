from __future__ import annotations

import zlib

import numpy as np
import pytest
from test_density import articles
from wareflow.llm import decontam, html, langid, packing, quality, subword, warc


def test_quality_on_held_out_labels(spark, sf_dir):
    # The smallest table has 19 held-out labels, too few for a rate.
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.query(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.doc_id in labels and r.held_out]
    assert len(right) > 50 and np.mean(right) > 0.9


def test_language_on_held_out_rows(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in langid.query(spark, sf_dir).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.95


def test_models_on_odd_texts(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "%%% !!! ### ") * 5, "en" if i % 2 else "xx", i % 2) for i in range(60)], "doc_id long, text string, lang string, quality int")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%"), (4, "x" * 2_100_000), (5, "ß")], "doc_id long, text string")
    model = quality.fit(docs, docs.select("doc_id", "quality"))
    scores = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    found = {r.doc_id: r for r in langid.identify(odd, langid.fit(docs)).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[5].lang_pred in ("en", "xx") and found[4].lang_pred in ("en", "xx")
    none = docs.limit(0)
    assert quality.fit(none, none.select("doc_id", "quality")) is None and quality.score(odd, None).first().score == 1.0
    assert langid.fit(none) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert quality.score(none, model).count() == 0


def test_blocks_make_up_the_text():
    for text in ("", "ab cd", "x" * (subword.BLOCK * 2 + 5), "word " * 500_000, "söz\n日本 " * 300_000, "é" * (subword.BLOCK + 1)):
        assert "".join(subword.blocks(text)) == text and all(len(b) <= subword.BLOCK for b in subword.blocks(text))


ITEM = "Seven quick foxes jump over nine lazy dogs while the old farmer counts his brown hens beside a red barn at dawn"


def test_benchmark_items_are_found(spark):
    words = ITEM.split()
    texts = {
        1: f"before {ITEM} after",
        2: "filler words " * 200 + ITEM.upper() + " more words" * 50,
        3: "x " * 9000 + " ".join(words[:-1] + ["dusk"]),
        4: " ".join(words[: len(words) // 2]) + " and then something else entirely",
        5: ITEM.replace(" ", "\n").replace("dogs", "dogs,"),
        6: "nothing of the kind",
        7: None,
        8: "",
        9: " ".join(words[1:]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(70, ITEM), (71, None), (72, ""), (73, "two words"), (70, ITEM)], "item_id long, text string")
    got = {r.doc_id: {m.item for m in r.matches} for r in decontam.matched(docs, items).collect()}
    assert got == {1: {70}, 2: {70}, 3: {70}, 4: set(), 5: {70}, 6: set(), 7: set(), 8: set(), 9: {70}}
    assert decontam.matched(docs, items.limit(0)).where("size(matches) > 0").count() == 0
    assert decontam.matched(docs.limit(0), items).count() == 0


def test_decontamination_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def words(t):
        return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t.translate({i: i + 32 for i in range(65, 91)})).split()

    wanted = set()
    for d in docs:
        w = words(d.text)
        for i in items:
            v = words(i.text)
            own, n = shingles(v), len(v)
            at = [k for k in range(len(w) - n + 1) if tuple(w[k + 5 : k + 10]) in own or tuple(w[k : k + 5]) in own]
            if any(len(own & s) >= 0.8 * len(own | s) for s in (shingles(w[k : k + n]) for k in at)):
                wanted.add((d.doc_id, i.item_id))
    assert {(r.doc_id, r.item_id) for r in decontam.query(spark, sf_dir).collect()} == wanted and wanted


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(30))) for i in range(300)]
    index = decontam.Items.of(rows)
    probes = index.prints[:100].copy()
    for k in range(100):
        for bit in rng.choice(64, k % 18, replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    near = np.bitwise_count(probes[:, None] ^ index.prints[None, :]) <= decontam.RADIUS
    assert set(zip(*index.within(probes), strict=True)) == set(zip(*np.nonzero(near), strict=True))


PAGES = {
    "<body><nav>menu</nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three<p><b>Four<br>five</article><footer>f</footer>": "A & B\nOne two three\nFour five",
    "<div class='wrap'><div id='sidebar'>links here</div><div class=post><p>Long enough text of the post itself.</p><p>And a second one, long as well.</p></div></div><div id=comments><p>reader says</p></div>": "Long enough text of the post itself.\nAnd a second one, long as well.",
    "<header>site</header><main><header><h1>T</h1></header><p>x &lt;tag&gt; y</p><form>f</form><aside>a</aside></main>": "T\nx <tag> y",
    "<script>var t='</p>';</script><style>p{}</style><p>only</p><!-- no -->": "only",
    "plain": "plain",
    "": "",
    None: "",
    "<ul><li>": "",
    "<article><p>a<" + "b" * 50: "a",
}


def test_main_text_of_pages():
    for source, wanted in PAGES.items():
        assert html.main_text(source) == wanted
    assert html.main_text("<div>" * 3000 + "deep" + "</p>" * 3000) == "deep"


def test_main_text_query(spark, sf_dir):
    rows = html.query(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text == articles(pages[r.page_id]) for r in rows)


def test_warc_records_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=fr><title> A  b </title><body><a href='x'>l</a><p>t&eacute;xt"), (2, None, None), (3, "http://c/", "")], "page_id long, url string, html string")
    responses = warc.responses(pages)
    rows = warc.derived(responses).collect()
    ids = {r.key: r.record_id for r in responses.collect()}
    assert len(rows) == 6 and all(r.refers_to == ids[r.key] for r in rows) and len({r.record_id for r in rows}) == 6
    notes, text = (next(r for r in rows if r.key == 1 and r.record_type == t) for t in ("metadata", "conversion"))
    assert "title: A b\r\nlanguage: fr\r\n" in notes.block and "outlink: x\r\n" in notes.block and "source-header: Content-Type: text/html" in notes.block
    assert text.block == "l\ntéxt" and text.content_length == len(text.block.encode())
    assert all(r.block == "" for r in rows if r.key != 1 and r.record_type == "conversion")
    warc.written(warc.derived(responses), f"{tmp_path}/w")
    back = warc.read(spark, f"{tmp_path}/w").collect()
    assert all(r.intact for r in back)
    assert {(r.headers["WARC-Record-ID"], r.headers["WARC-Refers-To"], r.text) for r in back} == {(r.record_id, r.refers_to, r.block) for r in rows}
    assert warc.derived(responses.limit(0)).count() == 0


@pytest.mark.parametrize("width", [4, 16, 33])
def test_packing_loses_nothing_and_fits_best(width):
    rng = np.random.default_rng(width)
    docs = [(i, rng.integers(0, 1000, n).astype("<u2")) for i, n in enumerate([0, 1, width, width + 1, 5 * width, *rng.integers(0, 3 * width, 200)])]
    rows = list(packing.pack(docs, width, np.dtype("<u2")))
    back = {}
    for row in rows:
        assert len(row["ids"]) == 2 * width and row["n_tokens"] == row["cu_seqlens"][-1] <= width and row["position_resets"] == row["cu_seqlens"][:-1]
        for doc, part, ids in packing.unpacked(row):
            back[doc, part] = ids
    for i, ids in docs:
        assert np.array_equal(np.concatenate([back[i, p] for p in range(max(1, -(-len(ids) // width)))]), ids)
    lengths = np.array([len(x) for x in back.values()])
    room, plain = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(width - n)
            plain += 1
    assert len(rows) == plain


def test_packed_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    parts = {}
    for row in packing.query(spark, sf_dir).collect():
        for doc, part, ids in packing.unpacked(row):
            parts[doc, part] = ids
    for doc, text in texts.items():
        ids = np.concatenate([parts[doc, p] for p in range(sum(d == doc for d, _ in parts))])
        assert ids.tolist() == known.encode(text, add_special_tokens=False).ids
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a", 0)], "doc_id long, text string, ids int")
    path = __import__("public_tokenizers").path("byte_bpe_50k.tiktoken")
    held = packing.packed(odd.coalesce(1), path, 8).collect()
    assert sorted(map(str, held[0].doc_ids)) == ["1", "2", "None"] and packing.packed(odd.limit(0), path).count() == 0
