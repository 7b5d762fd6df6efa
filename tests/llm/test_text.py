"""Operators on single texts, against libraries and brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from millrace.llm import byte_bpe, common, decontamination, html_text, language_id, pii, quality, token_counts

ODD = [None, "", " ", "  a  b ", "a\n b\t\x00c", "Été über 日本語 🙂", "x" * 3000, "a b " * 3000, "▁ a▁b", "it's we'll 12,345 --- !!\r\n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", 1.0) for i, t in enumerate(ODD)] + [(1, "", "n", 1.0), (None, "again", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double")


def test_token_counts_are_the_librarys(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts.token_counts(odd).collect()), key=str)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in odd.collect()), key=str)
    assert got == want
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_long_texts_are_split_at_safe_boundaries(monkeypatch):
    path = common.tokenizer_path("piece_bpe_32k.model")
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \né") for _ in range(9000)) for _ in range(3)] + ["z" * 20000]
    whole = token_counts.Counter(path).count(texts)
    monkeypatch.setattr(token_counts, "PART", 5000)
    monkeypatch.setattr(token_counts, "CACHE", 50)
    assert token_counts.Counter(path).count(texts) == whole == [len(x) for x in token_counts.Counter(path).model.encode(texts)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = common.rank_file(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys_and_decodes_back(spark, odd, tiktoken_encoding):
    for r in byte_bpe.digests(odd, with_ids=True).join(odd.select("doc_id", "text"), "doc_id").collect():
        ids = tiktoken_encoding.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(odd)).where("doc_id is not null").collect()
    assert all(r["text"] == (ODD[r["doc_id"]] or "") for r in back)


def test_bpe_of_random_bytes_appends_and_edits(tiktoken_encoding):
    rng = random.Random(4)
    v = byte_bpe.coder(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), byte_bpe.default_pattern()).vocabulary
    for _ in range(300):
        data = bytes(rng.choice(b"abeinrst \xc3\xa9") for _ in range(rng.randint(1, 120)))
        whole = byte_bpe.PrefixEncoding(v, data)
        assert whole.ids() == ([v.ranks[data]] if data in v.ranks else v.merge(data))
        cut = rng.randint(0, len(data))
        assert byte_bpe.PrefixEncoding(v, data[:cut]).append(data[cut:]).last == whole.last
        a = rng.randint(0, len(data))
        b, new = rng.randint(a, len(data)), bytes(rng.choice(b"abei") for _ in range(rng.randint(0, 4)))
        whole.edit(a, b, new)
        assert whole.last == byte_bpe.PrefixEncoding(v, data[:a] + new + data[b:]).last
    long = byte_bpe.PrefixEncoding(v, b"abcde" * 400)
    assert long.edit(10, 11, b"x") < 300


def test_language_of_odd_texts(spark, odd):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs.where(~common.held_out()))
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(odd.limit(0), model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_language_and_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (common.table(spark, sf, x).toPandas() for x in ("documents", "labels"))
    got = language_id.op3_language_id(spark, sf).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(docs) and (held.lang == held.lang_pred).mean() > 0.98
    got = quality.op1_quality(spark, sf).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= max(held.quality.mean(), 0.85)


def test_quality_without_labels_or_text(spark, odd):
    w = quality.fit(odd.select("doc_id", "text").limit(0).selectExpr("*", "1 as quality"))
    assert {round(r["score"], 6) for r in quality.score(odd, w).collect()} == {0.5}
    features = quality.features(*common.utf8(__import__("pyarrow").array(["", "a a b", None])))
    assert set(features[0]) == {1}


def brute_spans(t):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in card.finditer(t):
        n = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits(m)))))
        out += [(m.start(), 2, m.end())] if 14 <= len(digits(m)) <= 19 and n % 10 == 0 else []
    return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15])


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("a@.1 +-(25é%") for _ in range(rng.randint(0, 40)))
        assert pii.plain(t) == brute_spans(t)


@pytest.mark.parametrize("text, kind, found", [
    ("mail john.smith (at) example [dot] com now", "email", "john.smith (at) example [dot] com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("john at example dot co dot uk", "email", "john at example dot co dot uk"),
    ("plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("１９２.168.0.1", "ip", "１９２.168.0.1"),
    ("u​ser@ex­ample.com", "email", "u​ser@ex­ample.com"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    assert [(pii.KINDS[k], text[s:e]) for s, k, e, hidden in pii.find(text) if hidden] == [(kind, found)]


@pytest.mark.parametrize("text, kind, found", [
    ("call +1 555 one two three 4567 now", "phone", "+1 555 one two three 4567"),
    ("call +1 555 123 456 seven", "phone", "+1 555 123 456 seven"),
    ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
    ("host 192 punkt 168 punkt 0 punkt 1", "ip", "192 punkt 168 punkt 0 punkt 1"),
    ("host ten.0.0.1 or 10.0.0.one", "ip", "10.0.0.one"),
    ("card 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
    ("ann at firm dot xyz", "email", "ann at firm dot xyz"),
    ("ann at the dot com", "email", "ann at the dot com"),
    ("write ann@firm dot com.", "email", "ann@firm dot com"),
    ("ann @ mail dot firm dot museum", "email", "ann @ mail dot firm dot museum"),
    ("ann (at) firm dot xyz", "email", "ann (at) firm dot xyz"),
    ("ann@firm.co dot uk", "email", "ann@firm.co dot uk"),
    ("john @ gmail . com", "email", "john @ gmail . com"),
    ("𝐣𝐨𝐡𝐧@example.com", "email", "𝐣𝐨𝐡𝐧@example.com"),
    ("ⓙⓞⓗⓝ@example.com", "email", "ⓙⓞⓗⓝ@example.com"),
    ("+1 (7O6) 555-3138", "phone", "+1 (7O6) 555-3138"),
    ("alice ät example punkt de", "email", "alice ät example punkt de"),
    ("alice at example dot solutions", "email", "alice at example dot solutions"),
    ("ann at firm dot us dot museum", "email", "ann at firm dot us dot museum"),
    ("192 . 168 . 0 . 1 up", "ip", "192 . 168 . 0 . 1"),
    ("write alice (a) mail (d) example (d) com", "email", "alice (a) mail (d) example (d) com"),
    ("mail a l i c e @ e x a m p l e . c o m now", "email", "a l i c e @ e x a m p l e . c o m"),
    ("call plus one double five five one two three four five six seven now", "phone", "plus one double five five one two three four five six seven"),
    ("+1 triple 5 one two three 4567", "phone", "+1 triple 5 one two three 4567"),
])
def test_short_disguises(text, kind, found):
    assert [(pii.KINDS[k], text[s:e]) for s, k, e, hidden in pii.find(text) if hidden] == [(kind, found)]


@pytest.mark.parametrize("text", [
    "300 dot 168 dot 0 dot 1", "4111 1111 1111 111 two", "one two three", "At 10.0.0.1 one can see", "one 10.0.0.1",
    "Call +1 706 555 3138. One of us", "meet @ the cafe. It was 1O o'clock", "ann@firm.com dot the i", "look at a dot there", "1 point 2, or two point three",
    "+1 (848) 555-1373 Un texte", "meet me at nine dot thirty", "she looked at the dot com boom", "he was at noon dot ten", "option (a) example (b) other (d) more", "1 . 2 . 3 . 4 . 5", "double five, triple six",
])
def test_texts_without_further_spans(text):
    assert [x for x in pii.find(text) if x[3]] == []


@pytest.mark.parametrize("text", ["look at the dot there", "one of two, three or four", "at (dot) noon", "Москва река", ""])
def test_clean_texts_have_no_spans(text):
    assert pii.find(text) == []


@pytest.mark.parametrize("text", [" " * 10**6 + "(at) x", "( " * 10**5 + "at", "a@b.co " * 10**5 + "x (at) y (dot) com", "a at b" + " " * 10**5 + "dot com", "a " * 10**5 + "@ b", "a dot " * 10**5, "1 . " * 10**5, "1" + " " * 10**5 + "one"])
def test_one_long_text_takes_seconds(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 20


def test_pii_table(spark, odd):
    rows = spark.createDataFrame([(1, "é a@b.co +1 (706) 555-3138", 1), (1, None, 1), (2, "", 1)], "doc_id long, text string, found int")
    got = sorted((tuple(map(tuple, r["found"])) for r in pii.find_pii(rows).collect()), key=len)
    assert got == [(), (), (("email", 2, 8, False), ("phone", 9, 26, False))]
    assert pii.redact("é a@b.co", pii.find("é a@b.co")) == "é [email]"
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_pages(spark):
    page = """<html><body><header>Site</header><div id="page"><div class="cookie-banner">We use cookies. Accept them all.</div><article><header><h1>Title here</h1></header>
        <p>First&nbsp;para &amp; <b>more.<br><p>Second <a href=q>link</a>\n para.</p><aside class="sidebar"><p>Related stuff goes here now.</p></aside><form><p>Sign up for our newsletter today.</p></form>
        <section class="comments"><h2>Comments</h2><div><p>Great article, I loved it very much indeed. Thank you.</p></div></section><script>var a="</p>";</script></article></div><footer>&copy; x</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "<p", "t"), (4, "u", "plain text only, without any markup at all.", "t")], "page_id long, url string, html string, text string")
    got = {(r["page_id"]): r["text"] for r in html_text.main_text(rows).collect()}
    assert got[1] == "Title here\nFirst para & more.\nSecond link para." and got[2] == got[3] == ""
    assert html_text.main_text(rows.limit(0)).count() == 0


def test_marginals_are_those_of_all_labelings():
    import itertools

    pages = [html_text.Page(p) for p in ("<div><p>a b</p><nav>x</nav></div>", "<p>one</p>")]
    place = {x: i for i, x in enumerate(sorted({t for p in pages for f in p.traits for t in f}))}
    rng = np.random.default_rng(0)
    unary, edge = rng.normal(size=len(place)), rng.normal(size=(2, 2, 2))
    forest = html_text.Forest(pages, place)
    got, _ = forest.marginals(unary, edge)
    own = np.bincount(forest.node, unary[forest.feature], len(forest.parent))
    total, content = 0.0, np.zeros(len(own))
    for y in itertools.product((0, 1), repeat=len(own)):
        w = np.exp(sum(own[i] * y[i] + (edge[int(forest.leaf[i])][y[forest.parent[i]], y[i]] if forest.parent[i] >= 0 else 0) for i in range(len(own))))
        total += w
        content += w * np.array(y)
    assert np.allclose(got, content / total)


def test_decontamination_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"so {item.upper()}! end", 1), (2, "Tiny Item", 1), (2, None, 1), (3, "", 1), (4, "tiny", 1), (5, "x " + " ".join(item.split()[:10]), 1), (5, "ALPHA beta", 1), (6, "über-tiny item", 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, items int")
    tests = spark.createDataFrame([(10, item), (9, "tiny item"), (9, "tiny item"), (8, None), (7, "--")], "item_id long, text string")
    hit = decontamination.hit_words().alias("hit")
    got = sorted((r["doc_id"], r["n_words"], r["hit"], r["items"]) for r in decontamination.decontaminate(docs, tests).select("*", hit).collect())
    assert got == [(1, 13, 11, ["10"]), (2, 0, 0, []), (2, 2, 2, ["9"]), (3, 0, 0, []), (4, 1, 0, []), (5, 2, 0, []), (5, 11, 10, ["10"]), (6, 3, 2, ["9"])]
    for a, b in ((docs.limit(0), tests), (docs, tests.limit(0))):
        assert decontamination.decontaminate(a, b).where(hit > 0).count() == 0


def test_decontamination_index_has_few_rows_in_a_row_group(spark):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"w{i} a b " * 150_000) for i in range(14)], "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(docs)
    groups = [m.row_group(i).num_rows for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert index.count() == sum(groups) > 6 and max(groups) <= 4
    assert not any(spark.conf.get(key, None) for key in decontamination.SMALL_GROUPS)


def test_decontamination_query_writes_small_row_groups(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    texts = [(i, f"w{i} a b " * 150_000) for i in range(14)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b w5 a"), (2, "b w7")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    made, plain = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df: made.append(plain(df)) or made[-1])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.op5_decontamination(spark, str(tmp_path)).collect()}
    assert got == {i: (450_000, {5: 449_998, 7: 299_998}.get(i, 0), int(i in (5, 7))) for i in range(14)}
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made[0].inputFiles()]
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 4


def test_decontamination_in_blocks_gives_the_same(spark, monkeypatch):
    docs, tests = (common.table(spark, "/root/testdata/sf0.001", x) for x in ("documents", "benchmark"))
    one = sorted(map(str, decontamination.decontaminate(docs, tests).select("doc_id", "n_words", "items", decontamination.hit_words()).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    assert sorted(map(str, decontamination.decontaminate(docs, tests).select("doc_id", "n_words", "items", decontamination.hit_words()).collect())) == one


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y y y a b"), (2, "b"), (3, "b a"), (4, "a x x x x b")], "doc_id long, text string")
    a, b = decontamination.words_of(["a b"])[0]
    vocabulary = np.unique(np.array([a, b]))
    index = decontamination.build_index(docs)
    got = {r["doc_id"]: (r["items"], r["starts"], r["ends"]) for r in decontamination.search(index, vocabulary, [("near", np.array([a, b]), 3)]).collect()}
    assert got == {1: (["near"], [0, 6], [3, 8]), 2: ([], [], []), 3: (["near"], [0], [2]), 4: ([], [], [])}


def test_pages_keep_formulas_and_linked_text_and_drop_what_is_hidden():
    p = "This is a paragraph of the article, long enough to be one. " * 3
    page = f"""<html><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><article><h1>Title of it</h1><p>{p}</p>
        <p>We have <math><mi>E</mi>=<mi>mc</mi></math> as the formula.</p><p><a href=q>A whole sentence of the article is a link here.</a></p>
        <div hidden><p>{p}unseen</p></div><p style="color:red; display: none">{p}unseen</p><p class="hidden-print">Seen on a screen, in the article. {p}</p></article></body></html>"""
    got = html_text.texts([page], html_text.fit())[0].split("\n")
    assert "We have E=mc as the formula." in got and "A whole sentence of the article is a link here." in got
    assert not any("unseen" in x for x in got) and "Home" not in got and any(x.startswith("Seen on") for x in got)
    assert html_text.texts(["<div>" * 20000 + "</p>" * 20000], html_text.fit()) == [""]


def _site(inner):
    return f'<html><body><nav class="menu"><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>{inner}<footer>&copy; 2024 Site</footer></body></html>'


PARAGRAPHS = [f"Paragraph number {i} of this article says a few things about rivers. It goes on like this for quite a while, and then ends." for i in range(6)]


@pytest.mark.parametrize("open_, close", [('<div class="z3">', "</div>"), ("<div>", "</div>"), ('<div class="thread"><div class="post">', "</div></div>"), ('<section id="q77">', "</section>")])
def test_articles_without_a_name_are_found(open_, close):
    got = html_text.texts([_site(f"{open_}<h1>Title of it</h1><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p>{close}")], html_text.fit())[0].split("\n")
    assert got[-2:] == PARAGRAPHS[:2] and "Home" not in got and not any("Site" in x for x in got)


@pytest.mark.parametrize("name", ["related-history", "share-price", "alert-info", "warning-signs", "legal-history"])
def test_parts_of_articles_stay_whatever_their_names(name):
    inner = f'<article><h1>T</h1><p>{PARAGRAPHS[0]}</p><div class="{name}"><p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></div><section class="{name}"><p>{PARAGRAPHS[3]}</p></section><p>third &lt;tag&gt; &copy; y</p><p>{PARAGRAPHS[4]}</p></article>'
    got = html_text.texts([_site(inner)], html_text.fit())[0].split("\n")
    assert [x for x in got if x.startswith("Para")] == PARAGRAPHS[:5] and "third <tag> © y" in got


def test_sources_stay_and_comments_go():
    comments = f'<div class="comments"><p>{PARAGRAPHS[3]}</p><p>{PARAGRAPHS[4]}</p></div>'
    inner = f"<article><h1>T</h1><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p><h2>Sources</h2><ul><li><a href=1>A study of things</a></li><li><a href=2>Another study, 2020</a></li></ul>{comments}</article>"
    got = html_text.texts([_site(inner)], html_text.fit())[0].split("\n")
    assert got == ["T", *PARAGRAPHS[:2], "Sources", "A study of things", "Another study, 2020"]


@pytest.mark.parametrize("page", ["<div hidden>" * 50_000 + "x", "<div hidden>x</div>" * 50_000, "<b hidden " * 100_000, "<p hidden>a<div hidden>" * 25_000 + "</div>" * 9])
def test_one_long_page_takes_seconds(page):
    model, began = html_text.fit(), time.time()
    html_text.texts([page], model)
    assert time.time() - began < 20


def test_frames_with_names_that_were_never_seen():
    """Their names are words of another language; tags, links and what they hold tell them apart."""
    names = {"nav": "navi wegweiser", "header": "kopfzeile", "footer": "fusszeile", "aside": "randspalte", "div": "werbung anzeige", "notice": "hinweis", "form": "anmeldung", "comment": "kommentare lesermeinung", "share": "teilen"}
    right = total = 0
    for source in html_text.labelled_pages(100, seed=4, names=names):
        page = html_text.Page(source, marked=True)
        found = set(html_text.texts([source], html_text.fit())[0].split("\n"))
        right += sum((t in found) == bool(page.label[i]) for i, t in zip(page.leaves, page.texts))
        total += len(page.leaves)
    assert right / total > 0.95, right / total


def test_accuracy_on_generated_pages_that_were_not_learned():
    right = total = 0
    for source in html_text.labelled_pages(60, seed=99):
        page = html_text.Page(source, marked=True)
        found = set(html_text.texts([source], html_text.fit())[0].split("\n"))
        right += sum((t in found) == bool(page.label[i]) for i, t in zip(page.leaves, page.texts))
        total += len(page.leaves)
    assert right / total > 0.95


def test_query_of_pages(spark, tmp_path):
    rows = [(1, "u", _site(f"<article><h1>Straße 🙂</h1><p>{PARAGRAPHS[0]}</p></article>")), (1, None, None), (None, "v", ""), (2, "w", "<p")]
    spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, html_text.op10_html_text(spark, str(tmp_path)).collect()), key=str)
    text = "Straße 🙂\n" + PARAGRAPHS[0]
    assert got == sorted([(1, "u", text, len(text)), (1, None, "", 0), (None, "v", "", 0), (2, "w", "", 0)], key=str)


def test_query_of_personal_data(spark, tmp_path):
    docs = [(1, "é a@b.co +1 (706) 555-3138 and 10.0.0.1"), (2, None), (2, ""), (3, "ann (at) firm dot xyz"), (3, "ann (at) firm dot xyz"), (None, "4111 1111 1111 1111 " * 3000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, pii.op9_pii(spark, str(tmp_path)).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t in docs:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(t or "")]
        n = [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
        want.append((d, *n, sha(",".join(base)), "email:0:21" if d == 3 else ",".join(base)))
    assert got == sorted(want, key=str)


def test_features_of_long_texts_are_those_of_their_pieces(monkeypatch):
    import pyarrow as pa

    data, offsets = common.utf8(pa.array(["Some words, and more of them. " * 200]))
    whole = quality.features(data, offsets)
    monkeypatch.setattr(common, "STEP_BYTES", 600)
    monkeypatch.setattr(common.pieces, "__defaults__", (600,))
    parts = quality.features(data, offsets)
    assert (whole[1] == parts[1]).all() and np.abs(whole[2] - parts[2]).max() < 0.05 and abs((parts[2] ** 2).sum() - 1) < 1e-9
    assert list(common.pieces(data[:5], quality._KIND == 0)) == [(0, 5)]


def plain_language(docs, asked):
    """(id, language, score) of the asked (id, text), by loops over docs (id, text, language)."""
    import math

    def grams(t):
        c = [32] * 3 + [ord(x.lower()[0]) if x.isalpha() else 32 for x in t or ""] + [32] * 2
        for i in range(len(c) - 2):
            a, b, d = (x != 32 for x in c[i : i + 3])
            h = (c[i] * 0x9E3779B97F4A7C15 + 1) % 2**64
            for k, (use, f) in enumerate(((a, 0), (a or b, 0xC2B2AE3D27D4EB4F), ((a and b) or (b and d), 0x165667B19E3779F9))):
                h = (h * 31 + c[i + k] * f) % 2**64 if k else h
                if use:
                    x = h
                    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        x = ((x ^ x >> shift) * m) % 2**64
                    yield ((x ^ x >> 31) >> 40) % language_id.BUCKETS

    counts, priors = {}, {}
    for _, t, lang in docs:
        if t is not None and lang:
            priors[lang] = priors.get(lang, 0) + 1
            counts.setdefault(lang, [])
            counts[lang] += grams(t)
    langs = sorted(x for x in counts if counts[x])
    total = sum(priors[x] for x in langs)
    out = []
    for d, t in asked:
        found = list(grams(t))
        sums = [math.log(priors[x] / total) + sum(math.log((counts[x].count(g) + language_id.SMOOTHING) / (len(counts[x]) + language_id.SMOOTHING * language_id.BUCKETS)) for g in found) for x in langs]
        best = max(range(len(langs)), key=sums.__getitem__)
        out.append((str(d), langs[best], round(1 / sum(math.exp(s - sums[best]) for s in sums), 6)) if found else (str(d), "und", 0.0))
    return out


LANGUAGES = [(1, "The cat sat on the mat.", "en"), (2, "A dog and the cat", "en"), (3, "Der Hund und die Katze", "de"), (4, "Über Straßen", "de"), (5, None, "de"), (6, "12 !", "fr"), (7, "no language", None)]


def test_language_model_is_that_of_a_plain_loop(spark):
    asked = [(10, "the DOG"), (11, "die straße"), (12, None), (13, "--"), (14, "x"), (14, "x"), (None, "und the")]
    model = language_id.fit(spark.createDataFrame(LANGUAGES, "doc_id long, text string, lang string"))
    got = language_id.predict(spark.createDataFrame([(*a, "clash") for a in asked], "doc_id long, text string, lang_pred string"), model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in got) == sorted(plain_language(LANGUAGES, asked))


def test_language_stage_keeps_what_a_plain_loop_keeps(spark):
    docs = LANGUAGES + [(8, "the the", "xx"), (8, "the the", "xx"), (9, "??", "en"), (None, "die Katze", "de"), (11, "", None), (12, "q", "en")]
    docs += [(20 + i, t, "en" if i % 2 else "it") for i, t in enumerate(["zw", "una casa", "a house", "il gatto e il cane", "cats", "o"])]
    learned = [d for d in docs if d[0] is None or zlib.crc32(str(d[0]).encode()) % 4 != 2]
    assert 0 < len(learned) < len(docs)
    found = plain_language(learned, [(i, d[1]) for i, d in enumerate(docs)])
    want = [(*docs[int(i)], "clash") for i, lang, score in found if lang != "und" and score >= 0.5]
    rows = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, score string")
    got = language_id.stage(spark, rows, "")
    assert got.columns == rows.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert language_id.stage(spark, rows.limit(0), "").count() == 0


def test_decontamination_stage_is_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    text = lambda n: " ".join(rng.choice(["a", "B", "ü"]) for _ in range(n))
    items = [(1, text(12)), (2, text(10)), (2, "x Y"), (3, None), (4, "--"), (None, text(11))]
    docs = [(rng.randrange(40) or None, text(rng.randrange(30)) + rng.choice(["", " x-y.", " x a y"]), "n") for _ in range(80)]
    docs += [(50 + i, f"so {t}, too", "n") for i, (_, t) in enumerate(items)] + [(60, None, "n"), (61, "", "n"), docs[0]]
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    hit = lambda w: any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))
    want = [d for d in docs if not hit(words(d[1]))]
    assert 10 < len(want) < len(docs) - 10
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.createDataFrame(docs, "doc_id long, text string, items string")
    got = decontamination.stage(spark, rows, str(tmp_path))
    assert got.columns == rows.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert decontamination.stage(spark, rows.limit(0), str(tmp_path)).count() == 0


def test_bpe_stage_is_the_library(spark, odd, tiktoken_encoding):
    got = [(r["doc_id"], r["n_tokens"], r["ids"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.stage(spark, odd, "").collect()]
    want = []
    for r in odd.collect():
        ids = tiktoken_encoding.encode_ordinary(r["text"] or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (r["text"] or "").encode())]
        want.append((r["doc_id"], len(ids), ids, *sha))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert byte_bpe.stage(spark, odd.limit(0), "").count() == 0 and byte_bpe.digests(odd.limit(0)).count() == 0


def test_query_of_token_counts_and_bpe(spark, tmp_path, tiktoken_encoding):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    texts = [*ODD, "word " * 4200]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, over_limit boolean").write.parquet(str(tmp_path / "documents.parquet"))
    n = [(str(i), len((t or "").encode()), k := len(model.encode(t or "")), k > 4096) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op6_token_counts(spark, str(tmp_path)).collect()) == sorted(n)
    assert any(x[3] for x in n)
    want = [(str(i), len(ids := tiktoken_encoding.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.op2_byte_bpe(spark, str(tmp_path)).collect()) == sorted(want)


def plain_features(text):
    """Feature -> value, each feature by its name instead of a bucket."""
    token = re.findall(r"[0-9A-Za-z]+|[!-/:-@\[-`{-~]+", text)
    punct = [not t[0].isalnum() for t in token]
    shape = [t if p else 1 if not re.search("[A-Za-z]", t) else 2 if not re.search("[a-z]", t) else 3 if t[0].isupper() else 4 for t, p in zip(token, punct)]
    word = [t.lower() for t in token]
    found = [("word", w) for w in word] + [("shape", s) for s in shape]
    found += [("words", *x) for x in zip(word, word[1:])] + [("shapes", *x) for x in zip(shape, shape[1:])]
    found += ["again" for x, y in zip(word, word[1:]) if x == y] + ["again" for x, y, p in zip(word, word[2:], punct[2:]) if x == y and not p]
    value = {f: np.log1p(found.count(f)) for f in found}
    length = sum(v * v for v in value.values()) ** 0.5
    return {f: v / length for f, v in value.items()}


def plain_quality(rows, shards, rounds):
    """Weights by feature from rows (id, text, label), by loops."""
    import pandas as pd

    examples = [(i, label, {**plain_features(t), "bias": 1.0}) for i, t, label in rows if t is not None and label is not None]
    state = {}

    def weight(zn):
        z, n = zn
        return 0.0 if abs(z) <= quality.L1 else -(z - (1 if z > 0 else -1) * quality.L1) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)

    for turn in range(rounds):
        total = {}
        for shard in range(shards):
            own = [e for e in examples if zlib.crc32(f"deal{e[0]}".encode()) % shards == shard]
            mixed = dict(zip((e[0] for e in own), pd.util.hash_array(np.array([str(e[0]) for e in own], object)).tolist()))
            now = dict(state)
            for _, label, x in sorted(own, key=lambda e: (mixed[e[0]] ^ turn * 0x9E3779B9, str(e[0]))):
                w = {f: weight(now.get(f, (0.0, 0.0))) for f in x}
                p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in x.items())))
                for f, v in x.items():
                    z, n = now.get(f, (0.0, 0.0))
                    g = (p - label) * v
                    now[f] = z + g - ((n + g * g) ** 0.5 - n**0.5) / quality.ALPHA * w[f], n + g * g
            for f, (z, n) in now.items():
                a, b = total.get(f, (0.0, 0.0))
                total[f] = a + z * len(own) / len(examples), b + n * len(own) / len(examples)
        state = total
    return {f: weight(zn) for f, zn in state.items()}


def test_quality_model_is_that_of_plain_loops(spark):
    rng = random.Random(3)
    good, bad = ["The", "river", "runs", "South.", "It", "is", "old"], ["BUY", "now!!", "now", "9", "$$$", "click", "here"]
    text = lambda own, other: " ".join(rng.choice(own if rng.random() < 0.8 else other) for _ in range(rng.randrange(1, 12)))
    rows = [(i, *((text(good, bad), 1) if i % 3 else (text(bad, good), 0))) for i in range(60)] + [(100, None, 1), (101, "no label", None), (102, "", 0)]
    w = plain_quality(rows, 2, 3)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"), shards=2, rounds=3)
    asked = [(200 + i, text(good, bad) if i % 2 else text(bad, good)) for i in range(20)] + [(300, None), (300, ""), (None, "The river"), (301, "unseen words")]
    want = [(str(d), 1 / (1 + np.exp(-w["bias"] - sum(w.get(f, 0) * v for f, v in plain_features(t or "").items())))) for d, t in asked]
    got = [(str(r["doc_id"]), r["own"]) for r in quality.score(spark.createDataFrame([(*a, "clash") for a in asked], "doc_id long, text string, quality string"), model).withColumnRenamed("score", "own").collect()]
    assert [d for d, _ in sorted(got)] == [d for d, _ in sorted(want)] and np.allclose([s for _, s in sorted(got)], [s for _, s in sorted(want)], atol=1e-4)
    assert max(s for _, s in got) > 0.7 and min(s for _, s in got) < 0.3
    assert quality.score(spark.createDataFrame([], "doc_id long, text string, quality string"), model).count() == 0


@pytest.mark.parametrize("part", [1, 2, 7, 50])
def test_ngrams_and_tokens_of_long_texts_are_those_of_their_pieces(monkeypatch, tiktoken_encoding, part):
    """What tasks do with texts that are longer than a piece, with pieces of a few characters."""
    rng = random.Random(part)
    texts = [*ODD[:6], *("".join(rng.choice("abé Z,.\n 日") for _ in range(rng.randint(0, 120))) for _ in range(30))]

    def counted():
        out = set()
        for piece in language_id.pieces(texts):
            for row, bucket in language_id.ngrams(*piece):
                for pair in zip(row.tolist(), bucket.tolist()):
                    out.add((*pair, sum(x[:2] == pair for x in out)))
        return out

    whole, code = counted(), byte_bpe.Coder(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), byte_bpe.default_pattern())
    monkeypatch.setattr(language_id, "PART", part)
    monkeypatch.setattr(byte_bpe, "PART", part)
    assert counted() == whole and whole
    for t in filter(None, texts):
        ids = np.frombuffer(code.encode(t), "<u4").tolist()
        assert ids == tiktoken_encoding.encode_ordinary(t) and code.decode(np.array(ids, "<u4").tobytes()) == t.encode()
