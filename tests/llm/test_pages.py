import pytest
from pyspark.sql import functions as F

from tarnweave.llm import boilerplate, residue, stuffing, truncation

PROSE = [f"The {a} {b} follows the {c} near the old {d}, and nobody in the {b} counts the {c} again." for a, b, c, d in [("quiet", "river", "road", "bridge"), ("small", "team", "map", "house"), ("narrow", "street", "market", "tower"), ("old", "garden", "wall", "door")]]


def texts_of(df, *cols):
    return {r[0]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_residue(spark):
    long = " ".join(PROSE)
    rows = [
        (1, "Home News Shop Search Error 404. The page /a/b was not found on this server. © 2025 Site. All rights reserved.", "error"),
        (2, "Please enable JavaScript to view this page.", "script"),
        (3, f"{long} Please enable JavaScript to view this page.", None),
        (4, f"{long} The {{{{ name }}}} is here today. ", "slot"),
        (5, f"{long} In the X engine the expression {{{{ name }}}} is replaced by the value at run time.", None),
        (6, f"{long} Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
        (7, "Printers have used the words lorem ipsum as filler since long before the question of this town.", None),
        (8, "Price: undefined EUR, NaN left", "slot"),
        (9, "", "none"), (10, None, "none"), (11, "   ", "none"),
        (12, "Open daily from 9 to 17.", None),
        (None, "You need to enable JavaScript to run this app.", "script"),
        (13, long * 500, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "seq long, body string").withColumn("leaf", F.lit("clash")).withColumn("words", F.lit(1))
    got = texts_of(residue.residue_scores(df, id_col="seq", text_col="body"), "reason")
    assert got == {i: reason for i, _, reason in rows if reason != "none"}
    assert residue.residue_scores(df.limit(0), id_col="seq", text_col="body").count() == 0
    assert residue.mine_templates(df, "body").where("verdict = 'error'").count() >= 1


UNSEEN = ["We couldn't load this content right now.", "This article has been removed by its owner.", "Deze pagina bestaat niet meer.", "The shelf you asked for stands empty today."]


def test_messages_of_unseen_wording(spark):
    """The company of a template decides where no wording is known: it recurs alone, in records that failed."""
    rows = [(10 * k + i, f"http://h{i}.test/p{k}", 503 if i % 2 else 200, f"Zine Boards Wiki{i} {m}" if i == 3 else m if i else f"{m} Item {k}{i}x.") for k, m in enumerate(UNSEEN) for i in range(6)]
    rows += [(1000 + i, f"http://h{i}.test/a", 200, f"{' '.join(PROSE)} Story number {i}. {UNSEEN[0]}") for i in range(1)]
    rows += [(2000 + i, f"http://h{i}.test/o", 200, f"Open daily from {i} to 17.") for i in range(8)]
    df = spark.createDataFrame(rows, "seq long, url string, status int, body string")
    got = {r.seq for r in residue.residue_scores(df, id_col="seq", text_col="body", status_col="status", url_col="url").where("residue").collect()}
    wanted = {r[0] for r in rows if r[0] < 1000}
    assert len(got & wanted) >= 0.8 * len(wanted) and not {s for s in got if s >= 1000}
    alone = residue.residue_scores(df.withColumn("status", F.lit(None).cast("int")), id_col="seq", text_col="body", status_col="status", url_col="url")
    assert alone.where("residue").count() == 0


def test_company_merges_over_leaves():
    kind = residue.by_company
    assert kind(10, 10, 0, 4, 0b1111, 1, 5) == "error" and kind(10, 10, 6, 0, 0b1111, 1, 5) == "error"
    assert kind(10, 10, 0, 0, 0b1111, 1, 5) is None and kind(10, 5, 6, 6, 0b1111, 1, 5) is None and kind(10, 10, 6, 0, 0b1, 1, 5) is None
    assert kind(100, 20, 0, 0, 2**40 - 1, 2**20 - 1, 5) == "furniture"


def test_templates_merge_in_any_order():
    a, b, c = ("x 1 y z".split(), "x 2 y z".split(), "x 1 y w".split())
    merge = residue.in_common
    assert merge(merge(a, b), c) == merge(a, merge(b, c)) == merge(merge(c, a), b)


def test_stuffing(spark, sf):
    model = stuffing.fit_prose_model(spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet"), text_col="text", language_col="lang")
    rows = [
        (1, "cheap watches best tickets discount sofas " * 12, True),
        (2, " ".join(f"#cheap{i}shoes" for i in range(60)), True),
        (3, " | ".join(f"Brand{chr(65 + i % 26)}ex phones" for i in range(60)), True),
        (4, " ".join(f"Mark{chr(65 + i % 26)}on B-{i}21 boots size {i} black" for i in range(30)), True),
        (5, None, None), (6, "", None), (7, "cheap watches", False),
        (8, " ".join("{{ name }} [Your title] ${city}" for _ in range(40)), False),
    ]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "seq long, body string").withColumn("links", F.array(F.lit("u"))).withColumn("words", F.lit("clash"))
    got = texts_of(stuffing.stuffing_scores(df, model, id_col="seq", text_col="body", links_col="links"), "stuffed")
    assert got == {i: w for i, _, w in rows if w is not None}
    prose = spark.read.parquet(f"{sf}/documents.parquet")
    scored = stuffing.stuffing_scores(prose, model, id_col="doc_id", text_col="text")
    assert scored.where("stuffed").count() <= 0.01 * prose.count()
    assert stuffing.stuffing_scores(df.limit(0), model, id_col="seq", text_col="body").count() == 0


def test_perplexity_decides(sf):
    """Prose without any sentence end is none of ended sentences either; its perplexity alone spares it."""
    import re

    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table(sf.replace("sf0.001", "sf0.01") + "/documents.parquet", columns=["text", "lang"]).to_pylist() if r["text"]]
    model = stuffing.ProseModel.fit([r["text"] for r in rows], [(r["lang"] or "").strip().lower()[:2] for r in rows])
    texts = [t for r in rows if len((t := re.sub(r"[.!?…]", " ", r["text"])).split()) >= 45]
    assert sum(not stuffing._of_sentences(t) for t in texts) > 0.95 * len(texts)
    shares = [(abnormal / words, model.page("cheap watches best tickets discount sofas " * (words // 6))) for words, abnormal, _, _, _ in map(model.page, texts)]
    assert max(share for share, _ in shares) < 0.6 and min(page[1] / page[0] for _, page in shares) > 0.6


def test_short_stuffing(spark, sf):
    model = stuffing.fit_prose_model(spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet"), text_col="text", language_col="lang")
    rows = [(1, "cheap watches best tickets discount sofas " * 4, True), (2, " ".join(f"#cheap{i}shoes" for i in range(20)), True), (3, "Error 500. Something went wrong on our side, reference 1xuqkbw. Please try again later.", False), (4, "cheap watches", False)]
    df = spark.createDataFrame([r[:2] for r in rows], "seq long, body string")
    assert texts_of(stuffing.stuffing_scores(df, model, id_col="seq", text_col="body"), "stuffed") == {i: w for i, _, w in rows}


def test_the_prose_model_is_fitted_on_all_texts(spark):
    """Words, endings, counts and bounds are those of all rows, however they are split; a sample of 4,000 has others."""
    import random
    from collections import Counter

    rng = random.Random(4)
    some = ["the", "of", *(f"{a}{b}{c}" for a in "bdfgk" for b in ("ar", "el", "on") for c in ("ing", "ed", "er", "s"))]
    rows = [(" ".join(rng.choices(some, weights=range(len(some), 0, -1), k=rng.randrange(6, 14))) + f" {i}.", "EN " if i % 3 else None) for i in range(4600)]
    df = spark.createDataFrame([*rows, (None, "en"), ("", "en"), rows[0]], "t string, lang string")
    model = stuffing.fit_prose_model(df, text_col="t", language_col="lang")

    rows = [*rows, ("", "en")]
    expected = stuffing.ProseModel.fit([t for t, _ in rows], [(lang or "").lower()[:2] for _, lang in rows])
    assert model == expected and model.function_words and model.endings and 0 < model.low < model.high
    classes = [model.classes(t) for t, _ in rows]
    others = stuffing.ProseModel(model.function_words, model.endings)
    others.learn(stuffing.ClassCounts(Counter(x for own in classes[1:] for x in stuffing._triples(own))))
    every = stuffing.ClassCounts(Counter(x for own in classes for x in stuffing._triples(own)))
    assert every.costs_apart(classes[0]) == pytest.approx(others.costs_of(classes[0]))
    assert model == stuffing.fit_prose_model(df.repartition(5), text_col="t", language_col="lang")


def test_a_prose_model_without_prose(spark):
    empty = spark.createDataFrame([(None, None)], "t string, lang string")
    model = stuffing.fit_prose_model(empty, text_col="t", language_col="lang")
    assert not model.function_words and not model.costs and model.high == float("inf")
    pages = spark.createDataFrame([(1, "cheap watches best tickets " * 20)], "seq long, body string")
    assert stuffing.stuffing_scores(pages, model, id_col="seq", text_col="body").where("stuffed").count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>.x{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<div class="c1">News › Shop › Headline here</div><p class="notice">We use cookies to improve your visit. Accept all or change your settings.</p>
<section><h1>Headline here</h1><p class="by">By Ann Other on 2 May 2025</p><ul><li>Print</li><li>Copy link</li></ul>
<p>The first <b>long</b> paragraph says what happened &amp; where it did, in many words.</p><!-- x --><p>Read on.<p>Our bakery gave away cookies and asked every guest to accept one with a smile.
<h2>A subhead of it</h2><blockquote>Somebody said something worth quoting at this length.</blockquote><ul><li>first entry of the list</li><li>second one</li></ul>
<p>Sponsored: save 20 percent on garden chairs this week.</p><figure><figcaption>A caption below a picture of the place.</figcaption></figure>
<script>var a = "<p>no</p>";</script><h3>Comments</h3><p>Jo: First!</p></section>
<aside><h3>Related articles</h3><ul><li>Another headline of the site</li></ul><p class="bio">After many days the author of this text wrote another one about the same place.</p></aside>
<footer><p>© 2025 Site. All rights reserved.</p></footer></body></html>"""
BLOCKS = ["Headline here", "The first long paragraph says what happened & where it did, in many words.", "Read on.", "Our bakery gave away cookies and asked every guest to accept one with a smile.", "A subhead of it", "Somebody said something worth quoting at this length.", "first entry of the list", "second one", "A caption below a picture of the place."]


def test_main_blocks(spark):
    flat = PAGE.replace("<section>", "").replace("</section>", "")
    table = PAGE.replace("<section>", "<table><tr><td>").replace("</section>", "</td>").replace("<aside>", "<td>").replace("</aside>", "</td></tr></table>")
    rows = [(1, PAGE), (2, flat), (3, table), (1, PAGE), (4, None), (5, ""), (6, "   "), (7, "plain text only, with no tag around it"), (None, PAGE), (8, "<html><body><h1>Only</h1>"), (9, "<p>" + "word " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("tag", F.lit(0))
    got = {}
    for r in boilerplate.main_blocks(df).orderBy("page_id", "block").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[2] == got[3] == got[None] == BLOCKS
    assert sorted(got[1]) == sorted(BLOCKS * 2)
    assert 4 not in got and 5 not in got and 6 not in got and got[8] == ["Only"] and len(got[9]) == 1
    assert boilerplate.main_blocks(df.limit(0)).count() == 0


def test_main_blocks_in_boxes():
    text = lambda html: [x.text for x in boilerplate.main_lines(html)]
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
    end = "<footer><p>© 2025 Site. All rights reserved.</p></footer>"
    side = "<aside><h3>Related articles</h3><ul><li>Another headline of the site</li></ul></aside>"
    head = "<header><h1>Headline here</h1><p class=by>By Ann Other on 2 May 2025</p></header>"
    a, b, c, d = PROSE
    assert text(f"<html><body>{nav}<article>{head}<p>{a}</p><p>{b}</p></article>{side}{end}</body></html>") == ["Headline here", a, b]
    boxed = f"<p>{a}</p><div><p>{b}</p></div>{side}<section><h2>A subhead of it</h2><p>{c}</p></section><table><tr><td>{d}</td></tr></table><p>Read on.</p>"
    assert text(f"<html><body>{nav}<article><h1>Headline here</h1>{boxed}</article>{end}</body></html>") == ["Headline here", a, b, "A subhead of it", c, d, "Read on."]
    related = "<div><div><h3>Related</h3></div><ul><li>Another headline of the site</li><li>One more of its headlines</li></ul></div>"
    assert text(f"<html><body>{nav}<article>{head}<div><p>{a}</p><p>{b}</p>{related}</div><p>{c}</p></article>{side}{end}</body></html>") == ["Headline here", a, b, c]
    assert text(f"<html><body>{nav}<h1>Headline here</h1><p>{a}</p><div><p>{b}</p></div>{side}<p>One more line about the author.</p>{end}</body></html>") == ["Headline here", a, b]


UNLISTED = f"""<html><body><div class=top><a href=/>Start</a> <a href=/a>All</a> <a href=/z>Zine</a></div><div><h1>Headline here</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p><h2>Sub</h2><p>{PROSE[2]}</p>
<h3>Reader opinions</h3><p>Jo: Fine text</p><p>Ann: I like the map!</p><h3>More stories</h3><ul><li><a href=1>Old bridge closed</a></li><li><a href=2>New map found</a></li><li><a href=3>The market moves</a></li></ul></div>
<div><a href=/i>Who we are</a> <a href=/j>Jobs</a></div></body></html>"""


def test_parts_under_headings_of_any_wording():
    assert [x.text for x in boilerplate.main_lines(UNLISTED)] == ["Headline here", PROSE[0], PROSE[1], "Sub", PROSE[2]]


def test_ratios_decide(monkeypatch, sf):
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table(f"{sf}/page_contents.parquet")["html"].to_pylist() if h]
    blocks = lambda: [{x.text for x in boilerplate.main_lines(h)} for h in pages]
    before, real = blocks(), boilerplate.smoothed_ratios
    monkeypatch.setattr(boilerplate, "smoothed_ratios", lambda lines: [0.0] * len(lines))
    assert not any(blocks())
    monkeypatch.setattr(boilerplate, "smoothed_ratios", lambda lines: [1 / (1 + r) for r in real(lines)])
    kept = sum(len(a & b) for a, b in zip(before, blocks(), strict=True))
    assert kept < 0.75 * sum(map(len, before))


def test_block_md5():
    assert boilerplate.block_md5("é") == __import__("hashlib").md5("é".encode()).hexdigest()


def test_flat_text(spark):
    body = " ".join(PROSE)
    df = spark.createDataFrame([(1, f"Site News Home News Shop Search We use cookies to improve your visit. Accept all or change your settings. {body} © 2025 Site. All rights reserved."), (2, None), (3, "")], "seq long, t string")
    got = texts_of(boilerplate.flat_main_text(df, id_col="seq", text_col="t"), "main_text")
    assert list(got) == [1] and got[1] == body


def test_flat_text_by_region():
    body = " ".join([*PROSE, "“The baker gave away one cookie.”", "Read on."])
    titles = "Regional cookie without Ashulm Western shard in Ostdol Narrow frost and Ferost"
    head = "Site News Home News Shop Search We use cookies to improve your visit. Accept all or change your settings. By Ann Other on 2 May 2025"
    tail = f"Send by mail Copy link Share this page Related articles {titles} Enter your email to join 26 other readers. © 2025 Site. All rights reserved."
    assert boilerplate.main_text_of_flat(f"{head} {body} {tail}") == body
    assert boilerplate.main_text_of_flat(f"{body} Comments Jo: A fine text, thank you! Ann: I see it in another way. Site: All rights reserved.") == body
    assert boilerplate.main_text_of_flat(f"{body[:-9]} and nobody said more Copy link Print {titles}").startswith(body[:-9])
    assert boilerplate.main_text_of_flat(body) == body and boilerplate.main_text_of_flat("no sentence here") == "no sentence here"
    assert boilerplate.main_text_of_flat("© 2025 Site. All rights reserved.") == ""


@pytest.fixture(scope="module")
def endings(spark):
    usual = ["— Ann Other", "Source: https://h.test/12345", "Tags: house, letter", "(Photo: Ann)", "Last update: 3 May 2025", "And nobody knows what the walk of Ann will bring…"]
    names = ["Ann", "Bob", "Cleo", "Dora", "Emil", "Fay"]
    rows = []
    for i in range(240):
        body = " ".join(PROSE[(i + k) % 4] for k in range(3))
        tail = usual[i % 6].replace("Ann", names[i % 5])
        rows.append((i, f"{body} {tail}" if i % 3 == 0 else f"{body} “{PROSE[i % 4]}”" if i % 3 == 1 else body))
    whole = " ".join(PROSE)
    cut = [(1000, whole[:94]), (1001, whole[:81].rstrip() + "…"), (1002, whole[:120].rsplit(" ", 1)[0] + " [...]"), (1003, whole[:90] + "�"), (1004, whole[:130].rsplit(" ", 1)[0] + "... Read more"), (1005, whole[:150].rsplit(" ", 1)[0] + " ")]
    other = [(2000, None), (2001, ""), (2002, "  "), (None, whole[:94])]
    df = spark.createDataFrame([*rows, *cut, *other], "doc_id long, text string").withColumn("log_odds", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") >= 1000, "cut").otherwise("usual"))
    return df, {i for i, _ in cut} | {None}


def test_truncation(spark, endings):
    df, wanted = endings
    scores = truncation.ending_scores(df.drop("log_odds"), keep=["source"]).cache()
    assert {r.doc_id for r in scores.where("truncated").collect()} == wanted
    assert scores.count() == df.where("trim(text) <> ''").count()
    rates = {r.source: (r.texts, r.truncated) for r in truncation.truncation_rates(scores, F.col("source")).collect()}
    assert rates["cut"] == (6, 6) and rates["usual"][1] == 1  # the row without an id
    assert truncation.ending_scores(df.limit(0)).count() == 0
    assert truncation.ending_scores(df).count() == scores.count()  # a clashing column that isn't kept


def test_one_context_hashes_like_many():
    text = "ärgerlich — ok"
    codes = __import__("numpy").array([ord(c) for c in text], dtype="uint64")
    for n in truncation.ORDERS:
        assert list(truncation._context_hashes(codes, n, "de")) == [truncation._context_hash(text[i : i + n], "de") for i in range(len(text) - n + 1)]


def test_full_stop_inside_a_sentence(spark):
    names = ["Ann", "Bob", "Cleo", "Dora", "Emil", "Fay"]
    rows = [(i, " ".join([*PROSE, f"It is day {i}.", f"In the morning Dr. {names[i % 6]} walked to the old house.", PROSE[i % 4], f"After that Dr. {names[(i + 1) % 6]} left."])) for i in range(400)]
    cut = [(1000, f"{PROSE[0]} In the morning Dr."), (1001, f"{PROSE[1]} {PROSE[2]} After that Dr.")]
    scores = truncation.ending_scores(spark.createDataFrame(rows + cut, "doc_id long, text string")).where("truncated").collect()
    assert {r.doc_id for r in scores} == {1000, 1001} and all(r.log_odds < -5 for r in scores)


def test_copies_and_long_beginnings_are_no_usual_endings(spark):
    whole = [(i, " ".join(PROSE[(i + k) % 4] for k in range(3)) + f" It is {i}.") for i in range(40)]
    copies = [(1000 + i, f"{PROSE[0]} {PROSE[1][:60].rsplit(' ', 1)[0]}") for i in range(8)]
    words = "the old road leads along a river and a wall to the small house behind the narrow tower and on"
    long = [(3000 + i, f"{PROSE[i % 4]} Here {' '.join(w + c for w in words.split())}") for i, c in enumerate("abcdefgh")]
    told = [(2000 + i, f"{PROSE[i % 4]} Here {' '.join(w + c for w in words.split())} to the end of it.") for i, c in enumerate("ijklmnopqrstuvwx")]
    scores = truncation.ending_scores(spark.createDataFrame(whole + copies + long + told, "doc_id long, text string")).where("truncated").collect()
    assert {r.doc_id for r in scores} == {i for i, _ in copies + long}


def test_class_counts_decide(sf):
    """Without the counts, or with those of other contexts, no ending is a usual one."""
    import numpy as np
    import pyarrow.parquet as pq

    texts = {t for t in pq.read_table(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")["text"].to_pylist() if t and t.strip()}
    endings = [truncation._Ending(t, "en") for t in sorted(texts)]
    counts = np.zeros((truncation.ROWS, truncation._SIZE))
    truncation._add(counts, endings)
    load = counts[1:-2:2].mean(axis=1)
    open_ends = [e for e in endings if not e.terminated]
    least = -np.log(np.mean([len(t) for t in texts])) + truncation.MARGIN

    def whole(model):
        return int((truncation._class_scores(model, load, open_ends) >= least).sum())

    assert whole(counts) > 0.1 * len(open_ends)
    assert whole(np.zeros_like(counts)) == 0 and whole(np.roll(counts, 77, axis=1)) < 0.2 * whole(counts)


def test_odd_texts(spark):
    """Signs without a class, of other planes, or none at all; a text of a million words."""
    rows = [(1, "The quiet river follows the old road. " * 130_000), (2, ""), (3, None), (None, "x"), (4, "\x00 a\x00b"), (5, "…"), (6, "\ufffd"), (7, "🙂 a text with a smile 🙂"), (8, "   \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit("clash")).withColumn("_lang", F.lit("c"))
    got = {r.doc_id: r.truncated for r in truncation.ending_scores(df).collect()}
    assert set(got) == {1, None, 4, 5, 6, 7} and got[1] is False and got[6] is True


def test_symbols():
    stream, ends = truncation.symbols(["Ab’c d12 “(X)”", "https://h.test/abc Zé"])
    pad = [truncation._START] * truncation.ORDERS[-1]
    a, up, sp, d = truncation._LOWER, truncation._UPPER, truncation._SPACE, truncation._DIGIT
    assert stream.tolist() == [*pad, up, sp, a, d, d, sp, 16 + ord("("), up, 16 + ord(")"), *pad, 16 + 0xE004, sp, up]
    assert ends.tolist() == [len(pad) + 9, len(stream)]
    assert truncation.symbols(["a\x00b", "\x00", "", "🙂"])[0].tolist() == [*pad, a, sp, a, *pad, sp, *pad, *pad, 16 + ord("🙂")]
    marked, plain = truncation._end_keys([truncation._Ending("x " * 3000 + "(X)", "en"), truncation._Ending("", "en")])
    keys = truncation._class_keys(truncation.symbols(["x " * 3000 + "(X)"])[0])
    assert [int(plain[k][0]) for k in range(len(truncation.ORDERS))] == [int(keys[n][-1]) for n in truncation.ORDERS]
