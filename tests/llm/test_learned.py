"""Learned operators: held-out accuracy, odd rows; and the operators on pages, quotes and benchmarks."""

import random
import zlib

import numpy as np
import pytest
from corpus import documents, frame, prose

from strandlake.llm import decontaminate, langid, neardup, pagetext, quotes, toxicity


def _labelled(n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        t, bad = prose(rng, rng.choice([20, 60, 200])), i % 4 == 0
        if bad:
            words = t.split(" ")
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "moronic", "worthless"]))
            t = " ".join(words)
        rows.append((i, t, "en", "s", 0, 0.5, 7))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _labelled()
    rows += [(1000, None, None, None, 0, 0.0, 0), (1001, "", "en", "s", 0, 0.0, 0), (1, rows[1][1], "en", "s", 0, 0.0, 0)]
    got = toxicity.held_out_query(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_toxicity_learns_from_bounded_bytes(spark):
    import pyarrow as pa

    sized = pa.table({"doc_id": [1, 2, 3, 4, 5], "y": [0, 0, 0, 1, 1], "place": [3, 1, 2, 9, 8], "size": [10, 50, 60, 500, 1]})
    assert toxicity.within(sized, 100) == [(2, 0), (1, 0), (5, 1)]
    assert toxicity.within(sized, 5) == [(2, 0), (5, 1)]
    rows, labels = _labelled(60)
    rows.append((999, "idiotic " * 100_000, "en", "s", 0, 0.0, 0))
    got = toxicity.held_out_query(frame(spark, rows), spark.createDataFrame([*labels, (999, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    assert toxicity.held_out_query(frame(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_without_labels(spark):
    rows, _ = _labelled(5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.held_out_query(frame(spark, rows), none).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1


def test_language_on_held_out_rows(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        lang = "ab"[i % 2]
        t = prose(rng, rng.choice([5, 40]))
        rows.append((i, t if lang == "a" else t.translate(str.maketrans("aeiot", "üöäyk")), lang, "s", 0, 0.0, 0))
    rows += [(900, None, "a", "s", 0, 0.0, 0), (901, "123 !!", None, "s", 0, 0.0, 0), (902, "", "a", "s", 0, 0.0, 0)]
    got = {r["doc_id"]: r for r in langid.held_out_query(frame(spark, rows)).collect()}
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    held = [got[i] for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and np.mean([r["lang_pred"] == "ab"[r["doc_id"] % 2] for r in held]) > 0.98


def _counted_model(langs=4, seed=5):
    rng = np.random.default_rng(seed)
    return langid.Model.of({f"l{k}": rng.integers(0, 50, 1 << langid.BITS).astype(float) for k in range(langs)}, dict.fromkeys([f"l{k}" for k in range(langs)], 7))


def _plain_scores(model, text):
    """Log-likelihoods by plain loops over the n-grams of one text."""
    cp, offsets = langid.code_points([text.lower()])
    ll = model.prior.copy()
    for n in langid.SIZES:
        for k in range(len(cp) - n + 1):
            g = langid.aligned(cp[k : k + n], np.array([0, n]), n, langid.BITS)[0][0]
            ll += model.logp[g]
    return ll


def test_language_depends_on_the_text_alone(monkeypatch):
    rng = random.Random(3)
    model = _counted_model()
    texts = ["hello", "", "a", prose(rng, 40), "x", prose(rng, 300), "hello", None, "Zz top"]
    alone = [model.predict([t]) for t in texts]
    for cells in (langid.CELLS, 400, 4):
        monkeypatch.setattr(langid, "CELLS", cells)
        names, scores = model.predict(texts)
        for k, (name, score) in enumerate(alone):
            assert names[k] == name[0] and scores[k] == pytest.approx(score[0], rel=1e-12)
    monkeypatch.undo()
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        names, scores = model.predict(order)
        assert [(n, float(s)) for n, s in zip(names, scores, strict=True)] == [(model.predict([t])[0][0], float(model.predict([t])[1][0])) for t in order]
    for t in ("hello", "a", texts[3]):
        ll = _plain_scores(model, t)
        name, score = model.predict([t])
        assert name == [model.langs[int(ll.argmax())]] and score[0] == pytest.approx(1 / np.exp(ll - ll.max()).sum(), rel=1e-5)


def test_language_counts_of_many_texts_add_up():
    texts = ["ab", "c", "", None, "déjà vu", "ab"]
    assert (langid._bucket_counts(texts) == sum(langid._bucket_counts([t]) for t in texts)).all()


def test_language_ties_and_repeated_rows(spark):
    even = langid.Model.of(dict.fromkeys("ba", np.ones(1 << langid.BITS)), {"a": 3, "b": 3})
    assert even.predict(["some text"])[0] == ["a"] and even.predict(["some text"])[1][0] == pytest.approx(0.5)
    rows = [(1, "some text", "en", "s", 0, 0.0, 0)] * 3 + [(None, "some text", "en", "s", 0, 0.0, 0), (2, prose(random.Random(1), 60_000), "en", "s", 0, 0.0, 0)]
    got = langid.predict(frame(spark, rows), even).collect()
    assert len(got) == 5 and len({(r["lang_pred"], r["score"]) for r in got[:4]}) == 1


def test_language_without_rows(spark):
    assert langid.held_out_query(frame(spark, [])).count() == 0
    one = frame(spark, [(2, "hello", None, "s", 0, 0.0, 0)])
    assert langid.held_out_query(one).first()["lang_pred"] == "und"


QUESTION = "Say if Anna buys 12 apples for 5 dollars each, how much does Anna pay for 12 apples in total today?"


def _find(spark, texts):
    docs = frame(spark, [(i, t, "", "", 0, 0.0, 0) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(7, QUESTION, 1), (8, "short", 1), (9, None, 1), (7, QUESTION, 1)], "item_id long, text string, doc_id int")
    return {r["doc_id"]: r["reparameterised"] for r in decontaminate.find(docs, bench).collect()}


def test_templates_and_slot_consistency(spark):
    other = "so it is. Say if Bob buys 17 apples for 9 euros each, how much does Bob pay for 17 apples in total today? yes"
    broken = other.replace("pay for 17", "pay for 18")
    assert _find(spark, [QUESTION, other, broken, None, "", "just 12 apples for 5 dollars each", QUESTION * 2]) == {0: False, 1: True, 6: False}


def test_plain_leaks_like_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(15, 50))) for i in range(20)]
    rows, want = [], set()
    for d in range(100):
        t = prose(rng, 150)
        if d % 5 == 0:
            i, passage = items[d % 20]
            t = t + " " + passage + " " + prose(rng, 30)
            want.add((d, i))
        rows.append((d, t, "", "", 0, 0.0, 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame(spark, rows), bench).collect()} == want
    kept = decontaminate.keep_clean(frame(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(100)) - {d for d, _ in want}
    assert decontaminate.find(frame(spark, []), bench).count() == 0


def test_short_and_value_only_items(spark):
    items = [(1, "What is the capital of France?"), (2, "17 + 25 = 42"), (3, "12 3 4.5 67 8 90 11 13 14"), (4, ""), (5, " ")]
    texts = ["So tell us. What is the capital of France? Thanks", "we know that 17 + 25 = 42 here", "we know that 17 + 26 = 43 here", "sums 12 3 4.5 67 8 90 11 13 14 end", "sums 12 3 4.5 67 8 90 11 99 14 end", "capital of France?", "", None]
    got = decontaminate.find(frame(spark, [(i, t, "", "", 0, 0.0, 0) for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["reparameterised"]) for r in got} == {(0, 1): (1, 1, False), (1, 2): (1, 1, False), (3, 3): (2, 2, False)}


def test_spelt_numbers_fill_slots(spark):
    item = "If a farmer buys twelve sheep at 9 euros each and sells three of them, how many are left over now?"
    texts = ["If a farmer buys twenty sheep at 7 euros each and sells Five of them, how many are left over now?", "so If a farmer buys twelve sheep at 9 euros each and sells three of them, how many are left over now?", "nothing like it, three of them at most"]
    got = decontaminate.find(frame(spark, [(i, t, "", "", 0, 0.0, 0) for i, t in enumerate(texts)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["reparameterised"] for r in got.collect()} == {0: True, 1: False}


def test_decontamination_matches_sql(spark):
    import duckdb

    rng = random.Random(15)
    names, numbers, units = ["Anna", "Bob", "Zoë", "O'Neil"], ["12", "7", "3.5", "1,200", "twelve", "sixty"], ["km", "%", " euros", " kg", "", " hours"]
    pieces = [lambda: rng.choice(numbers) + rng.choice(units), lambda: rng.choice(names), lambda: prose(rng, 1), lambda: prose(rng, 1), lambda: prose(rng, 2) + rng.choice([",", ".", "\n", "  "])]
    make = lambda n, q=(3, 3, 6, 6, 6): " ".join(rng.choices(pieces, q)[0]() for _ in range(n))
    items = [(i, make(rng.choice([2, 5, 9, 20, 40]))) for i in range(40)] + [(40, "12 7 3 5 90 11 4 8 6"), (41, "What is it?"), (42, " "), (40, "a second text of forty is here and long")]

    def changed(text):
        for old in rng.sample(numbers + names, 3):
            text = text.replace(old, rng.choice(numbers if old in numbers else names))
        return text

    docs = []
    for i in range(150):
        item = rng.choice(items)[1]
        docs.append((i, make(30) + " " + rng.choice([item, changed(item), changed(item), " ".join(item.split(" ")[: rng.randint(1, 20)])]) + " " + make(20)))
    docs += [(900, None), (901, ""), (902, "  "), (5, docs[5][1])]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({decontaminate.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 80 and {x[4] for x in want} == {True, False}


def test_many_benchmark_windows_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(4, 30)) + rng.choice(["", " 12 of 7"])) for i in range(30)]
    texts = [prose(rng, 60) + " " + rng.choice(items)[1] + " " + prose(rng, 5) if i % 3 else prose(rng, 3000) for i in range(40)] + [None, "", items[0][1]]
    docs, bench = frame(spark, [(i, t, "", "", 0, 0.0, 0) for i, t in enumerate(texts)] + [(0, texts[0], "", "", 0, 0.0, 0)]), spark.createDataFrame([(*x, 1, "h") for x in items], "item_id long, text string, doc_id int, hash string")
    few = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontaminate.find(docs, bench).collect())) == few and len(few) > 20


PAGE = """<html><head><title>T</title></head><body><header>Site</header><nav><ul><li>a</li></ul></nav><div class="cookie-notice">We use</div><main><article><header><h1>Ti&amp;t</h1></header><p><b>One<br><p>Two  x&nbsp;y {}</p><ul><li>i1<li>i2</ul><div id="comments"><p>c</p></div><script>var t="</p>";</script><form><input>f</form><p>End &lt;b&gt; <i>it</i>alic</article></main><footer>F</footer></body></html>"""


def test_page_extraction():
    assert pagetext.extract(PAGE.format("z")) == "Ti&t\nOne\nTwo x y z\ni1\ni2\nEnd <b> italic"
    assert pagetext.extract(None) == pagetext.extract("") == pagetext.extract("<nav>x</nav>") == ""
    assert pagetext.extract("plain <b>x</b> & y < z") == "plain x & y < z"
    assert pagetext.extract("<div>" * 5000 + "deep") == "deep"


PAGES = "page_id long, url string, html string, text int, host int, page int, subtrees int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], PAGES)


def _plain_templates(rows):
    """(host, hash) by dictionaries, from the module's hashes of single pages."""
    pages, seen = {}, {}
    for _, url, html in rows:
        host = (url or "").partition("://")[2].partition("/")[0].lower()
        whole, mine = pagetext.page_hashes(html)
        pages.setdefault(host, set()).add(whole)
        for h, inside in mine:
            seen.setdefault((host, h, inside), set()).add(whole)
    least = lambda host, inside: max(pagetext.MIN_INSIDE, pagetext.MIN_SHARE * len(pages[host])) if inside else pagetext.MIN_PAGES
    return {(host, h) for (host, h, inside), found in seen.items() if len(found) >= least(host, inside)}


def _site(rng, n, host, marked=True):
    """Pages of one site: menus and footers of other words on each page, an article with a paragraph that some repeat."""
    rows, want = [], []
    shared = prose(rng, 25)
    for i in range(n):
        body = [prose(rng, 6), *(prose(rng, 30) for _ in range(rng.randint(1, 4))), *([shared] if i % 3 == 0 else [])]
        menu = "".join(f'<li><a href="/{k}">{prose(rng, 1)}</a></li>' for k in range(rng.randint(3, 7)))
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:])
        # Element names and classes that no list holds.
        html = f'<html><head><title>t</title></head><body><div class="x1"><ul>{menu}</ul></div><div class="x2">Call {rng.randint(0, 9999)}</div>' + (f"<article>{inner}</article>" if marked else f'<div class="z">{inner}</div>') + "<section>All rights kept by us</section></body></html>"
        rows.append((i, f"https://{host}/{i}", html))
        want.append("\n".join(body))
    return rows, want


def test_site_templates_go_without_the_lists(spark):
    rows, want = _site(random.Random(3), 40, "a.example")
    got = {r["page_id"]: r for r in pagetext.main_text(_pages(spark, rows), lists=False).collect()}
    assert [got[i]["text"] for i in range(40)] == want and all(r["by_method"] for r in got.values())


def test_site_templates_without_article_elements(spark):
    rows, want = _site(random.Random(4), 40, "b.example", marked=False)
    got = {r["page_id"]: r["text"] for r in pagetext.main_text(_pages(spark, rows), lists=False).collect()}
    # The menu goes by its links, the constant section by its content; a line of other words stays.
    assert all(got[i].split("\n")[1:] == want[i].split("\n") and got[i].startswith("Call ") for i in range(40))


def test_template_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = _site(rng, 25, "a.example")[0] + _site(rng, 3, "b.example")[0] + _site(rng, 1, "c.example")[0] + _site(rng, 12, "d.example", False)[0]
    rows += [(900 + i, "https://copies.example/x", "<section>same page</section><article><p>again</p></article>") for i in range(9)]
    rows += [(990, None, "<p>lone</p>"), (991, "https://A.example/up", rows[0][2]), (992, "https://a.example/none", None)]
    pages = _pages(spark, rows).select("page_id", "url", "html").withColumn("host", pagetext._host(pagetext.F.col("url"))).withColumn("page", pagetext.F.xxhash64("html"))
    assert {(r["host"], r["subtree"]) for r in pagetext.templates(pages).collect()} == _plain_templates(rows)


def test_site_templates_go_and_repeated_rows_stay(spark):
    rng = random.Random(1)
    own = [prose(rng, 20) for _ in range(30)]
    rows = [(i, f"https://h.example/{i}", f"<body><div>Follow us on all channels</div><p>{t}</p></body>") for i, t in enumerate(own)]
    rows += [(100 + i, "https://copies.example/x", "<p>same page again</p>") for i in range(30)]
    rows += [(200, None, None), (201, "not a url", "<p>lone</p>"), (0, "https://h.example/0", rows[0][2])]
    for limit in (pagetext.BROADCAST_TEMPLATES, -1):
        held, pagetext.BROADCAST_TEMPLATES = pagetext.BROADCAST_TEMPLATES, limit
        found = pagetext.main_text(_pages(spark, rows)).collect()
        pagetext.BROADCAST_TEMPLATES = held
        got = {r["page_id"]: r["text"] for r in found}
        assert len(found) == len(rows) and all(got[i] == t for i, t in enumerate(own))
        assert got[100] == "same page again" and got[200] == "" and got[201] == "lone"


def test_pages_without_rows_and_long_ones(spark):
    import time

    assert pagetext.main_text(_pages(spark, [])).count() == 0
    words = prose(random.Random(2), 900_000)
    long = "<nav>menu</nav><article>" + "".join(f"<p>{words[k : k + 4000]}</p>" for k in range(0, 5_000_000, 4000)) + "</article>"
    assert len(long) > 5_000_000
    (got,) = pagetext.main_text(_pages(spark, [(1, "https://l.example/", long)])).collect()
    assert got["text"] == "\n".join(x for x in (" ".join(words[k : k + 4000].split()) for k in range(0, 5_000_000, 4000)) if x)
    for odd in ("<a " * 1_500_000, "<a '" * 1_000_000, '<a "> ' * 300_000, "<div>" * 300_000 + "</p>" * 300_000, "<li><div>" + "<b>" * 200_000 + "<li></li>" * 200_000, "<!--" * 900_000, "<" * 3_000_000):
        began = time.time()
        pagetext.extract(odd)
        assert time.time() - began < 30


def test_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nThanks a lot"),
        (1, 1, "assistant", "Use sort."),
        (1, 2, "user", "Anna wrote:\n> How do I sort?\n>> deeper words\nI meant stable."),
        (1, 3, "assistant", "> Use   SORT.\nIs that stable?"),
        (1, 4, "user", "> never said\nwell"),
        (2, 5, "user", "> How do I sort?\nalone"),
        (2, 9, None, None),
        (None, 1, "user", "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_order(table).collect()}
    assert len(got) == len(rows)
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, 0, 0, 1, 3]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 1, 2, 3]
    assert [got[1, t]["text"] for t in range(5)] == ["How do I sort?\nThanks a lot", "Use sort.", "I meant stable.", "Is that stable?", "well"]
    assert got[1, 2]["n_quotes"] == 2 and got[1, 2]["n_linked"] == 1 and got[1, 4]["n_linked"] == 0
    assert [quotes.brute_force(rows)[k][2:] for k in range(5)] == [(got[1, t]["reply_to"], got[1, t]["n_linked"]) for t in range(5)]
    assert got[2, 5]["reply_to"] is None and got[2, 9]["thread"] == 9 and got[2, 9]["text"] is None
    assert quotes.reply_order(table.limit(0)).count() == 0


def test_quotes_wrapped_anew_and_common_lines(spark):
    long = "The scheduler keeps a queue of tasks. It gives each worker the oldest one that fits, and waits for the rest."
    wrapped = "> The scheduler keeps a queue\n> of tasks. It gives each worker\n> the oldest one that fits, and waits for the rest."
    rows = [
        (1, 0, "user", long + "\n\nThanks"),
        (1, 1, "assistant", "Thanks"),
        (1, 2, "user", "Thanks\n\nother words here"),
        (1, 3, "assistant", wrapped + "\n>\n> Thanks\nWhich task is that?"),
        (1, 4, "user", "> It gives each worker the\n> oldest one that fits, and waits for the rest.\n\nso?"),
    ]
    got = {r["turn"]: (r["reply_to"], r["n_linked"]) for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (0, 1)}


def test_quotes_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 14)):
            own = prose(rng, rng.choice([1, 4, 12])) + rng.choice(["", ". ", "\n\n"]) + rng.choice(["ok", "Thanks", prose(rng, 9)])
            quoted = ""
            if said and rng.random() < 0.6:
                words = rng.choice(said).split()
                quoted = rng.choice(["", "Bob wrote:\n"]) + "\n".join("> " + rng.choice(["", "> "]) + " ".join(words[k : k + 5]) for k in range(0, len(words), 5)) + "\n"
            said.append(own)
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", None]), quoted + own))
    rows += [rows[3], (None, 4, "user", "> ok\nx"), (3, None, "user", "> ok\ny"), (50, 1, None, None), (50, 2, "user", ""), (51, 1, "user", "> " + "long " * 50_000)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, unit int, source int, lines int")
    key = lambda r: tuple((x is None, x) for x in r)
    found = quotes.reply_order(table)
    got = sorted(((r["conv_id"], r["turn"], r["reply_to"], r["n_linked"]) for r in found.collect()), key=key)
    assert got == sorted(quotes.brute_force(rows), key=key)
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({quotes.SQL})").fetchall()
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_quotes_in_a_long_conversation(spark):
    table = spark.createDataFrame([(1, i, "user", f"m {i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["depth"], r["thread"]) for r in quotes.reply_order(table).collect()}
    assert got == {i: (i, 0) for i in range(300)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.5), (400, 0.75), (5000, 0.9)):
        e = []
        for _ in range(30):
            common = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**64, n - len(common), dtype=np.uint64)))) for _ in range(2))
            e.append(neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None])[0])
        true = len(common) / (2 * n - len(common))
        assert abs(np.mean(e) - true) < 0.03


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    key = "0123456789abcdef" * 3
    items = [(1, prose(rng, 40))]
    good = prose(rng, 200)
    texts = [good, good, prose(rng, 150) + f" token={key} " + prose(rng, 50), prose(rng, 100) + " " + items[0][1] + " " + prose(rng, 100), "too short", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    schema = "doc_id long, text string, lang string, source string, n_chars long, cuts int, cut_id int, th long, hash int, rep long, comp long, n_shingles int, item_id long, column_0 string"
    items = spark.createDataFrame([(1, prose(rng, 40), 1, "x")], "item_id long, text string, doc_id int, hash string")
    good = prose(rng, 200)
    rows = [(1, good), (1, good), (2, prose(rng, 120) + " token=abcdefgh1"), (3, None), (None, prose(rng, 90)), (4, prose(rng, 30_000))]
    for name, part in (("none", []), ("odd", [(*r, "en", "s", 1, 1, 2, 3, 4, 5, 6, 7, 8, "c") for r in rows])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(str(r["doc_id"]) for r in got) == ([] if name == "none" else ["1", "1", "2", "4", "None"])


def test_repeated_rows_everywhere(spark):
    from strandlake.llm import pieces, quality, queries

    rows = [(1, "some words of a text", "en", "s", 0, 0.0, 0)] * 3 + [(2, None, "en", "s", 0, 0.0, 0)] * 2 + [(None, "x y", "en", "s", 0, 0.0, 0)]
    docs = frame(spark, rows)
    for out in (quality.measure(docs), pieces.digests(docs, queries.piece_model()), langid.predict(docs, _counted_model()), toxicity.score(docs, toxicity.fit([], np.zeros(0)))):
        got = [tuple(r) for r in out.collect()]
        assert len(got) == 6 and len(set(got)) == 3, out.columns


def test_documents_fixture_runs_everywhere(spark):
    rows = documents(3, 20)
    assert neardup.keep_first(frame(spark, rows)).columns == frame(spark, []).columns
