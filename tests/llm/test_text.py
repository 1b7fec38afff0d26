import random
from pathlib import Path

import pytest

from veinwork.llm import lines, markup, pairs, scans, splitting
from veinwork.llm.tokenizer import DEFAULT_DIR, automaton, encode_column


def test_encoding_equals_the_library(spark):
    lib = pytest.importorskip("tokenizers")
    tok = lib.Tokenizer.from_file(str(Path(DEFAULT_DIR) / "byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rnd = random.Random(5)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "\n" * 200, "Die Änderung, naïve 漢字 🙂 don't"]
    texts += ["".join(rnd.choice("abcdehinorst  \n.',019ÄßЖ中🙂\u00a0\u3000\x1c") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    auto = automaton()
    for t in texts:
        ids = auto.encode(t)
        assert ids == tok.encode(t, add_special_tokens=False).ids
        assert auto.decode(ids) == t
    df = spark.createDataFrame([(1, "hi", "x"), (2, None, "x"), (3, "", "x"), (1, "hi", "y")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_column(df, "doc_id", "text").collect())
    assert got == [(1, [5303]), (1, [5303]), (2, []), (3, [])]


def pieces_of(spark, text, size=splitting.RANGE, **kw):
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, sec_no int, text string")
    return splitting.split_texts(df, ["doc_id", "sec_no"], "text", size=size, **kw).orderBy("piece_no").collect()


@pytest.mark.parametrize("size", [splitting.RANGE, 4000])
def test_pieces_cover_the_text(spark, size):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["word ", "another ", "end. ", "line\n", "par.\n\n", "x" * 40]) for _ in range(6000)) + "z" * 6000
    got = pieces_of(spark, text, size)
    assert [p.piece_no for p in got] == list(range(1, len(got) + 1))
    assert got[0].start == 0 and got[-1].end == len(text)
    for a, b in zip(got, got[1:]):
        assert b.body_start == a.end and a.start <= b.start < b.body_start and b.body_start - b.start <= 500
    assert all(len(p.piece) <= 2500 and p.piece == text[p.start : p.end] for p in got)


def test_forced_runs_over_range_ends(spark):
    rows = [("a", 1, "x" * 2600), ("b", 1, ("y" * 2400 + " ") * 3), ("c", 1, "w " * 100 + "v" * 2501), ("d", 1, None), ("e", 1, "u" * 2500)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id string, sec_no int, text string")
    want = {"a": "forced", "b": "natural", "c": "forced"}
    assert {r.doc_id: r.cut for r in splitting.oversized(df, ["doc_id", "sec_no"], "text").collect()} == want
    runs = splitting.boundary_runs(df.filter("text IS NOT NULL").distinct(), ["doc_id"], "text", size=700)
    assert {r.doc_id: r.longest_run for r in runs.collect()} == {"a": 2600, "b": 2400, "c": 2501, "e": 2500}


def test_files_by_byte_range(spark, tmp_path):
    text = "".join(f"Satz {i} mit Ä und 漢字. " for i in range(4000))
    p = tmp_path / "big.txt"
    p.write_text(text, "utf-8")
    paths = spark.createDataFrame([(str(p), p.stat().st_size)], "path string, n_bytes long")
    got = splitting.split_files(spark, paths, size=20_000).orderBy("piece_no").collect()
    raw = text.encode()
    assert got[0].start == 0 and got[-1].end == len(raw)
    for a, b in zip(got, got[1:]):
        assert b.body_start == a.end and b.piece_no == a.piece_no + 1
    assert all("\ufffd" not in x.piece for x in got)


MARKUP = [
    ("plain text, r < g and s > 0, [3] and [7, 12], $5 million to $3 million", []),
    ("0.42*** and 0.17* with smooth_gap_ratio in {a, b, c}; 3 | 4 | 5; R&D", []),
    ("- a dash list\n- of two", []), (None, []), ("", []),
    ("a <b>bold</b> word", ["html"]), ("x&nbsp;y", ["html"]), ("cut <div class=", ["html"]), ("&lt;p&gt;hi&lt;/p&gt;", ["html"]), ("<!-- nav -->", ["html"]),
    ("# Head\ntext", ["markdown"]), ("Title\n=====\n", ["markdown"]), ("a **b** c", ["markdown"]), ("see [x](y.md)", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("note[^5]", ["markdown"]),
    ("== Head ==\n''x''", ["wiki"]), ("[[Model|word]] {{cite|a=b}}", ["wiki"]), ("{| class=\"w\"\n|-\n| a || b\n|}", ["wiki"]),
    ("\\section{A} see~\\cite{k}", ["latex"]), ("Here $y_t = a$ holds", ["latex"]), ("\\begin{verbatim}\na * b\n\\end{verbatim}", ["latex"]),
    ("**a** and [[b]]", ["markdown", "wiki"]),
]


@pytest.mark.parametrize("text,want", MARKUP)
def test_markup_kinds(text, want):
    assert markup.kinds(text) == want


def test_clean_keeps_structure():
    text = "## Head\n\nA *b* [c](d).\n\n* one\n* two\n\n```\nx = a * b\n```\n\n\\begin{equation}\n y_t = 1\n\\end{equation}\n"
    assert markup.render(markup.parse(text)) == "Head\n\nA b c.\n\n- one\n- two\n\n    x = a * b\n\n     y_t = 1"
    assert markup.tree_match(("a", "", [("b", "", []), ("c", "", [])]), ("a", "", [("c", "", []), ("b", "", [])]))[0] == 2


def test_long_and_deep_markup():
    for text, kind in (("**" + "b " * 300 + "b**", "markdown"), ("$x^2 " + "+ y " * 400 + "z$", "latex"), ("{{" + "p=1 " * 900 + "}}", "wiki"), ("[" + "w " * 400 + "w](http://x.y)", "markdown"), ("<a title='" + "t " * 1500 + "'>x</a>", "html")):
        assert markup.kinds(text) == [kind], text[:20]
    deep = "word"
    for k in range(12):
        deep = f"\\textbf{{{deep}}}"
    assert markup.render(markup.parse(deep)) == "word"


def test_wrapper_induction(spark):
    rnd = random.Random(3)
    words = "market river growth tax orchard weather account transport season price".split()
    line = lambda: " ".join(rnd.choice(words) for _ in range(9)) + "."
    page = lambda i: f"Welcome to the portal\n\n# Report {i}\n\n{line()}\n\n{line()}\n\n## Links\n\n- Home\n- Contact us\n\nAll rights reserved"
    rows = [("p%d" % i, 0, page(i), "a.org") for i in range(12)] + [("q%d" % i, 0, page(i), "b.org") for i in range(3)] + [("n", 0, None, "a.org"), ("m", 0, "Welcome to the portal", None), ("x", 0, "## Links\n\n- Home\n- Other " + line(), "a.org")]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, text string, host string")
    clean = {r.doc_id: r.clean for r in markup.clean_texts(df, "host").collect()}
    assert len(clean) == len(rows) and clean["n"] is None and clean["m"] == "Welcome to the portal"
    for i in range(12):
        assert clean[f"p{i}"].startswith(f"Report {i}\n\n") and "Links" not in clean[f"p{i}"] and "Contact" not in clean[f"p{i}"] and "rights" not in clean[f"p{i}"] and "portal" not in clean[f"p{i}"]
        assert clean[f"p{i}"].count(".") == 2
    assert "Contact us" in clean["q0"]  # too few pages to tell
    assert "Links" in clean["x"] and "Other" in clean["x"]  # a heading stays with content below it
    assert markup.clean_texts(df.limit(0), "host").count() == 0


def test_wrappers_come_from_all_pages(spark):
    # of one host the 45 pages of least hash bear a notice and 150 others don't; of another nearly all pages are long
    noticed = spark.createDataFrame([(f"Notice of today\n\nBody {i}\n\nImprint",) for i in range(300)], "text string").selectExpr("text", "xxhash64(text) AS k").orderBy("k").limit(45)
    others = spark.createDataFrame([(f"Body {i}\n\nImprint",) for i in range(1000, 1900)], "text string").selectExpr("text", "xxhash64(text) AS k").orderBy("k", ascending=False).limit(150)
    long = ["Portal\n\n" + "\n\n".join(f"Line {i} {j}" for j in range(400)) for i in range(8)] + [f"Portal\n\nBody {i}" for i in range(3)]
    # no page of a third host has all that is constant on it: each lacks one of four lines
    lines_ = ["> Line 0", "- Line 1", "| Line 2 |", "# Line 3"]
    some = ["\n\n".join([f"Body {i}"] + [x for k, x in enumerate(lines_) if k != i % 4]) for i in range(12)]
    rows = [(f"a{i}", 0, r.text, "a") for i, r in enumerate([*noticed.collect(), *others.collect()])] + [(f"b{i}", 0, t, "b") for i, t in enumerate(long)] + [(f"c{i}", 0, t, "c") for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, text string, host string")
    want = [("a", "/para", "Imprint"), ("b", "/para", "Portal")] + [("c", "/heading1", "Line 3"), ("c", "/item", "Line 1"), ("c", "/quote", "Line 0"), ("c", "/row", "Line 2")]
    assert sorted(map(tuple, markup.page_templates(df, "host").collect())) == want
    # the same with a part for every few pages, and no template where nothing is constant
    assert sorted(map(tuple, markup.page_templates(df, "host", align_pages=3).collect())) == want
    assert markup.page_templates(df.filter("host = 'a'"), "host", least_share=1.1).count() == 0


def test_long_pages_are_aligned():
    page = ("page", "", [("para", str(i), []) for i in range(20_000)])
    assert markup.tree_match(("page", "", [("para", str(7 * i), []) for i in range(300)]), page)[0] == 301


def test_markup_found_counts_twins_once(spark):
    df = spark.createDataFrame([("d", 1, "a **b**", "x"), ("d", 1, "a **b**", "x"), ("e", 2, None, "x")], "doc_id string, sec_no int, text string, markup string")
    assert [tuple(r) for r in markup.markup_found(df).collect()] == [("d", 1, "markdown")]


PAIRS = [
    (1, "Why?", None, "empty"), (2, "Why?", "\u200b", "empty"), (3, "Why is it so?", "Answer:", "empty"), (4, "Name it.", "none", None), (5, "Why?", "```\n```", "empty"),
    (6, "Explain the role of the gearbox.", "EXPLAIN THE ROLE OF THE GEARBOX.", "copies_prompt"), (7, "Explain the role of the gearbox.", "Explain the role of the gearbox.\nIt turns the shaft.", None),
    (8, "Why?", "I'm sorry, but I can't help with that request.", "refusal"), (9, "Why is it?", "I'm sorry for the loose notation; here is the answer. It is the case that the gearbox turns.", None),
    (10, "Warum ist das Gesetz in diesem Modell wichtig?", "The law is the base of the model and it is what the courts apply in the end.", "wrong_language"),
    (11, "Translate into Spanish: the law is the base of the model.", "La ley es la base del modelo y de los tribunales.", None),
    (12, "List entities as JSON.", '{"a": [1, 2', "truncated"), (13, "List entities as JSON.", '```json\n{"a": [1]}\n```', None),
    (14, "Why does the pump stop?", "The pump stops when the valve of the drum fails. The pump sto", "truncated"),
    (15, "Why does the pump stop?", "The pump stops when the valve of the drum fails", None), (16, None, "A fine answer.", None), (17, "", "", "empty"),
]


def test_files_are_cut_in_utf8(spark, tmp_path):
    fr = "à la fin de l'année, l'été précède déjà l'automne où tout s'arrête. " * 60
    zh = "市场的价格由供给和需求决定。利率上升时投资减少！谁来支付？" * 60
    for name, text in (("fr", fr), ("zh", zh)):
        raw = text.encode()
        assert len(splitting.by_bytes(raw)) == len(raw) and len(splitting.by_bytes(raw[1:-1])) == len(raw) - 2
        (tmp_path / name).write_bytes(raw)
        paths = spark.createDataFrame([(str(tmp_path / name), len(raw))], "path string, n_bytes long")
        for size in (len(raw) + 1, 1000):
            got = splitting.split_files(spark, paths, limit=400, overlap=60, size=size).orderBy("piece_no").collect()
            assert "".join(raw[p.body_start : p.end].decode() for p in got) == text and {p.kind for p in got} <= {"natural", "end"}
            assert all(p.piece == raw[p.start : p.end].decode() and p.end - p.start <= 400 for p in got)
            cuts = [raw[: p.end].decode()[-1] for p in got[:-1]]
            assert set(cuts) <= (set(" ") if name == "fr" else set("。！？"))


def test_copies_by_compression():
    prompt = "Describe in two sentences how the water level of the upper reservoir depends on the rainfall of the past month and on the gates of the dam."
    assert pairs.copies_prompt(prompt, prompt.replace("rainfall", "snowfall")) and pairs.copies_prompt(prompt, f"Question: {prompt}")
    assert pairs.copies_prompt(prompt + " " + "Here is a passage. " * 3, prompt) and pairs.copies_prompt("Straße und Fluß, groß wie nie", "STRASSE UND FLUSS, GROSS WIE NIE")
    assert not pairs.copies_prompt(prompt, prompt + " It rises by a metre for each week of rain, and falls as soon as a gate is opened.")
    assert not pairs.copies_prompt(prompt, "It depends on the gates of the dam.") and not pairs.copies_prompt(None, prompt)


def test_long_refusals_and_answers_after_an_apology():
    long_ = "I'm sorry, but I can't help with that request. As an assistant I am bound by my policies. " + "If you have another question, I will gladly look at it with you. " * 8
    assert len(long_) > 581 and pairs.is_refusal(long_)
    assert pairs.is_refusal("Mi dispiace, ma non posso rispondere a questa domanda.") and pairs.is_refusal("Infelizmente, não posso ajudar com isso.")
    assert not pairs.is_refusal("I cannot say for sure. " + "The gearbox turns the shaft and the shaft turns the wheel. " * 4)


def test_parallel_items_are_whole(spark):
    rows = [(1, "List three causes of the flood.", "1. Rain feeds the flood\n2. Melting snow drives the flood\n3. An open gate worsens the flood"), (2, "List three causes of the flood.", "1. Rain feeds the flood\n2. Melting snow drives the flood\n3. An open ga")]
    rows += [(i, "Say more.", "The flood takes the bridge. The gate holds the water back.") for i in range(3, 30)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, response string")
    assert [tuple(r) for r in pairs.defective_pairs(df).collect()] == [(2, "truncated")]
    assert [tuple(r) for r in pairs.defective_pairs(df, most_asked=0).collect()] == [(2, "truncated")]


def test_pair_defects(spark):
    rows = [(i, p, r) for i, p, r, _ in PAIRS] + [(1, "Why?", None)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, response string").selectExpr("*", "'x' AS defect")
    got = {r.pair_id: r.defect for r in pairs.defective_pairs(df).collect()}
    assert got == {i: d for i, _, _, d in PAIRS if d}


def test_scan_lines():
    assert [lines.number_of(x) for x in ("- 12 -", "Page 4", "iv", "p. l2", "6.08", "(3)", "scenario.")] == [12, 4, 4, 12, None, None, None]
    assert scans.hyphen_at("the unemp¬ ") == "unemp" and scans.hyphen_at("a - ") is None
    model = lines.train_lines(plain_texts(150), [])
    assert model.goes_on("the use of short-", "term credit", 18, False, False) and not model.goes_on("the use of short-", "and", 18, False, False)
    assert scans.confusion_cost("moves", "rnoves") < 0.5 and scans.confusion_cost("queue", "qiieiie") < 0.5 and scans.confusion_cost("stays", "delay") > 1


def plain_texts(n, seed=4):
    rnd = random.Random(seed)
    words = ["the", "of", "and", "in", "market", "weather", "river", "short-term", "growth", "between", "account", "settled", "long-run", "transport", "orchard", "measure", "depends", "on"]
    return [" ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 14))).capitalize() + "." for _ in range(rnd.randint(5, 30))) for _ in range(n)]


def test_line_classifiers_on_held_out_pages():
    import numpy as np

    model = lines.train_lines(plain_texts(150), [])
    hits = wrong = joins = bad = 0
    for doc in lines.made_documents(plain_texts(60, 9), np.random.default_rng(3)):
        keys, offsets = {}, {}
        for no, (page, _, _) in enumerate(doc, 1):
            for key, n in lines.edge_rows("\n".join(page)):
                into, k = (keys, key) if n is None else (offsets, n - no)
                into[k] = into.get(k, 0) + 1
        for no, (page, marks, on) in enumerate(doc, 1):
            kinds = model.kinds("\n".join(page), [k for k, n in keys.items() if n > 1], [k for k, n in offsets.items() if n > 1], sum(offsets.values()) > 1, no)
            found = {i for i, k in enumerate(kinds) if k in ("header", "number", "header+number")}
            hits += len(found & set(marks))
            wrong += len(found ^ set(marks))
            for i, goes in on.items():
                after = next((page[j].split()[0] for j in range(i + 1, len(page)) if page[j].strip() and j not in marks), None)
                if after and after[0].isalpha():
                    joins += 1
                    bad += model.goes_on(page[i], after, max(map(len, page)), False, False) != bool(goes)
    assert hits > 50 and wrong <= 0.06 * hits, (hits, wrong)
    assert joins > 200 and bad <= 0.03 * joins, (joins, bad)


def test_short_heads_and_short_words(spark):
    body = [f"the {w} of the market is settled and it depends on the account of the weather in the orchard between" for w in ("growth", "measure", "river", "transport", "harvest", "season")]
    rows = [("f", i, "Notes", t, None) for i, t in enumerate(plain_texts(60))]
    rows += [("s", i, f"Page {i}", f"INDEX\n\n{b}\nand the use 0f the market 1s settled in the account of growth.", i) for i, b in enumerate(body, 1)]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, heading string, text string, page int")
    got = {(r.sec_no, r.line_no, r.defect) for r in scans.scan_defects(df).collect()}
    assert {(i, 1, "running_header") for i in range(1, 7)} <= got
    assert {(i, 4, "misread_chars") for i in range(1, 7)} <= got


def test_scan_defects_and_repair(spark):
    body = "the economic growth of many regions depends upon labour markets and upon trade between them over longer periods"
    filler = [("f", i, "Notes", " ".join([body] * 3), None) for i in range(1, 41)]
    p1 = "MARKET NOTES AND QUERIES\n\nthe economic growth of many reg-\nions depends upon labour markets and upon tra-\n\n1"
    p2 = "MARKET NOTES AND QUERIES\n\nde between them. the econornic growth of many regions depends upon\nlabour markets and upon short- and longer periods. the growth of reg-\nions.\n\n2"
    rows = filler + [("s", 1, "Page 1", p1, 1), ("s", 2, "Page 2", p2, None), ("s", 2, "Page 2", p2, None), ("s", 3, "Page 3", " ", 3), ("n", 1, "Page 1", None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, heading string, text string, page int").dropDuplicates()
    got = {(r.sec_no, r.line_no, r.defect) for r in scans.scan_defects(df).collect() if r.doc_id == "s"}
    assert {(1, 1, "running_header"), (1, 3, "line_hyphen"), (1, 4, "line_hyphen"), (1, 6, "page_number"), (2, 1, "running_header"), (2, 4, "line_hyphen"), (2, 7, "page_number")} <= got
    assert not {g for g in got if g[0] == 1 and g[2] == "misread_chars"}
    text = {r.sec_no: r.text for r in scans.repaired_pages(df).collect() if r.doc_id == "s"}
    assert text[1] == "the economic growth of many regions depends upon labour markets and upon trade"
    assert text[2].startswith("between them.")
    empty = spark.createDataFrame([], "doc_id string, sec_no int, heading string, text string, page int")
    assert scans.scan_defects(empty).count() == 0


def scan_words(n=300):
    rnd = random.Random(8)
    parts = ["ma", "ner", "to", "lic", "sand", "ver", "un", "pel", "dor", "fit", "gra", "ben", "hu", "cer", "wis"]
    return sorted({"".join(rnd.sample(parts, rnd.randint(3, 4))) for _ in range(n)})


@pytest.mark.parametrize("times", [1, 100])
def test_misreadings_at_every_size(spark, times):
    words = scan_words()
    bad = {w.replace("n", "u", 1): w for w in words[::6] if "n" in w} | {w.replace("t", "f", 1): w for w in words[1::6] if "t" in w}
    counts = [(w, 4000 * times) for w in words] + [(b, 10 * times) for b in bad]
    fixes, common = scans.corrections(spark.createDataFrame(counts, "word string, n long"))
    got = {r.word: r.right for r in fixes.collect()}
    assert sum(got.get(b) == w for b, w in bad.items()) >= 0.95 * len(bad)
    assert not set(words) & set(got) and not set(bad) & set(common)


def test_frequent_misreadings_are_looked_up(spark):
    words = [w for w in scan_words() if "nn" not in w]
    w = next(x for x in words if x.count("t") == 1)
    b = w.replace("t", "f")
    rows = [("f", i, "Notes", "\n".join(" ".join(words[(j + i) % 7 :]) for j in range(60)), None) for i in range(40)]
    rows += [("s", i, f"Page {i}", f"{words[3]} {words[4]} {b} {words[5]} {words[6]}.\n{words[7]} ﬁ{words[8]} {words[9]}.", i) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, heading string, text string, page int")
    got = {(r.sec_no, r.line_no) for r in scans.scan_defects(df).collect() if r.defect == "misread_chars"}
    assert got >= {(i, n) for i in range(1, 31) for n in (1, 2)}


def test_running_heads_beyond_any_list(spark):
    heads = [f"On the {a} of {b}" for a in ("tide", "harvest", "canal", "mortgage", "weather", "ledger") for b in ("copper", "velvet", "orchards", "minstrels", "Jutland", "glass")]
    assert len(heads) == 36
    body = "a long first body line that runs to the margin of the page and goes on without a stop there\nand a second body line that is about as long as the one above it and ends here."
    rows = [("d", i, f"Page {i}", f"{heads[i // 3].lower().replace('the', 'thc' if i % 3 == 2 else 'the')}\n\n{body.replace('long', f'long {i}')}", i) for i in range(108)]
    rows += [("e", i, f"Page {i}", f"{heads[0].lower()}\n\n{body.replace('long', f'long {i}')}", i) for i in range(3)]
    pages = spark.createDataFrame(rows, "doc_id string, sec_no int, heading string, text string, page int").select("doc_id", "sec_no", "text")
    model = lines.train_lines(plain_texts(150), [])
    got = [(r.doc_id, r.sec_no) for r in scans.classified_pages(pages, model).collect() if r.kinds[0] == "header"]
    assert sorted(got) == sorted((d, s) for d, s, *_ in rows)
    long_ = [(r.doc_id, r.sec_no, tuple(r.kinds)) for r in scans.classified_pages(pages, model, most_listed=0).collect()]
    assert sorted(long_) == sorted((r.doc_id, r.sec_no, tuple(r.kinds)) for r in scans.classified_pages(pages, model, most_listed=100).collect())
