"""Operators on single texts: license scan, BPE, chat format, HTML, language, toxicity, against brute force."""

import functools
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import bpe, chat_format, html_extract, language_id, license_scan, toxicity

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOC = "doc_id bigint, text string, lang string, n_words string, sig string, k int, t int, host string"


def frame(spark, texts):
    """Documents with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1, 2, "z") for i, t in texts], DOC)


# ---- license scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_license_base_places(spark):
    rng = random.Random(3)
    vocabulary = "under the mit license apache version 2 cc by nc a É not".split()
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "UNDER the MIT-License, CC BY-NC cc by nc"), (302, "UNDER the MIT-License, CC BY-NC cc by nc"), (None, "cc by nc " * 3000)]
    got = license_scan.scan_licenses(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    expected = []
    for i, t in texts:
        w = words(t)
        starts = [(s, p) for p in license_scan.BASE_PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        at = [s for s, _ in starts]
        expected.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({license_scan.BASE_PHRASES[p] for _, p in starts}))))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(expected, key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_templates(spark):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, [(i, f"Before. {t} After.") for i, t in enumerate(t for ts in license_scan.all_templates().values() for t in ts)])).collect()}
    labels = [label for label, ts in license_scan.all_templates().items() for _ in ts]
    assert all(label in rows[i].labels.split(",") for i, label in enumerate(labels))
    damaged = "Permission is hereby granted free of charge to any individual obtaining a copy of this software and associated documentation files"
    row = license_scan.scan_licenses(frame(spark, [(1, damaged), (2, "this software is free of charge")])).orderBy("doc_id").collect()
    assert row[0].labels == "mit" and 0.8 <= row[0].score < 1 and row[1].labels == ""


def test_matching_statistics():
    """States and lengths along random word sequences against the longest suffix that some template holds."""
    scan = license_scan.scanner()
    held = [tuple(c) for c in scan.codes]
    inside = {t[i:j] for t in held for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(5)
    for _ in range(60):
        line = []
        while len(line) < 40:
            t = rng.choice(held)
            a = rng.randrange(len(t))
            line += t[a : a + rng.randint(1, 7)]
        state = length = 0
        for i, c in enumerate(line):
            while state and c not in scan.go[state]:
                state = scan.link[state]
                length = scan.length[state]
            if c in scan.go[state]:
                state, length = scan.go[state][c], length + 1
            best = max((n for n in range(i + 2) if not n or tuple(line[i + 1 - n : i + 1]) in inside), default=0)
            assert length == best
            suffix = tuple(line[i + 1 - length : i + 1])
            for t, stops in scan.places[state].items():
                assert stops == [e for e in range(length, len(held[t]) + 1) if held[t][e - length : e] == suffix]


def test_license_versions(spark):
    by = license_scan.all_templates()
    texts = [(1, by["gpl-2"][0]), (2, by["gpl-3"][0]), (3, by["agpl-3"][0]), (4, " ".join(by["bsd"][:3])), (5, " ".join(by["bsd"][:3] + by["bsd-3"])), (6, "no licence at all, but free software of any version")]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert got == {1: "gpl-2", 2: "gpl-3", 3: "agpl-3", 4: "bsd", 5: "bsd,bsd-3", 6: ""}


def labels_of(text):
    return sorted({s[0] for s in license_scan.scanner().scan(text.encode())[2]})


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["cc-by-nd"]),
        ("licensed under the GNU General Public License, version 1", ["gpl-1"]),
        ("a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ["cc-by-nc-nd"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", ["cc-by-nc-sa"]),
        ("under a Creative Commons Attribution 3.0 Unported License", ["cc-by"]),
        ("GNU General Public License, version 4", []),
        ("Creative Commons Attribution 5.0 International", []),
        ("licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa"]),
        ("GNU Lesser General Public License, version 2.1", ["lgpl-2.1"]),
        ("the GNU Affero General Public License v3", ["agpl-3"]),
    ],
)
def test_license_variants(text, labels):
    assert labels_of(f"Some code. {text}. More of it.") == labels


def test_license_chains_by_hand():
    """Texts of templates with words left out or put in, against the rule that every telling word must be there and no other may stand between."""
    rng = random.Random(12)
    scan = license_scan.scanner()
    for _ in range(300):
        label, words = rng.choice([t for t in scan.templates if len(t[1]) > 12])
        words = list(words)
        at = rng.randrange(4, len(words) - 4)
        told = license_scan.tells_apart(words[at])
        without = b" ".join([b"x", *words[:at], *words[at + 1 :], b"y"]).decode()
        assert (label in labels_of(without)) is not told or told and label not in labels_of(without), (label, without)
        between = b" ".join([*words[:at], rng.choice([b"noderivatives", b"lesser"]), *words[at:]]).decode()
        whole = [t for t in scan.templates if t[0] == label and t[1] != words]
        if not whole and at / len(words) < license_scan.COVERED and 1 - at / len(words) < license_scan.COVERED:
            assert label not in labels_of(between)


def test_many_license_spans_take_linear_time():
    import time

    line = "creative commons attribution 4 0 international gnu general public license version 2 all rights reserved "
    began = time.perf_counter()
    n, _, spans = license_scan.scanner().scan((line * 50_000).encode())
    assert (n, len(spans)) == (750_000, 150_000) and time.perf_counter() - began < 15


def test_best_spans_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(rng.choice("abcd"), s, s + rng.randrange(12), 1.0, rng.randrange(9)) for s in (rng.randrange(40) for _ in range(25))]
        both = lambda s, o: min(s[2], o[2]) - max(s[1], o[1]) + 1
        want = [s for s in spans if not any(o[0] != s[0] and o[4] > s[4] and 2 * both(s, o) > s[2] - s[1] + 1 for o in spans)]
        assert sorted(license_scan.Scanner._best(spans)) == sorted(want)


# ---- BPE


def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    pool = [*map(chr, range(0, 0x250)), *"aaaaaabbb   \n\t'sstt", "<|endoftext|>", "  ", "　", "​", "́", "٠", "\U0001f600", "中文", "\x1c", "'ll ", "\r\n"]
    texts = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(2000)]
    texts += [(5000, None), (5001, ""), (5002, "a" * 50_000), (5003, "<|endoftext|>" * 3), (5004, " " * 3000), (5004, " " * 3000), (None, "x")]
    got = bpe.token_digests(frame(spark, texts)).collect()
    lib = library()
    expected = []
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_bpe_merges_common_words_once():
    """Words that every slice has stay known while more others pass by than a worker remembers."""
    tokenizer, rng, merged = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4), []
    merge, lib = tokenizer.merge_words, library()
    tokenizer.merge_words = lambda words: merged.extend(words) or merge(words)
    common = [f" common{''.join(rng.choices('aeiou', k=6))}" for _ in range(200)]
    for _ in range(5):
        texts = ["".join([*common, *[" " + "".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(5000)]]) for _ in range(9)]
        ids = tokenizer.encode(texts)
        assert np.frombuffer(ids[0], "<u4").tolist() == lib.encode(texts[0], add_special_tokens=False).ids
    assert len(merged) > 200_000 and all(merged.count(w.encode()) == 1 for w in set(common[:20]))


def test_bpe_narrow_pattern_finds_the_same():
    tokenizer = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    plane = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}{}b", " {} ", "1 {}2", " \n{} {}x'll{}"):
        for start in range(0, len(plane), 256):
            text = "".join(form.replace("{}", c) for c in plane[start : start + 256])
            assert tokenizer.narrow_words.findall(text) == tokenizer.words.findall(text)
    lib = library()
    for text in ("", "\U00010400\U00010401x \U0001d7d8\U0001d7d9 \U0001f600!", "a b\U00020000c", "\uffff \ufffd"):
        [ids] = tokenizer.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids and tokenizer.decode([ids]) == [text]


def test_bpe_decodes_any_ids():
    """Ids that no text has, too: broken characters, special tokens, no ids at all."""
    tokenizer, lib, rng = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), library(), random.Random(5)
    ids = [[rng.randrange(n) for _ in range(rng.randrange(20))] for n in (256, len(tokenizer.token_bytes)) for _ in range(500)]
    assert tokenizer.decode([np.array(x, "<u4").tobytes() for x in ids]) == [lib.decode(x, skip_special_tokens=False) for x in ids]
    assert tokenizer.decode([b"", b""]) == ["", ""] and tokenizer.decode([]) == []


def test_bpe_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bpe.encode_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_decodes_what_it_encodes(spark, tmp_path, monkeypatch):
    """The pipeline's ids are decoded and compared; a vocabulary in which two strings share an id is found out."""
    import corpus_pipeline as pipeline

    texts = [(1, "a plain text\u3000\U0001f600<|endoftext|> \n"), (2, None), (3, ""), (None, "x"), (4, "aa" * 40_000), (4, "y")]
    lib = library()
    expected = [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in texts]
    got = pipeline.encode(spark, frame(spark, texts), "")
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted(expected, key=str) and all(r.n_tokens == len(r.ids) for r in rows)

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["id"] = spec["model"]["vocab"]["!"]
    lossy = tmp_path / "lossy.json"
    lossy.write_text(json.dumps(spec), encoding="utf-8")
    monkeypatch.setattr(pipeline.bpe, "encode_documents", functools.partial(bpe.encode_documents, tokenizer=str(lossy)))
    assert pipeline.encode(spark, frame(spark, [(1, "no mark")]), "").count() == 1
    with pytest.raises(Exception, match="doc_id 7 do not decode"):
        pipeline.encode(spark, frame(spark, [(1, "no mark"), (7, "a mark!")]), "").collect()


# ---- chat format


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<|", "|>", "<|endoftext|>", "", None, "a\nb\r\n ", "é中\U0001f600", "\\n", "<", "x" * 20_000]
    rows, n = [], 0
    for c in range(30):
        for turn in range(1 + c % 5):
            rows.append((c, turn, ["system", "user", "assistant"][(c + turn) % 3], odd[n % len(odd)], "zz"))
            n += 1
    rows += [(100, None, None, "no role", "zz"), (100, 1, "as\nsist<|ant\\n", "odd role", "zz"), (100, 1, "as\nsist<|ant\\n", "odd role", "zz"), (None, 0, "assistant", "no conversation", "zz")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digest_formatted(out).collect()}
    full = {r.conv_id: r for r in out.collect()}
    convs = {}
    for c, turn, role, text, _ in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert full[c].formatted.count("<|im_start|>") == len(turns) == full[c].formatted.count("<|im_end|>")
        assert len(full[c].ids) == len(full[c].mask) and got[c].formatted_chars == len(full[c].formatted)


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.digest_formatted(chat_format.format_conversations(empty)).count() == 0


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><a href="/">Site no</a></header><nav><ul><li><a href="/a">menu no</a></li></ul></nav>
<div class="cookie-notice">We use cookies no</div>
<div class="wrap"><div class="post post-%d"><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b>,
 <a href="#">a link</a> and caf&eacute; &#8364;.</p><div class="ad">buy no</div><p>Second paragraph, long enough to count as text of the article.
<form><input><button>send no</button></form><ul><li>one</li><li>two</li></ul><!-- <p>no</p> --></div>
<aside class="sidebar"><p>Related things no, with quite some text in them too.</p></aside>
<section id="comments"><div class="comment"><p>A reader says no, and goes on saying it for long, and longer, and longer still.</p></div></section></div>
<footer>&copy; no</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph with bold, a link and café €.\nSecond paragraph, long enough to count as text of the article.\none\ntwo"


def test_html_main_text(spark):
    pages = [(i, f"https://h.example/{i}", PAGE % i, "p") for i in range(5)]
    pages += [(10, None, None, "p"), (11, "::bad::", "", "p"), (12, "https://h.example/x", "<p>only &lt;this&gt;", "p"), (12, "https://h.example/x", "<p>only &lt;this&gt;", "p"), (None, "https://o.example", "<nav>x</nav>", "p")]
    rows = html_extract.extract_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string, path string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        expected = "" if r.page_id in (None, 10, 11) else "only <this>" if r.page_id == 12 else TEXT
        assert (r.text, r.n_chars) == (expected, len(expected)), r.page_id


def test_html_consensus_wins(spark):
    usual = "<body><div class='teaser'><p>short</p></div><div class='story'><p>" + "the story goes on " * 20 + "</p></div></body>"
    odd = "<body><div class='teaser'><p>" + "a long teaser " * 30 + "</p></div><div class='story'><p>brief</p></div></body>"
    pages = spark.createDataFrame([(i, "https://s.example/", usual) for i in range(5)] + [(9, "https://s.example/", odd)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(pages).where("page_id = 9").collect()} == {"brief"}


def test_html_paths_are_whole(spark):
    """Containers that differ only far down their paths are not one."""
    deep = "<div class='flex items-center justify-between'>" * 12
    usual = f"<body>{deep}<div class='aa'><p>" + "beside the story " * 3 + "</p></div><div class='bb'><p>" + "the story goes on " * 40 + "</p></div></body>"
    pages = spark.createDataFrame([(i, "https://s.example/", usual) for i in range(4)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(pages).collect()} == {" ".join(["the story goes on"] * 40)}
    tree = html_extract.parse("<table>" + "<tr><td>" * 20_000 + "<p>" + "words " * 50)
    assert html_extract.choose(tree, html_extract._weigh(tree)).tag == "td"
    nested = spark.createDataFrame([(1, "https://t.example/", "<table>" + "<tr><td>" * 3000 + "<p>" + "words " * 50)], "page_id bigint, url string, html string")
    assert html_extract.extract_main_text(nested).first().text == " ".join(["words"] * 50)


@pytest.mark.parametrize(
    ("attributes", "beside"),
    [("class='overflow-hidden'", False), ("title='a hidden gem' data-hidden='1'", False), ("class=x hidden", True), ("hidden=''", True), ("hidden='false'", False), ("aria-hidden=true", True), ("style='color:red; display: none'", True), ("class='comments-open'", True)],
)
def test_html_hidden_is_an_attribute(attributes, beside):
    assert any(html_extract._step("div", attributes)[1:]) is beside


def test_html_paths_have_all_classes(spark):
    names = ["tw-" + "x" * 90, "tw-" + "y" * 90, "tw-" + "z" * 90]
    beside, story = " ".join([*names, "zz-a"]), " ".join([*names, "zz-b"])
    usual = f"<body><div class='{beside}'><p>" + "side matter " * 5 + f"</p></div><div class='{story}'><p>" + "the story goes on " * 40 + "</p></div></body>"
    pages = spark.createDataFrame([(i, "https://s.example/", usual) for i in range(4)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(pages).collect()} == {" ".join(["the story goes on"] * 40)}


def test_html_hostile_pages_take_linear_time():
    import time

    story = "<body><article><p>" + "the story goes on " * 20 + "</p></article>"
    for page in ("<div>" * 10_000 + story, story + "<a title='x\" >text " * 270_000, "<div>" * 30_000 + "</section>" * 30_000 + story, story + '<a x=">" ' * 200_000, "<script>" * 100_000 + story, "<" * 300_000 + story):
        began = time.process_time()
        assert "the story goes on the story" in html_extract.extract(page, None)
        assert time.process_time() - began < 5


@pytest.mark.parametrize("raw", sorted(html_extract.RAW))
def test_html_raw_elements_without_end(raw):
    page = f"<body><{raw}>no <b>no</b><article><p>" + "the story " * 20 + "</p></article></body>"
    assert html_extract.extract(page, None) == " ".join(["the story"] * 20)
    closed = f"<body><{raw}>no <p>no</p></{raw.upper()} ><p>" + "the story " * 20 + "</p></body>"
    assert html_extract.extract(closed, None) == " ".join(["the story"] * 20)


def test_html_page_wide_form(spark):
    page = "<body><form action=x><header><a href=y>menu</a></header><div class='main'><p>" + "the story " * 20 + "</p></div></form></body>"
    pages = spark.createDataFrame([(i, "https://f.example/", page) for i in range(3)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(pages).collect()} == {" ".join(["the story"] * 20)}
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
    assert html_extract.extract("<body><p>text</p><form><p>no</p></form></body>", None) == "text"


def test_html_article_of_any_class():
    page = "<body><article class='post comments-open has-related'><p>" + "the story " * 20 + "</p></article><div class='x'><p>teaser</p></div></body>"
    assert html_extract.extract(page, None) == " ".join(["the story"] * 20)
    assert "no" not in html_extract.extract("<body><article hidden><p>no</p></article><p>yes</p></body>", None)


STORY = " ".join(["the story goes on"] * 40)


@pytest.mark.parametrize("name", ["with-sidebar", "no-sidebar", "post-comments-open", "search-page", "page-with-menu", "related-content", "content-sidebar-wrap", "js-alert-host", "notice"])
def test_html_wrappers_are_no_verdict(spark, name):
    inner = f"<main><article><p>{STORY}</p></article></main>"
    side = "<div class='sidebar'><p>" + "read this too " * 60 + "</p></div><div class='comments'><article class='comment'>" + "first! " * 300 + "</article></div>"
    pages = [f"<body><header>x</header><div class='{name}'>{inner}{side}</div><footer>f</footer></body>", f"<body><div class='{name}'><p>{STORY}</p><div class='ads'>buy</div></div><div class='menu'>home</div></body>"]
    assert [html_extract.extract(p, None) for p in pages] == [STORY, STORY]
    rows = spark.createDataFrame([(i, "http://a.b/x", pages[0].replace("goes on", f"goes on {i}")) for i in range(5)], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_extract.extract_main_text(rows).collect()) == [(i, STORY.replace("goes on", f"goes on {i}")) for i in range(5)]


def test_html_marked_blocks_and_words():
    page = f"""<body><article><p class="advert">buy</p><p>{STORY}</p><p hidden>no<p>it <b class="x">goes</b> <span class="ad">buy <span>more</span></span>further</p>
        <ul><li>one</li><li class="sponsored"><p>no</p><p>no</p><li>two</ul><h2 class=notice>no</h2><p class="notice">no</p><span aria-hidden="true">no</span>the <a class="share" href=x>no</a>end</article></body>"""
    assert html_extract.extract(page, None).split("\n") == [STORY, "it goes further", "one", "two", "the end"]
    assert html_extract.extract("<body><article><p class=related-text>" + "</p><p class=related-text>".join(["some words of it"] * 9) + "</p><p class=ad>no</p></article>", None) == "\n".join(["some words of it"] * 9)
    assert html_extract.extract(f"<body><span class='ad'>unclosed <p>{STORY}</p>", None) == STORY


def test_html_many_marks_take_linear_time():
    import time

    for unit in ("<div class='ad{}'>x", "<span class=ad>x", "<p class='comment{}'>some words", "<div class='menu'><p class=ad>x</p></div>", "<li class=ad><a class=share>x"):
        page = "".join(unit.format(i) if "{}" in unit else unit for i in range(40_000))
        began = time.perf_counter()
        html_extract.extract(page, None)
        assert time.perf_counter() - began < 20


def test_html_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_extract.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        blocks = (" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


# ---- language


def naive_phrases(train, text):
    """Greedy longest matches over the whole text."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in train:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_cross_parsing_equals_brute_force():
    rng = random.Random(7)
    train = "".join(rng.choice("abcd ") for _ in range(400)) + "xyz"
    sample = language_id.sample_of("x", [train], 10_000)
    start = language_id.suffix_automaton(sample.line)
    assert sample.line == f"\0{language_id.symbols(train)}\0"
    texts = ["".join(rng.choice("abcdx q") for _ in range(rng.randint(0, 3000))) for _ in range(40)] + ["ab cd" * 1500]
    for t in texts:
        assert language_id.phrases(start, language_id.symbols(t)) == naive_phrases(sample.line, language_id.symbols(t))


def test_symbols():
    assert language_id.symbols("Ab1, Çé \ud800x") == "ab\0çé\0x" and language_id.symbols("") == "" and language_id.symbols(" 12 ") == "\0"


def test_language_automaton_of_a_large_script_is_small():
    import tracemalloc

    rng = random.Random(1)
    line = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40_000))
    tracemalloc.start()
    start = language_id.suffix_automaton(line)
    assert tracemalloc.get_traced_memory()[0] < 50e6
    tracemalloc.stop()
    assert language_id.phrases(start, line) == 1


def test_language_of_documents(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ul", "ost"]}
    say = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(40))
    rows = [(i, say(lang), lang) for i in range(60) for lang in ("aa", "bb")]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !?", "aa"), (502, "", None), (None, say("bb"), None)], "doc_id bigint, text string, lang string")
    got = language_id.detect_language(docs, docs.where("doc_id < 30")).collect()
    assert len(got) == 124
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert all(sorted(by[i]) == ["aa", "bb"] for i in range(60))
    assert by[500] == by[501] == by[502] == ["und"] and by[None] == ["bb"]
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in got)
    assert language_id.keep_identified(docs, docs).count() == 121
    assert {r.lang_pred for r in language_id.detect_language(docs, docs.limit(0)).collect()} == {"und"}
    assert language_id.detect_language(docs.limit(0), docs).count() == language_id.keep_identified(docs.limit(0), docs).count() == 0


def test_language_kept_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123 !?", None), (3, None, None), (4, "слово", None), (None, "x", None)], "doc_id bigint, text string, lang string")
    kept = language_id.keep_identified(docs, docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.where("doc_id in (1, 4) or doc_id is null").collect(), key=str)


def test_language_is_what_the_parse_finds(spark):
    say = {"aa": "kalomi tuka lomitu kalo " * 20, "bb": "schreng ulost engul schrost " * 20}
    rows = [(i, say[lang], lang) for i, lang in enumerate(("aa", "bb") * 5)]
    docs = spark.createDataFrame([*rows, (20, say["aa"], None), (21, say["bb"], None), (22, say["bb"], "aa"), (23, "12", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang for r in language_id.keep_identified(docs, docs.where("doc_id < 10")).collect()}
    assert got == {i: lang for i, _, lang in rows} | {20: "aa", 21: "bb", 22: "bb"}
    only = language_id.keep_identified(docs, docs.where("doc_id < 10"), languages=["bb"]).collect()
    assert {r.doc_id for r in only} == {1, 3, 5, 7, 9, 21, 22} and {r.lang for r in only} == {"bb"}


def test_language_learns_from_whole_rows(spark):
    words = ["alpha", "bravo", "charly", "delta", "wiz", "quux", "jump", "fog"]
    long = [(i, f"start{i} " + "z" * 100_000, "aa") for i in range(20)] + [(50, "y" * 200_000, "bb"), (60, "x" * 90_000, "cc"), (61, "w" * 80_000, "cc")]
    docs = spark.createDataFrame([*long, *[(100 + i, w, "aa") for i, w in enumerate(words)]], "doc_id bigint, text string, lang string")
    aa, cc = language_id.train(docs)  # bb has no row that is not too long
    assert sorted(aa.line.strip("\0").split("\0")) == sorted(words)  # no room for a long row, and no part of one
    assert (cc.lang, cc.line) == ("cc", "\0" + "w" * 80_000 + "\0")
    texts = ["ab" * 30, "cd" * 300, "ef" * 100]
    assert language_id.sample_of("x", texts, 400).line == "\0" + texts[0] + "\0" + texts[2] + "\0"


def test_language_sample_of_many_rows(spark):
    """The sample is the rows with the smallest hashes, equal rows once, whatever the number of rows and partitions."""
    docs = spark.range(9000).select((F.col("id") % 6000).alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 6000).alias("text"), F.lit("aa").alias("lang"))
    (one,), (two,) = language_id.train(docs), language_id.train(docs.repartition(7))
    assert one == two and one.line.count("\0") >= language_id.TRAIN_DOCS


def test_language_held_out_accuracy(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    from mnemospark.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = queries.op9_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(4)
    clean = "the of river stone walk house green light evening paper window table idea".split()
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(60)]
        if i % 5 == 0:
            w[10], w[40] = rng.choice(["idiot", "moron", "fool"]), rng.choice(["trash", "scum"])
        rows.append((i, " ".join(w), "p"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None, "p"), (901, "", "p"), (None, "You IDIOT, you scum", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic string")
    truth = spark.createDataFrame([*labels[:400], (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, truth).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(600) if got[i].toxic != (i % 5 == 0)]
    assert not [i for i in wrong if i % 5] and len(wrong) <= 3
    assert not got[900].toxic and not got[901].toxic and got[None].toxic
    assert not any(r.toxic for r in toxicity.score_toxicity(docs, truth.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), truth).count() == 0
    again = spark.createDataFrame([(0, "short", "p"), (0, rows[0][1], "p"), (950, "you idiot, you scum " + "word " * 90_000, "p"), (951, "you idiot, you scum " * 20_000, "p")], "doc_id bigint, text string, p_toxic string")
    both = docs.unionByName(again)
    one, two = (sorted((str(r.doc_id), r.toxic, round(r.p_toxic, 9)) for r in toxicity.score_toxicity(d, truth).collect()) for d in (both, both.repartition(5)))
    assert one == two and ("951", True) in {x[:2] for x in one} and ("950", False) in {x[:2] for x in one}


def test_toxicity_chain():
    """Each model is a stationary point of its objective, and later ones see earlier probabilities of models without their row."""
    rng = np.random.default_rng(1)
    x = rng.random((90, 4))
    kinds = np.column_stack([x[:, 0] > 0.6, x[:, 1] > 0.7, (x[:, 0] > 0.6) | (x[:, 1] > 0.7)])
    fold = np.arange(90) % toxicity.FOLDS
    weights = toxicity.fit_chain(x, kinds, fold)
    seen = x
    for c, w in enumerate(weights):
        y = kinds[:, c].astype(float)
        a = np.concatenate([np.ones((90, 1)), seen], axis=1)
        slope = a.T @ (y - toxicity.sigmoid(a @ w)) - np.array([1e-6, *[toxicity.PENALTY] * seen.shape[1]]) * w
        assert np.abs(slope).max() < 1e-4
        p = np.zeros(90)
        for i in range(90):
            v = toxicity.fit(seen[fold != fold[i]], y[fold != fold[i]])
            p[i] = toxicity.sigmoid(v[0] + seen[i] @ v[1:])
        seen = np.concatenate([seen, p[:, None]], axis=1)
    features = toxicity.Features({b"=a": 0, b"=b": 1, b"=c": 2, b"=d": 3})
    p = toxicity.predict(toxicity.Chain(features.chosen, weights), features, [b"a a b", b""])
    z = np.minimum(1.0, np.array([2, 1, 0, 0]) / (toxicity.FULL * 3))
    for c, w in enumerate(weights):
        assert p[0, c] == pytest.approx(toxicity.sigmoid(w[0] + np.concatenate([z, p[0, :c]]) @ w[1:]))


def test_toxicity_kinds():
    rng = np.random.default_rng(2)
    group = np.repeat([0, 1, 2], [30, 20, 10])
    x = np.eye(3)[group] + rng.random((60, 3)) * 0.1
    toxic = np.ones(60, bool)
    toxic[::7] = False
    kinds = toxicity.kinds_of(x, toxic)
    assert (kinds.any(axis=1) == toxic).all() and (kinds[toxic].argmax(axis=1) == group[toxic]).all()
    assert not toxicity.kinds_of(x, np.zeros(60, bool)).any() and toxicity.kinds_of(x[:1], np.ones(1, bool)).sum() == 1


def test_toxicity_held_out(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    asked = docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi")
    found = toxicity.score_toxicity(asked.unionByName(docs.join(labels.where(~held).select("doc_id"), "doc_id", "left_semi")), labels.where(~held)).join(labels.where(held).withColumnRenamed("toxic", "truth"), "doc_id")
    n = {(r.truth, r.toxic): r["count"] for r in found.groupBy("truth", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.9 and n.get((0, True), 0) / n[0, False] < 0.005


@pytest.mark.parametrize("run", [license_scan.scan_licenses, bpe.encode_documents, bpe.token_digests])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0
