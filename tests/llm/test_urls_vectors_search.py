"""URL filters, whitening and ranked search by a scan, against brute force, with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemospark.llm import lexical_search, queries, url_filters, whitening
from mnemospark.llm.url_filters import BLOCK_SHARE, DAMPING, MILLION, ROUNDS, UNIT

# ---- URL filters

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "bad.org/"), ("allow", "good.org/"), ("block", "shop.example.com/de/"), ("allow", "shop.example.com/de/"), ("allow", "com/x")]


def parts_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = []
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), verdict, rule))
    return max(fits)[3:1:-1] if fits else (None, None)


def judged_by_hand(pages):
    rows = [(*parts_of(url), html or "") for _, url, html in pages]
    rules = [rule_of(h, p) for h, p, _ in rows]
    counts, links = defaultdict(Counter), Counter()
    for (h, _, html), (_, verdict) in zip(rows, rules, strict=True):
        if h:
            counts[h][verdict] += 1
            for to in re.findall(r"""href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)""", html, re.I):
                if (to := parts_of("x://" + to)[0]) != h:
                    links[h, to] += 1
    pairs = set()
    for h in counts:
        labels = h.split(".")
        if len(labels) > 2 and not labels[-1][:1].isdigit():
            pairs |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])) for i in range(len(labels) - 2)}
    for a, b in pairs:
        links[a, b] += 1
        links[b, a] += 1
    scores = []
    for verdict, ends in (("allow", 0), ("block", 1)):
        whole = Counter()
        for e, n in links.items():
            whole[e[ends]] += n
        seeds = {h: c[verdict] / sum(c.values()) for h, c in counts.items()}
        rest = {h: 1 - c["allow"] / sum(c.values()) - c["block"] / sum(c.values()) for h, c in counts.items()}
        bases = [{h: math.floor(x * (UNIT * (1 - DAMPING)) + 0.5) for h, x in seeds.items()}, {h: math.floor(UNIT * (1 - DAMPING) + 0.5) for h in seeds}]
        arrived = []
        for base in bases:
            now = dict(base)
            for done in range(ROUNDS):
                new = Counter(base if done < ROUNDS - 1 else {})
                for e, n in links.items():
                    if e[ends] in now:
                        new[e[1 - ends]] += math.floor(now[e[ends]] * (n / whole[e[ends]] * rest.get(e[1 - ends], 1.0)) * DAMPING)
                now = new
            arrived.append(now)
        judged = {h: (c["allow"] / sum(c.values()), c["block"] / sum(c.values())) for h, c in counts.items()}
        scores.append({h: math.floor((seeds[h] + (1 - judged[h][0] - judged[h][1]) * (arrived[0].get(h, 0) / arrived[1][h] if arrived[1].get(h) else 0)) * MILLION + 0.5) for h in seeds})
    trust, distrust = scores
    out = []
    for (key, _, _), (h, p, _), (rule, verdict) in zip(pages, rows, rules, strict=True):
        t, d = (trust.get(h, 0), distrust.get(h, 0)) if h else (0, 0)
        bad = d > t and d >= BLOCK_SHARE * MILLION
        out.append((key, h, p, rule, verdict or ("block" if bad else "allow"), t, d))
    return sorted(out, key=repr)


def linked_pages():
    rng = random.Random(5)
    hosts = [f"{a}.{b}.{c}" for a in ("m", "www") for b in ("aa", "bb", "cc", "dd") for c in ("com", "org", "info")] + ["bad.org", "x.bad.org", "good.org", "friend.info", "farm.info", "old.net", "10.0.0.7"]
    link = lambda h: rng.choice(['<a href="http://{}/q">', "<A HREF='//{}?x'>", "<link href = https://{} rel=x>", '<a class=b href="HTTPS://{}#f">']).format(h)
    pages = []
    for i in range(500):
        h = "m.aa.com" if i % 3 == 0 else rng.choice(hosts)  # one host has a third of all pages
        pages.append((i, f"{rng.choice(['http', 'https'])}://{h.upper() if i % 7 == 0 else h}{rng.choice(['/en/1', '/de/2?x=/fr/', '/x#y', '', '?q', '/'])}", "".join(link(rng.choice(hosts)) for _ in range(rng.randrange(4))) + '<a href="/own"><a href="mailto:a@b">'))
    pages += [(1000 + i, "http://mill.info/a", '<a href="http://bad.org/1"><a href="http://x.bad.org/2">') for i in range(4)]  # links to what is blocked, nothing else
    pages += [(1100 + i, "http://good.org/a", '<a href="http://pal.info/1">') for i in range(4)] + [(1200, "http://pal.info/", ""), (1201, "http://alone.info/", None)]
    pages += [(2000, None, "<a href=//bad.org>"), (2001, "no scheme", None), (2002, "http://", "x"), (2003, "a://b://c/d", None), (2004, "", ""), (2005, "http://ÄB.com/x", "<a href=http://bad.org"), (2006, "http://" + "a." * 300 + "com/de/", "<a " * 50_000), (2006, "http://m.aa.com/", "href" * 100_000), (None, "http://bad.org/q\nz?r", None)]
    return pages


def test_url_filters(spark):
    pages = linked_pages()
    rules = url_filters.rules_table(spark, RULES)
    got = url_filters.filter_urls(spark.createDataFrame([(*p, "h", "b") for p in pages], "page_id bigint, url string, html string, host string, rule string").repartition(5), rules)
    want = judged_by_hand(pages)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    verdicts = {x[0]: x[4] for x in want if x[3] is None}
    assert verdicts[1000] == "block" and verdicts[1200] == verdicts[1201] == "allow"  # by links alone
    assert {(x[5] > 300_000, x[6]) for x in want if x[1] == "pal.info"} == {(True, 0)}  # trusted by a link


def test_url_filters_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filters.filter_urls(none, url_filters.rules_table(spark, RULES)).count() == 0
    rows = spark.createDataFrame([(1, "http://a.net/", None)], "page_id bigint, url string, html string")
    assert [tuple(r) for r in url_filters.filter_urls(rows, url_filters.rules_table(spark, RULES).limit(0)).collect()] == [(1, "a.net", "/", None, "allow", 0, 0)]


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x"), (2, "http://a.example.net/e"), (3, "http://shop.example.com/de/"), (4, "http://net"), (5, "http://notnet/")], "page_id bigint, url string").selectExpr("*", "'' as html")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages, url_filters.rules_table(spark, RULES)).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("shop.example.com/de/", "block"), 4: (None, "allow"), 5: (None, "allow")}


# ---- whitening


def whitened_by_hand(rows, weights="one", components=16):
    xs = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for k, v in rows]
    held = Counter(x for _, x in xs)
    fit = [x for x, c in sorted(held.items()) for _ in range(c if weights == "count" else 1)]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array([[n * c - t for c, t in zip(x, s, strict=True)] for x in fit], float) / n
    e, u = np.linalg.eigh(m.T @ m / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for k, x in xs:
        d = [n * c - t for c, t in zip(x, s, strict=True)]
        out.setdefault(k, []).append((sum(y * y for y in d), np.array(d, float) / n @ u[:, :components] / np.sqrt(e[:components])))
    return n, e[:components] / e.sum(), out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((20, 20))
    good = [(i, [float(c) for c in np.float32(rng.standard_normal(20) @ mix / 9)]) for i in range(400)]
    good += [(1000 + i, good[7][1]) for i in range(300)] + [good[9], good[9], (None, good[11][1])]  # a hot vector, repeated rows, no key
    bad = [(2000, None), (2001, []), (2002, [None] + [0.0] * 19), (2003, [math.nan] * 20), (2004, [math.inf] + [0.0] * 19), (2005, [1.0] * 3), (2006, [3e38] + [0.0] * 19)]
    frame = spark.createDataFrame([(k, v, "c", 1) for k, v in good + bad], "vec_id bigint, embedding array<float>, x string, rows int")
    n, explained, want = whitened_by_hand(good, weights)
    got = defaultdict(list)
    for r in whitening.whiten(frame, weights=weights).collect():
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-9
        got[r.vec_id].append((r.component, r.deviation, r.whitened))
    assert set(got) == set(want) and sum(map(len, got.values())) == 16 * len(good)
    sign = np.sign([w for c, _, w in sorted(got[3])] * want[3][0][1])
    for k, rows in got.items():
        copies = len(want[k])
        for at, (c, deviation, w) in enumerate(sorted(rows)):
            assert c == at // copies + 1 and deviation == want[k][0][0]
            assert abs(w * sign[c - 1] - want[k][0][1][c - 1]) < 1e-8


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame([(1, None)])).count() == whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = whitening.whiten(frame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [3.0, 2.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in rows) == [(1, 1, 2, 16384, 1.0), (2, 1, 2, 16384, 1.0), (3, 1, 2, 16384, 1.0)]


def test_deviations_are_exact():
    big = np.array([[1 << 31, 3], [3_000_000_000, 5], [4_000_000_000, 0]])
    assert whitening._deviation(big) == [(1 << 62) + 9, 9_000_000_000_000_000_025, None]
    assert whitening._deviation(big // (1 << 20)) == [2048**2, 2861**2, 3814**2]


# ---- ranked search


def ranked_by_hand(docs, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(k, Counter(words(t))) for k, t in docs]
    held = [(k, c, sum(c.values())) for k, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for k, t in items:
        asked[k] |= set(words(t))
    out = []
    for k, own in asked.items():
        scored = []
        for doc, c, n in held:
            m = 10 + 90 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, -1 if doc is None else doc, doc))
        out += [(k, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1)]
    return sorted(out, key=repr)


def search_tables():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "über", "ÉTÉ", "naïve", "x1", "1", "ab", "b", "a", "日本語", "e\u0301"]
    text = lambda n: rng.choice(["", ". "]) + "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "  ", "_", "\n", "\x00", "\x7f", "/"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1]), (2000, None), (2001, ""), (2002, " ...\t"), (2003, "w1 " * 200_000), (2004, "z" * 300_000)]
    items = [(i, text(rng.randrange(1, 8))) for i in range(30)] + [(50, "absent"), (51, None), (52, ""), (53, "w1 W1 w1"), (54, "w2"), (54, "w3 w2"), (None, "Über W5"), (55, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 40}, {"CELLS": 50}, {"BLOCK_ITEMS": 7}])
def test_ranked_search(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = search_tables()
    d = spark.createDataFrame([(k, t, 1, "n") for k, t in docs], "doc_id bigint, text string, n int, term string").repartition(6)
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, rank int")
    got = lexical_search.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked_by_hand(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], f"{k} bigint, text string") for k in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    asked = some.withColumnRenamed("doc_id", "item_id")
    assert lexical_search.search(docs, asked).count() == lexical_search.search(some, items).count() == lexical_search.search(docs, items).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, asked).collect()] == ranked_by_hand([(1, "a b")], [(1, "a b")])


@pytest.mark.parametrize("name", ["op11_url_filters", "op13_lexical_search"])
def test_matches_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]
    assert sorted((tuple(sorted(r.items())) for r in got), key=repr) == sorted((tuple(sorted(r.items())) for r in want), key=repr)
