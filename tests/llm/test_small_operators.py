"""Mixing, URL rules, quality, extraction, neighbours and the pipeline on small tables."""

import html
import random
import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from hazardline.llm.mixing import mix_sources
from hazardline.llm.neighbours import nearest
from hazardline.llm.quality import fit_quality, held_out, quality_scores
from hazardline.llm.url_filter import RULES, url_verdicts
from hazardline.llm.wrappers import blocks, extract, main_path, parse, pattern

FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


def fill(sizes, weights, most=3):
    """Share the total by weight, hold what is above its cap, share the rest again."""
    total, held = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(held.values())
        goal = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if goal[i] > most * sizes[i]]
        if not over:
            return [held.get(i, goal.get(i)) for i in range(len(sizes))]
        held |= {i: most * sizes[i] for i in over}


def test_mixing_fills_to_targets(spark):
    rng = random.Random(0)
    names = ["a", "b", "Ä", "zz", "c", None, "ab"]
    rows = [(i, " ".join("w" * rng.randrange(1, 400)), rng.choices(names, [200, 5, 60, 1, 80, 9, 30])[0], i) for i in range(900)]
    rows += [(901, None, "a", 1), (902, "", None, 2), (3, rows[3][1], rows[3][2], 3), (None, "x y", "b", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(4)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    order = sorted({r.source for r in got} - {None}) + [None]
    size = {s: sum(r.size for r in got if r.source == s) for s in order}
    want = dict(zip(order, fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for s in order:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= max(r.size for r in got if r.source == s)
    again = mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(df.limit(0)).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [t for _, t in RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/x", "https://example.org/en/12?a=1", "http://x.com/fr/", "http://x.com/de/1#q", "http://fr.com", "http://org/", "http://norg/", "x", None, "", "a://b://c/d", "http://ex.net/en/1?x=2&y=3",
            "http://example.org/en/2", "HTTP://com/fr/" + "y" * 5000, "http://x.com/de?/q"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls * 3)], "page_id long, url string, host int")
    got = url_verdicts(df).collect()
    verdicts = {t: v for v, t in RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == plain_rule((urls * 3)[r.page_id])
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
    assert len(got) == len(urls) * 3
    assert url_verdicts(df.limit(0)).count() == 0
    assert {r.verdict for r in url_verdicts(df.where("url = 'http://org/'")).collect()} == {"allow"}


@with_tables
def test_quality_on_held_out_rows(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality AS label")
    weights = fit_quality(docs, labels.where(~held_out("doc_id")))
    rows = quality_scores(docs, weights).join(labels, "doc_id").where(held_out("doc_id")).collect()
    assert np.mean([(r.score >= 0.7) == r.label for r in rows]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a " * 50000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality_scores(odd, weights).collect())
    nothing = fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality_scores(odd, nothing).collect()} == {0.5}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie notice">We use</div>
<article><h1>Big &amp; small</h1><p><b>One<br>two<p>three  &eacute;<ul><li>x<li>y</ul><form><input>q</form></article>
<div id="comments"><p>first!</p></div><footer>&copy;</footer><script>var t="</p>";</script></body>"""


def test_extraction(spark):
    plain = "<div class=menu>m</div><div><h2>Head</h2><p>" + "long text " * 30 + "</p><p>more</p></div><footer>tail</footer>"
    rows = [(1, "http://h/a", PAGE), (2, "http://h/b", PAGE.replace("three", "3")), (3, "http://g/x", plain), (4, None, None), (5, "http://h/c", ""), (6, "http://h/d", PAGE[:300]), (1, "http://h/a", PAGE), (7, "z://deep/", "<div>" * 3000 + "t")]
    got = sorted(extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").repartition(3)).collect())
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Big & small\n\nOne two\n\nthree é\n\nx\n\ny" and text[2] == text[1].replace("three", "3")
    assert text[3] == "Head\n\n" + ("long text " * 30).strip() + "\n\nmore" and text[4] == text[5] == "" and text[7] == "t"
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html.unescape("&eacute;") in text[6] or text[6].startswith("Big & small")


def test_parts_that_carry_the_article_are_not_marginal(spark):
    long = "many words of the text " * 20
    body = f"<h2 id=related-work>Work</h2><p>{long}</p><p class=notice>Beware</p><section id=share-prices><p>Prices <span id=Social_impact>rise</span></p></section>"
    side = "<div class=sidebar>side</div><div id=comments><p>first</p></div>"
    rows = [(f"http://h{i}/", f"<body><div class='{c}'>{body}{side}</div><footer>f</footer></body>") for i, c in enumerate(["content-sidebar-wrap", "no-sidebar", "has-header", "page-with-ads", "search-results"])]
    rows += [("http://h5/", f"<div class=search><article>{body}{side}</article></div>"), ("http://h6/", f"<form id=f>{body}{side}</form>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")).collect()}
    want = "\n\n".join(["Work", long.strip(), "Beware", "Prices rise"])
    assert [got[i] for i in range(7)] == [want] * 7
    beside = f"<article><p>{long}</p></article><div class=related><article>teaser</article></div><div class=comments>{long * 5}</div>"
    assert [r.text for r in extract(spark.createDataFrame([(1, "http://k/", beside)], "page_id long, url string, html string")).collect()] == [long.strip()]


def test_no_page_loses_its_article_to_the_hosts_path(spark):
    long = "many words of the text " * 20
    text = long.strip()
    pages = {
        "lead": ([f"<body><h1>Title</h1><p>lead</p><div>{long * 3}</div></body>"], [f"Title\n\nlead\n\n{(long * 3).strip()}"]),
        "templates": ([f"<body><div><div>{long}</div></div></body>"] * 19 + [f"<body><div>menu</div><p>{long}</p></body>"], [text] * 19 + ["menu\n\n" + text]),
        "cards": ([f"<body><main><article>{long}</article></main></body>"] * 5 + [f"<body><div>{long}</div><main><article>a</article><article>b</article></main></body>"], [text] * 5 + [text + "\n\na\n\nb"]),
        "several": ([f"<body><article>{long}</article><section><article>second {long}</article></section></body>"], [f"{text}\n\nsecond {text}"]),
        "rarer": ([f"<div><p>{long}</p></div>"] * 9 + [f"<div class=search><h2>Work</h2><p>{long}</p></div>"], [text] * 9 + ["Work\n\n" + text]),
        "title": ([f"<div><h1>Title</h1><p>by</p></div><article>{long}</article><ul><li><a>x</a></ul>"], ["Title\n\n" + text]),
    }
    rows = [(f"http://{h}/", i, page) for h, (given, _) in pages.items() for i, page in enumerate(given)]
    got = extract(spark.createDataFrame([(i, url, page) for url, i, page in rows], "page_id long, url string, html string").repartition(3)).collect()
    found = {(r.url[7:-1], r.page_id): r.text for r in got}
    wrong = [(h, i) for h, (_, want) in pages.items() for i, x in enumerate(want) if found[h, i] != x]
    assert wrong == []


def test_patterns_fold_and_align():
    a, b = pattern(parse("<ul><li>1<li>2<li>3</ul><p>x</p>")), pattern(parse("<ul><li>1</ul><hr><p>x</p>"))
    from hazardline.llm.wrappers import _both

    node = _both(a, b)
    assert [(k[0], k[1]) for k in node[3]] == [("ul", "1"), ("hr", "?"), ("p", "1")] and node[3][0][3][0][1] == "+"
    assert main_path(pattern(parse("<body><div><nav>n</nav><main><p>x</main></div></body>"))) == ["body", "div", "main"]
    assert blocks(parse("a<b>b</b>c<p>d")) == ["abc", "d"]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 12)).astype(np.float32)
    vectors[100:400] = vectors[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] * 12, 1), (2060, [float("inf")] + [1.0] * 11, 1), (2080, [None] + [1.0] * 11, 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    exact = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, relax=1.0).collect()}
    scores = vectors.astype(float) @ vectors.astype(float).T
    for q in range(0, 1500, 20):
        want = sorted((-np.round(scores[q, i], 9), i) for i in range(1500) if i != q)[:20]
        assert [exact[q, k + 1][0] for k in range(20)] == [i for _, i in want]
    found = {(r.query_id, r.vec_id) for r in nearest(df).collect()}
    truth = {(q, v) for (q, _), (v, _) in exact.items()}
    assert len(found & truth) >= 0.9 * len(truth) and len(exact) == 75 * 20
    assert nearest(df.limit(0)).count() == 0


@with_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and kept.schema == docs.schema, name
        before, after = {r.doc_id for r in docs.collect()}, [r.doc_id for r in kept.collect()]
        assert set(after) <= before and len(after) == len(set(after))
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and all(r.copies >= 1 and r.taken == r.copies * r.size for r in out)


def test_url_rates_cover_all_labelled_rows(spark, monkeypatch):
    from hazardline.llm import url_filter

    seen = []
    kept = url_filter._with_rates
    monkeypatch.setattr(url_filter, "_with_rates", lambda rows, rates, base: (seen.append((rates, base)), kept(rows, rates, base))[1])
    hosts = [f"s{i}.com" for i in range(60)]
    rows = [f"http://{h}/{'de' if i % 3 else 'fr'}/{j}" for i, h in enumerate(hosts) for j in range(5)] + ["http://hot.com/de/"] * 500 + ["http://s1.com/x"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").repartition(3)
    assert url_verdicts(df, most=40).count() == len(rows)
    rates, base = seen[0]
    got = {r.domain: (r.domain_rate, r.domain_weight) for r in rates["domain"].collect()}
    assert base == (200 + 500) / 800 and set(got) == {*hosts, "hot.com"}
    for i, h in enumerate(hosts):
        assert np.allclose(got[h], ((5 * (i % 3 > 0) + 10 * base) / 15, np.log1p(5)))
    # one address in most rows does not fill the sample, wherever its hash stands
    for name in "abcdef":
        hot = ["http://" + name + ".com/de/"] * 400 + ["http://x.com/fr/1", "http://y.com/fr/2"] * 4 + ["http://x.com/zz"]
        scores = url_verdicts(spark.createDataFrame(list(enumerate(hot)), "page_id long, url string"), most=20).collect()
        assert len({r.block_score for r in scores}) > 1
