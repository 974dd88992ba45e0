"""Operators 2 and 4, and the pipeline, against plain versions."""

import hashlib
import html
import random
import re
import string
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obsidia.llm import queries as q
from obsidia.llm.html_text import extract_pages, main_text
from obsidia.llm.secrets import base_digest, marginal_bytes, scan_secrets, secret_spans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets_of_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op4_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id])
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest() == base_digest(texts[r.doc_id])
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(r.spans.split(",")) | {""}


def test_secrets_of_random_texts():
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "ſecret", '"', "'", " ", "=", ":", "abc", "abcdef1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ef", "\n", "ñ", "😀", ".", "-"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 20)))
        spans = secret_spans(text)
        assert [(k, s, e) for s, e, k in spans if k != "novel"] == plain_base(text)
        base = [(s, e) for s, e, k in spans if k != "novel"]
        assert not any(s < b and a < e for s, e, k in spans if k == "novel" for a, b in base)


def test_novelty_reports_what_the_context_does_not_explain():
    rng = random.Random(8)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    assert [k for _, _, k in secret_spans(f"Authorization: Bearer {key}\n")] == ["novel"]
    start, end, _ = secret_spans(f"credentials -> private_key = '{key}'")[0]
    assert f"credentials -> private_key = '{key}'"[start:end] == key
    assert secret_spans("client: getUserNameFromConfig2 getUserNameFromConfig2") == []
    assert secret_spans(f"the same {key} again, session {key} and {key}") == []
    assert secret_spans("the private library of the client was authorized yesterday") == []
    assert marginal_bytes(key, "") > 24 > marginal_bytes(key, f"see {key}")


def test_odd_rows(odd_docs, no_docs, spark):
    rows = scan_secrets(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.doc_id for r in rows if r.spans} == {10}
    assert [s["kind"] for r in rows for s in r.spans] == ["assign", "access", "hex"]
    assert scan_secrets(no_docs).count() == 0
    pages = spark.createDataFrame([(1, "u", None, 0), (None, None, "", 0), (2, "u", "<p>a &amp; b</p>", 0), (2, "u", "<p>a &amp; b</p>", 0)], "page_id long, url string, html string, text int")
    assert sorted((str(r.page_id), r.text) for r in extract_pages(pages).collect()) == [("1", ""), ("2", "a & b"), ("2", "a & b"), ("None", "")]
    assert extract_pages(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark, sf_dir):
    raw = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in q.op2_html_extraction(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", raw[r.page_id], re.S)
        parted = re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", re.sub("<!--.*?-->", "", inside[1], flags=re.S))
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", parted)).split())
        assert r.text == want and r.n_chars == len(want)


NAV = "<nav><ul><li><a href=a>Home of all</a><li><a href=b>About us and them</a></ul></nav>"
BODY = "<p>The first paragraph of the article, with some length to it.</p><p>The second &lt;one&gt;, with a <a href=x>link</a> and\n more&nbsp;words.</p>"
TEXT = "The first paragraph of the article, with some length to it. The second <one>, with a link and more words."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{NAV}<article>{BODY}</article><footer>Foot</footer></body></html>",
        f"<body><header><h1>Site</h1>{NAV}</header><div class='page with-sidebar'><main>{BODY}<section id=comments><article class=comment><p>{'A reader says much. ' * 30}</p></article></section></main></div><aside>{'Aside text. ' * 40}</aside>",
        f"<body><div id=top-menu><a href=a>a</a></div><div class=content>{BODY}</div><div class='ad-slot banner'>{'Buy now, it is cheap. ' * 30}</div><div role=contentinfo>x</div>",
        f"<body><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><div>{BODY}<form><label>Mail</label><input name=m><button>Go</button></form></div><div class='cookie-notice'>We use cookies</div><!-- <p>gone</p> -->",
        f"<BODY><TABLE><TR><TD>{NAV}</TD><TD>{BODY}</TD></TR></TABLE>",
        f"<div hidden>secret</div>{BODY}<div style='display: none'>x</div>",
    ],
)
def test_articles_without_furniture(page):
    assert main_text(page) == TEXT


def test_broken_markup():
    assert main_text("<p><b>One<br><p>two</b> <i>th</i>ree") == "One two three"
    assert main_text("a < b and <c> d</c> &amp;amp; <p") == "a < b and d &amp;"
    assert main_text("<ul><li>a<li>b</ul>") == "a b" and main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("") == "" and main_text("<script>x") == "" and main_text("<!-- x") == ""


LONG = "<p>" + "Long words of a text about something. " * 5 + "</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p class=a">Hello world</p><p>Second</p>', "Hello world Second"),
        ("<p title=it's>One</p><p>Two</p>", "One Two"),
        ('<p title="a > b">One</p>', "One"),
        ("<main>x</main><p>outside</p>", "x"),
        ("<article><p>Intro.</p><section class=related-work><p>Earlier work.</p></section></article>", "Intro. Earlier work."),
        (f"<body class=no-sidebar><div class='social science'>{LONG * 3}</div><footer>x</footer>", ("Long words of a text about something. " * 15).strip()),
        (f"<div class='layout with-sidebar'>{LONG * 3}<div class='sidebar left'>{LONG}</div></div>", ("Long words of a text about something. " * 15).strip()),
        (f"<div class=content>{LONG * 3}</div><div class='related-posts widget'>{LONG}</div><div class='share buttons'>Share</div>", ("Long words of a text about something. " * 15).strip()),
        ("<article><div class=post-header><h2>Head line</h2></div><p>Body.</p></article>", "Head line Body."),
    ],
)
def test_names_and_quotes_that_mislead(page, want):
    assert main_text(page) == want


def test_long_pages_are_read_whole_in_linear_time():
    body = "".join(f"<p>Paragraph {i} of a very long page, with words enough.</p>" for i in range(40_000))
    assert main_text(f"<nav>menu</nav><article>{body}</article>").endswith("Paragraph 39999 of a very long page, with words enough.")
    for unclosed in ("<b></p>", "<i><b></i>", "<b><div></div>", "<li><b>", '<a href="'):
        start = time.monotonic()
        main_text(unclosed * (300_000 // len(unclosed)))
        assert time.monotonic() - start < 30


def test_very_long_texts_are_scanned_whole():
    text = "plain words and numbers 12345, again. " * 30_000 + "password = hunter2hunter2"
    assert [(k, text[s:e]) for s, e, k in secret_spans(text)] == [("assign", "password = hunter2hunter2")]


def passing(rows):
    """The rows that pass their own rules and whose source isn't far above the others, by a beta prior."""
    from tests.llm.test_tables import repeat_words, words

    out, fails = [], defaultdict(list)
    for r in rows:
        w, text = words(r.text), r.text or ""
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * repeat_words(w) > 50 * len(w) or sum(c in "#*$%&|<>" for c in text) > 0.5 * len(w) or len(lines) - len(set(lines)) > 0.5 * len(lines)
        fails[r.source].append(failed)
        if not failed:
            out.append(r)
    n = sum(map(len, fails.values()))
    m = sum(map(sum, fails.values())) / n
    v = max(sum(len(f) * (sum(f) / len(f) - m) ** 2 for f in fails.values()) / n, 1e-9)
    strength, cut = min(max(m * (1 - m) / v - 1, 10), 1e6), min(max(m + 2 * v**0.5, 0.5), 0.75)
    return [r for r in out if (sum(fails[r.source]) + strength * m) / (len(fails[r.source]) + strength) <= cut]


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage against a plain version over the rows that the last one left."""
    from tests.llm.test_near import five_words, similar
    from tests.llm.test_pairs import find_components
    from tests.llm.test_tokens import check_packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, tables[-1], sf_dir).persist()
        assert out.columns == columns, name
        tables.append(out)
    raw, good, lined, single, mixed = ([*t.collect()] for t in tables)
    assert sorted(r.doc_id for r in passing(raw)) == sorted(r.doc_id for r in good)

    pages = {(r.source, r.text) for r in good}
    hosts = Counter(s for s, _ in pages)
    on = Counter((s, x) for s, t in pages for x in {x.strip(" \t\n\r\x0b\f") for x in t.split("\n")} if x)
    often = {k for k, n in on.items() if n > 1 and n - 1 > 0.01 * (hosts[k[0]] - 1 + 400)}
    want = {}
    for r in good:
        kept = [x for x in r.text.split("\n") if (r.source, x.strip(" \t\n\r\x0b\f")) not in often]
        lines = r.text.split("\n")
        want[r.doc_id] = r.text if len(lines) - len(kept) > 0.5 * sum(map(bool, map(str.split, lines))) else "\n".join(kept)
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined if r.text != next(g.text for g in good if g.doc_id == r.doc_id))

    lined.sort(key=lambda r: r.doc_id)
    sets = [five_words(r.text) for r in lined]
    roots = find_components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])])
    assert sorted(r.doc_id for r in single) == [lined[i].doc_id for i, r in enumerate(roots) if r == i]

    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in single}
    check_packing([(r.doc_id, r.text) for r in mixed], corpus_pipeline.STAGES[-1][1](spark, tables[-1], sf_dir).collect())


def test_pipeline_runs_whole(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.filter(F.col("offset") + F.col("length") > 4096).count() == 0 and out.count() > 100
