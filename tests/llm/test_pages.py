"""URL trust against a plain PageRank, and article extraction against the pages' own mark-up."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest

from lagline.llm import html_paths, queries, url_trust

PAGES = "page_id long, url string, html string, host string, n double"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "h", 0.5) for r in rows], PAGES)


def ruled(host, path):
    best = None
    for rule in url_trust.RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
            best = rule
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def plain_ranks(rows):
    """host -> (trust, distrust) by power iteration over a dictionary."""
    pages = [(split(u), h or "") for _, u, h in rows]
    verdicts = defaultdict(Counter)
    for (host, path), _ in pages:
        rule = ruled(host, path)
        verdicts[host][rule.verdict if rule else None] += 1
    hosts = [h for h in verdicts if h]
    trusted = {h for h in hosts if 2 * verdicts[h]["allow"] > sum(verdicts[h].values())}
    blocked = {h for h in hosts if 2 * verdicts[h]["block"] > sum(verdicts[h].values())}
    edges = Counter()
    for (host, _), source in pages:
        for link in re.findall(r'href="(https?://[^"]*)"', source):
            if host and split(link)[0] != host:
                edges[host, split(link)[0]] += 1
    names = set(hosts) | {x for e in edges for x in e}
    out = []
    for seeds, links in ((trusted, edges), (blocked, {(b, a): n for (a, b), n in edges.items()})):
        total = Counter()
        for (a, _), n in links.items():
            total[a] += n
        start = {h: (h in seeds) / len(seeds) if seeds else 0.0 for h in names}
        rank = dict(start)
        for _ in range(200):
            fresh = {h: 0.15 * start[h] for h in names}
            for (a, b), n in links.items():
                fresh[b] += 0.85 * rank[a] * n / total[a]
            rank = fresh
        out.append(rank)
    return {h: (out[0][h], out[1][h]) for h in names}


def link(*urls):
    return "<p>" + "".join(f'<a href="{u}">x</a>' for u in urls)


def test_ranks_equal_plain_power_iteration(spark):
    rows = [
        (1, "http://a.org/fr/1", link("http://b.com/x", "http://b.com/y", "/own", "http://A.org/self")), (2, "http://b.com/1", link("http://c.com/")),
        (3, "http://c.com/1", link("http://bad.net/x")), (4, "http://bad.net/q", link("http://d.com/", "http://a.org/")), (5, "http://d.com/", None),
        (6, "http://s.example.net/en/1", link("https://d.com?x")), (7, "http://lonely.com/", ""), (8, "http://farm.com/", link("http://bad.net/1")),
        (None, "http://x.b.com/1", "<p>"), (9, None, link("http://bad.net/")), (9, None, link("http://bad.net/")), (10, "no scheme", None), (11, "http://B.com?x=://", ""),
    ]
    out = url_trust.judge_urls(pages_of(spark, rows)).collect()
    want = plain_ranks(rows)
    even = sum(d for _, d in want.values()) / len(want)
    assert len(out) == len(rows)
    for r in out:
        url = next(u for i, u, _ in rows if i == r.page_id)
        assert (r.host, r.path) == split(url)
        rule = ruled(r.host, r.path)
        assert r.rule == (rule.name if rule else None)
        trust, distrust = want.get(r.host, (0.0, 0.0))
        assert r.trust == pytest.approx(trust, abs=1e-4) and r.distrust == pytest.approx(distrust, abs=1e-4)
        assert r.verdict == (rule.verdict if rule else "block" if distrust > trust and distrust > even / 2 else "allow")
    verdict = {r.host: r.verdict for r in out}
    assert verdict["farm.com"] == "block" and verdict["d.com"] == "allow" and verdict["lonely.com"] == "allow"


def test_urls_of_the_small_table(spark, small_tables):
    out = queries.QUERIES["op5_url_trust"](spark, small_tables).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small_tables}/pages.parquet").collect()}
    assert len(out) == len(urls)
    for r in out:
        assert r.host == urlsplit(urls[r.page_id]).netloc.lower() and r.path == urlsplit(urls[r.page_id]).path
        rule = ruled(r.host, r.path)
        assert r.rule == (rule.name if rule else None) and (not rule or r.verdict == rule.verdict)


def test_no_pages(spark):
    assert url_trust.judge_urls(pages_of(spark, [])).count() == 0 and html_paths.extract_articles(pages_of(spark, [])).count() == 0


def test_articles_of_the_small_table(spark, small_tables):
    out = {r.page_id: r for r in queries.QUERIES["op6_html_paths"](spark, small_tables).collect()}
    for page in spark.read.parquet(f"{small_tables}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*(>|\Z)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert out[page.page_id].text == "\n".join(b for b in blocks if b)
        assert out[page.page_id].n_chars == len(out[page.page_id].text) and out[page.page_id].url == page.url


PROSE = "One two three, four five six; seven eight. Nine ten, eleven twelve!"


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;words&gt;", "plain <words>"), (f"<p>{PROSE}", PROSE),
    (f"<div class='main'><p>{PROSE}</p><p>Short</p></div><div class='sidebar'><p>{PROSE}</p></div>", f"{PROSE}\nShort"),
    (f"<body><header><h1>Site</h1></header><main><h1>Head</h1><p>{PROSE}<p>A<br>b <b>c</b>d</main><section id='comments'><p>{PROSE}</section>", f"Head\n{PROSE}\nA b cd"),
    (f"<article><p>{PROSE}<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><form><p>{PROSE}</form><ul><li>x<li>y</ul></article>", f"{PROSE}\nx\ny"),
    (f"<article><p title='a>b'>{PROSE} &amp;&am", f"{PROSE} &&am"),
    (f"<article><p>{PROSE}</p><div class='cookie-notice'>{PROSE}</div><aside>{PROSE}</aside><p>end</article><footer>{PROSE}", f"{PROSE}\nend"),
    (f"<article><p>{PROSE}</p></b></div><p>more<p", f"{PROSE}\nmore"),
])
def test_layouts(source, text):
    assert html_paths.main_text(source) == text


def test_articles_of_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", f"<p>{PROSE}"), (2, "u", "<article>" + f"<p>{PROSE}</p>" * 4000 + "</article>")]
    out = html_paths.extract_articles(pages_of(spark, rows)).collect()
    assert Counter(r.n_chars for r in out) == Counter({0: 2, len(PROSE): 1, 4000 * (len(PROSE) + 1) - 1: 1})


@pytest.mark.parametrize("source, text", [
    *[(f"<body class='x'><div class='{name}'><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar'>{PROSE}</div>", f"{PROSE}\n{PROSE}")
      for name in ("content has-sidebar", "no-sidebar", "with-nav", "share-price")],
    (f"<form id=aspnetForm action=x><nav>Home</nav><div id=main><p>{PROSE}</p></div><div id=comments>{PROSE} {PROSE}</div></form>", PROSE),
    (f"<html><head><meta charset=utf-8><title>T</title><body><p>{PROSE}</p>", PROSE),
    (f"<head><link rel=x href=y><p>{PROSE}</p>", PROSE),
    (f"<div class=header><nav>Home</nav><article><p>{PROSE}</p></article></div><div class=comments><article><p>{PROSE} {PROSE}</p></article></div>", PROSE),
    (f"<div class=sidebar><p>Label<main><p>{PROSE}</p></main></div>", PROSE),
    (f"<article><p>{PROSE}</p><section id='discussion'><h2 id='search'>Found</h2><p>{PROSE}</p></section><h2 id='related-work' class='header'>Others</h2><p>{PROSE}</p></article>",
     f"{PROSE}\nFound\n{PROSE}\nOthers\n{PROSE}"),
    # still boilerplate, however long
    (f"<div class=post><p>{PROSE}</p></div><div class='comment-list'><article><p>{PROSE} {PROSE} {PROSE}</p></article></div>", PROSE),
    (f"<p>{PROSE}</p><div class='cookie-notice'><p>{PROSE} {PROSE} {PROSE}</p></div>", PROSE),
    (f"<p>One <span class=share>Share this!</span>two, three.</p><form>Name: <input></form>", "One two, three."),
    ("<nav><a href=x>Home</a></nav><form>Name <select><option>a, b.</select></form>", ""),
])
def test_boilerplate_that_holds_the_article_counts(source, text):
    assert html_paths.main_text(source) == text


LONG = f"<p>{PROSE}</p>" * 40
MANY = "\n".join([PROSE] * 40)


@pytest.mark.parametrize("source, text", [
    (f"<div class=post><h1>Title</h1><p>Lead</p><div class=body>{LONG}</div></div>", f"Title\nLead\n{MANY}"),
    (f"<main><h1>Title</h1><p>Lead</p><div class=body>{LONG}</div></main>", f"Title\nLead\n{MANY}"),
    (f"<body><div class=post><div class=head><h1>Title</h1></div><div class=body>{LONG}</div><div><h2>End</h2><p>{PROSE}</p><ul><li>x</ul></div></div>",
     f"Title\n{MANY}\nEnd\n{PROSE}\nx"),
    (f"<body><ul><li>Home<li>About</ul><div><a href=x>Log in, now.</a></div><div class=post><p>Lead<div class=body>{LONG}</div></div><footer>{PROSE}</footer>", f"Lead\n{MANY}"),
    (f"<body><div>Home</div><div class=post><h1>Title</h1><ul><li><a href=x>Next post</a></ul><ol><li>Salt</ol><div class=body>{LONG}</div></div>", f"Title\nSalt\n{MANY}"),
    (f"<body><div><p>{PROSE}</p></div><main><div>{LONG}</div><p>Close</p></main>", f"{MANY}\nClose"),
])
def test_what_stands_around_a_long_body_counts(source, text):
    assert html_paths.main_text(source) == text


NAMES = (
    "ad-slot google-ad adsbygoogle commentlist comment-respond topnav mainnav footnav pagefooter gdpr-notice cookie-law-info share-tools entry-footer sidebarLeft ad_300 leftsidebar "
    "promo-box related-posts site-search navbar-top sponsored-links").split()


@pytest.mark.parametrize("name", NAMES)
def test_names_of_boilerplate_in_and_beside_the_article(name):
    part = f"<div class='{name}'><p>{PROSE}</p><ul><li>x</ul></div>"
    assert html_paths.main_text(f"<article><p>{PROSE}</p>{part}<p>End.</p></article>") == f"{PROSE}\nEnd."
    assert html_paths.main_text(f"<body>{part}<div class='story'><h1>Title</h1>{LONG}</div>{part}") == f"Title\n{MANY}"


@pytest.mark.parametrize("name", "has-sidebar no-sidebar with-nav share-price commentary threads uploads add-on research loads adapter".split())
def test_names_that_only_look_like_boilerplate(name):
    assert html_paths.main_text(f"<article><p>{PROSE}</p><div class='{name}'>{PROSE}</div></article>") == f"{PROSE}\n{PROSE}"


# Parts under names that no list knows: only the ratios of their paths tell them.
LABELS = "".join(f"<li><a href=/{w}>{w}</a>" for w in ("Alpha", "Beta", "Gamma news"))
UNKNOWN = [
    (f"<article><h1>Title</h1><ul class=q7>{LABELS}</ul>{LONG}<div class=zz><a href=/x>Read on</a></div></article>", f"Title\n{MANY}"),
    (f"<article><h1><a href=/>Title</a></h1>{LONG}<p><a href=/x>A linked paragraph</a></p><ul class=plain><li>Salt<li>Rice</ul><div class=k>{LABELS}</div></article>",
     f"Title\n{MANY}\nA linked paragraph\nSalt\nRice"),
    (f"<body><div class=b1>{LABELS}</div><div class=b2><h1>Title</h1><div class=b3>{LABELS}</div>{LONG}<div class=b4><a href=/t>One tale, at length, of all that was</a></div></div>",
     f"Title\n{MANY}"),
    (f"<article><table class=d><tr><td>1<td>2<tr><td><a href=/x>n</a><td>Some plain words here</table>{LONG}</article>", f"1\n2\nn\nSome plain words here\n{MANY}"),
]


@pytest.mark.parametrize("source, text", UNKNOWN)
def test_path_ratios_tell_parts_of_unknown_names(source, text):
    assert html_paths.main_text(source) == text


def test_the_result_depends_on_the_ratios(monkeypatch):
    monkeypatch.setattr(html_paths, "block_scores", lambda blocks, linked: html_paths.np.ones(len(blocks)))
    assert sum(html_paths.main_text(source) != text for source, text in UNKNOWN) >= 3


def test_pages_of_links_only():
    assert html_paths.main_text(f"<body><ul>{LABELS}</ul>") == "Alpha\nBeta\nGamma news"


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Sixty hosts, each linking to the next, the last one blocked: distrust goes back all the way, halving into a loop at the start."""
    n = 60
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(n - 1)] + [("h1", "h0", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([(f"h{i}", 0, int(i == n - 1)) for i in range(n)], "host string, trusted int, blocked int")
    got = {r.host: r.distrust for r in url_trust.propagate(edges, seeds).collect()}
    want = [0.0] * n
    for _ in range(3000):
        fresh = [0.15 * (i == n - 1) for i in range(n)]
        for src, dst in [(i, i + 1) for i in range(n - 1)] + [(1, 0)]:
            fresh[src] += 0.85 * want[dst]
        want = fresh
    even = sum(want) / n
    assert got.keys() == {f"h{i}" for i in range(n)} and all(got[f"h{i}"] == pytest.approx(w, abs=even / 1000) for i, w in enumerate(want))
    assert got["h1"] > 0 and got["h0"] > 0
