"""Main text on sites as they are made, and the op3 query against plain voting."""

from collections import Counter, defaultdict

import pytest

from loomgraph.llm import html, queries

LINE = "The river runs by the mill, and in the morning the fog lies over it until the sun is high."


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


CASES = {
    "a form around the page": (f'<form id="aspnetForm"><input name="x"><div class="content"><p>{LINE}</p><p>{LINE}</p></div></form>', f"{LINE} {LINE}"),
    "a form beside it": (f'<article><p>{LINE}</p><form><label>Your name</label><input><button>Go</button></form></article>', LINE),
    "readers of a blog": (f'<article><p>{LINE}</p></article><ol class="commentlist"><li><p>{LINE * 3}</p></li></ol>', LINE),
    "readers within": (f'<article><p>{LINE}</p><div class="discussion"><p>{LINE * 3}</p></div></article>', LINE),
    "adverts by name": (f'<article><p>{LINE}</p><div class="adsbygoogle"><p>{LINE[:40]}</p></div><div id="google_ads_div"><p>Buy now, and pay next year.</p></div></article>', LINE),
    "a site's own words": (f'<div class="text"><p>{LINE * 2}</p></div><div class="site-info"><p>All rights are ours, and so are all of these many words here.</p></div>', LINE * 2),
    "a section that is called otherwise": (f'<article><p>{LINE}</p><div class="binary-search"><p>{LINE}</p></div><section class="release-notices"><p>{LINE}</p></section></article>', f"{LINE} {LINE} {LINE}"),
    "a search box": (f'<article><p>{LINE}</p><div class="site-search"><p>Find what you are looking for, in all of our many pages, here.</p></div></article>', LINE),
    "a menu of other words": (f'<article><p>{LINE}</p><div class="county-menu"><p><a>One</a> <a>Two</a></p></div></article>', LINE),
    "character data": ("<article><p>a<![CDATA[ x>y &amp; ]]>b</p></article>", "a x>y &amp; b"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_single_pages_of_real_sites(spark, name):
    body, want = CASES[name]
    df = spark.createDataFrame([(1, "http://a.org/1", page(body))], "page_id long, url string, html string")
    assert html.main_text(df).first().text == want


def plain_votes(pages):
    """What hosts agree on, counted page by page on the driver."""
    hosts = defaultdict(list)
    for host, text in pages:
        hosts[host].append(html.votes_of(html.blocks_of(text or "")))
    out = {}
    for host, all_votes in hosts.items():
        all_votes = [v for v in all_votes if v]
        wins, worth, articles = Counter(), Counter(), defaultdict(set)
        marks, sets = defaultdict(lambda: defaultdict(set)), defaultdict(set)
        best_of = defaultdict(float)
        for votes in all_votes:
            article = votes[0][2]
            _, path, mark, score = votes[0]
            wins[path] += 1
            worth[path] += round(score)
            articles[path].add(mark)
            for role, p, m, w in set(votes[1:]):
                key = html.signed(html.key_of(p)) if p else 0
                if role == "beside":
                    marks[key][m].add(article)
                    best_of[key, m, article] = max(best_of[key, m, article], w)
                else:
                    sets[m].add(article)
        if not wins:
            continue
        n = sum(len(a) for a in articles.values())
        path = max(wins, key=lambda p: (wins[p], worth[p], p))
        more = set()
        for key, own in marks.items():
            count, most = sum(map(len, own.values())), max(map(len, own.values()))
            good = 2 * most < count if n >= html.FEW else sum(best_of[key, m, a] for m in own for a in own[m]) >= count
            if 2 * count >= n and good:
                more.add(key)
        less = {m for m, a in sets.items() if len(a) >= html.FEW and 2 * len(a) >= n}
        out[host] = (path, frozenset(more), frozenset(less))
    return out


def plain_text(text, agreed):
    own = html.blocks_of(text or "")
    path, more, less = agreed or ("", frozenset(), frozenset())
    if not (path and html.text_at(own, path)):
        path = html.best_path(own)[0]
    path = html.whole_path(own, path)
    return html.text_at(own, path, more, less) if path else ""


def host_of(url):
    import re

    found = re.match(html.HOST, url or "")
    return found[1].lower() if found else ""


def test_query_equals_plain_voting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    agreed = plain_votes([(host_of(r.url), r.html) for r in rows])
    got = {r.page_id: r.text for r in queries.op3_html_consensus(spark, sf_dir).collect()}
    assert got == {r.page_id: plain_text(r.html, agreed.get(host_of(r.url))) for r in rows}


def test_made_sites_equal_plain_voting(spark):
    rows = []
    for host in range(4):
        for n in range(2 + 3 * host):
            story = f'<div class="intro"><p>Story {n} of {host} begins on a day that was like no other day in that whole year.</p></div><div class="text"><p>{LINE * 2} And it was number {n}.</p><div class="box"><p>Subscribe to our letter, and never miss a story of {host}.</p></div></div>'
            rows.append((len(rows), f"http://H{host}.org/{n}", page(story + f'<div class="foot"><p>All of this site is ours alone, and nobody else may copy any part of it.</p></div>')))
    rows += [(100, None, page(f"<p>{LINE}</p>")), (101, "http://h3.org/x", None), (102, "http://h1.org/0", rows[3][2])]
    agreed = plain_votes([(host_of(u), h) for _, u, h in rows])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == {i: plain_text(h, agreed.get(host_of(u))) for i, u, h in rows}
    assert "Subscribe" not in got[len(rows) - 4] and "begins on a day" in got[len(rows) - 4]
