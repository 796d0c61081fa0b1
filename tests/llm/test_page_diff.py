"""Page differencing against a plain version, on awkward markup and on the pages of the smallest tables."""

import html as markup
import random
import re
from collections import Counter, defaultdict
from os.path import commonprefix

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import queries
from parlance.llm.html_lines import article, lines, place_of, shared
from parlance.llm.page_diff import extracted

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def common_length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=24), st.lists(st.integers(0, 4), max_size=24), st.sampled_from([1, 16, 100, 1 << 20]))
def test_shared_is_a_longest_common_subsequence(a, b, room):
    marks = shared(a, b, room)
    kept, rest = [x for x, m in zip(a, marks, strict=True) if m], iter(b)
    assert len(kept) == common_length(a, b) and all(x in rest for x in kept)


def texts(page):
    found = lines(page)
    return [found[i].text for i in article(found)[0]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []), ("", []), ("  \n ", []), ("plain  text\n here", ["plain text here"]), ("a < b &lt; c &amp;amp; &eacute;&#233;&nbsp;x", ["a < b < c &amp; éé x"]),
        ("<p>one<p>two<br>three<div>four</div>five", ["one", "two three", "four", "five"]), ("<b>in</b>line <i>x</i>", ["inline x"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes", ["yes"]), ("<p>a<!-- <p>no</p> -->b</p><!-- open <p>x", ["ab"]), ('<p title="a > b">t</p>', ["t"]),
        ("<nav>menu</nav><header>top</header><article><header><h1>T</h1></header>body</article><footer>f</footer><aside>s</aside>", ["T", "body"]),
        ("<body class='has-sidebar'><div class='content with-sidebar'>text</div><div id=sidebar>no</div><div class='siteMenu'>no</div><div class='admin'>yes</div></body>", ["text", "yes"]),
        ("<main><h1>T</h1><article>one</article><section id='comments'><article>no</article></section></main>", ["one"]), ("<main>in</main><p>out", ["in"]),
        ("<p>a</b></div></p>b<ul><li>x<li>y<ul><li>z</ul></ul>", ["a", "b", "x", "y", "z"]), ("<form>no</form><button>no</button><p>yes <select><option>no</select>", ["yes"]),
        ("<head><title>no</title><p>yes", ["yes"]), ("text <a href='cut", ["text"]), ("<article>unclosed <p>end", ["unclosed", "end"]), ("<div role=banner>no</div><div class=cookie-notice>no</div>yes", ["yes"]),
    ],
)
def test_lines(page, want):
    assert texts(page) == want


def test_places():
    same = ["http://a.org/en/5", "https://A.org/en/5/", "a.org/en/5.html#top", "https://a.org:443/en/5?utm_source=feed", "http://a.org/en/5?page=2&ref=x"]
    assert {place_of(u) for u in same} == {("a.org", "en/000000000005")}
    assert place_of("http://a.org/index.php?id=7&b=1") == ("a.org", "?b=000000000001&id=000000000007")
    assert place_of(None) == place_of("") == ("", "")


def plain(rows):
    """The operator without Spark, over all pairs of paths."""
    found = {i: lines(h) for i, (_, _, h) in enumerate(rows)}

    def entries(i):
        out = []
        for x in found[i]:
            key = ("slot", x.slot) if x.chrome else ("text", x.text)
            if not (x.chrome and out and out[-1] == key):
                out.append(key)
        return out

    first = {}
    for i, (page, url, h) in enumerate(rows):
        where, key = place_of(url), (page is not None, page or 0, url is not None, url or "", i)
        if where not in first or key < first[where][0]:
            first[where] = (key, i)
    hosts, has = defaultdict(list), defaultdict(Counter)
    for host, path in first:
        hosts[host].append(path)
        for e in set(entries(first[host, path][1])):
            has[e][host] += 1
    out = []
    for i, (page, url, _) in enumerate(rows):
        host, path = place_of(url)
        order = sorted(hosts[host], key=lambda p: p.encode())
        at = order.index(path)
        beside = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        here = entries(i)
        best = max(beside, key=lambda p: len(commonprefix([p, path]))) if beside else None
        both = Counter()
        places, marked = article(found[i])
        if best is not None:
            # which equal lines are matched is the library's choice, so tests have each text once a page
            near = entries(first[host, best][1])
            assert common_length(here, near) == sum(shared(here, near))
            both = Counter(x for x, m in zip(here, shared(here, near), strict=True) if m)
        own = [found[i][k].text for k in places]
        copied = sum(len(t) for t in own if both["text", t]) > 0.5 * sum(map(len, own))

        def site(t):
            n, total = has["text", t][host], sum(has["text", t].values())
            return both["text", t] and 2 * n > total and 2 * n >= len(order) and n >= max(3 if marked else 2, 10 if copied else 0)  # noqa: B023

        out.append((page, url, "\n".join(t for t in own if not site(t))))
    return out


def site(rng, host, pages, shape):
    """Pages of a host: lines of the site around and inside the text, a copied article, a passage that other hosts quote."""
    notice, teaser = f"All about {host} and its friends", f"Read more on {host}"
    for k in range(pages):
        own = [f"{host} story {k} line {j} " + " ".join(rng.choice("abcdefgh") for _ in range(12)) for j in range(rng.randint(2, 5))]
        if k in (1, 2):
            own = [f"{host} copied story line {j} with a good many words in it" for j in range(4)]
        if k % 3 == 0:
            own.insert(1, "A passage that every host quotes now and then")
        body = "".join(f"<p>{x}</p>" for x in own)
        menu = "".join(f"<li><a href=/{j}>{host} topic {rng.random()}</a></li>" for j in range(rng.randint(2, 6)))
        page = {"article": f"<nav><ul>{menu}</ul></nav><article>{body}<p>{teaser}</p></article><footer>{k} of {host}</footer>", "plain": f"<div>{notice}</div><ul class=menu>{menu}</ul>{body}<div>{teaser}</div>"}[shape]
        yield f"http://{host}/{'news' if k % 3 else 'blog'}/{k * 7}{'.html' if k % 2 else ''}", f"<html><body>{page}</body></html>"


def test_against_plain_version(spark):
    rng, rows = random.Random(5), []
    for host, pages, shape in (("one.org", 1, "plain"), ("two.org", 2, "plain"), ("few.org", 5, "plain"), ("some.org", 24, "article"), ("many.org", 60, "plain")):
        rows += [(len(rows) + i, u, h) for i, (u, h) in enumerate(site(rng, host, pages, shape))]
    rows += [(900, rows[10][1] + "?utm_source=x", rows[10][2]), rows[12], (901, None, "<p>no address"), (902, "http://many.org/news/7", None), (None, "http://some.org/x", "<p>no id")]
    frame = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7):
        got = sorted(map(repr, ((r.page_id, r.url, r.text) for r in extracted(frame.repartition(parts)).collect())))
        assert got == sorted(map(repr, plain(rows)))
    by = {page: text for page, _, text in plain(rows)}
    assert "Read more on many.org" not in "".join(by[i] for i in range(32, 92)) and "All about many.org" not in "".join(by[i] for i in range(32, 92))
    assert sum("every host quotes" in t for t in by.values()) == sum("every host quotes" in (h or "") for *_, h in rows[:92] + rows[92:93])  # a passage isn't a site's line
    assert sum(by[i].startswith("some.org copied story") for i in range(8, 32)) == 2  # nor is a copied article


def test_awkward_rows(spark):
    rows = [(1, "http://a.org/1", None), (1, "http://a.org/1", None), (None, None, ""), (2, "http://a.org/2", "<p>" + "long words here " * 200_000), (3, "::::", "<" * 1000), (4, "http://a.org/4", "<p>x\udcff".encode("utf-8", "replace").decode())]
    got = extracted(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", host string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_shared", "n_marked"]
    found = got.collect()
    assert Counter((r.page_id, r.url) for r in found) == Counter(r[:2] for r in rows) and all(r.n_chars == len(r.text) for r in found)
    assert {r.page_id: r.n_chars for r in found}[2] == 16 * 200_000 - 1
    assert extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op11_pages(spark):
    """The stored pages hold their text in one article element, as paragraphs."""
    got = {r.page_id: r for r in queries.op11_page_diff(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<br>", " ")
        want = "\n".join(x for x in (" ".join(markup.unescape(part).split()) for part in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    hosts = Counter(place_of(r.url)[0] for r in got.values())
    for r in got.values():  # menu, advert and footer, shared where there is a page to share them with
        assert (r.n_shared, r.n_marked) == ((3, 0) if hosts[place_of(r.url)[0]] > 1 else (0, 3))
