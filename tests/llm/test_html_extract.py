import itertools
import os
import random
import re
import time

import pytest

from marlstone.llm import html_extract as hx
from marlstone.llm.entry import op8_main_text


def text(page):
    return hx.parsed(1, "u", "h", "p", page).text()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><li>menu</nav><article><h1>A &amp; B</h1><p>one<br>\n two  <b>bold</b>&nbsp;x</article><footer>f</footer>", "A & B\none\ntwo bold x"),
        ('<article><p>a<p>b<ul><li>c<li>d</ul><script>var t="</p>";</script><div class="ad box">buy</div><div class="article-body">e</div></article>', "a\nb\nc\nd\ne"),
        ("<main><form>f</form><aside>s</aside><p>x &lt;tag&gt; &#233;&#x20AC; &amp &am &copy</p><section id='comments'><p>first!</section></main>", "x <tag> é€ & &am ©"),
        ("<article><p><b>a.<br><p>b</p><p>c</p></article>", "a.\nb\nc"),
        ("<article>1 < 2 and 3 <!-- no --> ok <unclosed attr='>", "1 < 2 and 3 ok"),
        ("<article><p>a</p><!-- open", "a"),
        ("<article><header>h</header><pre>x\n  y</pre><table><tr><td>1<td>2<tr><td>3</table></article>", "x y\n1\n2\n3"),
        ("plain text only", "plain text only"),
        ('<article><div role="navigation">n</div><p hidden>h</p><div aria-hidden="true">z</div><p class=lead>k</p></article>', "k"),
        ('<div class="page has-sidebar no-ads"><main><p>kept</p><div class="main sidebar">gone</div></main></div>', "kept"),
        ("<ARTICLE><P>Up</P><SCRIPT>x</SCRIPT ><P>per</ARTICLE>", "Up\nper"),
        ('<article class="post comments-open"><p>kept</p></article>', "kept"),
        ('<main class="wide content-sidebar"><p>kept</p></main>', "kept"),
        ('<article id="sidebar-effect-physics"><p>kept</p></article>', "kept"),
        ('<div class="menu">m</div><article><h2>A teaser</h2></article><div id="content"><p>the body of this page, longer</p></div>', "the body of this page, longer"),
        ('<article><p>a <label>b</label> <span class="notice">c</span></p><p class="share-price">d</p><math><mi>x</mi></math></article>', "a b c\nd\nx"),
        ('<article><p>a</p><div class="cookie-notice">n</div><div class="notice">n</div><ul class="site-menu"><li>m</ul><section class="user-comments">c</section></article>', "a"),
        ('<article><p>the story that is told here</p><article class="comment"><p>nice</p></article></article><article>more</article>', "the story that is told here"),
        ('<article><p>one of two, as long</p></article><article><p>two of two, as long</p></article>', "one of two, as long\ntwo of two, as long"),
        ("<article><div><p>a</b></i></span></p><p>b</div></article></div></article>", "a\nb"),
        ("<i><article>a</i> b</article>", "a b"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


@pytest.mark.parametrize("bad", ["<b>{0}</i>{0}", "<i><div><b>{0}</i>{0}", "<p><b>{0}</p>{0}", "<div>{0}</p>{0}", "<p>{0}<b>{0}<div>x{0}", "<li>{0}</li>{0}"])
def test_badly_nested_pages_take_linear_time(bad):
    def seconds(n):
        began = time.process_time()
        text("".join(part * n for part in re.split(r"\{0\}", bad)))
        return time.process_time() - began

    assert seconds(100_000) < 5 + 40 * seconds(10_000)


def test_longest_common_subsequence():
    def slow(a, b):
        for n in range(len(a), -1, -1):
            for keep in itertools.combinations(range(len(a)), n):
                it = iter(b)
                if all(a[i] in it for i in keep):
                    return n

    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 7)) for _ in "ab")
        found = sorted(hx.shared_lines(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == slow(a, b)


def page(body):
    return f"<html><body>{body}</body></html>"


def site():
    rows = []
    for host in range(3):
        for i in range(40 if host else 120):
            rows.append((len(rows), f"https://h{host}.org/sec{i % 4}/p{i}.html", page(f"<div>Menu {i % 4}</div><p>own line {host} {i}</p><p>All about us</p>")))
    rows += [(900, "https://alone.org/x", page("<div>Menu</div><p>own</p>")), (901, None, None), (902, "no url", ""), (903, "https://h0.org/a/1", page("<article><p>Menu 1</p></article>"))]
    return rows


def brute_force(rows):
    """Pages whose blocks are div and p: their lines by regular expression, neighbours by sorting, subsequences by table."""
    pages, out = [], {}
    for page_id, url, html in rows:
        lines = [x for x in re.split(r"<[^>]*>", html or "") if x]
        m = re.match(r"[a-z]+://([^/]*)(.*)", url or "")
        if "<article>" in (html or ""):
            out[page_id] = "\n".join(lines)
        else:
            pages.append((m[1] if m else "", m[2] if m else "", page_id, lines))
    pages.sort()
    for i, (host, path, page_id, lines) in enumerate(pages):
        near = [pages[j] for j in (i - 1, i + 1) if 0 <= j < len(pages) and pages[j][0] == host]
        common = lambda p: len(os.path.commonprefix([path, p[1]]))
        if not near:
            out[page_id] = "\n".join(lines)
            continue
        other = near[0][3] if len(near) < 2 or common(near[0]) >= common(near[1]) else near[1][3]
        size = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
        for a in range(len(lines) - 1, -1, -1):
            for b in range(len(other) - 1, -1, -1):
                size[a][b] = size[a + 1][b + 1] + 1 if lines[a] == other[b] else max(size[a + 1][b], size[a][b + 1])
        a = b = 0
        kept = []
        while a < len(lines):
            if b < len(other) and lines[a] == other[b]:
                a, b = a + 1, b + 1
            elif b < len(other) and size[a][b + 1] > size[a + 1][b]:
                b += 1
            else:
                kept.append(lines[a])
                a += 1
        out[page_id] = "\n".join(kept)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 50])
def test_differencing_is_the_same_over_any_ranges(spark, ranges):
    rows = site()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        out = {r.page_id: r.text for r in hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == brute_force(rows) and len(out) == len(rows)
    assert out[0] == "own line 0 0" and out[900] == "Menu\nown" and out[901] == "" and out[903] == "Menu 1"


def test_query(spark, sf):
    rows = op8_main_text(spark, sf).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        lines = [" ".join(__import__("html").unescape(x).split()) for x in __import__("re").split(r"<(?!/?b>)[^>]*>", inside.replace("<b>", "").replace("</b>", ""))]
        assert r.text == "\n".join(filter(None, lines)) and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert hx.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
