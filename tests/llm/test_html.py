from logloom.llm.html import extract, main_text, votes

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body>"
    "<div class='cookie-notice'>We use cookies</div><nav><ul><li><a href=x>Menu</a></li></ul></nav><div id=wrap class='col c12'>"
    "<div class='sidebar'><p>Side text side text side text</p></div><div class='post body-7'><h1>A &lt;title&gt;</h1>"
    "<p>First <b>bold</b>\n\n line<br>next&nbsp;one<p>Second <i>open<form><input value='x'><p>in a form</p></form>"
    "<ul><li>one<li>two</ul><div class=ad>Buy</div><table><tr><td>c1<td>c2</table>tail</div>"
    "<section id='comments'><p>Reader says a lot of things here, more than the article.</p></section></div>"
    "<footer>&copy; foot</footer></body></html>"
)
WANT = "A <title>\n\nFirst bold line next one\n\nSecond open\n\none\n\ntwo\n\nc1\n\nc2\n\ntail"


def test_one_page():
    assert extract(PAGE, None) == WANT
    assert votes(PAGE)[0] == "/html/body/div.c#.col/div.body-#.post"


def test_broken_markup():
    assert extract("", None) == "" and votes("") is None
    assert extract("just text", None) == "just text"
    assert extract("<p>cut <b", None) == "cut"
    assert extract("<article><p>a</div></span><p>b &amp", None) == "a\n\nb &"
    assert extract("<article><p>x<script>never closed <p>y", None) == "x"
    assert extract("<div>" * 3000 + "deep", None) == "deep"


def test_hosts_agree(spark):
    page = "<html><body><div class=main>{}</div><div class=extra>{}</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(f"<p>story {i} {'word ' * 30}</p>", "<p>short</p>")) for i in range(12)]
    rows += [(50, "http://A.example/x", page.format("<p>little</p>", "<p>a long extra part of the page</p>" * 9))]
    rows += [(60, None, "<p>free text"), (61, "http://b.example/", None), (62, "nonsense", ""), (63, None, None), (60, None, "<p>free text")]
    table = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, winners string")
    got = main_text(table).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[3] == f"story 3 {'word ' * 30}".strip()
    assert texts[50] == "little"  # the host's pages agree on .main
    assert texts[60] == "free text" and [texts[i] for i in (61, 62, 63)] == [""] * 3
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_text(table.where("false")).count() == 0


def test_time_follows_the_length_of_deep_and_unclosed_markup():
    import time

    begin = time.perf_counter()
    assert extract("<div>" * 60_000 + "deep", None) == "deep"
    assert extract("<b>" * 60_000 + "one<p>two", None) == "one\n\ntwo"
    assert extract("<div><p>a" * 20_000, None) == "\n\n".join("a" * 20_000)
    assert extract("<article>" + "<b><p>x</i>" * 20_000, None) == "\n\n".join("x" * 20_000)
    assert time.perf_counter() - begin < 20


def test_hosts_beyond_the_copied_ones_are_dealt_over_salts(spark, small, values, monkeypatch):
    from logloom.llm import html

    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = values(main_text(pages))
    monkeypatch.setattr(html, "HOSTS", 0)
    monkeypatch.setattr(html, "PAGES", 3)
    assert values(main_text(pages)) == want


def test_pages_against_a_plain_vote(spark, small):
    """The same votes, counted in plain Python over the whole table."""
    import re
    from collections import Counter, defaultdict

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    host = lambda u: (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", u or "") or ["", ""])[1].lower()
    count, weight, total = defaultdict(Counter), Counter(), Counter()
    for _, url, page in rows:
        if vote := votes(page or ""):
            count[host(url)][vote[0]] += 1
            weight[host(url), vote[0]] += vote[1]
            total[host(url)] += 1
    winners = {
        h: [p for p, n in sorted(c.items(), key=lambda x: (-x[1], -round(weight[h, x[0]], 3), x[0])) if n >= 0.05 * total[h]]
        for h, c in count.items()
    }
    got = {r["page_id"]: r["text"] for r in main_text(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    assert got == {i: extract(page or "", winners.get(host(url))) for i, url, page in rows}
