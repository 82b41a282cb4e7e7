import pytest
from pyspark.sql import functions as F

from pagelake.operators import dom, enrich, extract, jsonitems, profile, robots
from pagelake.operators.extract import Field

LIST = """<html><body><ul class="items list">
<li class="item first"><h3><a href="/b/1" title="One">One <b>bold</b></a></h3><p class=price>£1.50
<li class="item"><h3><a href="b/2" rel="x title">Two</a></h3><p class="price old">&pound;2<p>second
<li class="item"><h3></h3> </ul><a class="next" href="?page=2">Next</a></body></html>"""


def css(html, selector):
    return dom.select(dom.parse_html(html), selector)


@pytest.mark.parametrize(
    ("selector", "n"),
    [("li", 3), ("li.item", 3), (".first", 1), ("ul > li", 3), ("ul > a", 0), ("li h3 a", 2), ("h3 + p", 2),
     ("a[title]", 1), ("a[rel~=title]", 1), ('a[href*="page="]', 1), ("[class*=price]", 2), ("li:nth-child(2) a", 1),
     ("h3, p.price", 5), ("*", 16), ("ul.items.list li.item", 3), ("#none", 0), ('a[href="/b/1"]', 1)],
)
def test_selectors(selector, n):
    assert len(css(LIST, selector)) == n


def test_tolerant_tree():
    assert [dom.joined_text([n]) for n in css("<p>a<p>b<div>c</div>d", "p")] == ["a", "b"]
    assert [dom.joined_text([n]) for n in css("<table><tr><td>1<td>2<tr><td>3</table>", "td")] == ["1", "2", "3"]
    assert dom.joined_text(css('<script>var t="</p>";</script><p>x', "script")) == 'var t="</p>";'
    assert len(css("plain text", "body")) == 1
    assert len(css("<b>x</i></b><br><br/>", "br")) == 2
    with pytest.raises(ValueError):
        dom.compile_selector("a:hover")


def pages(spark, *htmls):
    return spark.createDataFrame(
        [(i, f"https://s.test/l/{i}.html", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string"
    )


def test_items(spark):
    rows = extract.extract_items(
        pages(spark, LIST, "", "<p>none</p>"), "li.item",
        {"name": "h3 a::text", "link": "h3 a::attr(href)", "price": ".price", "no": "i::attr(x)"},
    ).orderBy("page_id", "item_idx").collect()
    assert [(r["item_idx"], r["name"], r["link"], r["price"], r["no"]) for r in rows] == [
        (0, "One bold", "/b/1", "£1.50", ""), (1, "Two", "b/2", "£2", "")]


def test_text_getters(spark):
    r = extract.extract_boxes(
        pages(spark, LIST), "html",
        {"first": Field("a", "first"), "all": Field("a", "all"), "hrefs": Field("li a", "attr_all", "href"), "none": Field("i", "first")},
    ).first()
    assert (r["first"], r["all"], r["hrefs"], r["none"]) == ("One ", ["One ", "Two", "Next"], ["/b/1", "b/2"], None)


BOOK = """<ul class="breadcrumb"><li><a>Home</a><li><a>Books</a><li><a>Poetry</a></ul>
<div class="product_main"><h1>Title</h1><p class="price_color">£51.77</p>
<p class="instock availability">  In stock <i></i>(22 available) </p><p class="star-rating Three"></p></div>
<div id="product_description"></div> <p>Long text</p>
<table class="table-striped"><tr><th>UPC</th><td>u1</td></tr><tr><th>Tax</th><td> £0 </td></tr><tr><th>UPC</th><td>u2</td></tr><tr><th>Empty</th><td></td></tr></table>"""


def test_products(spark):
    full, bare = extract.product_items(pages(spark, BOOK, "<p>x</p>")).orderBy("page_id").collect()
    assert (full["title"], full["price"], full["availability"], full["rating"]) == ("Title", "£51.77", "In stock  (22 available)", "Three")
    assert (full["upc"], full["tax"], full["reviews"], full["category"], full["description"]) == ("u2", "£0", "0", "Poetry", "Long text")
    assert (bare["title"], bare["upc"], bare["category"], bare["reviews"], bare["currency"]) == (None, "", "", "0", "GBP")


def test_quotes_keep_rows_of_one_author(spark):
    html = """<div class=quote><span class=text>Q1</span><small class=author>A</small><span><a href="/a/1">x</a></span>
    <div class=tags><a class=tag>t1</a><a class=tag>t2</a></div></div>
    <div class=quote><span class=text>Q2</span><span><a href="/a/1">x</a></span></div>
    <div class=quote><span class=text>Q3</span></div>"""
    quotes = extract.quote_items(pages(spark, html))
    authors = spark.createDataFrame(
        [("https://s.test/a/1", " Ann ", None, "Here\n", "")],
        "author_url string, author_name string, author_birth_date string, author_birth_place string, author_description string",
    )
    rows = enrich.author_enrich(quotes, authors).orderBy("item_idx").collect()
    assert [(r["content"], r["tag_count"], r["author_name"], r["author_birth_place"]) for r in rows] == [
        ("Q1", 2, "Ann", "Here"), ("Q2", 0, "Ann", "Here"), ("Q3", 0, "", "")]


def test_outlinks(spark):
    rows = extract.outlinks(pages(spark, LIST), {"detail": "li a", "next": "a.next"}).orderBy("kind", "link_idx").collect()
    assert [(r["kind"], r["dst"]) for r in rows] == [
        ("detail", "https://s.test/b/1"), ("detail", "https://s.test/l/b/2"), ("next", "https://s.test/l/0.html?page=2")]


# --- JSON ---------------------------------------------------------------------------------


def items(spark, bodies, fields, path=""):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page_id bigint, text string")
    rows = jsonitems.json_items(df, fields, path).orderBy("page_id", "item_idx").collect()
    return [tuple(r) for r in rows]


def test_two_responses_of_daily_arrays_give_21_rows(spark):
    def days(n):
        return '{"city":"x","daily":{"time":[%s],"max":[%s],"min":[%s]}}' % (
            ",".join(f'"d{i}"' for i in range(n)), ",".join(map(str, range(n))), ",".join(map(str, range(n - 1))))

    rows = items(spark, [days(14), days(7)], {"日期": "time", "高": "max", "低": "min"})
    assert len(rows) == 21 and rows[13] == (0, 13, "d13", "13", "")


def test_places_of_items(spark):
    fields = {"a": "a", "b": "b.c"}
    assert items(spark, ['[{"a":1,"b":{"c":" x "}},{"z":1},5,null,{"a":null,"b":{"c":true}}]'], fields) == [
        (0, 0, "1", "x"), (0, 2, "5", "5"), (0, 4, "", "true")]
    assert items(spark, ['{"d":{"l":[{"a":1}]}}'], fields, "d.l") == [(0, 0, "1", "")]
    # A list that is not asked for by path is taken for zipped columns, and has none of the names.
    assert items(spark, ['{"items":[{"a":1}]}'], fields) == []
    # A path that is no list falls back; nested objects are looked at in text order.
    assert items(spark, ['{"n":1,"z":{"a":[7]},"b":{"a":[8]}}'], {"a": "a"}, "n") == [(0, 0, "7")]
    assert items(spark, ["<html>", "{bad", '"text"', "{}", "[]"], fields) == []


def test_captured_and_preference(spark):
    df = spark.createDataFrame([(1, '{"x":["s",{"a":1}]}'), (2, '{"x":{}}')], "page_id bigint, text string")
    api = jsonitems.json_records(df.withColumn("v", F.try_parse_json("text")), "v", {"a": "a"}, "x", objects_only=True)
    assert [tuple(r) for r in api.collect()] == [(1, 1, "1")]
    page = spark.createDataFrame([(1, 0, "dom"), (2, 0, "dom")], "page_id bigint, item_idx int, a string")
    assert sorted(tuple(r) for r in jsonitems.prefer_api(api, page, "page_id").collect()) == [(1, 1, "1"), (2, 0, "dom")]


# --- page predicates and profiles ---------------------------------------------------------


def test_challenge(values):
    got = values(["x CAPTCHA", "a" * 6000 + "captcha", "", None, "验证码", "plain"], profile.is_challenge)
    assert got == [True, False, False, False, True, False]


def test_robots(spark):
    rules = spark.createDataFrame(
        [("a.test", "*", 0, False, "/private"), ("a.test", "*", 1, True, "/private/ok"), ("a.test", "bot", 5, True, "/p"),
         ("a.test", "bot", 6, False, "/"), ("b.test", "*", 0, False, ""), ("c.test", "*", 0, True, "/x/y"), ("c.test", "*", 1, False, "/x"),
         ("c.test", "*", 2, False, "/q?n=1")],
        "host string, agent string, ordinal int, allow boolean, path string",
    )
    urls_in = ["http://a.test/private/ok", "https://A.test/z", "http://a.test/p1", "http://b.test/x", "http://c.test/x/y1",
               "http://c.test/x/z", "http://c.test/q?n=12", "http://d.test/", "http://a.test"]
    df = spark.createDataFrame(list(enumerate(urls_in)), "page_id int, url string")

    def ask(agent):
        return [r["allowed"] for r in robots.robots_allowed(df, rules, agent).orderBy("page_id").collect()]

    assert ask("other") == [False, True, True, True, True, False, False, True, True]
    assert ask("Bot/2.1") == [True, False, True, True, True, False, False, True, False]


def test_robots_escapes_and_nested_rules(spark):
    from urllib.robotparser import RobotFileParser

    lines = [
        (False, "/ü/"), (True, "/a%2Fb"), (False, "/a"), (True, "/a/b/c"), (False, "/q?x=1"), (False, "/50%"), (True, "/p/+"), (False, "/p"),
        (False, "/%7Euser"), (True, "/deep/1/2"), (False, "/deep/1"), (True, "/deep"), (False, "/d"),
    ]
    text = ["User-agent: *", *[f"{'Allow' if allow else 'Disallow'}: {path}" for allow, path in lines]]
    parser = RobotFileParser()
    parser.parse(text)
    rules = spark.createDataFrame([("h.test", "*", i, a, p) for i, (a, p) in enumerate(lines)], "host string, agent string, ordinal int, allow boolean, path string")
    paths = [
        "/%C3%BC/x", "/ü/x", "/%c3%bc", "/a/b", "/a%2Fb/z", "/a", "/a/b/c/d", "/ab", "/q?x=12", "/q?x=2", "/50%25", "/50%/x", "/p/+1", "/p/%2B1", "/p/1",
        "/~user/i", "/%7euser", "/deep/1/2/3", "/deep/1/3", "/deep/2", "/d", "/e", "", "/", "/deep%2F1", "/\U0010fffe",
    ]
    df = spark.createDataFrame([(i, f"http://h.test{p}", "k") for i, p in enumerate(paths)], "page_id int, url string, host string")
    got = {r["page_id"]: r["allowed"] for r in robots.robots_allowed(df, rules).collect()}
    assert {paths[i]: a for i, a in got.items()} == {p: parser.can_fetch("x", f"http://h.test{p}") for p in paths}


def test_many_rules_of_a_host(spark):
    rules = spark.createDataFrame([("h.test", "*", i, False, f"/{i}") for i in range(300)], "host string, agent string, ordinal int, allow boolean, path string")
    df = spark.range(3000).selectExpr("id as page_id", "concat('http://h.test/', id % 1000) as url")
    out = robots.robots_allowed(df, rules)
    firsts = tuple(str(i) for i in range(1, 300))
    assert out.where("not allowed").count() == sum(str(i % 1000).startswith(firsts) or i % 1000 == 0 for i in range(3000))


def test_profiles(spark):
    scripts = "<script></script>" * 9
    html = [LIST, f"<title> T&amp;T </title><body>{scripts}hi</body>", f"<body>{scripts}__NUXT__</body>", "<a rel=next href=x>n</a>"]
    df = pages(spark, *html)
    rows = {r["page_id"]: r for r in profile.render_choice(profile.signals(df)).collect()}
    assert [rows[i]["script_count"] for i in range(4)] == [0, 9, 9, 0]
    assert [rows[i]["render"] for i in range(4)] == ["direct", "playwright", "direct", "direct"]
    assert [rows[i]["js_dynamic"] for i in range(4)] == [False, True, True, False]
    assert df.filter("page_id = 1").select(profile.title("html").alias("t")).first()["t"] == "T&T"
    kinds = {r["page_id"]: r["pagination"] for r in profile.paging(df).collect()}
    assert kinds == {0: "next_button", 1: "unknown", 2: "unknown", 3: "next_button"}
    top = {r["label"]: r["n"] for r in profile.container_candidates(df).filter("page_id = 0").collect()}
    assert top == {}
    fields = {r["page_id"]: r["fields"] for r in profile.field_candidates(df).collect()}
    assert fields[0] == {"标题": "h3 a::text", "价格": ".price::text", "链接": "a::attr(href)"} and fields[1] == {}


def test_container_ties_go_to_the_larger_label(spark):
    html = '<div class="item product card"></div><article></article><li class=list><table><tr></table>'
    rows = profile.container_candidates(pages(spark, html)).orderBy(F.desc("n"), F.desc("label")).collect()
    assert [r["label"] for r in rows] == ["table tr", "li.list", "div.product", "div.item"]
