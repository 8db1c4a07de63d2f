from patchloom.llm.html_text import extract, main_text


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav>
      <div class="cookie-notice">We use cookies and say so at length here</div>
      <article><header><h1>Head &amp; tail</h1></header><p><b>One</b>  two&nbsp;x<br>three
      <div class="ad">Buy now</div><p class="notice">Note</p><p>4 &lt;b&gt; &copy;</p>
      <script>var t="</p>";</script><form><label>Mail</label></form><!-- c --><p><a>link</a></p>
      </article><section id="comments"><article class="comment"><p>Nice</p></article></section>
      <aside>side</aside><footer>foot</footer></body></html>"""
    assert main_text(page) == "Head & tail One two x three 4 <b> © link"


def test_surge_and_dive_without_marked_article():
    links = "".join(f'<li><a href="/{i}">Menu entry number {i}</a></li>' for i in range(9))
    body = f"<p>{'word ' * 40}</p><p>short</p><p>{'more ' * 40}</p>"
    page = f"<div><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div>"
    assert main_text(page) == " ".join(("word " * 40 + "short " + "more " * 40).split())


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<script>x") == ""
    assert main_text("<article><p>a<p>b &am") == "a b &am"
    assert main_text("<article><p title='x>y'>a</p><p class=\"q>b</p>") == "a b"
    assert main_text("<article>1 < 2 and <b") == "1 < 2 and"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<article><p>" + "x" * 300_000) == "x" * 300_000


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é🎈"), (None, None, None), (1, "u", "")],
                                  "page_id bigint, url string, html string").selectExpr(
        "*", "7 AS text", "8 AS n_chars")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    assert got == [(1, "u", "", 0), (1, "u", "é🎈", 2), (None, None, "", 0)]
    assert extract(pages.limit(0)).count() == 0


PROSE = "long words of prose " * 10


def test_words_of_class_and_id_do_not_empty_an_article():
    for c in ('class="layout has-sidebar"', 'id="no-comments"', 'class="widget"'):
        assert main_text(f"<div {c}><article><p>Text</p></article></div>") == "Text"
        assert main_text(f"<div {c}><p>{PROSE}</p></div>") == PROSE.strip()
    assert main_text(f'<article><h1 class="header">T</h1><section id="related-work"><h2 id="search">'
                     f'S</h2><p>{PROSE}</p></section></article>') == f"T S {PROSE}".strip()
    assert main_text('<article class="comments-open">Text</article>') == "Text"
    assert main_text(f'<article><p>a</p><div class="widget">{PROSE}</div></article>'
                     ) == f"a {PROSE}".strip()
    assert main_text('<main><p>Text</p><div class="share">x</div><ul id="related"><li><a>y</a></ul>'
                     ) == "Text"
    assert main_text(f'<article>Text</article><div class="comment-list"><article>{PROSE}</article>'
                     "</div>") == "Text"


def test_raw_elements_end():
    assert main_text("<html><head><title>t</title><body><article>a</article>") == "a"
    assert main_text("<head><title>t<body><article>a<svg><title>x</title></svg></article>") == "a"
    assert main_text("<article>a <svg/> b <math/>c</article>") == "a b c"
    assert main_text("<article><math><mi>x</mi><mo>=</mo><mn>1</mn></math> a</article>") == "x=1 a"
    assert main_text("<article><select><option>1<option>2</select> a</article>") == "a"
    assert main_text("<article><datalist><option>1<option>2</datalist><p>a</article>") == "a"
    assert main_text("<article>a<svg><svg></svg>no</svg> b<button>x<p>c</article>") == "a b c"


def test_short_pages_and_link_boxes_lose_nothing():
    assert main_text("<div><p>Short one.</p></div>") == "Short one."
    assert main_text('<div><a href="/">Home</a> | <a href="/b">Other</a></div>') == ""
    links = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(5))
    adverts = '<div class="ad">Buy</div>' * 4
    for box in (f"<ul>{links}</ul>", f"<aside><ul>{links}</ul></aside>", adverts):
        page = f"<div>{links}</div><div><p>{PROSE * 3}</p>{box}<p>The end.</p></div><div>{links}</div>"
        assert main_text(page) == f"{PROSE * 3}The end."
        nested = f"<div><section><p>{PROSE * 3}</p></section>{box}<section>The end.</section></div>"
        assert main_text(nested) == f"{PROSE * 3}The end."


def test_marked_article_that_does_not_surge_takes_nothing_from_the_rest():
    assert main_text(f"<article>Teaser</article><div><p>{PROSE}</p></div>") == f"Teaser {PROSE}".strip()
    assert main_text(f"<article>{PROSE}</article><div><p>{PROSE}</p></div>") == PROSE.strip()
    assert main_text(f"<article>{PROSE}</article><div>{PROSE}</div>", surge=1000) == PROSE.strip()
    assert main_text(f"<article>{PROSE}</article><div>{PROSE * 9}</div>", surge=1000
                     ) == f"{PROSE}{PROSE * 9}".strip()
