"""Whole texts of pages with uneven sections, mixed templates and noisy names."""

from tallyline.llm.html_consensus import Page, extract_text, host_paths

INTRO, BODY, LEAD = "An intro. " * 10, "The long text goes on. " * 45, "A lead paragraph. " * 8


def text(source, path=None):
    return Page(source).text(path).split("\n")


def clean(*texts):
    return [" ".join(t.split()) for t in texts]


def test_uneven_sections():
    page = f"<body><nav><a href=x>Home</a></nav><div id=main><div class=intro>{INTRO}</div><div class=text>{BODY}</div></div><footer>f</footer>"
    assert text(page) == text(page, ">body>div") == clean(INTRO, BODY)
    cells = f"<table><tr><td>{INTRO}<td>{BODY}</table>"
    assert text(cells) == clean(INTRO, BODY)


def test_lead_paragraphs_and_links():
    page = f"<body><div class=list><a href=1>One</a> <a href=2>Two</a></div><div><p>{LEAD}</p><p><a href=y>Source</a></p><div>{BODY}</div></div>"
    assert text(page) == clean(LEAD, "Source", BODY)


def test_mixed_templates(spark):
    plain = f"<div class=post>{BODY}</div>"
    pages = [plain, plain, plain, f"<div class=post></div><div class=story>{BODY}</div>", f"<div class=post>Read on</div><div class=story>{BODY}</div>"]
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = [r.text.split("\n") for r in extract_text(df).orderBy("page_id").collect()]
    assert got == [*[clean(BODY)] * 4, clean("Read on", BODY)]


def test_noisy_names_of_wrappers():
    side = "<div class=sidebar><p>Other things to read</p></div>"
    for name in ("class=content-sidebar-wrap", "class=post-with-comments", "class=content-no-sidebar", "id=market-share", "class=widget"):
        page = f"<body><nav><a href=x>Home</a></nav><div {name}><div class=inner><p>{INTRO}</p><p>{BODY}</p></div>{side}</div><footer>f</footer>"
        assert text(page) == clean(INTRO, BODY), name
    parts = f"<h1>Title</h1><div class=widget><p>{BODY}</p></div><div class=widget><p>{BODY}</p></div><div class=cookie>We use some</div>"
    assert text(parts) == clean("Title", BODY, BODY)
    assert text(f"<h2 id=market-share>Market share</h2><p>{BODY}</p>") == clean("Market share", BODY)


def test_noise_stays_noise():
    threads = f"<div class=comments><p>{BODY}</p></div>"
    assert text(f"<article><p>{LEAD} {INTRO} {LEAD}</p></article>{threads}") == clean(f"{LEAD} {INTRO} {LEAD}")
    assert text(f"<div><p>{BODY}</p></div>{threads}") == clean(BODY)
    links = "<div class='related'>" + "<a href=x>Some other page</a> " * 300 + "</div>"
    assert text(f"<p>{LEAD}</p>{links}") == clean(LEAD)
    assert text(f"<p>Some <span class=share>Share this</span> words</p><p>{BODY}</p>") == clean("Some words", BODY)
    assert text(f"<div role=navigation>{BODY}</div>") == [""]
    # by what a class names, however much of the page it holds
    assert text(f"<div class=post>{LEAD}</div><div class=comments>{BODY}</div>") == clean(LEAD)
    assert text(f"<div class=post>{LEAD}</div><section class=comments-section>{BODY}</section>") == clean(LEAD)
    assert text(f"<div>{LEAD}</div><div class=related>{BODY}</div>") == clean(LEAD)
    for name in ("sidebar-right", "acme-sidebar", "cookie-notice", "article-comments", "footer-col-2", "post-share"):
        assert text(f"<p>{LEAD}</p><div class={name}>{BODY}</div>") == clean(LEAD), name
    # a layout that uses such names for its text; comments never come back
    assert text(f"<div class=sidebar-right><p>{BODY}</p><div class=comments>{LEAD}</div></div>") == clean(BODY)
    assert text(f"<div class=comments>{LEAD}</div>") == [""]


def brute_force_votes(pages):
    """The winning path of each host, counted page by page."""
    votes = {}
    for _, url, source in pages:
        host = (url or "").lower().partition("//")[2].partition("/")[0]
        if (path := Page(source or "").vote()) is not None:
            votes.setdefault(host, {}).setdefault(path, []).append(1)
    return {h: min(by, key=lambda p: (-len(by[p]), p)) for h, by in votes.items()}


def test_the_vote_decides(spark):
    """Teasers and slogans outside the article have no telling name; the host's other pages tell."""
    slogan = "<div>Our paper is the best paper in town. Everybody reads it every day.</div>"
    teaser = f"<div class=box7><p>{LEAD}</p></div>"
    story = f"<div class=story><h1>Title</h1><p>{BODY}</p></div>"
    rows = [(i, "http://A.example/x", f"<body><nav>Home</nav>{story}</body>") for i in range(5)]
    rows += [(10, "http://a.example/y", f"<body>{slogan}{story}{teaser}</body>")]
    rows += [(11, "http://b.example/", f"<body>{slogan}{story}</body>"), (12, "http://b.example/", f"<body>{slogan}{story}</body>")]
    rows += [(13, "http://a.example/z", f"<body><div class=other><p>{BODY}</p></div></body>")]
    rows += [(14, None, f"<p>{LEAD}</p>"), (15, "http://c.example/", None), (16, "http://c.example/", ""), (17, "http://c.example/", "<div></div>")]
    # a tie goes to the first path
    rows += [(18, "http://d.example/", f"<div class=b>{BODY}</div><p>x</p>"), (19, "http://d.example/", f"<div class=a><p>{BODY}</p></div><div class=b>{LEAD}</div>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text.split("\n") for r in extract_text(df).collect()}
    alone = {i: text(source or "") for i, _, source in rows}
    story_text = clean("Title", BODY)
    assert got[10] == story_text and alone[10] == clean(slogan[5:-6], "Title", BODY, LEAD)
    assert got[11] == got[12] == alone[11] == clean(slogan[5:-6], "Title", BODY)  # all its pages have it
    assert got[13] == clean(BODY)  # another template
    assert got[14] == clean(LEAD) and got[15] == got[16] == got[17] == [""]
    winners = brute_force_votes(rows)
    assert winners["a.example"] == ">body>div.story" and winners["b.example"] == ">body"
    found = {r.host: r.path for r in host_paths(df.drop("host")).collect()}
    assert found == winners
    want = {i: text(source or "", winners.get((url or "").lower().partition("//")[2].partition("/")[0])) for i, url, source in rows}
    assert got == want


def test_long_page(spark):
    source = f"<body><article><p>{BODY}</p>" + f"<p>{INTRO}</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "http://h/", source)], "page_id long, url string, html string")
    assert extract_text(df).first().n_chars == len(clean(BODY)[0]) + 20_000 * (len(clean(INTRO)[0]) + 1)
