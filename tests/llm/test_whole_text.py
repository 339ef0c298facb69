"""Places where a part of a text was once left out."""

import time

from panelcast.llm import html, media, pii


def test_a_change_anywhere_in_a_text_alters_its_feature(spark):
    plain = "a" * 200_000
    rows = [(i, plain[:at] + "b" + plain[at + 1 :]) for i, at in enumerate((1, 77_777, 199_998))]
    got = media.features(spark.createDataFrame([(9, plain), *rows], "doc_id long, text string")).select("doc_id", "feature").collect()
    features = {r["doc_id"]: r["feature"] for r in got}
    assert all(features[i] != features[9] for i in range(3))


def test_long_secrets_upper_case_schemes_and_bare_ibans():
    key = "a1" * 400
    assert pii.masked(f"token: {key} end") == "token: <ACCOUNT> end"
    assert pii.masked("at HTTP://Example.org/x or Https://b.example.org now") == "at <URL> or <URL> now"
    assert pii.masked("pay GB82 WEST 1234 5698 7654 32 THE REST") == "pay <IBAN> THE REST"
    assert pii.find("pay GB83 WEST 1234 5698 7654 32")["iban"] == [] and pii.find("mailto:x ://a.org")["url"] == []
    assert pii.masked("token-token--token: ab12cd34") == "token-token--token: <ACCOUNT>"


def test_many_cues_in_one_run_take_linear_time():
    began = time.process_time()
    pii.find("token-" * 100_000)
    assert time.process_time() - began < 10


def test_frames_of_the_page_do_not_drop_its_text():
    text = "The whole story of the day, told at length and without haste. " * 5
    for page in (
        f'<body><form><div>{text}</div></form></body>',
        f'<body class="has-sidebar"><p>{text}</p></body>',
        f'<body><div class="comments-open"><main><p>{text}</p></main></div></body>',
        f'<body><article class="has-related"><p>{text}</p></article></body>',
    ):
        assert html.main_text(page, None, frozenset()) == " ".join(text.split())
    beside = f'<body><div>{text}</div><form>Your name</form><div class="related">Read this too</div></body>'
    assert html.main_text(beside, None, frozenset()) == " ".join(text.split())
    cards = f'<body><main><p>{text}</p></main><div class="related"><article>Read this too</article></div></body>'
    assert html.main_text(cards, None, frozenset()) == " ".join(text.split())


def test_deep_elements_are_recognised_and_closed():
    text = "The whole story of the day, told at length."
    page = f"<body><div><article>{'<div>' * 66}<p>{text}</p>" + '<div class="advert">Buy now</div>' + f"{'</div>' * 66}<p>And its end.</p></article></div></body>"
    assert html.main_text(page, None, frozenset()) == f"{text} And its end."


STORY = "The whole story of the day, told at length and without haste. " * 5
TOLD = " ".join(STORY.split())


def plain(page):
    return html.main_text(page, None, frozenset())


def test_names_of_page_frames_drop_nothing():
    assert plain(f'<body class="single no-sidebar"><p>{STORY}</p></body>') == TOLD
    assert plain(f'<body><div class="content-with-sidebar"><p>{STORY}</p></div></body>') == TOLD
    assert plain(f'<body><form id="aspnetForm"><div><p>{STORY}</p></div></form></body>') == TOLD
    assert plain(f'<body><article><p>{STORY}</p><section id="related-work"><p>Others did it before us.</p></section></article></body>') == f"{TOLD} Others did it before us."
    assert plain(f'<body><article><header class="entry-header"><h1>A title</h1></header><p>{STORY}</p></article></body>') == f"A title {TOLD}"


def test_main_is_known_by_its_name_among_others():
    junk = '<div class="box"><p>Weather: rain</p></div>'
    assert plain(f'<body>{junk}<div class="main wide"><p>{STORY}</p></div>{junk}</body>') == TOLD


def test_parts_with_links_or_fields_are_told_by_their_names():
    links = '<div class="related"><a href="/a">One more story</a> <a href="/b">And another one</a></div>'
    search = '<div class="search-box">Search: <input name="q"></div>'
    advert = '<div class="advert">Buy now</div><div class="comments"><p>I liked it</p></div>'
    assert plain(f"<body><article><p>{STORY}</p>{links}{search}{advert}</article></body>") == TOLD
    assert plain(f"<body><p>{STORY}</p>{links}{search}{advert}</body>") == TOLD


def test_deep_menus_and_adverts_are_dropped():
    for inner in ("<nav>Menu of the site</nav>", "<aside>Read on</aside>", '<div class="advert">Buy now</div>', '<div class="notice"><form>Name <input></form></div>'):
        page = f"<body><article>{'<div>' * 400}<p>{STORY}</p>{inner}{'</div>' * 400}</article></body>"
        assert plain(page) == TOLD


def test_template_goes_from_an_article_however_much_it_is(spark):
    fixed = "This note stands under every page of ours, is longer than most of them, and says nothing of the page. " * 4
    rows = [(i, f"http://h.example/{i}", f"<body><article><p>Only page {i} says {i * 7}</p><p>{fixed}</p></article></body>") for i in range(12)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Only page {r['page_id']} says {r['page_id'] * 7}" for r in got) and len(got) == 12


def test_many_hosts_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    page = '<body><div><span>Our Site {h}</span></div><div class="box"><p>Story {i} of {h}</p><p>Sign up for the letter of {h}</p></div></body>'
    rows = [(h * 10 + i, f"http://h{h}.example/{i}", page.format(h=h, i=i)) for h in range(40) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {h * 10 + i: f"Story {i} of {h}" for h in range(40) for i in range(6)}
