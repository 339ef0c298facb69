"""Parts of a page by their place and name, simple tree matching against a plain table, long digit runs."""

import random
import time

from panelcast.llm import html, pii, registry  # noqa: F401

STORY = "The whole story of the day, told at length and without haste."
LONG = "A reader said this and that, and then said it again at length. " * 40


def plain(page):
    return html.main_text(page, None, frozenset())


def test_quotes_of_names_do_not_matter():
    for form in ('class="comments"', "class='comments'", "class=comments", "id = comments", "ROLE=comments"):
        assert plain(f"<body><article><p>{STORY}</p><div {form}>Nice one</div></article></body>") == STORY
    assert html._names(" class='a b' id=c data-id='x'") == ["a", "b", "c"]


def test_long_parts_beside_short_texts_go():
    assert plain(f'<body><article><p>{STORY}</p></article><div class="comments">{LONG}</div></body>') == STORY
    assert plain(f'<body><article><p>{STORY}</p><div id="comments">{LONG}</div></article></body>') == STORY
    assert plain(f'<body><p>{STORY}</p><div class="sidebar">{LONG}</div></body>') == STORY
    assert plain(f'<body><article><p>{STORY}</p></article><form>{LONG}<input></form></body>') == STORY
    page = f'<body><form action="/"><div class="cookie-notice">{LONG}</div><main><p>{STORY}</p></main></form></body>'
    assert plain(page) == STORY
    assert plain(f'<body><form><header>Site</header><div><p>{STORY}</p></div><div class="comment-list">{LONG}</div></form></body>') == STORY


def test_words_within_names_drop_nothing_alone():
    for name in ("share-price", "social-history", "comment-policy", "ad-hoc-committee", "menu-of-the-day", "masthead-history"):
        assert plain(f'<body><article><p>{STORY}</p><div class="{name}">And more of it.</div></article></body>') == f"{STORY} And more of it."
    for name in ("comments-section", "ad-banner", "site-footer", "main-nav", "share-buttons", "newsletter-signup", "comment-list"):
        assert plain(f'<body><article><p>{STORY}</p><div class="{name}">And more of it.</div></article></body>') == STORY
    assert plain(f'<body><p><a href="/x">{STORY}</a> Yes.</p><ul><li><a href="/">Home</a></li></ul></body>') == f"{STORY} Yes."


def test_hidden_parts_go():
    for how in ("hidden", 'style="display: none"', "style='color:red;display:none'", 'hidden=""'):
        assert plain(f"<body><article><p>{STORY}</p><p {how}>Not seen</p></article></body>") == STORY
    assert plain(f'<body><article><p class="hidden-gem" aria-hidden="false">{STORY}</p></article></body>') == STORY


def tree(rng, depth):
    label = rng.choice("abc")
    return html.Node(label, [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else [])


def form_of(node):
    return node.label + (f"({','.join(map(form_of, node.children))})" if node.children else "")


def most_pairs(x, y):
    """Simple tree matching as the textbook has it."""
    if x.label != y.label:
        return 0
    m = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, c in enumerate(x.children):
        for j, d in enumerate(y.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + most_pairs(c, d))
    return 1 + m[-1][-1]


def test_matching_has_as_many_pairs_as_the_plain_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = tree(rng, 3), tree(rng, 3)
        got = html.align(form_of(a), form_of(b))
        assert sum(x >= 0 for x in got) == most_pairs(a, b)
        used = [x for x in got if x >= 0]
        assert used == sorted(set(used))  # order kept, no node twice


def test_long_lists_of_unlike_siblings_take_little_time():
    rng = random.Random(1)
    names = [f"div.n{chr(97 + k % 26)}{k}x" for k in range(8000)]
    other = [n for n in names if rng.random() < 0.9]
    began = time.process_time()
    got = html.align(f"page({','.join(names)})", f"page({','.join(other)})")
    assert sum(x >= 0 for x in got) == len(other) + 1
    same = html.align("page(" + ",".join(["p", "div"] * 4000) + ")", "page(" + ",".join(["div", "p", "p"] * 3000) + ")")
    assert sum(x >= 0 for x in same) > 4000 and time.process_time() - began < 20


def test_runs_of_more_digits_than_python_reads():
    text = "x " + "0" * 5000 + ".1.1.1 and " + "9" * 6000 + ".1.1.1 and 1.2.3." + "0" * 4999 + "4"
    assert pii.find(text)["ip"] == [(2, 5008), (len(text) - 5006, len(text))]


def test_personal_data_of_a_whole_row_of_digits(spark):
    rows = [(1, "0" * 5000 + ".1.1.1"), (2, None), (3, "+" + "1" * 9000)]
    got = {r["doc_id"]: r["n_ip"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
