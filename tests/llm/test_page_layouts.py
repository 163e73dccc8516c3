"""Main text of layouts marked by hand: nothing of an article is lost, nothing around it stays, with telling names and without."""

import time

import pytest

from lumentrail.llm import html_text, toxicity

P = "<p>{}</p>"
LONG = "This is a paragraph of an article that says a good deal, in whole sentences, about one thing or another."
MORE = "Another paragraph follows it, also of some length, so that the two of them together weigh enough."
TWO = P.format(LONG) + P.format(MORE)
MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"
REFS = "<ul>" + "".join(f"<li><a href=r{i}>Reference number {i}</a></li>" for i in range(5)) + "</ul>"
REFS_TEXT = "\n".join(f"Reference number {i}" for i in range(5))


@pytest.mark.parametrize(
    "page, text",
    [
        # A stray quotation mark opens no value.
        (f'<article><p class="x"">One.</p>{TWO}</article><p title="a">after</p>', f"One.\n{LONG}\n{MORE}"),
        (f"<body><div id='content'><p data-x=a'b>One.</p>{TWO}</div></body>", f"One.\n{LONG}\n{MORE}"),
        (f'<article><p title="a > b">One.</p><p title = \'c > d\' hidden-not>Two.</p>{TWO}</article>', f"One.\nTwo.\n{LONG}\n{MORE}"),
        (f'<article><a href="never closed>x</a>{TWO}</article>', f"x\n{LONG}\n{MORE}"),
        # What most blogs send.
        (f"<body><nav>{MENU}</nav><article><header><h1>Title</h1><p>By A</p></header><div class='entry-content'>{TWO}</div></article><footer>f</footer></body>", f"Title\nBy A\n{LONG}\n{MORE}"),
        (f"<main><h1>Soup</h1><div><ul><li>2 onions</li><li>salt</li></ul></div><div>{TWO}</div></main>", f"Soup\n2 onions\nsalt\n{LONG}\n{MORE}"),
        (f"<body><div id=content><h1>Title</h1><p>Intro.</p><div><div>{TWO}</div></div><table><tr><td>1</td><td>2</td></tr></table></div></body>", f"Title\nIntro.\n{LONG}\n{MORE}\n1\n2"),
        (f"<article><h1>Title</h1><section><h2>One</h2>{TWO}</section><section><h2>Two</h2>{P.format(LONG)}</section></article>", f"Title\nOne\n{LONG}\n{MORE}\nTwo\n{LONG}"),
        # A list of links at the end of an article is no menu.
        (f"<article><h1>Title</h1>{TWO}<h2>References</h2>{REFS}</article>", f"Title\n{LONG}\n{MORE}\nReferences\n{REFS_TEXT}"),
        (f"<body><div id=wrap><div id=content><h1>T</h1>{TWO}<h2>References</h2>{REFS}</div></div></body>", f"T\n{LONG}\n{MORE}\nReferences\n{REFS_TEXT}"),
        # Named surroundings inside and beside.
        (f"<body><header>{MENU}</header><main><div class=breadcrumbs><a href=a>Home</a></div><article><h1>T</h1>{TWO}<aside>see too</aside><div class=share-buttons>Share</div></article><section class=comments><p>{LONG}</p></section></main></body>", f"T\n{LONG}\n{MORE}"),
        (f"<body><div class='cookie-banner'><p>{LONG}</p></div><div class=post><h2>T</h2><p>short lead</p><div class=body>{TWO}</div></div><div class=sidebar>{MENU}</div></body>", f"T\nshort lead\n{LONG}\n{MORE}"),
        # No telling names: density alone.
        (f"<body><div>{MENU}</div><div><h1>T</h1>{TWO}</div><div>{MENU}</div></body>", f"T\n{LONG}\n{MORE}"),
        (f"<body><div><div>{MENU}</div><div><h1>T</h1><p>By B</p><div>{TWO}</div></div><div>{MENU}</div></div></body>", f"T\nBy B\n{LONG}\n{MORE}"),
        (f"<body><table><tr><td>{MENU}</td><td><h1>T</h1>{TWO}</td></tr></table></body>", f"T\n{LONG}\n{MORE}"),
        (f"<body><h1>T</h1><div>{TWO}</div><div><a href=a>One</a> | <a href=b>Two</a> | <a href=c>Three</a></div></body>", f"T\n{LONG}\n{MORE}"),
        (f"<body><div><h1><a href=/>Site</a></h1>{MENU}</div><div><h1>T</h1><blockquote>quoted</blockquote>{TWO}<pre>x = 1</pre></div></body>", f"T\nquoted\n{LONG}\n{MORE}\nx = 1"),
        (f"<body><div>Lead text that stands in the block itself. <b>Bold.</b><div>{TWO}</div>Last words.</div><div>{MENU}</div></body>", f"Lead text that stands in the block itself. Bold.\n{LONG}\n{MORE}\nLast words."),
        (f"<body><div><span><a href=a>a</a> <a href=b>b</a> <a href=c>c</a></span></div><section><dl><dt>term</dt><dd>what it means</dd></dl><div>{TWO}{TWO}</div></section></body>", f"term\nwhat it means\n{LONG}\n{MORE}\n{LONG}\n{MORE}"),
        (f"<body><div><a href=a>Home</a> &gt; <a href=b>News</a><div><h1>T</h1>{TWO}</div></div></body>", f"T\n{LONG}\n{MORE}"),
        (f"<body><div id=page><div class=header><h1>Site</h1></div><div class=content><h1>T</h1>{TWO}<div class='ad-slot'>Buy</div></div><div class=footer>f</div></div></body>", f"T\n{LONG}\n{MORE}"),
        (f"<article>{TWO}<figure><img src=x><figcaption>A figure.</figcaption></figure><div class=related-posts>{MENU}</div></article>", f"{LONG}\n{MORE}\nA figure."),
    ],
)
def test_layouts(page, text):
    assert html_text.main_text(page) == text


NAMELESS = [
    (f"<body><div>{MENU}</div><div><h1>T</h1>{TWO}</div><div>{MENU}</div></body>", f"T\n{LONG}\n{MORE}"),
    (f"<body><table><tr><td>{MENU}</td><td><h1>T</h1>{TWO}</td></tr></table></body>", f"T\n{LONG}\n{MORE}"),
    (f"<body><div><div>{MENU}</div><div><h1>T</h1>{TWO}</div><div><a href=x>one</a><a href=y>two</a></div></div></body>", f"T\n{LONG}\n{MORE}"),
]


@pytest.mark.parametrize("page, text", NAMELESS)
def test_density_decides_on_pages_without_names(page, text, monkeypatch):
    assert html_text.main_text(page) == text
    for names in ("AROUND", "AROUND_ROLES", "AROUND_NAMES"):
        monkeypatch.setattr(html_text, names, frozenset())
    assert html_text.main_text(page) == text  # no list of names is needed
    monkeypatch.setattr(html_text.Page, "content", lambda self: ({self.tag.index("body")}, self.cut, set()))
    assert html_text.main_text(page) != text  # but the choice is


@pytest.mark.parametrize("part", ['<p a="', "<p a='\">", '<p =" x', "<p ='\"", '="', '<a href="x"" ', "<p " + "'\"=" * 50])
def test_attributes_take_linear_time(part):
    times = []
    for n in (20_000, 200_000):
        began = time.perf_counter()
        html_text.main_text(part * (n // len(part)) + "<p>end")
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * max(times[0], 0.01)


@pytest.mark.parametrize("mark", '"“«„')
def test_open_quotation_marks_take_linear_time(mark):
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", False, 1.0)])
    began = time.perf_counter()
    assert toxicity.evidence("idiot " + mark * 1_000_000, trie)[0] > 0
    assert time.perf_counter() - began < 4


def test_quotations_are_the_leftmost_within_lines():
    import random
    import re

    told = re.compile("\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choices("\"“”«»„\nab", k=rnd.randrange(14)))
        assert toxicity.quotations(text) == [m.span() for m in told.finditer(text)]


@pytest.mark.parametrize("text", ["an idiooot", "iiiidiot", "id-iot", "i​di­ot", "idiot", "IDIOOOOT!", "id_iot"])
def test_disguises_are_found(text):
    assert sum(toxicity.evidence(text, toxicity.FuzzyTrie([toxicity.Term("idiot", False, 1.0)]))) > 0


@pytest.mark.parametrize("text", ["id iot", "a-b-c-d", "patriot-ic", "cooool", "---", "well-known", "x-y"])
def test_clean_words_stay_clean(text):
    assert toxicity.evidence(text, toxicity.FuzzyTrie([toxicity.Term("idiot", False, 1.0)])) == (0.0, 0.0)


def test_pieces_pass_every_word_that_the_automata_match():
    import random

    rnd = random.Random(2)
    terms = [toxicity.Term(w, False, 1.0) for w in ("idiot", "moron", "scum", "pathetics", "worthlessly", "abominations", "aaaaaaaaaaaa", "ababababab")] + [toxicity.Term("stup", True, 1.0)]
    trie = toxicity.FuzzyTrie(terms)
    passed = 0
    for _ in range(60_000):
        word = list(rnd.choice(terms).text)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randrange(2)] = rnd.choices("abiost", k=rnd.randrange(2))
        word = "".join(word)
        state, stem, found = trie.start, None, None
        for c in word:
            state = trie.next[state][c] if c in trie.next[state] else trie._step(state, c)
            if state < 0:
                break
            stem = stem or trie.stemmed[state]
            if stem:
                break
        found = (stem, 0) if stem else trie.found[state] if state >= 0 else None
        assert found is None or trie.pieces.exact(word) or trie.pieces.may(word), word
        assert (trie.pieces.exact(word) is not None) == bool(found and not found[1])
        assert trie.match(word) == found
        passed += trie.pieces.may(word)
    assert not trie.pieces.may("something") and passed > 5_000
