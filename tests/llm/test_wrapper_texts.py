"""What counts as a host's fixed text."""

from takeoff.llm import wrappers


def texts(spark, pages):
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}


def test_text_of_one_page_is_not_fixed(spark):
    page = "<body><div>Welcome</div><p>Text {0}</p>{1}</body>"
    got = texts(spark, [page.format(0, "<h2>Only here</h2>"), page.format(1, ""), page.format(2, "<blockquote>A quote</blockquote>"), page.format(1, "")])
    assert got == {0: "Text 0\nOnly here", 1: "Text 1", 2: "Text 2\nA quote", 3: "Text 1"}


def test_every_page_of_a_host_counts(spark):
    """40 pages of one template and 3 of a second one, which a sample of 8 pages would hardly hold twice; one has an article."""
    pages = [f"<body><div>Welcome</div><p>Text {i}</p></body>" for i in range(40)]
    pages += [f"<body><blockquote>All rights reserved</blockquote><pre>Code {i}</pre></body>" for i in range(3)] + ["<article><p>Alone</p></article>"]
    assert texts(spark, pages) == {i: f"Text {i}" for i in range(40)} | {40 + i: f"Code {i}" for i in range(3)} | {43: "Alone"}


def test_long_streams_align_in_full(monkeypatch):
    parts = lambda s: [wrappers.Part(((c,),)) for c in s]
    a, b = parts("x" + "abcde" * 300), parts("abcde" * 300 + "x")  # the greedy way takes the last x first
    whole = wrappers.aligned(a, b)
    monkeypatch.setattr(wrappers, "MOST_CELLS", 1000)
    halved = wrappers.aligned(a, b)
    for pairs in (whole, halved):
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert sum(None not in p for p in pairs) == 1500


def test_menus_and_imprints_of_a_host_without_articles_go(spark):
    """Twenty pages of one host in three shapes: what all of them repeat goes, in groups of equal paths too, and each page's own text stays."""
    def page(i):
        own = [f"Own {i} {k}" for k in range(i % 4 + 1)]
        middle = [f"<h3>Title {i}</h3>" + "".join(f"<div>{t}</div>" for t in own), "".join(f"<p>{t}</p>" for t in own), f"<ul>{''.join(f'<li>{t}' for t in own)}</ul><blockquote>Q{i}</blockquote>"][i % 3]
        menu = "".join(f"<div>{t}</div>" for t in ("Home", "Menu", "Products"))
        return f"<body>{menu}{middle}<div>Imprint X</div><div>All rights</div></body>", [f"Title {i}"] * (i % 3 == 0) + own + [f"Q{i}"] * (i % 3 == 2)

    made = [page(i) for i in range(20)]
    assert texts(spark, [p for p, _ in made]) == {i: "\n".join(t) for i, (_, t) in enumerate(made)}


def test_taking_the_wrapper_away_changes_pages():
    pages = [f"<body><div>Menu</div><div>Text {i}</div><p>Imprint</p></body>" for i in range(4)]
    wrapper = wrappers.inferred(pages)
    assert [wrappers.main_text(p, wrapper) for p in pages] == [f"Text {i}" for i in range(4)]
    assert wrappers.main_text(pages[0], []) == "Menu\nText 0\nImprint"


def test_alignment_by_brute_force():
    rng, part = __import__("random").Random(3), lambda c, t: wrappers.Part(((c,),), frozenset(t))
    for _ in range(60):
        a, b = ([part(rng.choice("xy"), rng.choice(["1", "2", "3", ""])) for _ in range(rng.randint(0, 6))] for _ in range(2))
        score = lambda p, q: 0 if p.core != q.core else 2 if p.texts == q.texts and p.texts else 1
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                s = score(a[i], b[j])
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + s if s else 0)
        pairs = wrappers.aligned(a, b)
        assert sum(score(a[i], b[j]) for i, j in pairs if None not in (i, j)) == best[-1][-1]
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
