"""Templates of large hosts."""

from tidepool.llm import html


def test_block_on_a_small_share_of_a_large_host(spark):
    """A notice on 10 % of a host's pages goes; a word marked up amid text stays, however often it recurs."""
    rows = []
    for k in range(80):
        notice = "<div>Our offices are closed on Monday</div>" if k % 10 == 0 else ""
        rows.append((k, f"https://a.example/{k}", f"<body>{notice}<p>Page {k} tells of <a href='/p'>Paris</a> and number {k * k}.</p></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    assert got == {k: f"Page {k} tells of Paris and number {k * k}." for k in range(80)}


def test_recurring_shapes_without_names(spark):
    """Menus, adverts and footers whose words change from page to page go by their shape alone: no word list, no choice of the article element."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url LIKE '%//blog.%' OR url LIKE '%//thther.%'")
    plain = {r.page_id: r.text for r in html.main_texts(pages, least=10**9, names=False).collect()}
    got = {r.page_id: r.text for r in html.main_texts(pages, names=False).collect()}
    want = {r.page_id: r.text for r in html.main_texts(pages, least=10**9).collect()}
    changed = [k for k in got if got[k] != plain[k]]
    assert len(changed) > 100
    assert all(got[k] == want[k] for k in changed)


def test_shapes_of_content_stay(spark):
    """A part of one shape that holds the text of its pages is no template, on pages without an article element either."""
    rows = [(k, f"https://a.example/{k}", f"<div class=top>menu {k}</div><div class=body>Text number {k} of the site, with some more words about {k * k}.</div><div class=end>end {k}</div>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(pages, names=False).collect()}
    assert got == {k: f"Text number {k} of the site, with some more words about {k * k}." for k in range(9)}


def test_counts_equal_brute_force(spark):
    """Different pages of a host for each subtree, page by page in plain Python."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marked = html.page_marks(pages)
    got = {r.mark: (r.pages, r.chars, r.total) for r in html.subtree_counts(marked).collect()}
    seen = {}
    for r in pages.select(html.host_key("url").alias("host"), "html").collect():
        root = html.parse(r.html)
        found, shapes = html.mark_subtrees(root)
        own = {html.COUNTED: 0} | {m: 0 for m, free in found.items() if free} | shapes
        for mark, chars in own.items():
            kept = seen.setdefault(html.of_host(mark, r.host), {})
            text = html.article_text(root)
            kept[text] = tuple(max(a, b) for a, b in zip(kept.get(text, (0, 0)), (chars, root.chars)))
    assert got == {k: (len(v), sum(c for c, _ in v.values()), sum(t for _, t in v.values())) for k, v in seen.items()}


def test_counts_decide_on_hosts_with_pages_enough(spark):
    """With the template off the pages of a large host change; names decide only on the small host, where a side note stays out by its name."""
    rows = [(k, f"https://big.example/{k}", f"<div class=sidebar>Links {k}</div><p>Text number {k} and more of it, as long as texts are.</p>") for k in range(9)]
    rows += [(100, "https://small.example/", "<div class=sidebar>Links</div><p>Text of the small site.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    off = {r.page_id: r.text for r in html.main_texts(pages, least=10**9, names=False).collect()}
    assert got[100] == "Text of the small site." and off[100] == "Links\n\nText of the small site."
    assert all(got[k] == f"Text number {k} and more of it, as long as texts are." for k in range(9))
    assert all(off[k] != got[k] for k in range(9))
