import html
import re

from ringwatch.llm import pages

PAGE = (
    "<html><head><title>t</title></head><body><header><div>Site</div></header><div class='cookie-notice'>Cookies</div><div id='stuff'><h1>Title {0}</h1><p>Body {0} one&nbsp;two</p>"
    "<div class='comments'><p>nice!</p></div><form><label>Mail</label></form></div><div id='foo'><p>All rights reserved</p></div></body></html>"
)


def test_query_on_known_layout(spark, sf):
    got = {r.page_id: r.text for r in pages.op7_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


def test_template_finds_the_article_without_article_elements(spark):
    rows = [(k, f"http://x.y/{k}", PAGE.format(k)) for k in range(8)]
    rows += [(90, None, None), (91, "http://z", ""), (92, "http://z", "<p>un<b>clo</b>sed <a href='x>y'>link</a><!-- c --> &lt;b&gt; <script>x<p></script><div class=ad>buy</div>"), (93, "bad url", "plain text"), (0, "http://x.y/0", PAGE.format(0))]
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    texts = dict((a, b) for a, b, _ in got)
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert texts[0] == "Title 0 Body 0 one two" and texts[7] == "Title 7 Body 7 one two"
    assert texts[90] == texts[91] == "" and texts[92] == "unclosed link <b>" and texts[93] == "plain text"


def test_what_is_left_out():
    body = "<body><nav>menu</nav><main><article><header><h1>T</h1></header><p>a<b>b</b>c</p><aside>side</aside><div class='share-buttons'>share</div><p>d</p><section id='comments'><article class='comment'>c</article></section></article></main><footer>f</footer></body>"
    assert pages.main_text(body, [], set()) == "T abc d"
    assert pages.main_text("<article>a<br>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article>", [], set()) == "a b c d e f"
    assert pages.main_text("<div class='has-sidebar'><div class='AD'>buy</div><article>x</article></div>", [], set()) == "x"
    assert pages.main_text("<article><p>x</article>" + "<div>" * 500 + "y", [], set()) == "x"
    assert pages.main_text("<!-- open <p>x", [], set()) == "" and pages.main_text("a < b <3", [], set()) == "a < b <3"


def test_equal_vectors_form_classes():
    import pandas as pd

    tokens = pd.DataFrame({"token": ["/a", "/a/b", "/a/b/c", "/a/d", "/x"], "low": [1, 1, 2, 3, 4], "high": [1, 1, 2, 3, 4], "pages": [9, 9, 9, 9, 9], "times": [9, 9, 27, 28, 9]})
    valid, inside = pages.nest(tokens)
    assert valid == {"/a", "/a/b", "/a/b/c"} and inside["/a/b/c"] == "/a/b"


def test_empty_table(spark):
    assert pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LISTED = (
    "<html><body><div class='top'><p>Our site since 1990</p></div><article><h1>Title {0}</h1><p>Body {0}</p><p>Read more in our shop</p></article>"
    "<div class='text'><p>Second part {0}</p></div><div class='more'><a href='/{0}'>Another story {0}</a></div></body></html>"
)


def test_template_reads_every_content_slot_of_pages_with_articles(spark):
    rows = [(k, f"http://x.y/{k}", LISTED.format(k)) for k in range(8)]
    rows += [(20 + k, f"http://same.y/{k}", LISTED.format(1)) for k in range(8)]
    got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k} Body {k} Second part {k}" for k in range(8))
    assert all(got[20 + k] == "Title 1 Body 1 Read more in our shop" for k in range(8))


def test_all_roles_of_a_page_are_read():
    assert pages.main_text("<h1 class=entry-title>T</h1><div class=text><p>body</p></div>", [], set()) == "T body"
    assert pages.main_text("<main><p>intro</p><article>x</article></main><div>y</div>", [], set()) == "intro x"


def test_all_names_of_an_element_count():
    assert pages.main_text("<p>a</p><div class='mt-4 p-3 border rounded comments'>nice!</div>", [], set()) == "a"
    assert pages.role_of("div", " class='a b c d article-content'", pages.UNKNOWN)[1] == pages.NAMED
    labels = {pages.role_of("div", f" class='{'w-1/2 text-[#fff] mt-4 flex ' * n}{last}'", pages.UNKNOWN)[0] for n in (1, 9) for last in ("one", "two")}
    assert len(labels) == 4 and all(len(x) < 80 and not set("/#") & set(x) for x in labels)


def test_names_count_one_by_one():
    text = lambda x: pages.main_text(f"<article><p>a</p><div {x}>b</div></article>", [], set())
    for out in ("class='ad no-margin'", "class='comments with-avatars'", "class='a b c d sidebar'", "class='search'", "class='search-form'", "class='related-posts'", "id='mainMenu'", "class='cookie-notice'", "class='promo-a1'"):
        assert text(out) == "a", out
    for kept in ("class='search-study'", "class='no-ads'", "class='has-sidebar'", "class='layout-comments'", "class='social-history'", "class='entry-header'"):
        assert text(kept) == "a b", kept


CARDS = (
    "<html><body><article class='story'><h1>Title {0}</h1><p>Body {0}</p><article><p>Update {0}</p></article><article><p>Later {0}</p></article></article>"
    "<div class='grid'><article><h2>Other {0}</h2><p>Teaser {0}</p></article><article><h2>Third {0}</h2><p>Short {0}</p></article></div></body></html>"
)


def test_cards_of_other_stories_are_no_part_of_the_article(spark):
    rows = [(k, f"http://x.y/{k}", CARDS.format(k)) for k in range(8)]
    got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} Body {k} Update {k} Later {k}" for k in range(8)}


def test_classes_are_those_of_brute_force_occurrence_vectors(spark):
    """Random pages without article elements: classes of equal occurrence vectors, counted page by page in plain Python."""
    import random
    from collections import defaultdict

    random.seed(7)
    names = ["one", "two", "three", "four", "five six seven eight nine", "no-margin layout", "wide"]
    table, vectors = [], defaultdict(lambda: defaultdict(lambda: [0] * 12))
    for host in ("a.b", "c.d"):
        fixed = [(random.choice(["div", "section", "p"]), random.choice(names), random.random() < 0.4) for _ in range(9)]
        for k in range(12):
            body = "".join(f"<{tag} class='{name}'>{'same' if same else random.randrange(10**6)}</{tag}>" * (1 if same else random.randrange(1, 3)) for tag, name, same in fixed)
            table.append((k, f"http://{host}/{k}", f"<html><body><div class='main'>{body}</div></body></html>"))
            blocks, counts = pages.parse(table[-1][2])
            for path, role, text, *_ in blocks:
                counts[path + pages._mark(text)] = counts.get(path + pages._mark(text), 0) + (role != pages.DROP)
            for token, n in counts.items():
                vectors[host][token][k] = n
    found = {r.host: r for r in pages.templates(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    for host, tokens in vectors.items():
        common = {t: tuple(v) for t, v in tokens.items() if sum(x > 0 for x in v) >= 6 and t != "*"}
        sizes = defaultdict(list)
        for t, v in common.items():
            sizes[v].append(t)
        valid = {t for members in sizes.values() if len(members) >= 2 for t in members}
        for t in sorted(common):
            v = common[t]
            if t.rpartition("/")[0] in valid and sum(v) % sum(x > 0 for x in v) == 0:
                valid.add(t)
        assert {t for t in valid if "#" not in t} == {*found[host].slots, *found[host].links} and {t for t in valid if "#" in t and sum(x > 0 for x in common[t]) >= 0.9 * 12} == set(found[host].fixed)


def extracted(spark, rows):
    return {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


COPIED = "<html><body><div class='nav'><a href='/'>Home</a></div><article><h1>The title</h1><p>The body of the story.</p><p>seen {0} times</p></article><div class='foot'><p>All rights</p></div></body></html>"


def test_near_copies_on_a_host_keep_their_article(spark):
    """Half of a host's pages, or all of them, are copies of one article that differ in a counter."""
    rows = [(k, f"http://x.y/{k}", COPIED.format(k)) for k in range(4)] + [(k, f"http://x.y/{k}", COPIED.replace("The title", f"Title {k}").replace("The body of", f"Body {k} of").format(k)) for k in range(4, 8)]
    rows += [(20 + k, f"http://same.z/{k}", COPIED.replace("The body of the story.", "The body of the story. " * 9).format(k)) for k in range(8)]
    got = extracted(spark, rows)
    assert [got[k] for k in range(4)] == [f"The title The body of the story. seen {k} times" for k in range(4)]
    assert [got[k] for k in range(4, 8)] == [f"Title {k} Body {k} of the story. seen {k} times" for k in range(4, 8)]
    assert [got[20 + k] for k in range(8)] == [f"The title {'The body of the story. ' * 9}seen {k} times" for k in range(8)]


def test_a_note_stays_whatever_the_number_of_pages(spark):
    """A paragraph of the article that repeats on some pages is content on hosts of any size."""
    page = "<html><body><article><h1>Title {0}</h1><p>Body {0} and more of it</p>{1}</article></body></html>"
    for n in (3, 8, 20):
        rows = [(k, f"http://x{n}.y/{k}", page.format(k, "<p>Editor note</p>" if k % 2 else "")) for k in range(n)]
        assert extracted(spark, rows) == {k: f"Title {k} Body {k} and more of it" + (" Editor note" if k % 2 else "") for k in range(n)}


def test_pieces_of_a_block_stay_in_page_order():
    text = lambda x: pages.main_text(x, [], set())
    assert text("<div>one <span class='post-title'>two</span> three</div>") == "one two three"
    assert text("<article><p>a<span class='content'>b</span>c <i class='advert'>buy</i> d</p></article>") == "abc d"
    assert text("<article><p>a<i class='ad'>x</i>b</p><p> c </p></article>") == "ab c"


def test_the_template_finds_the_article_without_any_name(spark, monkeypatch, sf):
    """Roles of elements and classes switched off: what lies where and how much of it tell the article from menu, advert and footer."""
    real = pages.role_of
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(pages, "role_of", lambda tag, attributes, above: (real(tag, attributes, pages.UNKNOWN)[0], pages.UNKNOWN))
    batch = pa.RecordBatch.from_pylist([{"page_id": r.page_id, "url": r.url, "html": r.html} for r in rows])
    tokens = pd.concat([b.to_pandas() for b in pages._tokens(iter([batch]))]).groupby(["host", "token"], as_index=False).sum()
    tokens["all"] = tokens["host"].map(tokens[tokens["token"] == "*"].set_index("host")["pages"])
    tokens = tokens[(tokens["token"] != "*") & (tokens["pages"] >= tokens["all"] * pages.SUPPORT) & ((tokens["pages"] >= pages.PAGES) | ~tokens["token"].str.contains("#"))]
    found = {host: pages._template(own).iloc[0] for host, own in tokens.groupby("host")}
    right = 0
    for r in rows:
        t = found[pages.host_of(r.url)]
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        right += pages.main_text(r.html, set(t.slots), set(t.fixed), set(t.links), set(t.cards), t.region) == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
    assert right >= 0.9 * len(rows)


def test_broken_markup_takes_linear_time():
    import time

    for n, make in ((30_000, lambda n: '<a "' * n + "'>"), (30_000, lambda n: "<div>" * n + "</x>"), (30_000, lambda n: "<b>x" * n), (30_000, lambda n: "<a " * n + '"'), (20_000, lambda n: "<h1>" * n), (200_000, lambda n: "&#" + "9" * n + ";x"), (100_000, lambda n: "<!" * n), (30_000, lambda n: "<a<" * n + " '")):
        took = []
        for m in (n, 4 * n):
            page, best = make(m), 9e9
            for _ in range(2):
                start = time.process_time()
                pages.main_text(page, [], set())
                best = min(best, time.process_time() - start)
            took.append(best)
        assert took[1] < 10 * took[0] + 0.2, (make(2), took)
    assert pages.main_text("&#" + "9" * 5000 + "; &#0000065; &#x0041;", [], set()) == "\ufffd A A"


def test_templates_by_a_shuffle_with_a_hot_host(spark, monkeypatch):
    rows = [(k, "http://hot.y/1" if k % 3 else f"http://h{k}.y/1", LISTED.format(k)) for k in range(60)]
    want = extracted(spark, rows)
    monkeypatch.setattr(pages, "BROADCAST_BYTES", 0)
    assert extracted(spark, rows) == want
