import pytest

from edgeloom.llm.html_text import Wrapper, aligned, article, extracted, folded, inferred, stream, tokens

PAGE = """<html><head><title>T</title><script>if (a<b) x="</p>";</script><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div><main><article class="post has-sidebar"><header class="entry-header"><h1>Title &amp; more</h1></header><p>One   two<br>three <b>bold</b>text<p>Second &lt;para&gt; &#8364; &nbsp; x<div class="ad">AD</div><ul><li>a<li>b</ul><form><input><label>mail</label></form><blockquote>quote</blockquote><table><tr><td>c1<td>c2</table><!-- no --></article>
<section class="comments"><article class="comment"><p>reader says</p></article></section></main><aside>aside</aside><footer>foot</footer></body></html>"""
TEXT = "Title & more\nOne two three boldtext\nSecond <para> € x\na\nb\nquote\nc1\nc2"


def test_rules():
    assert article(PAGE) == TEXT
    assert article("<p>plain <i>text</i> only") == "plain text only"
    assert article("just &lt; text") == "just < text"
    assert article('<div class="content"><p>a</p></div><div class="footer">x</div><div class=comments>c</div>') == "a"
    assert article("<div hidden>no</div><p>yes<p style='display:none'>no</p>") == "yes"
    assert article("") == "" and article("<") == "<" and article("<p") == "" and article("</article></p>x") == "x"
    assert article("<article><p>" + "word " * 50_000 + "</article>") == ("word " * 50_000).strip()


def test_repeats_fold_and_differences_become_options():
    item = ["<li", "#", ">li"]
    assert folded(["<ul", *item, *item, *item, ">ul"]) == ["<ul", ["+", item], ">ul"]
    w = aligned(["<p", "#", ">p", "<hr", "<b", ">b"], ["<p", "#", ">p", "<b", ">b"])
    assert w == ["<p", "#", ">p", ["?", ["<hr"]], "<b", ">b"]


def page(paragraphs, notice):
    p = "".join(f"<p>{x}</p>" for x in paragraphs)
    return f"<html><body><nav><ul><li>a</li><li>b</li></ul></nav>{'<div class=notice>n</div>' if notice else ''}<article><h1>t</h1>{p}</article><footer>f</footer></body></html>"


def test_wrapper_matches_pages_it_has_not_seen():
    w = Wrapper(inferred([page(["x"] * 2, False), page(["q r s", "y", "z"], True), page(["q"], True)]))
    for k in (1, 2, 9):
        for notice in (False, True):
            p = page([f"p{i}" for i in range(k)], notice)
            assert w.fits(stream(tokens(p)))
            assert article(p, w) == "\n".join(["t", *[f"p{i}" for i in range(k)]])
    assert not w.fits(stream(tokens("<html><table></table></html>")))
    assert article("<html><p>other</p></html>", w) == "other"


def test_rows(spark):
    rows = [(i, f"http://H{i % 2}.example.com/{i}", page([f"text {i}"] * (i % 4 + 1), i % 3 == 0), "x") for i in range(40)]
    rows += [(100, None, PAGE, ""), (101, "not a url", None, ""), (102, "http://h.example/", "", ""), (103, "http://h.example/", "<p>" + "é" * 100_000, ""), (1, rows[1][1], rows[1][2], "")]
    out = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 45
    for r in out:
        if r["page_id"] < 40:
            assert r["text"] == "\n".join(["t"] + [f"text {r['page_id']}"] * (r["page_id"] % 4 + 1))
    by = {r["page_id"]: r for r in out}
    assert by[100]["text"] == TEXT and by[101]["text"] == "" and by[102]["n_chars"] == 0 and by[103]["n_chars"] == 100_000
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def neutral(i, n, note=False):
    """A page without any mark: menu, title, n paragraphs, a footer."""
    p = "".join(f"<p>paragraph {k} of page {i} with its own words</p>" for k in range(n))
    note = "<div class='z'>We moved to a new building</div>" if note else ""
    return f'<html><body><div class="xq1"><a href="/">Home</a> <a href="/c">Contact us</a></div>{note}<div class="b2"><h2>title {i}</h2>{p}</div><div class="k9">Copyright 2020 &amp; later</div></body></html>'


def test_texts_of_the_template_are_left_out_and_slots_stay():
    w = Wrapper(inferred([neutral(i, 2 + i % 4, i % 2 == 0) for i in range(12)]))
    for i, n in ((50, 1), (51, 2), (52, 30)):
        for note in (False, True):
            p = neutral(i, n, note)
            want = "\n".join([f"title {i}", *[f"paragraph {k} of page {i} with its own words" for k in range(n)]])
            assert w.fits(stream(tokens(p))) and article(p, w) == want
            assert article(p) == "Home Contact us\n" + ("We moved to a new building\n" if note else "") + want + "\nCopyright 2020 & later"
    # what only copies share is no template, nor is what an article says on every page
    copies = [neutral(1, 20) for _ in range(12)]
    assert article(copies[0], Wrapper(inferred(copies))) == article(copies[0])
    licence = [page([f"own text {i} " * 5, "All rights reserved"], False) for i in range(12)]
    assert article(licence[3], Wrapper(inferred(licence))).endswith("All rights reserved")
    # an article that some pages mark and others don't
    mixed = [neutral(i, 3).replace('<div class="b2">', "<article>").replace("</div><div class=\"k9\">", "</article><div class=\"k9\">") if i % 2 else neutral(i, 3) for i in range(12)]
    w = Wrapper(inferred(mixed))
    for p in mixed:
        assert article(p, w).startswith("title ") and "Copyright" not in article(p, w)


def test_alignment_keeps_what_every_page_has():
    import random

    rng = random.Random(4)
    fits = 0
    for _ in range(60):
        blocks = [[f"<{t}", "#", f">{t}"] for t in rng.sample("abcdefgh", 4)]
        pages = []
        for k in range(5):
            p = ["<r"]
            for b in blocks[:2]:
                p += b * rng.randint(1, 4)
            p += blocks[2] if rng.random() < 0.5 else []
            pages.append([*p, *blocks[3], ">r"])
        w = None
        for p in pages:
            w = folded(p) if w is None else folded(aligned(w, folded(p)))
        shortest, longest = min(map(len, pages)), max(map(len, pages))
        assert all(Wrapper(w).fits(p) for p in pages), (w, pages)
        must = [x for x in w if isinstance(x, str)]
        for p in pages:  # what is not optional is a subsequence of every page
            it = iter(p)
            assert all(x in it for x in must)
        fits += Wrapper(w).fits(["<r", *blocks[0] * 9, *blocks[1], *blocks[3], ">r"])
        assert shortest <= longest
    assert fits >= 40


def test_long_streams_are_matched_in_one_go():
    w = Wrapper(["<a", ["+", [["?", ["<b"]], ["+", ["<b"]]]], ">a"])
    assert not w.fits(["<a", *["<b"] * 5000, "<c"])


def test_clashing_columns(spark):
    rows = [(i, f"http://h/{i}", neutral(i, 2 + i % 4), "x", "y", i, 1) for i in range(12)]
    out = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string, rank int, n_chars int"))
    assert out.columns == ["page_id", "url", "html", "host", "wrapper", "rank", "text", "n_chars"]
    for r in out.collect():
        assert r["text"].startswith("title ") and r["n_chars"] == len(r["text"]) and r["host"] == "x"


@pytest.mark.parametrize("broken", ["<p><b>x<br><p>y</p>", "<article><p><b>x<p>y"])
def test_broken_markup_keeps_the_text(broken):
    assert article(broken) == "x\ny"


def test_forms_references_scripts_and_quotes():
    from edgeloom.llm.html_text import article

    assert article("<form><article><p>Hello world</p><input value=x></article></form>") == "Hello world"
    assert article("<body><form id=f><h1>Head</h1><p>text</p><button>Go</button></form></body>") == "Head\ntext"
    assert article("<body><p>text</p><form><p>Your name <input></p></form></body>") == "text"
    assert article("<article><p>text</p><form><label>Mail</label><p>Sign up</p></form></article>") == "text"
    assert article("<p>AT&<b>amp;</b> R&<i>para</i>graph</p>") == "AT&amp; R&paragraph"
    assert article("<p>AT&<!-- -->amp; &lt;b&gt; &amp;amp;</p>") == "AT&amp; <b> &amp;"
    assert article("<p>x<script>let a = 1</script>y<style>p {}</style>z<!-- c -->!</p>") == "xyz!"
    assert article('<p>a</p><a title="x>hello') == "a\nhello"
    assert article("<p><![CDATA[1 < 2 &amp; 3]]></p>") == "1 < 2 &amp; 3"


def test_every_page_of_a_host_is_learned_from(spark, monkeypatch):
    from edgeloom.llm import html_text

    monkeypatch.setattr(html_text, "ITEMS", 400, raising=False)  # many parts, which are aligned with each other
    monkeypatch.setattr(html_text, "PARTS", 4, raising=False)
    own = lambda i: "\n".join([f"title {i}", *[f"paragraph {k} of page {i} with its own words" for k in range(2 + i % 4)]])
    rows = [(i, f"http://h/{i}", neutral(i, 2 + i % 4, i % 60 == 7)) for i in range(300)]  # five pages have the note
    rows += [(1000 + i, f"http://copies/{i}", neutral(1, 20)) for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in extracted(table).collect()}
    assert [i for i in range(300) if out[i] != own(i)] == []
    assert {out[1000 + i] for i in range(30)} == {article(neutral(1, 20))}  # what only copies share is no template
    assert {r["page_id"]: r["text"] for r in extracted(table.repartition(7)).collect()} == out


def test_long_pages_are_learned_from(monkeypatch):
    from edgeloom.llm import html_text

    def long(i, n=800):
        return neutral(i, 0).replace("</div><div class=\"k9\">", "".join(f"<p class='c{k}'>own {i} {k}</p>" for k in range(n)) + "</div><div class=\"k9\">")

    pages = [long(i) for i in range(4)]
    assert len(folded(stream(tokens(pages[0])))) > 2000
    w = inferred(pages)
    assert article(long(9), Wrapper(w)) == "\n".join(["title 9", *[f"own 9 {k}" for k in range(800)]])
    parts = [html_text.learned([stream(tokens(long(i, n)))]) for i, n in ((0, 800), (1, 900))]
    assert len(html_text.joined(parts)) > len(parts[0]) > 2000
    monkeypatch.setattr(html_text, "CELLS", 60)  # rows of the table are made again, level by level
    assert inferred([neutral(i, 2 + i % 4, i % 2 == 0) for i in range(12)]) and inferred(pages[:2] + [neutral(7, 3)])
    short = [neutral(i, 2 + i % 4, i % 2 == 0) for i in range(12)]
    few = inferred(short)
    monkeypatch.undo()
    assert few == inferred(short)


def test_a_wrapper_may_have_more_texts_than_there_are_letters():
    items = ["<a", *[f"#{k:016x}" for k in range(70_000)], ["?", ["<b"]], "#", ">a"]
    page = ["<a", *items[1:70_001], "#other", ">a"]
    w = Wrapper(items)
    assert w.constants(page) == list(range(1, 70_001))
    assert not w.fits([*page[:-2], ">a"]) and not w.fits(["<a", "<c", *page[1:]])
