import html
import random
import re

import pytest

from tessera.llm import wrappers as wr

SCHEMA = "page_id long, url string, html string, text string, page_host string, bucket int"


def sentence(rng, n=None):
    return " ".join(rng.choice(["alpha", "beta", "größe", "delta & co", "x < y", "“quoted”"]) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(n or rng.randint(8, 40))).capitalize() + "."


def links(rng, n):
    return "".join(f'<li><a href="/{i}">{rng.choice(["Home", "News", "About", "World"])} {i}</a></li>' for i in range(n))


def esc(t):
    return html.escape(t).replace("“", "&ldquo;").replace("”", "&#8221;")


def semantic(rng, i):
    """Article elements, with markup that isn't closed, and page parts of every kind around and inside."""
    blocks = [sentence(rng, 5), *(sentence(rng) for _ in range(rng.randint(1, 6)))]
    p = "".join(f"<p>{esc(b)}" + rng.choice(["</p>", "", "<br>"]) + "\n" for b in blocks[1:])
    comments = "".join(f'<div class="comment"><b>user{k}</b><p>{sentence(rng)}</p></div>' for k in range(rng.randint(0, 3)))
    page = (
        f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>if (a<b) "</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul>{links(rng, 5)}</ul></nav>'
        f'<div class="cookie-notice">We use cookies. <button>OK</button></div><main><article class="post post-{i}"><h1>{esc(blocks[0])}</h1>{p}<div class="share-links"><a href="#">Share</a></div></article>'
        f'<section id="comments"><h2>Comments</h2>{comments}<form><textarea>Say</textarea></form></section></main><aside><p>{sentence(rng)}</p></aside><footer>&copy; {i}</footer>'
    )
    return page + rng.choice(["</body></html>", ""]), blocks


def classes(rng, i):
    """Only divs with names."""
    blocks = [sentence(rng) for _ in range(rng.randint(1, 8))]
    inner = "".join(f"<p>{esc(b)}</p>" + ('<div class="ad-slot">Buy now</div>' if k == 0 and i % 3 == 0 else "") for k, b in enumerate(blocks))
    sidebar = f'<div class="sidebar"><div class="widget"><h3>Top</h3><ul>{links(rng, 4)}</ul></div></div>'
    return f'<html><body><div id="masthead">My site</div><div class="main-menu"><ul>{links(rng, 6)}</ul></div><div class="entry-content">{inner}</div>{sidebar}<div id="footer"><p>All rights reserved by us and nobody else.</p></div></body></html>', blocks


def nameless(rng, i):
    """No names at all: what is the same on each page, and lists of links, aren't the text."""
    blocks = [sentence(rng) for _ in range(rng.randint(3, 9))]
    inner = "".join(f"<p>{esc(b)}</p>" for b in blocks)
    return f"<html><body><div>Welcome to the site of all sites</div><div><ul>{links(rng, rng.randint(3, 8))}</ul></div><div><div>{inner}</div></div><div>Imprint and terms of this site, the same on each page</div></body></html>", blocks


def sections(rng, i):
    """Headings and paragraphs by turns, lists and tables."""
    blocks, inner = [], ""
    for k in range(rng.randint(1, 4)):
        head, one, two = sentence(rng, 3), sentence(rng), sentence(rng)
        blocks += [head, one, two]
        inner += f"<h2>{esc(head)}</h2><p>{esc(one)}</p><ul><li>{esc(two)}</ul>"
        if k == 1:
            blocks += ["a", "b c"]
            inner += "<table><tr><td>a<td>b <i>c</i></table>"
    return f"<body><nav>{sentence(rng)}</nav><article>{inner}</article><div class=newsletter>{sentence(rng)}<input></div></body>", blocks


KINDS = {"s.example.com": semantic, "c.example.com": classes, "n.example.org": nameless, "h.example.org": sections}


def site(n=40, seed=2):
    rng, rows = random.Random(seed), []
    for host, kind in KINDS.items():
        for i in range(n if kind is not semantic else 3 * n):
            page, blocks = kind(rng, i)
            rows.append((len(rows), f"https://u@{host.upper()}:80/a/{i}?q=1", page, "clash", "clash", 1, "\n\n".join(blocks)))
    return rows


def test_pages_of_all_kinds(spark, monkeypatch):
    rows = site()
    odd = [
        (900, None, "<p>no host</p>", "", "", 1),
        (901, "https://s.example.com/x", None, "", "", 1),
        (902, "https://s.example.com/x", "", "", "", 1),
        (903, "nonsense", "plain text, a < b &amp; c &am", "", "", 1),
        (904, "http://deep.example.com/", "<div>" * 3000 + "deep down" + "</div>" * 3000, "", "", 1),
        (905, "http://long.example.com/", "<article>" + "<p>many words here.</p>" * 20_000 + "</article>", "", "", 1),
        (906, "http://open.example.com/", "<p>before <script>never closed <p>x", "", "", 1),
        (None, "http://open.example.com/", "<p>before</p><!-- never closed <p>x", "", "", 1),
    ]
    monkeypatch.setattr(wr, "FAN", 3)  # several rounds
    table = spark.createDataFrame([*(r[:6] for r in rows), *odd, odd[3]], SCHEMA).repartition(11)
    out = wr.extracted(table)
    assert out.columns == ["page_id", "url", "html", "page_host", "bucket", "text", "n_chars"]
    found = out.select("page_id", "text", "n_chars").collect()
    assert len(found) == len(rows) + len(odd) + 1 and all(r["n_chars"] == len(r["text"]) for r in found)
    got = {r["page_id"]: r["text"] for r in found}
    wrong = [r[0] for r in rows if got[r[0]] != r[6]]
    assert not wrong, (len(wrong), got[wrong[0]], rows[wrong[0]][6], rows[wrong[0]][2])
    assert (got[900], got[901], got[902], got[903], got[904]) == ("no host", "", "", "plain text, a < b & c &am", "deep down")
    assert got[905] == "\n\n".join(["many words here."] * 20_000) and got[906] == "before" and got[None] == "before"
    assert wr.extracted(table.where("page_id < 0")).count() == 0


def test_other_partitionings_agree(spark):
    rows = [r[:6] for r in site(15, 3)]
    once, again = (sorted(map(tuple, wr.extracted(spark.createDataFrame(rows, SCHEMA).repartition(n)).select("page_id", "text").collect())) for n in (2, 9))
    assert once == again


def test_copies_of_one_page_keep_their_text(spark):
    page = semantic(random.Random(1), 1)
    table = spark.createDataFrame([(i, "http://copies.example.com/", page[0], "", "", 1) for i in range(50)], SCHEMA)
    assert {r["text"] for r in wr.extracted(table).collect()} == {"\n\n".join(page[1])}


def test_wrapper_is_a_regular_expression_without_unions():
    pages = [wr.prepared(wr.stream(p)[0]) for p in ("<ul><li>a<li>b</ul><p>one</p>", "<ul><li>a</ul><h2>x</h2><p>two</p><p>three</p>", "<ul><li>a</ul><p>one</p>")]
    assert [wr.signature(p) for p in pages] == ["html<ul<li+<#+>> p<#>>", "html<ul<li<#>> h2<#> p+<#+>>", "html<ul<li<#>> p<#>>"]
    assert wr.signature(wr.aligned(pages)) == "html<ul<li+<#+>> h2?<#> p+<#+>>"
    turns = [wr.prepared(wr.stream("<h2>t</h2><p>x</p>" * n)[0]) for n in (3, 1)]
    assert wr.signature(turns[0]) == "html<(+<h2+<#+> p+<#+>>>".replace("h2+", "h2").replace("p+", "p")
    assert wr.signature(wr.aligned(turns)) == wr.signature(turns[0])


def test_alignment_against_every_choice():
    """The pairs found weigh as much as the best of all that keep the order."""
    rng = random.Random(4)

    def best(a, b):
        if not a or not b:
            return 0.0
        s = wr.alike(a[0], b[0])
        return max(best(a[1:], b), best(a, b[1:]), best(a[1:], b[1:]) + s if s >= 0.5 else 0)

    for _ in range(200):
        a, b = ([wr.Node(rng.choice(["p", "div", "div.x", "#"]), [wr.Node(rng.choice("qr"))]) for _ in range(rng.randint(0, 6))] for _ in range(2))
        found = wr.pairs(a, b)
        assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert sum(wr.alike(a[i], b[j]) for i, j in found) == pytest.approx(best(a, b))


def test_given_pages(spark):
    """The tables' articles, by a pattern that knows their template."""
    sf = "/root/testdata/sf0.001"

    def slow(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        return "\n\n".join(filter(None, blocks))

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = wr.op11_inferred_wrappers(spark, sf)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert {r["page_id"]: r["text"] for r in found.collect()} == {i: slow(p) for i, p in pages.items()}
