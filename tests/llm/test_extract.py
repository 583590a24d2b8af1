import random

from evalforge.llm import extract


def page(i, body, nav="Home About", extra="", close=True, tail=""):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>{nav}</a></li></ul></nav><!-- c --><div class=\"ad\">Buy now</div>{extra}<article>{body}</article>{tail}<footer>&copy; h</footer>" + ("</body></html>" if close else "")


def slow(i, paras):
    return "\n".join(" ".join(p.split()) for p in paras if p.split())


def test_groups():
    rnd = random.Random(1)
    html, want = [], []
    for i in range(20):
        paras = [" ".join(rnd.choice(["the", "a", "x<y", "cat & dog", "“q”", "é"]) for _ in range(rnd.randrange(1, 9))) + f" {i} {k}" for k in range(rnd.randrange(1, 6))]
        esc = [p.replace("&", "&amp;").replace("<", "&lt;") for p in paras]
        body = f"<h1>Title\n {i}</h1>" + "".join((f"<p><b>{p}<br>" if rnd.random() < 0.3 else f"<p>{p}</p>") for p in esc)
        body += "<aside>side</aside><div class='comments'><p>reader says</p></div><form>mail <input></form><p class='share-notice'>Share</p>"
        html.append(page(i, body, close=i % 3 > 0, extra="<div class='cookie-notice'>We use cookies" if i % 4 == 0 else "", tail="<section id='comments'><p>no</p></section>"))
        want.append(slow(i, [f"Title {i}", *paras]))
    assert extract.group_texts(html) == want
    assert extract.group_texts(html[:1]) == want[:1]
    assert extract.group_texts([html[3]] * 12) == [want[3]] * 12
    assert extract.group_texts([None, ""]) == ["", ""]


def test_without_article():
    html = [f"<html><body><div class='menu'>Menu</div><div><p>Always the same line</p><p>Text {i} here</p></div><div class='footer'>f</div></body></html>" for i in range(12)]
    assert extract.group_texts(html) == [f"Text {i} here" for i in range(12)]


def test_template_nests():
    root, nested = extract.template([extract.parse(page(i, f"<p>own {i}</p>")) for i in range(5)])
    texts = [t for _, t in root]
    assert "Home" in texts and "<article>" in texts and "own" not in texts
    assert texts.index("<nav>") < texts.index("Home") < texts.index("<article>")


def test_extract(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", page(i, f"<p>text {i}&#33;</p>"), "z") for i in range(300)]
    rows += [(None, "http://h0.example/", page(0, "<p>no id</p>"), "z"), (900, None, page(1, "<p>no url</p>"), "z"), (901, "junk", None, None), (0, rows[0][1], rows[0][2], "z"), (902, "http://h1.example/long", page(2, "<p>" + "w " * 50000 + "</p>"), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"text {i}!" for i in range(300))
    assert by[None] == "no id" and by[900] == "no url" and by[901] == "" and by[902] == ("w " * 50000).strip()
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(df.limit(0)).count() == 0


def like_the_data(i, body, host="h", nav="One Two", ad="x"):
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in nav.split())
    return f'<!DOCTYPE html><html lang="en"><head><title>T {i}</title></head><body><nav><ul>{menu}</ul></nav><div class="ad">{ad}</div><article><h1>T {i}</h1>{body}</article><footer>&copy; {host} &middot; f{i}</footer></body></html>'


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def test_template_decides():
    """Pages like those of the data: the slot comes from the group's template; without it nothing is left out."""
    rnd = random.Random(2)
    paras = [[words(rnd, rnd.randrange(4, 40)) for _ in range(rnd.randrange(1, 6))] for _ in range(12)]
    html = [like_the_data(i, "".join(f"<p>{p}</p>" for p in ps), ad=words(rnd, 9)) for i, ps in enumerate(paras)]
    want = ["\n".join([f"T {i}", *ps]) for i, ps in enumerate(paras)]
    assert extract.group_texts(html) == want
    emptied = extract.group_texts(html, known=extract.Template())
    assert all(e != w and "©" in e and "One" in e for e, w in zip(emptied, want))
    # elements that have other names: what holds most of the open text is the slot, and an advert's words don't count
    plain = [h.replace("article>", "section>").replace("<section>", '<section class="x">').replace("nav>", "div>").replace("footer>", "div>").replace('class="ad"', 'class="zzz"') for h in html]
    assert extract.group_texts(plain) == want
    # an element that is the template's elsewhere isn't the article's
    inner = [h.replace("</h1>", f'</h1><section class="ad">{words(rnd, 5)}</section>').replace('<div class="ad">', '<section class="ad">') for h in html]
    assert extract.group_texts(inner) == want


def test_labelled_text_stays():
    rnd = random.Random(3)
    html = [like_the_data(i, f'<p>{words(rnd, 20)}</p><p class="alert">own {i} alert</p><div class="related"><p>see {i} too</p></div>') for i in range(9)]
    got = extract.group_texts(html)
    assert all(f"own {i} alert" in t and f"see {i} too" in t for i, t in enumerate(got))


def test_few_pages_and_copies():
    rnd = random.Random(4)
    for n in (3, 7, 8):  # an unmarked line that is the same on all pages of a host
        html = [like_the_data(i, f"<p>Always this line</p><p>{words(rnd, 30)}</p><p>{words(rnd, 30)}</p>") for i in range(n)]
        assert not any("Always" in t for t in extract.group_texts(html))
    # copies of a page don't make it template, nor do near copies
    paras = [words(rnd, 12) for _ in range(8)]
    near = [like_the_data(i, "".join(f"<p>{p}</p>" for p in [*paras, f"edit {i}"])) for i in range(5)]
    assert all(set(paras) <= set(t.split("\n")) for t in extract.group_texts(near + near[:1] * 9))
    # hosts of one page learn from each other where the article is
    html = [like_the_data(i, f"<p>{words(rnd, 25)}</p>", host=f"h{i}", nav=words(rnd, 3), ad=words(rnd, 6)).replace("article>", "section>") for i in range(20)]
    got = extract.group_texts(html, [f"h{i}" for i in range(20)])
    assert all(t.startswith(f"T {i}\n") and t.count("\n") == 1 for i, t in enumerate(got))


def test_nulls_and_empty():
    assert extract.group_texts([]) == []
    assert extract.group_texts([None, "", "plain words", "<p>", "<b>x</b>"]) == ["", "", "plain words", "", "x"]


def bare(html):
    """No element but the heading tells what it is."""
    for t in ("article", "nav", "footer"):
        html = html.replace(f"<{t}>", "<div>").replace(f"</{t}>", "</div>")
    return html.replace('<div class="ad">', "<div>")


def group_like_the_data(seed, n):
    rnd = random.Random(seed)
    paras = [[words(rnd, rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 6))] for _ in range(n)]
    html = [like_the_data(i, "".join(rnd.choice([f"<p>{p}</p>", f"<p><b>{p}<br>"]) for p in ps), nav=words(rnd, rnd.randrange(3, 7)), ad=words(rnd, 9)) for i, ps in enumerate(paras)]
    return html, ["\n".join([f"T {i}", *ps]) for i, ps in enumerate(paras)]


def test_classes_decide(monkeypatch):
    """Menus, adverts, article and footer that are all a bare div, with other words on each page: only the classes tell them apart."""
    html, want = group_like_the_data(6, 14)
    plain = [bare(h) for h in html]
    assert extract.group_texts(plain) == want == extract.group_texts(html)
    assert [extract.group_texts(plain[i : i + 3]) for i in (0, 3, 6)] == [want[i : i + 3] for i in (0, 3, 6)]
    for names in ("_FOREIGN", "_UNPROVEN", "_LANDMARKS"):
        monkeypatch.setattr(extract, names, set())
    monkeypatch.setattr(extract, "_ASIDE", {"head"})
    assert extract.group_texts(plain) == want == extract.group_texts(html)  # no list has a part in it
    monkeypatch.setattr(extract, "told_apart", lambda pages, hosts: pages)
    assert all(a != b for a, b in zip(extract.group_texts(plain), want))


def test_roles():
    html, _ = group_like_the_data(7, 5)
    paths = [[t.path for t in p if t.tag and t.text == "<div>"] for p in extract.roles([extract.parse(bare(h)) for h in html])]
    assert len({tuple(p) for p in paths}) == 1  # each div has the same role on all pages
    menu, ad, article, footer = (p.rpartition("/")[2] for p in paths[0])
    assert "ul" in menu and "h1" in article and ad == "div@1#1" and footer == "div@2#1"
    optional = [bare(h).replace("</head>", "</head><div>notice</div>" if i % 2 else "</head>") for i, h in enumerate(html)]
    got = [{t.path.rpartition("/")[2] for t in p if t.text == "<div>"} for p in extract.roles([extract.parse(h) for h in optional])]
    assert all(menu in g and article in g for g in got)  # those that hold something of the class keep their roles
    assert extract.roles([]) == [] and extract.roles([[]]) == [[]]


def test_fixed_text_counts(monkeypatch):
    """What the classes of text hold within the article's slot goes; without them it stays."""
    rnd = random.Random(8)
    html = [bare(like_the_data(i, f"<p>{words(rnd, 20)}</p><p>Read our terms</p><p>{words(rnd, 9)}</p>", ad=words(rnd, 5))) for i in range(8)]
    assert not any("Read our terms" in t for t in extract.group_texts(html))
    monkeypatch.setattr(extract, "_classes", lambda pages: set())
    assert all("Read our terms" in t for t in extract.group_texts(html))


def test_layouts_of_small_hosts():
    """Hosts of one page learn from pages of their layout alone."""
    html, want = group_like_the_data(9, 20)
    mixed = [bare(h) if i % 2 else bare(h).replace("<body>", '<body><section class="top"></section>') for i, h in enumerate(html)]
    assert extract.group_texts(mixed, [f"h{i}" for i in range(20)]) == want


def test_deep_and_odd_pages():
    deep = "<div>" * 300 + "x" + "</div>" * 300
    assert extract.group_texts([deep] * 2 + ["</div></p>tail", "<div><p>a<div>b", "<article><p>one</article><article><p>two</article>"])[0] == "x"
