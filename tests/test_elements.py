"""Selectors against plain evaluation, charsets, object literals against json, JSON-LD, by small pages."""

import json
import random
import re

import pytest

from marquee.plans import catalog
from marquee.sources import elements, literals, pages, selectors

PAGE = """<html><body><div id=main class="a b"><p class=x> One <b>two</b>
 three</p><p class=x>four</p><img src="/rel.png"><img class=full src="http://x.example/i.png">
<a href=" ">no</a><a rel=t href="https://t.example">go</a><p class=l>Lineup:<br>Alexa <i>Fluor</i><br/> <br>ALIS.</p>
<span class="flag w-condition-invisible">Cancelled</span><span class=flag>SOLD-out</span></p></div></body></html>"""


@pytest.mark.parametrize(
    ("selector", "what", "want"),
    [
        ("p", "text", "One two three"),
        ("#main p.x", "text", "One two three"),
        ("div.b.a b", "text", "two"),
        ("i p", "text", None),
        ("h1", "text", None),
        ("img", "src", None),
        ("img.full", "src", "http://x.example/i.png"),
        ("a", "@href", None),
        ("a[rel=t]", "href", "https://t.example"),
        ("a[rel]", "text", "go"),
        ("p.l", "lines", "Lineup:\nAlexa Fluor\nALIS."),
        (".flag", "shown:cancelled", "false"),
        (".flag", "shown:sold-out", "true"),
    ],
)
def test_values(selector, what, want):
    assert elements.value(elements.parse(PAGE), selector, what) == want


def test_charsets():
    assert elements.decoded("Grün".encode("latin-1"), "text/html; charset=ISO-8859-1") == "Grün"
    assert elements.decoded('<meta charset="windows-1252">Grün'.encode("cp1252")).endswith("Grün")
    assert elements.decoded("Grün".encode()) == "Grün" and elements.decoded(b"a", "charset=nonsense") == "a"
    assert elements.decoded(None) is None and elements.decoded(b"") == ""


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (4, "</p><p>" * 3000 + "end")], "page_id long, html string")
    found = {(r.page_id, r.pos): r.t for r in elements.picked(pages, "", {"t": ("p", "text")}).collect()}
    assert found[1, 1] is None and found[2, 1] is None and found[None, 1] == "x" and len(found) == 4
    assert elements.picked(pages.limit(0), "p", {"t": ("", "text")}).count() == 0 and elements.members(pages, "events").count() == 0


def loosely(x, rng):
    """A value written as scripts write literals."""
    gap = lambda: rng.choice(["", "", " ", "\n", "/* } ' */", "// {\n"])
    if isinstance(x, dict):
        names = [k if re.fullmatch(r"[A-Za-z_$][\w$]*", k) and k.isascii() and rng.random() < 0.7 else loosely(k, rng) for k in x]
        inside = ",".join(f"{gap()}{n}{gap()}:{gap()}{loosely(v, rng)}{gap()}" for n, v in zip(names, x.values(), strict=True))
        return "{" + inside + ("," if x and rng.random() < 0.3 else "") + gap() + "}"
    if isinstance(x, list):
        return "[" + ",".join(gap() + loosely(v, rng) for v in x) + ("," if x and rng.random() < 0.3 else "") + gap() + "]"
    if isinstance(x, str):
        quote = rng.choice("\"'")
        plain = json.dumps(x, ensure_ascii=rng.random() < 0.5)[1:-1]
        return quote + (plain if quote == '"' else plain.replace('\\"', '"').replace("'", "\\'")) + quote
    return rng.choice(["null", "undefined"]) if x is None else {True: rng.choice(["true", "!0"]), False: rng.choice(["false", "!1"])}[x] if isinstance(x, bool) else json.dumps(x)


def drawn(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -3, 12345678901234567890, 0.5, -1e-7, 2.5e30])
    if kind < 5:
        return "".join(rng.choice("ab{}[]:,'\"\\\n\t/ é\u2028😀") for _ in range(rng.randrange(8)))
    if kind == 5:
        return [drawn(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {drawn_name(rng): drawn(rng, depth + 1) for _ in range(rng.randrange(4))}


def drawn_name(rng):
    return rng.choice(["a", "b_1", "$c", "true", "events", "x y", "", "it's", '"', "ü"])


def test_literals_against_json():
    rng = random.Random(6)
    for _ in range(1500):
        x = drawn(rng)
        assert literals.read(loosely(x, rng) + rng.choice(["", ";", ")", "}", " , 1"])) == x


def test_literals_in_scripts():
    rng = random.Random(7)
    for _ in range(200):
        before, events, after = ({f"k{i}": drawn(rng, 2) for i in range(rng.randrange(3))} for _ in range(3))
        inner = {f"m{k}": v for k, v in before.items()} | {"events": list(events.values())} | after
        script = f"let t = 'events: ['; /* events: [ */ start({{kind: {loosely(before, rng)}, node: {loosely(inner, rng)}}}, {loosely('}', rng)});"
        assert literals.member_list(script, "events") == inner["events"]
    assert literals.member_list("f({a: [1], b: '}'})", "b") is None and literals.member_list("", "a") is None and literals.around("a: [", "a") is None
    for broken in ("{a: [1}", "{a: [f(1)]}", "{a [1]}", "{a: [1]", "{a: ['x]}"):
        with pytest.raises(ValueError):
            literals.read(broken)
    deep = "[" * 5_000 + "]" * 5_000
    found = literals.read(deep)
    for _ in range(4_999):
        (found,) = found
    assert found == [] and literals.read("{a:1,a:2,'b':.5,c:0x1F,}") == {"a": 2, "b": 0.5, "c": 31}


def test_broken_literals_are_told(spark):
    made = spark.createDataFrame([(1, "<script>f({events: [{a: 'x',},]})</script>"), (2, "<script>f({events: [g()]})</script>"), (3, "<p>")], "page_id long, html string")
    got = {(r.page_id, r.pos): (r.member, r.error is None) for r in elements.members(made, "events").collect()}
    assert got == {(1, 1): ('{"a": "x"}', True), (2, 0): (None, False)}


def test_json_ld_of_any_shape():
    page = '<script type="application/ld+json">%s</script>'
    for graph in ('{"@type": "Event", "n": 1}', '[{"@type": "Event", "n": 1}]', 'null', '"x"', '[null, 3, {"@type": "MusicEvent", "n": 1}]'):
        found = pages.json_ld(page % f'{{"@graph": {graph}}}')
        assert [x["n"] for x in found] == ([1] if '"n"' in graph else [])
    assert pages.json_ld(page % '{"@type": "Event", "n": "a &quot;b&quot;"}')[0]["n"] == "a &quot;b&quot;"


TAGS, CLASSES = ["div", "p", "a", "ul", "li"], ["x", "y", "Zed"]


def drawn_page(rng):
    """Nested elements; paragraphs and items hold no others, so that written pages parse as drawn."""

    def element(depth):
        tag = rng.choice(TAGS[:2] if depth > 3 else TAGS)
        tag = "span" if tag in ("p", "li") and depth <= 3 and rng.random() < 0.5 else tag
        attrs = "".join(f' {k}="{v}"' for k, v in (("class", " ".join(rng.sample(CLASSES, rng.randrange(3)))), ("id", rng.choice("ijk")), ("href", rng.choice(["/event/1", "http://a.example", "x.PDF"]))) if rng.random() < 0.5)
        inside = "" if tag in ("p", "li") else "".join(element(depth + 1) for _ in range(rng.randrange(4 - min(depth, 3))))
        return f"<{tag}{attrs}>{rng.choice(['', 'One two', 'three'])}{inside}</{tag}>"

    return "".join(element(0) for _ in range(3))


def drawn_selector(rng, depth=0):
    def simple():
        kind = rng.randrange(9 if depth < 2 else 6)
        if kind == 0:
            return "." + rng.choice([*CLASSES, "X"])
        if kind == 1:
            return "#" + rng.choice("ij")
        if kind == 2:
            return rng.choice(["[href]", "[href^=http]", "[href*='/event/']", '[href$=".pdf"]', "[href='/event/1']", "[href!=x]", "[^hr]", "[class=x]"])
        if kind == 3:
            return rng.choice([":first-child", ":last-child", ":only-child", ":first-of-type", ":last-of-type", ":empty"])
        if kind == 4:
            return rng.choice([":nth-child(2)", ":nth-child(odd)", ":nth-child(2n)", ":nth-last-child(-n+2)", ":nth-of-type(2n+1)", ":eq(0)", ":gt(0)", ":lt(1)"])
        if kind == 5:
            return rng.choice([":contains(one  TWO)", ":containsOwn(three)"])
        inner = drawn_selector(rng, depth + 1)
        return rng.choice([f":not({inner})", f":is({inner})", f":has({rng.choice(['', '> ', '+ ', '~ '])}{inner})"])

    def compound():
        return rng.choice(["", *TAGS, "*", "span"]) + "".join(simple() for _ in range(rng.randrange(2))) or "div"

    chain = lambda: "".join(x for i in range(rng.randrange(1, 4)) for x in ([rng.choice([" ", ">", " > ", "+", " ~ "])] if i else []) + [compound()])
    return ", ".join(chain() for _ in range(rng.choice([1, 1, 2])))


def inside(e):
    yield e
    for k in e.kids:
        yield from inside(k)


def plainly(selector, within):
    """What a selector names, from the left: sets of elements, step by step, over the whole tree."""
    everything = [e for e in inside(within) if e.tag]
    out = set()
    for chain in selectors.compiled(selector).chains:
        now = None
        for i, compound in enumerate(chain.compounds):
            if now is None:
                reach = [within, *everything] if compound.tests == [selectors._asked] else everything
            else:
                step, reach = chain.steps[i - 1], []
                for e in now:
                    if step == ">":
                        reach += e.kids
                    elif step == " ":
                        reach += [x for x in inside(e) if x is not e]
                    elif e.above is not None and e is not within or chain.compounds[0].tests == [selectors._asked] and e.above is not None:
                        place = next(j for j, k in enumerate(e.above.kids) if k is e)
                        reach += e.above.kids[place + 1 : place + 2] if step == "+" else e.above.kids[place + 1 :]
            now = {x for x in reach if compound.fits(x, within)}
        out |= now
    return sorted((e for e in out if e.tag), key=lambda e: e.order)


def test_selectors_against_plain_evaluation():
    rng = random.Random(9)
    hits = 0
    for _ in range(2500):
        root = elements.parse(drawn_page(rng))
        within = rng.choice([root, *root.select("*")][:4])
        selector = drawn_selector(rng)
        got = within.select(selector)
        assert got == plainly(selector, within), (selector, within.tag)
        assert within.first(selector) is (got[0] if got else None)
        hits += bool(got)
    assert hits > 400


LISTING = """<div class=wrap><div class="prog-row"><span class="prog-date">1.</span><h3>One</h3></div><div class="prog-row">none</div>
<ul class=events><li><a class="event-item" href="/event/1">A</a><li><a class="event-item">B</a></ul><article class="events highlight">no</article><article class="events">yes</article>
<div class="row"><div class=column>c1</div><p><span class=column>c2</span></p></div><p>plain<div>after</div><a href="HTTPS://x.example/shop">s</a>
<h6 class=h6>Label</h6><div>Value</div><table><tr><td class=datum>d1<td>e1<tr><td>d2</table><select><option>1<option selected>2</select></div>"""


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        (".prog-row:has(.prog-date) h3", ["One"]),
        ("ul.events li:has(a.event-item[href])", ["A"]),
        ("article.events:not(.highlight)", ["yes"]),
        (".row > .column", ["c1"]),
        ("a[href^=http]", ["s"]),
        ("a[href*='/event/']", ["A"]),
        (".h6 + div", ["Value"]),
        ("tr:has(.datum) > td", ["d1", "e1"]),
        ("table > tr", []),
        ("tbody > tr", ["d1e1", "d2"]),
        ("p + div", ["after"]),
        ("li, option[selected]", ["A", "B", "2"]),
        ("div:has(> h3):has(> span)", ["1.One"]),
        ("option:containsOwn(2)", ["2"]),
        ("h3, h6, .nothing", ["One", "Label"]),
    ],
)
def test_selectors_of_list_pages(selector, want):
    assert [e.text() for e in elements.parse(LISTING).select(selector)] == want


@pytest.mark.parametrize("selector", ["", "div >", "> > p", "a[href", ":nope", ":has(", "p:nth-child(x)", "a,,b", "div)", ":has()"])
def test_no_selectors(selector):
    with pytest.raises(ValueError):
        selectors.compiled(selector)


def test_long_pages_take_linear_time():
    """Twenty thousand rows, an index look-up each."""
    page = "<table>" + "".join(f"<tr class=r{i % 7}><td>{i}<td><a href=/e/{i}>x</a>" for i in range(20_000)) + "</table>"
    rows = elements.parse(page).select("tr.r3:has(a[href*=/e/]) > td:first-child")
    assert len(rows) == 2857 and rows[0].text() == "3"


def test_plain_pages_are_cut_as_the_parser_reads_them():
    """Random runs of tags and texts, odd ones among them; what is not plain is left to the parser."""

    def tree(e):
        return e.tag, e.attrs, [c if isinstance(c, str) else tree(c) for c in e.children], len(e.kids)

    def parsed(page):
        b = elements._Builder()
        b.feed(page)
        b.close()
        return tree(b.root)

    bits = "<div>|</div>|<p class=a>|</p>|<li>|<ul>|<tr>|<table>|<td>|</table>|<br/>|a|&amp;|&amp|&|<a href=/x/>|<a href=\"u\" HREF='v'>|</a>|<A B>|<|>|<x-y z=1>|</x-y >|<i a = 1>|<!-- c -->|<?p>|<script>|<title>|</p x>|<a href='?a=1&b'>|\n|é|<p\tid=q\n>|<a x=1/y>|<td=1>".split("|")
    rng, plain = random.Random(3), 0
    for _ in range(3_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        found = elements._plain(page)
        plain += found is not None
        assert found is None or tree(found) == parsed(page), page
    assert 500 < plain < 2_500


def test_cards_are_written_where_their_page_is(spark, sf_dir):
    """Only their parts are collected and move."""
    plan = catalog.QUERIES["cards_of_pages"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Support" in plan and "Support" not in re.search(r"collect_list\((.*?), 0, 0\)", plan)[1]


def test_pages_of_all_sources_are_read_once(spark, sf_dir):
    plan = catalog.QUERIES["staged_of_sources"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
