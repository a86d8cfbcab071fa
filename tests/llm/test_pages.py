"""Main bodies, keyword stuffing and template residue."""

import random

import numpy as np

from pagewright.llm import mainbody, markup, residue, stuffing

rng = random.Random(12)
NOUNS = [a + b for a in "lantern harbour meadow orchard tunnel kernel lattice sonnet".split() for b in ("", "s", "ing", "er")]


def sentence(r=rng):
    return f"The {r.choice(NOUNS)} of every {r.choice(NOUNS)} records that {r.choice(NOUNS)} {r.randrange(9999)} with the {r.choice(NOUNS)}, although it is {r.choice(NOUNS)} at the end."


def prose(n=12):
    return "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(n))


def page(body, title="A page"):
    return f"<html><head><title>{title}</title><script>var x='<p>no</p>'</script></head><body><div class='top'><a href='/'>Home</a> <a href='/a'>About</a> <a href='/b'>Books</a></div>{body}<div id=foot>© Site. All rights reserved.</div></body></html>"


def test_blocks_have_paths_and_links():
    got = markup.blocks(page("<main><p>One <a href=x>two</a> three<p>four</main><pre>  a\n b</pre><!-- c --><br>tail &lt;b&gt;"))
    assert [b.text for b in got] == ["A page", "Home About Books", "One two three", "four", "a b", "tail <b>", "© Site. All rights reserved."]
    assert got[1].path == "html/body/div.top" and got[1].links == 3 and got[2].path.endswith("main/p") and got[2].linked == 3 and got[3].path.endswith("main/p")
    assert markup.blocks(None) == [] == markup.blocks(" \n") and markup.visible_text(None) == ""


def pages(spark, rows):
    return spark.createDataFrame([(k, "key", c) for k, c in rows], "docid long, key string, content string")


STUFFED = "<p>" + " - ".join(f"{m} {n} lamps" for _ in range(20) for m in ("cheap", "buy", "new") for n in ("zorva", "milek")) + "</p>"
LINKS = "".join(f"<a href='/t{k}'>tag{k}x lamps</a>, " for k in range(90))
NAMES = [a + b + c for a in "vel tor mir".split() for b in "ado eni ura obi".split() for c in "kan lis mer pon sta".split()]
TIMETABLE = "".join(f"<li>{'Mon Tue Wed Thu'.split()[k % 4]} {8 + k % 9}:15 {NAMES[2 * k]} lecture and {NAMES[2 * k + 1]} {NOUNS[k]} room {k * 37}</li>" for k in range(30))


def test_stuffed_pages(spark):
    rows = [(1, page(STUFFED)), (2, page(LINKS)), (3, page(prose())), (4, page(TIMETABLE)), (5, None), (6, ""), (7, "<p>lamps lamps lamps</p>"), (1, page(STUFFED)), (None, page(STUFFED)), (8, page("<p>" + "lamps " * 50_000 + "</p>")), (9, page("<p>Lorem ipsum dolor magna ornare velit posuere nullum. </p>" * 20))]
    got = {r.docid: r for r in stuffing.page_recurrence(pages(spark, rows)).collect()}
    assert {k for k, r in got.items() if r.stuffed} == {1, 2, 8} and len(got) == 9 and got[5].terms == 0
    assert stuffing.page_recurrence(pages(spark, [])).count() == 0


def test_link_profile(spark):
    rows = [(1, "http://a.test/x"), (1, "http://a.test/x"), (1, "http://a.test/y#z"), (1, "https://b.test"), (2, None), (None, "http://a.test/")]
    got = [tuple(r) for r in stuffing.link_profile(spark.createDataFrame(rows, "src long, dst_url string")).collect()]
    assert got == [(1, 3, 2, 2 / 3)]


def test_links_decide(spark):
    """A few names, all of them links to as many targets, are a link list; without the links they prove nothing."""
    body = "<body><p>" + " ".join(f"<a href=/{w}>{w}</a>" for w in NAMES[:12]) + "</p></body>"
    links = [(1, f"http://h.test/{w}") for w in NAMES[:12]] + [(2, "http://h.test/x"), (9, "http://h.test/y")]
    found = stuffing.stuffed_pages(pages(spark, [(1, body), (2, body), (3, page(prose()))]), spark.createDataFrame(links, "src long, dst_url string"))
    assert {r.docid: r.stuffed for r in found.collect()} == {1: True, 2: False, 3: False}


def test_fifty_keywords_are_enough(spark):
    words = [f"{m} {n} lamps" for k in range(9) for m in ("cheap", "buy") for n in ("zorva",)]
    got = stuffing.recurrence(markup.blocks("<p>" + " ".join(words)[:280] + "</p>"))
    assert got.terms < 60 and got.stuffed


def test_residue(spark):
    cases = {
        1: page(prose(3) + "<p>Dear {{first_name}}, the ${room} is open.</p>"),
        2: page("<p>Lorem ipsum dolor sit amet magna ornare velit posuere nullum pretium integra tempus sodales.</p>"),
        3: page("<h1>Error 404: /x/y was not found on this server</h1>"),
        4: page("<noscript>Please enable JavaScript to continue</noscript>"),
        5: page("<p>Sample text goes here (12). The intro still missing (4).</p>"),
        6: page("<h2>Votre session a expiré</h2>"),
    }
    clean = {
        11: page(prose() + "<pre>Hello {{name}} and ${x}</pre>"),
        12: page(prose() + "<p>Why do some sites ask visitors to enable JavaScript? " + sentence() + sentence() + "</p>"),
        13: page(prose() + "<noscript>Please enable JavaScript to continue</noscript>"),
        14: page(prose() + "<p>The printers write TODO on every unfinished sheet, a habit that others took over. The placeholder text of old typesetters was nonsense, mostly lorem and ipsum, it is said.</p>"),
        15: None,
        16: " ",
        17: page("<p>" + sentence() * 5000 + "</p>"),
    }
    rows = [*cases.items(), *clean.items(), (1, cases[1]), (None, cases[1])]
    got = {r.docid: r.residue for r in residue.page_residue(pages(spark, rows)).collect()}
    assert {k for k, v in got.items() if v} == set(cases) and set(got) == set(cases) | set(clean)
    assert sorted(r.docid for r in residue.without_residue(pages(spark, rows)).collect() if r.docid) == sorted(clean)
    assert residue.page_residue(pages(spark, [])).count() == 0


def site_page(k):
    main = "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(4))
    return (
        f"<html><head><title>Title {k}</title></head><body><div class=cookie>We use cookies to keep this site running.</div>"
        f"<div class=nav><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div class=nav><a href=/>Home</a> &gt; News &gt; Title {k}</div>"
        f"<div class=post><h1>Title {k}</h1>{main}<li><a href=/q>Some other {k}</a> – {sentence()}</li></div>"
        f"<div class=side>Popular this week</div><div class=side><a href=/z{k}>Another thing {k * 7}</a>. {sentence()}</div><div class=foot>Tags: ant, bee, cow, dog {k}</div></body></html>"
    )


def test_main_body(spark):
    html = {k: site_page(k) for k in range(12)}
    blocks, want = [], set()
    for k, content in html.items():
        for n, b in enumerate(x for x in markup.blocks(content) if x.tag != "title"):
            blocks.append((k, n, b.tag if n % 5 else None, b.links, b.text, "extra"))
            if "post" in b.path:
                want.add((k, n))
    blocks += [*blocks[:7], (3, 90, "p", 0, None, "x"), (3, 91, "p", 0, "  ", "x"), (None, 1, "p", 0, "a", "x"), (500, 0, "p", 0, sentence() + sentence(), "x")]
    table = spark.createDataFrame(blocks, "docid long, block_no int, tag string, n_links int, content string, path string")
    source = spark.createDataFrame([(k, f"http://host{k % 2}.test/p{k}", c) for k, c in html.items()] + [(0, "http://host0.test/p0", html[0])], "docid long, url string, content string")
    got = {tuple(r) for r in mainbody.main_body(table, source).collect()}
    assert got == want | {(500, 0)}
    assert mainbody.main_body(table.limit(0), source.limit(0)).count() == 0


def test_bodies_from_html_alone(spark):
    html = {k: site_page(k) for k in range(12)}
    source = spark.createDataFrame([(k, f"http://host{k % 2}.test/p{k}", c) for k, c in html.items()] + [(0, "http://host0.test/p0", html[0]), (50, "http://host0.test/x", None)], "docid long, url string, content string")
    got = {r.docid: r.body.split("\n") for r in mainbody.bodies(source).collect()}
    assert got == {k: [b.text for b in markup.blocks(c) if "post" in b.path] for k, c in html.items()}


def test_main_body_keeps_short_texts_alike_but_for_numbers(spark):
    """Rooms on pages of many sites are main body; a line with a number that stands on a site's pages is not."""
    html = {}
    for site in range(12):
        for k in range(6):
            room = f"<p>Sala {site * 31 + k}, Fri {8 + site % 9}:15</p>" if k == site % 6 else ""
            seen = f"<p>Visits: {site * 977 + k * 13}</p>" if site < 8 and k < 4 else ""
            html[site * 10 + k] = (site, f"<html><head><title>Title {site} {NAMES[k]} {sentence()}</title></head><body><main><p>{sentence()} {sentence()}</p>{room}<p>{sentence()} {sentence()}</p>{seen}</main></body></html>")
    blocks = [(d, n, b.tag, b.links, b.text) for d, (_, c) in html.items() for n, b in enumerate(x for x in markup.blocks(c) if x.tag != "title")]
    table = spark.createDataFrame(blocks, "docid long, block_no int, tag string, n_links int, content string")
    source = spark.createDataFrame([(d, f"http://host{s}.test/p{d}", c) for d, (s, c) in html.items()], "docid long, url string, content string")
    got = {tuple(r) for r in mainbody.main_body(table, source).collect()}
    assert got == {(d, n) for d, n, _, _, text in blocks if not text.startswith("Visits")}


def test_stuffed_pages_at_any_distance(spark):
    r = random.Random(5)
    cycle = NAMES[:45]
    frame = "".join(f"<div class=box>{sentence(r)}</div>" for _ in range(3))
    shuffled = " ".join(w for _ in range(8) for k in range(0, 45, 9) for w in r.sample(cycle[k : k + 9], 9))
    cases = {
        1: page(frame + "<p>" + " ".join(cycle * 5) + "</p>"),
        2: page(frame + "<p>" + shuffled + "</p>"),
        3: page(frame + "".join(f"<li><a href=/{w}>{w} {w}en</a></li>" for w in NAMES)),
        4: "<p>" + " ".join(f"cheap {w} lamps" for w in NAMES[:14]) + "</p>",
    }
    body = prose(6)
    clean = {11: page(body + body), 12: page(prose(8)), 13: page(frame + TIMETABLE), 14: "<p>lamps lamps lamps</p>", 15: page("<p>" + " ".join(NAMES[:12]) + "</p>")}
    got = {r.docid: r for r in stuffing.page_recurrence(pages(spark, [*cases.items(), *clean.items()])).collect()}
    assert {k for k, v in got.items() if v.stuffed} == set(cases)
    assert got[1].recurring < 0.3 and got[1].autocorrelation > 0.4 and got[2].regular > 0.3


def test_matches_at_all_lags():
    r = random.Random(6)
    n = 400
    ids = np.array([r.choice([0, 0, 0, 0, r.randrange(1, 40)]) for _ in range(n)])
    want = [0] + [int((ids[k:] == ids[:-k]).sum()) for k in range(1, n)]
    assert stuffing._matches(ids, np.arange(n), n).tolist() == want


LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
)


def test_standard_filler(spark):
    cases = {k: page(prose(3) + f"<p>{text}</p>") for k, text in enumerate((*LOREM, " ".join(LOREM)))}
    cases |= {
        11: page(prose(3) + "<ul>" + "<li>Lorem ipsum</li>" * 8 + "</ul>"),
        12: page("<p>Lorem <b>ipsum</b> dolor <b>sit</b> amet <i>consetetur</i> sadipscing <b>elitr</b> nonumy <b>eirmod</b> tempor <i>invidunt</i> labore</p>"),
        13: page("<p>Suspendisse potenti. Maecenas sagittis ligula nec risus tristique, in pharetra urna mattis. Vivamus eget felis.</p>"),
    }
    about = page(prose() + f"<p>Printers have used the words lorem and ipsum for centuries. {sentence()}</p>" + "<li>Lorem ipsum</li>" * 8)
    clean = {21: about, 22: page(prose(2) + "".join(f"<li>Test {k}</li>" for k in range(20))), 23: page(prose(2) + "<li>Lorem ipsum</li>")}
    got = {r.docid: r.residue for r in residue.page_residue(pages(spark, [*cases.items(), *clean.items()])).collect()}
    assert {k for k, v in got.items() if v} == set(cases)
