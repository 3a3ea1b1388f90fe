"""Inputs that the given tables do not hold: the training-data operators lose nothing on them."""

import base64
import gzip
import json
import random
import time
import urllib.parse
import zlib

from millrace.llm import media, quotations, secrets, wrappers


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer_wrappers(pages)).collect()}


def test_hosts_with_two_templates(spark):
    plain = "<body><nav>Menu</nav><div class=content><p>Story {0} one<p>Story {0} two</div><div class=foot><p>All rights</div></body>"
    rows = [(i, "http://a.b/x", plain.format(i)) for i in range(3)] + [(3, "http://a.b/y", "<body><nav>Menu</nav><main><p>In main</p></main></body>")]
    rows += [(10, None, "<main><p>No url</p></main>"), (11, "no url", "<body><div class=content><p>Other template</p></div></body>")]
    want = {i: f"Story {i} one\n\nStory {i} two" for i in range(3)} | {3: "In main", 10: "No url", 11: "Other template"}
    assert texts_of(spark, rows) == want


def test_copies_of_a_page_delete_nothing(spark):
    page = "<body><nav>{0}</nav><h1>Headline</h1><div class=text><p>Only paragraph</p></div></body>"
    rows = [(i, f"http://m{i % 2}.b/{i}", page.format(f"menu {i}")) for i in range(6)] + [(9, "http://one.b/", page.format("m"))]
    assert set(texts_of(spark, rows).values()) == {"Headline\n\nOnly paragraph"}
    twice = "<body><p>Said twice</p><p>Said twice</p></body>"
    assert texts_of(spark, [(1, "http://a.b/", twice)]) == {1: "Said twice\n\nSaid twice"}
    two = ["<body><p>First story</p><div class=end>Fixed</div></body>", "<body><p>Second story</p><div class=end>Fixed</div></body>"]
    assert texts_of(spark, [(i, "http://a.b/", two[i % 2]) for i in range(4)]) == {i: ("First story", "Second story")[i % 2] for i in range(4)}


def found_in(text):
    base, found = secrets.scan(text)
    assert base == []
    return [text[a:b] for a, b, _ in found]


def test_base64_anywhere():
    secret = b"some words before api_key='abcdefgh12345' and some more words behind it, so that lines wrap"
    coded = base64.b64encode(secret).decode()
    for before in ("https://h/p/", "id_", "x-", "ab/", "abc_"):
        (got,) = found_in(f"{before}{coded}")
        assert got in coded and b"abcdefgh1234" in base64.b64decode(coded[coded.index(got) // 4 * 4 :][: -(-len(got) // 4) * 4])
    packed = base64.b64encode(gzip.compress(random.Random(1).randbytes(300).hex(" ").encode() + secret)).decode()
    for end in ("\n", "\r\n", "\n  ", "\\n"):
        for text, width in ((coded, 20), (coded, 76), (packed, 76), (coded, 15)):
            wrapped = end.join(text[i : i + width] for i in range(0, len(text), width))
            assert len(found_in(f"data: {wrapped}")) == 1, (end, width)
            assert len(found_in(f"data{end}{wrapped}{end}More")) == 1, (end, width)
    for odd in ("\xa0", "\u200b", "\ufeff", "\0", "é"):
        assert len(found_in(base64.b64encode(f"{odd}password: abcdefgh12{odd} end{odd}".encode()).decode())) == 1, odd
    assert len(found_in(base64.b64encode(b"\xff\x00\x80 password: abcdefgh12 \xfe").decode())) == 1
    assert "abcdefgh" not in secrets.redacted(f"see https://h/p/{coded}") and secrets.redacted(f"id_{coded}").count(secrets.PLACEHOLDER) == 1


def test_compressed_bytes_in_any_escape(monkeypatch):
    secret = random.Random(2).randbytes(200).hex(" ").encode() + b" password: abcdefgh12 and more"
    for packed in (gzip.compress(secret), zlib.compress(secret), zlib.compress(secret, 1), gzip.compress(zlib.compress(secret))):
        letters = packed.decode("latin-1")
        forms = {
            "quote": urllib.parse.quote(packed), "plus": urllib.parse.quote_plus(packed), "all": "".join(f"%{b:02x}" for b in packed),
            "hex": "".join(f"\\x{b:02x}" for b in packed), "repr": repr(packed), "json": json.dumps(letters),
            "units": "".join(f"\\u{b:04x}" for b in packed), "entities": "".join(f"&#{b};" for b in packed),
            "twice": urllib.parse.quote(urllib.parse.quote(packed)), "base64": base64.b64encode(b"head " + packed).decode(),
        }
        for name, text in forms.items():
            assert found_in(f"before {text} after"), name
            assert secrets.PLACEHOLDER in secrets.redacted(f"before {text} after"), name
    filler = gzip.compress(b"nothing here ")
    assert len(found_in(base64.b64encode(filler + gzip.compress(secret) + filler).decode())) == 1
    monkeypatch.setattr(secrets, "MAX_UNPACKED", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    monkeypatch.setattr(secrets, "PIECE", 1000)
    for at in (0, 4990, 5000, 49_995):
        large = base64.b64encode(gzip.compress(b"." * at + b" password: abcdefgh12 " + b"." * (60_000 - at))).decode()
        assert [len(x) for x in found_in(large)] == [len(large.rstrip("="))], at


def test_bodies_of_any_size():
    large = base64.b64encode(gzip.compress(bytes(secrets.MAX_UNPACKED + 1000) + b" password: abcdefgh12 ")).decode()
    assert len(found_in(large)) == 1


def test_quotes_repeated_in_the_quoting_conversation(spark):
    said = "The meeting was moved to Friday morning."
    rows = [
        (1, 0, "user", f"> {said}\n\n{said}\n\nIs that so?"), (1, 1, "user", said),
        (2, 3, "user", said), (3, 0, "user", f"> {said}\nThanks."),
        (4, 0, "user", "Shall we meet?\nYes, on Friday.\nBring the book."), (4, 1, "user", "Fine."), (4, 2, "user", "> Yes, on Friday.\nGood."),
        (5, 0, "user", "> Yes, on Friday.\nNo."), (6, 0, "user", "> Fine.\nElsewhere."),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_conv, r.parent_turn) for r in quotations.reply_ordered(chats).collect()}
    assert got[1, 0] == (1, 2, 3) and got[3, 0] == (1, 1, 0)
    assert got[4, 2] == (1, 4, 0) and got[5, 0] == (0, None, None) and got[6, 0] == (1, 4, 1)


def items_of(page):
    items = media.parse_sequence(page)
    assert [i["position"] for i in items] == list(range(len(items)))
    return [i["text"] if i["kind"] == "text" else (i["digest"], i["caption"]) for i in items]


def test_captions_anywhere_and_all_media():
    image = "<img src='urn:sha256:{}' alt=x>".format
    assert items_of(f"a<figure><figcaption>Cap <b>one</b></figcaption>{image('A')}</figure>b") == ["a", ("a", "Cap one"), "b"]
    assert items_of(f"<figure>{image('A')}<figcaption>Cap</figcaption>{image('B')}</figure>{image('C')}") == [("a", "Cap"), ("b", "Cap"), ("c", "x")]
    assert items_of("a<figure><figcaption>Cap</figcaption><table><tr><td>1</table></figure>b") == ["a", "Cap", "1", "b"]
    assert items_of("a<figure><p>b</p><figcaption>One</figcaption><figcaption>Two</figcaption></figure>c") == ["a", "b", "One", "Two", "c"]
    assert items_of(f"<figure><figcaption>Out</figcaption><figure>{image('A')}</figure></figure>") == [("a", "Out")]
    assert items_of(f"<figure>{image('A')}<figcaption>Cut") == [("a", "Cut")]
    page = "a<video src='urn:sha256:AA'>old</video><audio><source src='urn:sha256:BB'><source src=c.mp3></audio><picture><source srcset=y>" + image("D")
    assert items_of(page) == ["a", ("aa", None), "old", ("bb", None), (None, None), ("d", "x")]


def encoded(rng, text, depth):
    """``text`` under ``depth`` random encodings, each of which the scan unwraps."""
    for _ in range(depth):
        kind = rng.randrange(4)
        if kind == 0:
            text = "".join(f"%{b:02X}" for b in text.encode())
        elif kind == 1:
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif kind == 2:
            text = base64.b64encode(text.encode()).decode()
        else:
            text = base64.b64encode((gzip if rng.random() < 0.5 else zlib).compress(text.encode())).decode()
    return text


def test_random_chains_over_given_documents(spark, sf_dir):
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    for i, text in enumerate(t for t in texts if t):
        words = text[:3000]
        secret = f" password: Zq{i:04d}abcdefg "
        coded = encoded(rng, secret + words[:40], rng.randrange(1, 6))
        whole = f"{words}\n{coded}\n{words}"
        base, found = secrets.scan(whole)
        inside = [(a, b) for a, b, k in found if k == 0 and a >= len(words) and b <= len(words) + 2 + len(coded) + 1]
        assert inside, (i, coded[:80])
        assert set(base) <= set(found)
        assert secrets.scan(secrets.redacted(whole))[1] == [] or not any(k == 0 for _, _, k in secrets.scan(secrets.redacted(whole))[1])


def test_deep_escapes_are_linear():
    for text in ("%" + "25" * 300_000 + "70assword=abcdefgh1", "&" + "#38;" * 100_000 + "#112;assword=abcdefgh1", "%5C" + "x255C" * 100_000 + "x70assword=abcdefgh1"):
        start = time.perf_counter()
        _, found = secrets.scan(text)
        assert time.perf_counter() - start < 20 and any(k == 0 and b == len(text) for _, b, k in found)


PROBES = {
    '<body class="no-sidebar single"><article><p>Text</p></article></body>': "Text",
    '<body><div class="content-with-sidebar"><main><p>Text</p></main></div></body>': "Text",
    '<body><article class="reader-view"><p>Text</p></article></body>': "Text",
    '<body><section id="related-work"><h2>Related</h2><p>Text of it</p></section></body>': "Related\n\nText of it",
    '<body><div class="post-header"><h1>Title</h1></div><div class=post><p>Text</p></div></body>': "Title\n\nText",
    "<p data-x=it's>One.</p><p>Two isn't.</p>": "One.\n\nTwo isn't.",
    '<form id=main><div class=menu><p>Menu</p></div><div class=c><p>All of the text</p></div></form>': "All of the text",
    "<body>" + "<div>" * 10_000 + "deep" + "</div>" * 10_000 + "<p>after</p>": "deep\n\nafter",
}


def test_probe_pages(spark):
    rows = [(i, f"http://h{i}.x/", page) for i, page in enumerate(PROBES)]
    assert list(dict(sorted(texts_of(spark, rows).items())).values()) == list(PROBES.values())


def test_hosts_without_article_elements(spark):
    rng, rows, want = random.Random(5), [], {}
    frames = [
        "<body><div id=top><a href=/>Home</a><a href=/a>About</a></div><div class=c><h1>{0}</h1>{1}</div><div class=legal><p>All rights reserved.</p></div></body>",
        "<table><tr><td class=nav><a href=/1>One</a></td><td><h2>{0}</h2>{1}</td></tr><tr><td>Fixed line</td></tr></table>",
        "<body><header><p>Site</p></header><section><h1>{0}</h1><div>{1}</div></section><div class='site-footer'><p>{0} foot</p></div></body>",
    ]
    for i in range(24):
        title, paragraphs = f"Title {i}", [f"Text {i} {j} {rng.random()}" for j in range(1 + i % 4)]
        rows.append((i, f"https://host{i % 3}.example/{i}", frames[i % 3].format(title, "".join(f"<p>{p}</p>" for p in paragraphs))))
        want[i] = "\n\n".join([title, *paragraphs])
    assert texts_of(spark, rows) == want


def test_a_text_depends_on_the_other_pages_of_its_host(spark):
    page = "<body><article><h1>Story {0}</h1><p class=lead>Words {0}</p><div class=note><span>Read our terms.</span></div></article></body>"
    alone = texts_of(spark, [(0, "http://a.b/0", page.format(0))])
    among = texts_of(spark, [(i, f"http://a.b/{i}", page.format(i)) for i in range(6)])
    assert alone[0] == "Story 0\n\nWords 0\n\nRead our terms." and among[0] == "Story 0\n\nWords 0"


def test_pages_with_many_distinct_siblings(spark):
    page = "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{{0}}>text {i}</div>" for i in range(5000))
    rows = [(i, "http://a.b/", page.format("xy"[i])) for i in range(2)]
    assert [len(t.split("\n\n")) for t in texts_of(spark, rows).values()] == [5000, 5000]
