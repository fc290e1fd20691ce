"""Text out of markup against a parser that walks the tree, and marks against plain escaping."""

import html
import random
import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import functions as F

from agoraspark.functions import markup


class Plain(HTMLParser):
    """Text outside the unwanted elements, by depth."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.within, self.depth = [], None, 0

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")
        if self.depth and tag == self.within:
            self.depth += 1
        elif not self.depth and tag in ("quote", "blockquote", "spoiler", "code", "pre"):
            self.within, self.depth = tag, 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.out.append(" ")
        if self.depth and tag == self.within:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return re.sub(r"\s+", " ", "".join(parser.out)).strip()


def got(spark, pages, f):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", f(F.col("p")).alias("t")).collect()
    return [r["t"] for r in sorted(rows)]


def test_nested_subtrees_go_whole(spark):
    rng = random.Random(4)
    names = ["p", "b", "quote", "blockquote", "code", "spoiler", "preface", "pre", "li"]
    pages = ["<blockquote>quoted <code>x</code> still quoted</blockquote> said", "<quote>a<quote>b</quote>c</quote>d", "open <spoiler> never closed", "</quote>stray</p> end", "<!-- <quote> --> kept", "", "no tags", "<preface>kept</preface>", "<QUOTE a='1'>x</Quote>y"]
    for _ in range(150):
        pages.append("".join(rng.choice([f"<{(n := rng.choice(names))}>", f"</{rng.choice(names)}>", f"<{n} class='a'>", f" w{rng.randrange(9)} ", "\n"]) for _ in range(rng.randrange(1, 40))))
    pages.append("<quote>" * 300 + "deep" + "</quote>" * 300 + " out")
    assert got(spark, pages, markup.stripped) == [plain(p) for p in pages]
    assert got(spark, [None], markup.stripped) == [None]


def test_entities_are_decoded_once(spark):
    texts = ["&amp;lt; &lt;b&gt; &quot;&apos;&#39;&#x27;", "&copy;&eacute; &unknown; &", "&#128578; &#x1F642; &#xD800; &#0; &#9999999;", "a&b;c", ""]
    want = ["&lt; <b> \"'''", "©é &unknown; &", "🙂 🙂 &#xD800; &#0; &#9999999;", "a&b;c", ""]
    assert got(spark, texts, markup.decoded) == want


def test_normalised(spark):
    pages = ["<p>ÀÉÎÕÜ ñ Ångström ż Ở</p> see https://x.y/z?a=1 &Eacute;TÉ", "é a b\n c"]
    want = ["".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in ["ÀÉÎÕÜ ñ Ångström ż Ở see ÉTÉ", "é a b c"]]
    assert got(spark, pages, markup.normalised) == want


def test_marks(spark):
    words = ["the", "quot"]

    def want(text):
        return "".join(f"<mark>{r}</mark>" if r.lower() in words else html.escape(r).replace("&#x27;", "&#039;") for r in re.findall(r"[^\W\d_]+|(?:[\W\d_])+", text))

    texts = ['the the cat quot "x"', "The <b>the</b> & 'quot' quotes", "", "the"]
    assert got(spark, texts, lambda t: markup.marked_words(t, words)) == [want(t) for t in texts]
    assert got(spark, texts[:1], lambda t: markup.marked_crop(t, words, 45)["marked"]) == ["<mark>the</mark> <mark>the</mark> cat <mark>quot</mark> &quot;x&quot;"]
    crop = got(spark, ["a b c d e f g the h i j"], lambda t: markup.marked_crop(t, words, 8))[0]
    assert tuple(crop) == ("… c d e f g <mark>the</mark> h i …", 8)
