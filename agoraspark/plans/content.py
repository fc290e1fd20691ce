"""What texts say about themselves: sections, claims, freshness, structure, language, scripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.functions import guide, markup
from agoraspark.functions import text as T
from agoraspark.plans.base import AS_OF, EVENTS, Theme, events, table

theme = Theme()

# Our own vocabulary: for each section terms by weight, tags with points, tags to fall back on, and what makes a guide.
SECTIONS = {"craft": {3: ["stone", "river bed"], 1: ["the"]}, "talk": {3: ["idiot", "moron"], 2: ["clown"]}, "abroad": {2: ["der", "les", "los"], 1: ["que"]}}
TAG_POINTS = {"src1": ("craft", 2), "src2": ("talk", 5)}
FALLBACK_TAGS, FALLBACK = ["src3", "src4"], "general"
GUIDE_TAGS, GUIDE_TERMS = {"src5": 4, "src6": 2}, ["the", "que"]
THRESHOLD = 4
TITLE = "substr(text, 1, 60)"


def _matches(term: str, column: str) -> str:
    return f"regexp_matches({column}, '(^|[^a-z0-9]){term.replace(' ', '[\\s-]')}($|[^a-z0-9])')"


def _score_sql(section: str) -> str:
    parts = [
        f"CASE WHEN {_matches(t, 'title')} THEN {2 * w} WHEN {_matches(t, 'body')} THEN {w} ELSE 0 END" for w,
        terms in SECTIONS[section].items() for t in terms
    ]
    return " + ".join(parts + [f"CASE WHEN source = '{tag}' THEN {n} ELSE 0 END" for tag, (s, n) in TAG_POINTS.items() if s == section])


@theme.add(f"""
WITH d AS (SELECT doc_id, source, lower({TITLE}) AS title, lower(text) AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
s AS (SELECT doc_id, unnest([{', '.join(f"{{'section': '{s}', 'place': {i}, 'score': {_score_sql(s)}}}" for i, s in enumerate(SECTIONS))}]) AS x, source, title FROM d),
b AS (SELECT doc_id, source, title, x.section AS section, x.score AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, source, title ORDER BY x.score DESC, x.place) = 1),
o AS (SELECT doc_id, CASE WHEN score >= {THRESHOLD} THEN section WHEN source IN ('src3', 'src4') THEN '{FALLBACK}' END AS section, CASE WHEN score >= {THRESHOLD} THEN score ELSE 2 END AS score FROM b
  UNION ALL SELECT doc_id, 'guide', g FROM (SELECT doc_id, CASE source WHEN 'src5' THEN 4 WHEN 'src6' THEN 2 ELSE 0 END + {' + '.join(f"CASE WHEN {_matches(t, 'title')} THEN 3 ELSE 0 END" for t in GUIDE_TERMS)} AS g FROM d) WHERE g >= {THRESHOLD})
SELECT doc_id, section, CAST(score AS BIGINT) AS score FROM o WHERE section IS NOT NULL""")
def txt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each document: terms in the title count double, in the body only if the title lacks them, tags add points.

    The best section counts if it reaches a threshold, else one that the tags fall back on; guides are told apart from it.
    """
    rows = table(spark, sf_dir, "documents").filter("text is not null and source is not null").select(
        "doc_id", "source", F.lower(F.substring("text", 1, 60)).alias("title"), F.lower("text").alias("body")
    )
    hit = lambda t, c: F.col(c).rlike(T.whole_word(t))
    scores = []
    for place, (section, tiers) in enumerate(SECTIONS.items()):
        score = F.lit(0)
        for weight, terms in tiers.items():
            for t in terms:
                score = score + F.when(hit(t, "title"), 2 * weight).when(hit(t, "body"), weight).otherwise(0)
        for tag, (of, points) in TAG_POINTS.items():
            if of == section:
                score = score + F.when(F.col("source") == tag, points).otherwise(0)
        scores.append(F.struct(score.alias("score"), F.lit(-place).alias("before"), F.lit(section).alias("section")))
    guide = sum((F.when(F.col("source") == tag, n).otherwise(0) for tag, n in GUIDE_TAGS.items()), F.lit(0))
    guide = sum((F.when(hit(t, "title"), 3).otherwise(0) for t in GUIDE_TERMS), guide)
    rated = rows.select("doc_id", "source", F.greatest(*scores).alias("best"), guide.alias("guide"))
    enough = F.col("best.score") >= THRESHOLD
    topical = F.when(enough, F.struct(F.col("best.section").alias("section"), F.col("best.score").cast("long").alias("score"))).when(
        F.col("source").isin(FALLBACK_TAGS), F.struct(F.lit(FALLBACK).alias("section"), F.lit(2).cast("long").alias("score"))
    )
    additive = F.when(F.col("guide") >= THRESHOLD, F.struct(F.lit("guide").alias("section"), F.col("guide").cast("long").alias("score")))
    return rated.select("doc_id", F.explode(F.array_compact(F.array(topical, additive))).alias("x")).select("doc_id", "x.section", "x.score")


@theme.add(f"SELECT doc_id, {_matches('of the', 'low')} AS spaced, {_matches('src 1', 'tag')} AS tagged FROM (SELECT doc_id, lower(text) AS low, replace(source, 'src', 'src-') AS tag FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)")
def txt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tokens of two parts, which a blank or a hyphen may join."""
    rows = table(spark, sf_dir, "documents").filter("text is not null and source is not null")
    return rows.select(
        "doc_id", F.lower("text").rlike(T.whole_word("of the")).alias("spaced"),
        F.replace("source", F.lit("src"), F.lit("src-")).rlike(T.whole_word("src 1")).alias("tagged")
    )


@theme.add(r"""
WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) AS links, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS heads, regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS spec,
  list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM pages WHERE html IS NOT NULL)
SELECT page_id, CAST(len(links) AS BIGINT) AS claims, CAST(len(list_filter(links, lambda x: starts_with(x, 'http'))) AS BIGINT) AS sourced, CAST(len(heads) AS BIGINT) AS sections, md5(array_to_string(list_transform(heads, lambda x: trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g'))), chr(10))) AS toc_md5,
  CAST(len(spec) AS BIGINT) AS spec_rows, CAST(len(w) AS BIGINT) AS words, CAST(greatest(1, ceil(len(w) / 220.0)) AS BIGINT) AS minutes, len(spec) > 0 OR len(links) > 0 AS is_guide FROM p""")
def txt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page offers as a guide: claims and how many name a source, its table of contents, specification rows, words, minutes."""
    rows = table(spark, sf_dir, "pages").filter("html is not null")
    every = lambda p, g: F.regexp_extract_all("html", F.lit(p), g)
    rows = rows.select(
        "page_id", every(r'(?i)<a [^>]*href="([^"]*)"', 1).alias("links"),
        every(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>", 2).alias("heads"),
        F.size(every(r"(?is)<tr[^>]*>(.*?)</tr>", 1)).cast("long").alias("spec_rows"),
        F.size(F.filter(F.split(T.stripped_html(F.col("html")), " "), lambda x: x != "")).alias("n")
    )
    return rows.select(
        "page_id",
        F.size("links").cast("long").alias("claims"),
        F.size(F.filter("links", lambda x: x.startswith("http"))).cast("long").alias("sourced"),
        F.size("heads").cast("long").alias("sections"),
        F.md5(F.array_join(F.transform("heads", lambda x: F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", ""))), "\n").cast("binary")).alias("toc_md5"),
        "spec_rows",
        F.col("n").cast("long").alias("words"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / 220.0)).alias("minutes"),
        ((F.col("spec_rows") > 0) | (F.size("links") > 0)).alias("is_guide"),
    )


# Pages as guides: list entries are claims, the menu and the footer are headings, the advertisement is a risk.
GUIDE = """(SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '<li>', '<claim tier="' || (page_id % 8) || CASE WHEN page_id % 3 = 0 THEN '" src="https://s.example/' || page_id ELSE '' END || '">'), '</li>', '</claim>'),
  '<nav>', '<h2>More &amp; more</h2>'), '<footer>', '<h3>More, more</h3>'), '<h1>', '<h1>More more</h1><h1>'), '<div class="ad">', '<risk level="' || (CASE page_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'Medical' WHEN 2 THEN 'unheard' WHEN 3 THEN '' ELSE 'none' END) || '"/>'),
  '<article>', CASE WHEN page_id % 2 = 0 THEN '<spec cost="9" risk="' || (CASE page_id % 4 WHEN 0 THEN 'high' ELSE 'low' END) || '" time="" pro="yes"/>' ELSE '' END), '<title>', CASE WHEN page_id % 5 = 0 THEN '<tldr>' ELSE '<title>' END) AS html FROM pages WHERE html IS NOT NULL)"""


@theme.add(f"""
WITH g AS (SELECT page_id, html, html LIKE '%<tldr%' AS summary FROM {GUIDE}),
c AS (SELECT page_id, list_transform(string_split(html, '<claim ')[2:], lambda x: split_part(x, '</claim>', 1)) AS raw, html, summary FROM g),
t AS (SELECT page_id, html, summary, list_filter(list_transform(raw, lambda x: {{'tier': CASE WHEN page_id % 8 <= 5 THEN page_id % 8 ELSE 0 END, 'sourced': contains(split_part(x, '>', 1), 'src='), 'text': trim(regexp_replace(replace(replace(regexp_replace(substr(x, strpos(x, '>') + 1), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))}}), lambda x: x.text <> '') AS claims,
  regexp_extract_all(html, '<risk level="([^"]*)"', 1) AS risks FROM c),
h AS (SELECT page_id, html, summary, claims, list_transform(list_concat(list_transform(risks, lambda r: CASE WHEN r = '' THEN 'moderate' ELSE lower(r) END), CASE WHEN contains(html, '<spec ') THEN [CASE page_id % 4 WHEN 0 THEN 'high' ELSE 'low' END] ELSE [] END), lambda r: coalesce(list_position(['none', 'low', 'moderate', 'high', 'medical'], r), 0)) AS places,
  trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain,
  list_transform(regexp_extract_all(html, '(?s)<h[1-4]>(.*?)</h[1-4]>', 1), lambda x: trim(substr(trim(regexp_replace(lower(replace(replace(x, '&quot;', '"'), '&amp;', '&')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), 1, 60))) AS bases FROM t),
n AS (SELECT *, list_transform(bases, lambda b, i: b || CASE WHEN len(list_filter(bases[:i - 1], lambda o: o = b)) > 0 THEN '-' || len(list_filter(bases[:i], lambda o: o = b)) ELSE '' END) AS anchors, len(string_split(plain, ' ')) AS words FROM h)
SELECT page_id, CAST(len(claims) AS BIGINT) AS claims, CAST(len(list_filter(claims, lambda x: x.sourced)) AS BIGINT) AS sourced, CAST(coalesce(list_sum(list_transform(claims, lambda x: x.tier)), 0) AS BIGINT) AS tiers,
       md5(array_to_string(list_transform(claims, lambda x: x.text), chr(10))) AS claims_md5, md5(array_to_string(anchors, ' ')) AS anchors_md5,
       ['none', 'low', 'moderate', 'high', 'medical'][nullif(coalesce(list_max(places), 0), 0)] AS risk, CASE WHEN contains(html, '<spec ') THEN 'cost,risk,pro' ELSE '' END AS spec,
       CAST(words AS BIGINT) AS words, CAST(greatest(1, ceil(words / 220.0)) AS BIGINT) AS minutes, summary, summary OR len(claims) > 0 OR contains(html, '<spec ') AS is_guide FROM n""")
def txt_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages offer as guides: claims with tiers and sources, contents, specification, worst risk, words and minutes."""
    page = F.col("page_id")
    level = F.when(page % 6 == 0, "low").when(page % 6 == 1, "Medical").when(page % 6 == 2, "unheard").when(page % 6 == 3, "").otherwise("none")
    source = F.when(page % 3 == 0, F.concat(F.lit('" src="https://s.example/'), page.cast("string"))).otherwise("")
    spec = F.concat(F.lit('<spec cost="9" risk="'), F.when(page % 4 == 0, "high").otherwise("low"), F.lit('" time="" pro="yes"/>'))
    html = F.col("html")
    for old, new in (
        ("<li>", F.concat(F.lit('<claim tier="'), (page % 8).cast("string"), source, F.lit('">'))),
        ("</li>", F.lit("</claim>")),
        ("<nav>", F.lit("<h2>More &amp; more</h2>")),
        ("<footer>", F.lit("<h3>More, more</h3>")),
        ("<h1>", F.lit("<h1>More more</h1><h1>")),
        ('<div class="ad">', F.concat(F.lit('<risk level="'), level, F.lit('"/>'))),
        ("<article>", F.when(page % 2 == 0, spec).otherwise("")),
        ("<title>", F.when(page % 5 == 0, "<tldr>").otherwise("<title>")),
    ):
        html = F.replace(html, F.lit(old), new)
    rows = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", guide.evidence(html).alias("e"))
    count = lambda x: F.size(x).cast("long")
    return rows.select(
        "page_id",
        count("e.claims").alias("claims"),
        count(F.filter("e.claims", lambda x: x["source"].isNotNull())).alias("sourced"),
        F.aggregate("e.claims", F.lit(0).cast("long"), lambda s, x: s + x["tier"]).alias("tiers"),
        F.md5(F.array_join(F.transform("e.claims", lambda x: x["text"]), "\n").cast("binary")).alias("claims_md5"),
        F.md5(F.array_join(F.transform("e.contents", lambda x: x["anchor"]), " ").cast("binary")).alias("anchors_md5"),
        "e.risk",
        F.array_join("e.spec", ",").alias("spec"),
        F.col("e.words").cast("long").alias("words"),
        F.col("e.minutes").cast("long").alias("minutes"),
        "e.summary",
        (F.col("e.summary") | (F.size("e.claims") > 0) | (F.size("e.spec") > 0)).alias("is_guide"),
    )


REVIEWED = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'medical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' WHEN 3 THEN 'none' WHEN 4 THEN 'low' END AS risk, CASE WHEN doc_id % 7 <> 3 THEN CAST(doc_id % 1500 AS INTEGER) END AS days_ago FROM labels)"


def review_days(risk: Column) -> Column:
    """Days between reviews by the level of risk. Fixed values."""
    return F.when(risk.isin("medical", "high"), 180).when(risk == "moderate", 365).when(risk == "none", 730).otherwise(545)


@theme.add(f"""
SELECT doc_id, risk, days, CASE WHEN days_ago IS NULL THEN 'unknown' WHEN days_ago < days THEN 'fresh' WHEN days_ago - days > days / 2.0 THEN 'stale' ELSE 'due' END AS freshness
FROM (SELECT *, CASE WHEN risk IN ('medical', 'high') THEN 180 WHEN risk = 'moderate' THEN 365 WHEN risk = 'none' THEN 730 ELSE 545 END AS days FROM {REVIEWED})""")
def txt_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's review is due: its interval by risk, stale when half of another has passed, unknown without a review."""
    i = F.col("doc_id")
    risk = F.when(i % 6 == 0, "medical").when(i % 6 == 1, "high").when(i % 6 == 2, "moderate").when(i % 6 == 3, "none").when(i % 6 == 4, "low")
    rows = table(spark, sf_dir, "labels").select("doc_id", risk.alias("risk"), F.when(i % 7 != 3, (i % 1500).cast("int")).alias("ago"))
    rows = rows.withColumn("days", review_days(F.col("risk")))
    late = F.col("ago") - F.col("days")
    word = F.when(F.col("ago").isNull(), "unknown").when(late < 0, "fresh").when(late > F.col("days") / 2, "stale").otherwise("due")
    return rows.select("doc_id", "risk", "days", word.alias("freshness"))


PAIRED = "(SELECT p.page_id, p.html AS before, n.html AS after FROM pages p JOIN pages n ON n.page_id = p.page_id + 1 WHERE p.html IS NOT NULL AND n.html IS NOT NULL)"


@theme.add(rf"""
WITH x AS (SELECT page_id, list_distinct(regexp_extract_all(before, 'href="([^"]*)"', 1)) AS a, list_distinct(regexp_extract_all(after, 'href="([^"]*)"', 1)) AS b, len(regexp_extract_all(before, '<p[ >]')) AS p1, len(regexp_extract_all(after, '<p[ >]')) AS p2, len(regexp_extract_all(before, '<a[ >]')) AS a1, len(regexp_extract_all(after, '<a[ >]')) AS a2, len(regexp_extract_all(before, '<h[1-6][ >]')) AS h1, len(regexp_extract_all(after, '<h[1-6][ >]')) AS h2 FROM {PAIRED})
SELECT page_id, CAST(p2 - p1 AS BIGINT) AS paragraphs, CAST(a2 - a1 AS BIGINT) AS anchors, CAST(h2 - h1 AS BIGINT) AS headings, CAST(len(list_filter(a, lambda u: NOT list_contains(b, u))) AS BIGINT) AS missing, CAST(len(list_filter(b, lambda u: NOT list_contains(a, u))) AS BIGINT) AS added FROM x""")
def txt_structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a page's structure differs from that of the page before: counts of tags, links that are missing or new."""
    pages = table(spark, sf_dir, "pages").filter("html is not null")
    counts = {"paragraphs": "<p[ >]", "anchors": "<a[ >]", "headings": "<h[1-6][ >]"}
    # what is compared is taken from each page once, before the join
    slim = pages.select(
        "page_id", *(F.regexp_count("html", F.lit(p)).cast("long").alias(n) for n, p in counts.items()),
        F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("links")
    )
    a, b = slim.alias("a"), slim.withColumn("page_id", F.col("page_id") - 1).alias("b")
    both = a.join(b, "page_id")
    gone, fresh = F.array_except("a.links", "b.links"), F.array_except("b.links", "a.links")
    return both.select(
        "page_id", *((F.col(f"b.{n}") - F.col(f"a.{n}")).alias(n) for n in counts), F.size(gone).cast("long").alias("missing"),
        F.size(fresh).cast("long").alias("added")
    )


@theme.add()
def txt_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing tags that close nothing and opening ones that stay open, by one pass with a stack.

    A closing tag takes all that was opened after its partner off the stack. The stack is a list in an aggregate, so a page
    is passed once, within its row.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(/?(?:p|div|ul|li|table|tr|td|h1|h2|a))[ >]"), 1)
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).cast("long").alias("orphans"))

    def step(state: Column, tag: Column) -> Column:
        name, stack = F.ltrim(F.lower(tag), F.lit("/")), state["stack"]
        place = F.array_position(stack, name)  # the latest opened comes first
        opened = F.struct(F.concat(F.array(name), stack).alias("stack"), state["orphans"].alias("orphans"))
        orphan = F.struct(stack.alias("stack"), (state["orphans"] + 1).alias("orphans"))
        closed = F.struct(F.slice(stack, (place + 1).cast("int"), F.size(stack)).alias("stack"), state["orphans"].alias("orphans"))
        return F.when(~tag.startswith("/"), opened).when(place == 0, orphan).otherwise(closed)

    rows = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.aggregate(tags, start, step).alias("s"))
    return rows.select("page_id", "s.orphans", F.size("s.stack").cast("long").alias("unclosed"))


@theme.add(r"""
WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS t
              FROM pages WHERE html IS NOT NULL),
     plain AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t FROM bare),
     low AS (SELECT page_id, trim(regexp_replace(strip_accents(lower(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '(?i)\bhttps?://\S+', ' ', 'g'))), '\s+', ' ', 'g')) AS t FROM plain)
SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM low""")
def txt_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a page for matching: no quotes, code, spoilers or addresses, entities decoded, lower case, no accents."""
    rows = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", markup.normalised(F.col("html")).alias("t"))
    return rows.select("page_id", F.char_length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@theme.add("SELECT doc_id, md5(translate(replace(lower(text || ' Ёлка Straße'), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿё', 'aaaaaaceeeeiiiinoooooouuuuyyе')) AS folded_md5, sha1(lower(text)) AS sha1, sha256(lower(text)) AS sha256 FROM documents WHERE text IS NOT NULL")
def txt_fold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded texts with the Cyrillic yo as ye, and digests."""
    low = F.lower("text").cast("binary")
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select(
        "doc_id", F.md5(T.folded(F.concat("text", F.lit(" Ёлка Straße")), cyrillic=True).cast("binary")).alias("folded_md5"),
        F.sha1(low).alias("sha1"), F.sha2(low, 256).alias("sha256")
    )


#: Our own words: articles, pronouns and prepositions of five languages, in the order in which ties are broken.
VOTES = {
    "es": "el|los|las|una|unos|del|su|sus|nos|sin|sobre|desde",
    "de": "der|die|das|den|dem|ein|ist|mit|von|zu|auf|für",
    "fr": "le|les|des|une|du|au|aux|nous|vous|sur|sans|chez",
    "tr": "ben|sen|biz|siz|onlar|şey|kadar|sonra|önce|böyle",
    "en": "of|in|to|is|it|he|she|they|we|at|from|by",
}
TURKISH = "şey|önce|böyle|kadar|sonra"


@theme.add(f"""
WITH s AS (SELECT doc_id, lower(substr(text, 1, 400)) AS t, substr(text, 1, 400) AS raw FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, raw, t, list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM s),
v AS (SELECT doc_id, raw, t, w, [{', '.join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words.split('|'))})))" for words in VOTES.values())}] AS n FROM w)
SELECT doc_id, CASE WHEN raw = '' THEN 'und' WHEN regexp_matches(raw, '\\p{{Cyrillic}}') THEN 'ru' WHEN regexp_matches(raw, '[ğĞşŞıİçÇöÖüÜ]') AND list_has_any(w, [{', '.join(repr(x) for x in TURKISH.split('|'))}]) THEN 'tr' WHEN list_max(n) = 0 THEN 'en' ELSE [{', '.join(repr(x) for x in VOTES)}][list_position(n, list_max(n))] END AS guess FROM v""")
def txt_language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by rules over the beginning of a text: script, then letters with a word, then the most stop words."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.substring("text", 1, 400).alias("raw"))
    w = F.filter(F.split(F.lower("raw"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    rows = rows.withColumn("w", w)
    count = lambda words: F.size(F.filter("w", lambda x: x.isin(words.split("|"))))
    best = F.greatest(*(F.struct(count(words).alias("n"), F.lit(-i).alias("before"), F.lit(lang).alias("lang")) for i, (lang, words) in enumerate(VOTES.items())))
    turkish = F.col("raw").rlike("[ğĞşŞıİçÇöÖüÜ]") & (count(TURKISH) > 0)
    rows = rows.withColumn("best", best)
    guess = F.when(F.col("raw") == "", "und").when(F.col("raw").rlike(r"\p{IsCyrillic}"), "ru").when(turkish, "tr").when(F.col("best.n") == 0, "en").otherwise(F.col("best.lang"))
    return rows.select("doc_id", guess.alias("guess"))


SCRIPTS = [
    ("ko", r"\uAC00-\uD7AF", 0.15), ("ja", r"\u3040-\u30FF", 0.10), ("zh", r"\u4E00-\u9FFF\u3400-\u4DBF", 0.15),
    ("th", r"\u0E00-\u0E7F", 0.15), ("hi", r"\u0900-\u097F", 0.15), ("hy", r"\u0530-\u058F", 0.15), ("ka", r"\u10A0-\u10FF", 0.15),
    ("he", r"\u0590-\u05FF", 0.15), ("el", r"\u0370-\u03FF", 0.15), ("ar", r"\u0600-\u06FF", 0.15), ("ru", r"\u0400-\u04FF", 0.15)
]
LATIN = r"A-Za-z\u00C0-\u024F"


def _range_sql(span: str) -> str:
    """A range of code points as the other dialect writes it."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", span)


# Our own additions of other scripts, so that every rule is met; the letters that tell languages of a script apart are fixed values.
ADDED = {1: "Привет мир " * 30, 2: "日本語のかな " * 60, 3: "안녕하세요 " * 50, 4: "Їжак і є ґанок " * 40, 5: "Ђак је његов љубимац " * 40, 6: "سلام دنیا گل پدر " * 40, 7: "مرحبا يا عالم " * 40, 8: "ωραία μέρα σήμερα " * 40}
VARIANTS = {"ar": [("fa", "پچژگ")], "ru": [("uk", "іїєґ"), ("sr", "ђћџњљ")]}


def _census_sql() -> str:
    scripts = " ".join(f"WHEN n[{i + 1}] / letters > {least} THEN " + "".join(f"CASE WHEN regexp_matches(t, '[{marks}]') THEN '{other}' ELSE " for other, marks in VARIANTS.get(lang, [])) + f"'{lang}'" + " END" * len(VARIANTS.get(lang, [])) for i, (lang, _, least) in enumerate(SCRIPTS))
    counts = ", ".join(f"len(regexp_extract_all(t, '[{_range_sql(span)}]'))" for _, span, _ in SCRIPTS)
    votes = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words.split('|'))})))" for words in VOTES.values())
    added = " ".join(f"WHEN {i} THEN '{text}'" for i, text in ADDED.items())
    return f"""
WITH t AS (SELECT doc_id, substr(CASE doc_id % 10 {added} ELSE '' END || CASE WHEN doc_id % 50 = 9 THEN substr(text, 1, doc_id % 40) WHEN doc_id % 50 = 19 THEN '12345 67890 12345 67890' ELSE text END, 1, 800) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, [{counts}] AS n, len(regexp_extract_all(t, '[{_range_sql(LATIN)}]')) AS latin, regexp_extract_all(lower(t), '[a-z\\x{{E0}}-\\x{{F6}}\\x{{F8}}-\\x{{FF}}ıçğşœ]+') AS w FROM t),
l AS (SELECT *, latin + list_sum(n) AS letters, [{votes}] AS v0 FROM c),
v AS (SELECT *, list_transform(v0, lambda x, i: x + CASE WHEN i = 4 AND x > 0 AND regexp_matches(t, '[ığş]') THEN 1 ELSE 0 END) AS v FROM l)
SELECT doc_id, CASE WHEN length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) < 20 THEN 'short' WHEN letters = 0 THEN 'no letters' {scripts} WHEN len(w) < 4 THEN 'short'
       WHEN list_max(v) >= 2 THEN ['es', 'de', 'fr', 'tr', 'en'][list_position(v, list_max(v))] WHEN len(w) > 25 THEN 'unmatched' ELSE 'short' END AS lang FROM v"""


@theme.add(_census_sql())
def txt_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by the census: too short, no letters, the first script above its share, languages of a script by their letters, then stop words."""
    i = F.col("doc_id")
    more = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ADDED.items() for x in pair)), (i % 10).cast("int")), F.lit(""))
    text = F.when(i % 50 == 9, F.substring("text", F.lit(1), (i % 40).cast("int"))).when(i % 50 == 19, "12345 67890 12345 67890").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.substring(F.concat(more, text), 1, 800).alias("t"))
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"[a-z\x{E0}-\x{F6}\x{F8}-\x{FF}ıçğşœ]+"), F.lit(0))
    counts = [F.regexp_count("t", F.lit(f"[{span}]")).alias(f"n_{lang}") for lang, span, _ in SCRIPTS]
    rows = rows.select("doc_id", "t", words.alias("w"), *counts, F.regexp_count("t", F.lit(f"[{LATIN}]")).alias("latin"))
    votes = {}
    for lang, own in VOTES.items():
        listed = own.split("|")
        votes[lang] = F.size(F.filter("w", lambda x: x.isin(listed)))  # noqa: B023
    votes["tr"] = votes["tr"] + F.when((votes["tr"] > 0) & F.col("t").rlike("[ığş]"), 1).otherwise(0)
    best = F.greatest(*(F.struct(n.alias("n"), F.lit(-place).alias("before"), F.lit(lang).alias("lang")) for place, (lang, n) in enumerate(votes.items())))
    rows = rows.withColumns({"best": best, "letters": sum((F.col(f"n_{lang}") for lang, _, _ in SCRIPTS), F.col("latin"))})
    out = F.when(F.length(markup.single_spaced(F.col("t"))) < 20, "short").when(F.col("letters") == 0, "no letters")
    for lang, _, least in SCRIPTS:
        own = F.lit(lang)
        for other, marks in reversed(VARIANTS.get(lang, [])):
            own = F.when(F.col("t").rlike(f"[{marks}]"), other).otherwise(own)
        out = out.when(F.col(f"n_{lang}") / F.col("letters") > least, own)
    out = out.when(F.size("w") < 4, "short").when(F.col("best.n") >= 2, F.col("best.lang")).when(F.size("w") > 25, "unmatched").otherwise("short")
    return rows.select("doc_id", out.alias("lang"))


@theme.add(f"""
WITH t AS (SELECT doc_id, substr(text, 1, 800) || CASE doc_id % 5 WHEN 1 THEN repeat('Привет мир ', 30) WHEN 2 THEN repeat('日本語のかな ', 60) WHEN 3 THEN repeat('안녕하세요 ', 50) ELSE '' END AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, [{', '.join(f"len(regexp_extract_all(t, '[{_range_sql(span)}]'))" for _, span, _ in SCRIPTS)}] AS n, len(regexp_extract_all(t, '[{_range_sql(LATIN)}]')) AS latin FROM t),
l AS (SELECT doc_id, n, latin, latin + list_sum(n) AS letters FROM c)
SELECT doc_id, CAST(letters AS BIGINT) AS letters, round(latin / greatest(letters, 1), 4) AS latin_share, CASE WHEN letters = 0 THEN 'none' {' '.join(f"WHEN n[{i + 1}] / letters > {least} THEN '{lang}'" for i, (lang, _, least) in enumerate(SCRIPTS))} ELSE 'latin' END AS script FROM l""")
def txt_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census of scripts in texts with some of other scripts put in: the first script above its share decides."""
    i = F.col("doc_id")
    more = F.when(i % 5 == 1, "Привет мир " * 30).when(i % 5 == 2, "日本語のかな " * 60).when(i % 5 == 3, "안녕하세요 " * 50).otherwise("")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(F.substring("text", 1, 800), more).alias("t"))
    counts = [F.regexp_count("t", F.lit(f"[{span}]")).alias(lang) for lang, span, _ in SCRIPTS]
    rows = rows.select("doc_id", *counts, F.regexp_count("t", F.lit(f"[{LATIN}]")).alias("latin"))
    letters = sum((F.col(lang) for lang, _, _ in SCRIPTS), F.col("latin"))
    rows = rows.withColumn("letters", letters.cast("long"))
    script = F.when(F.col("letters") == 0, "none")
    for lang, _, least in SCRIPTS:
        script = script.when(F.col(lang) / F.col("letters") > least, lang)
    return rows.select(
        "doc_id", "letters", F.round(F.col("latin") / F.greatest("letters", F.lit(1)), 4).alias("latin_share"),
        script.otherwise("latin").alias("script")
    )


@theme.add("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) AS INTEGER) AS weekday, CAST(week(ts) AS INTEGER) AS iso_week, CAST(isoyear(ts + INTERVAL 364 DAY) AS INTEGER) AS next_iso_year, strftime(ts, '%Y-%m') AS month, CAST(date_diff('day', ts, TIMESTAMP '" + AS_OF + "') AS INTEGER) AS days FROM events")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour, ISO day, week and year of the week, month and days since."""
    ts = F.col("ts")
    later = ts + F.expr("interval 364 days")
    return table(spark, sf_dir, "events").select(
        "event_id", F.hour(ts).alias("hour"), (F.weekday(ts) + 1).alias("weekday"), F.weekofyear(ts).alias("iso_week"),
        F.extract(F.lit("YEAROFWEEK"), later).alias("next_iso_year"), F.date_format(ts, "yyyy-MM").alias("month"),
        F.date_diff(F.lit(AS_OF).cast("timestamp_ntz"), ts).alias("days")
    )


@theme.add("""
SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(substr(text, 1, 80)), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents WHERE text IS NOT NULL""")
def fn_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of documents folded and joined by hyphens."""
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.slug(F.substring("text", 1, 80)).alias("slug"))


@theme.add("SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 6)) AS word FROM documents) GROUP BY 1 QUALIFY row_number() OVER (ORDER BY docs DESC, word) <= 100")
def txt_long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred long words of most documents: repeats go within the row, so one shuffle by word is left."""
    words = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.char_length(w) > 6))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return rows.orderBy(F.desc("docs"), "word").limit(100)
