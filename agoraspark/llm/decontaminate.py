"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers (and lists of them), the unit right after one, and names become typed placeholders; what is left is lower-cased and
cut at everything that is no letter or digit. A name is a run of capitalised words that are no function words of English,
French, German or Spanish and don't stand after an article or a number, where languages that write nouns with capitals have
a noun. Every window of WINDOW template tokens of every document is hash-joined with the windows of the benchmark items.
Matches whose diagonals (offsets between document and item) lie within DRIFT of each other are taken together, so words put
in or left out do no harm, and a document holds an item if they cover MIN_COVERAGE of its tokens, at least MIN_WORDS of them
plain words where it has as many, and the slots agree: over the covered places, equal values of the item stand against
equal values of the document and unequal against unequal, for MIN_CONSISTENCY of the distinct pairs. So a copy with other
numbers and names is found, and texts of the same form by chance are not.
Every document is looked up by lower-case words without names as well, since names can't be told in a copy in capitals or
in lower case; of such a copy with other names only what lies between the names is compared.

Items shorter than a window are one window of their own length; an item of fewer than MIN_TOKENS tokens is held only by a
document whose whole template it is, since its words stand in any text. Documents are tokenised once for windows of all sizes.

Null and empty texts, in either table, match nothing, and so do texts without a letter or digit. Texts are read whole however
long. Rows of docs that repeat a doc_id and a text count once; rows that share a doc_id with other texts, or have none, are
looked up apart by a hash of the text. Repeated rows of the benchmark count once; rows that share an item_id are one item's
texts, of which the better match counts; those without an id are left out. Of equally good matches the earlier in the text
counts. Empty tables give empty results. Other columns are ignored and kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoraspark.llm.common import NO_ID, row_key, stored, unclashing

WINDOW = 8
MIN_COVERAGE = 0.5
MIN_CONSISTENCY = 0.8
MIN_TOKENS = 3
MIN_WORDS = 3
DRIFT = 8  # tokens by which the matches of one copy may be shifted against each other, by words put in or left out
BROADCAST_WINDOWS = 200_000  # benchmark windows up to which they are broadcast (16 bytes each); beyond, both sides are shuffled

# Fixed lists: units, and function words that may stand with a capital at a sentence's start, by language.
UNITS = (
    "percent|prozent|mm|cm|m|km|inch|inches|foot|feet|yard|yards|mile|miles|mg|g|kg|gram|grams|kilogram|kilograms|ton|tons|ounce|ounces|pound|pounds|"
    "ml|l|liter|liters|litre|litres|gallon|gallons|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|"
    "dollar|dollars|cent|cents|euro|euros|degree|degrees|celsius|fahrenheit|kmh|mph|watt|watts|volt|volts|"
    "meter|metern|kilometer|kilometern|gramm|kilogramm|tonne|tonnen|sekunde|sekunden|minuten|stunde|stunden|tag|tage|tagen|woche|wochen|monat|monate|monaten|jahr|jahre|jahren|grad|"
    "mètre|mètres|kilomètre|kilomètres|gramme|grammes|kilogramme|kilogrammes|tonnes|seconde|secondes|heure|heures|jour|jours|semaine|semaines|mois|an|ans|année|années|degré|degrés|"
    "metro|metros|kilómetro|kilómetros|gramo|gramos|kilo|kilos|kilogramo|kilogramos|tonelada|toneladas|segundo|segundos|minuto|minutos|hora|horas|día|días|semana|semanas|mes|meses|año|años|litro|litros|grado|grados"
)
FUNCTION_WORDS = (
    "The|A|An|If|In|On|At|Of|To|For|From|By|With|And|Or|But|As|Is|Are|Was|Were|Be|It|Its|This|That|These|Those|He|She|They|We|You|I|His|Her|Their|"
    "What|Which|Who|When|Where|Why|How|Each|Every|All|Some|There|Then|After|Before|Find|Let|Suppose|Given|Not|No|Do|Does|Did|Can|Could|Will|Would|"
    "Le|La|Les|Un|Une|Des|Du|De|Et|Ou|Mais|Si|En|Dans|Sur|Au|Aux|Par|Pour|Avec|Sans|Sous|Il|Elle|Ils|Elles|Nous|Vous|Je|Tu|On|Ce|Cet|Cette|Ces|Son|Sa|Ses|Leur|Leurs|"
    "Que|Qui|Quoi|Quel|Quelle|Quels|Quelles|Quand|Comment|Combien|Pourquoi|Où|Est|Sont|Chaque|Tous|Toutes|Après|Avant|Puis|Ne|Pas|Soit|"
    "Der|Die|Das|Den|Dem|Ein|Eine|Einen|Einem|Einer|Eines|Und|Oder|Aber|Wenn|Im|Am|An|Auf|Aus|Bei|Mit|Nach|Seit|Von|Vom|Zu|Zum|Zur|Für|Durch|Über|Unter|Vor|"
    "Er|Sie|Es|Wir|Ihr|Ich|Du|Sein|Seine|Ihre|Was|Wer|Wie|Wo|Wann|Warum|Welche|Welcher|Welches|Ist|Sind|War|Waren|Jede|Jeder|Jedes|Alle|Einige|Dann|Nicht|Kein|Keine|Sei|"
    "El|Los|Las|Uno|Una|Unos|Unas|Del|Al|Y|O|Pero|Como|Con|Sin|Por|Para|Desde|Hasta|Entre|Sobre|Ella|Ellos|Ellas|Nosotros|Yo|Su|Sus|Este|Esta|Estos|Estas|Ese|Esa|"
    "Qué|Quién|Cuál|Cuáles|Cuándo|Cuánto|Cuántos|Cuántas|Cómo|Dónde|Es|Son|Era|Eran|Cada|Todos|Todas|Después|Antes|Luego|Sea|Se|Lo"
)
ARTICLES = "the|a|an|der|die|das|den|dem|des|ein|eine|einen|einem|einer|eines|le|la|les|un|une|du|el|los|las|una|unos|unas"

# groups are repeated possessively, which needs no stack, so texts of any length pass
NUMBER = r"\p{N}+(?:[.,:]\p{N}+)*+"
NUMBERS = rf"{NUMBER}(?:[\s,;/\-]+{NUMBER})*+"
NO_LETTER = r"(?![\p{L}\p{M}\p{N}])"
UNIT_WORD = rf"(?:%|(?i:{UNITS}){NO_LETTER})"
WORD_NAME = rf"(?<![\p{{L}}\p{{M}}\p{{N}}\uE001])(?!(?:{FUNCTION_WORDS})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{Ll}}\p{{M}}]+{NO_LETTER}"
# not after an article or a number; then words of a name side by side are one
NAMES = rf"(?=\p{{Lu}}[\p{{Ll}}\p{{M}}])(?<!(?<![\p{{L}}\p{{M}}])(?i:{ARTICLES})\s)(?<!0\s{{1,3}}){WORD_NAME}(?:[\s\-]+{WORD_NAME})*+"
NUMBER_MARK, UNIT, NAME, END, NUMBER_END = "\uE000", "\uE001", "\uE002", "\uE003", "\uE004"  # mark raw tokens; of private use
MARKS = NUMBER_MARK + UNIT + NAME + END + NUMBER_END


def _clean(text: Column) -> Column:
    return F.translate(text, MARKS, " " * len(MARKS))


def _numbered(text: Column) -> Column:
    """The text with numbers as 0, and the unit right after one as 1."""
    out = F.regexp_replace(text, NUMBERS, " 0 ")
    return F.regexp_replace(out, rf" 0 \s*{UNIT_WORD}", " 0 1 ")


def _split(marked: Column) -> Column:
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def _named(marked: Column) -> Column:
    return _split(F.regexp_replace(marked, NAMES, "2"))


def template(text: Column, names: bool = True) -> Column:
    """The template tokens of a text: 0 for a number, 1 for a unit, 2 for a name of one or more words (a word each without names), else a lower-case word."""
    out = _numbered(_clean(text))
    return _named(out) if names else _split(out)


def raw_tokens(text: Column, names: bool = True) -> Column:
    """The tokens that template() canonicalises, in lower case, place by place."""
    out = F.regexp_replace(_clean(text), NUMBERS, f" {NUMBER_MARK}$0{NUMBER_END} ")
    out = F.regexp_replace(out, rf"{NUMBER_END} \s*({UNIT_WORD})", f"{NUMBER_END} {UNIT}$1{END} ")
    if names:
        # what follows a number is told by its mark here, as by the 0 in template()
        out = F.regexp_replace(out, NAMES.replace(r"(?<!0\s{1,3})", rf"(?<!{NUMBER_END}\s{{1,3}})"), f"{NAME}$0{END}")
    marked = rf"[{NUMBER_MARK}{UNIT}{NAME}][^{END}{NUMBER_END}]+[{END}{NUMBER_END}]"
    found = F.regexp_extract_all(out, F.lit(rf"{marked}|[\p{{L}}\p{{M}}\p{{N}}]+"), 0)
    return F.transform(found, lambda t: F.lower(F.translate(t, MARKS, "")))


def _windows(rows: DataFrame, name: str, sizes: list[int], view: int) -> DataFrame:
    """Replace the tokens of a column by arrays name_size: the hash of each run of size tokens, apart for each view.

    A size below zero stands for the whole of a text of that many tokens. Hashes of 1, 2, 4, ... tokens are put together, so
    a run costs a few hashes of numbers instead of size hashes of words, and sizes share them.
    """

    def joined(a: str, b: str, shift: int) -> Column:
        n = F.greatest(F.size(b) - shift, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: F.xxhash64(x, y))

    power = [f"{name}_power_1"]
    rows = rows.withColumn(power[0], F.transform(name, lambda t: F.xxhash64(F.lit(view), t)))
    longest = max(abs(s) for s in sizes)
    while 1 << len(power) <= longest:
        power.append(f"{name}_power_{1 << len(power)}")
        rows = rows.withColumn(power[-1], joined(power[-2], power[-2], 1 << len(power) - 2))
    for size in sizes:
        have, out = 0, f"{name}_{size}"
        for k, one in enumerate(power):
            if abs(size) >> k & 1:
                rows = rows.withColumn(out, joined(out, one, have) if have else F.col(one))
                have += 1 << k
        if size < 0:
            rows = rows.withColumn(out, F.when(F.size(name) == -size, F.col(out)).otherwise(F.array().cast("array<bigint>")))
    return rows.drop(name, *power)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_row (hash of the text), view (1 with names, 2 without), template, raw tokens and window size (below zero: the whole)."""
    rows = benchmark.select(F.col("item_id").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    views = [F.struct(F.lit(v).alias("view"), template(F.col("text"), v == 1).alias("item_template"), raw_tokens(F.col("text"), v == 1).alias("item_raw")) for v in (1, 2)]
    rows = rows.select("item_id", F.xxhash64("text").alias("item_row"), F.explode(F.array(*views)).alias("p")).select("item_id", "item_row", "p.*").filter(F.size("item_template") > 0)
    size = F.size("item_template")
    return rows.withColumn("w", F.when(size < MIN_TOKENS, -size).otherwise(F.least(size, F.lit(WINDOW))))


def _item_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """item_id, item_row, view, item_at and h of every window of every item."""
    parts = []
    for view in (1, 2):
        rows = _windows(items.filter(F.col("view") == view).select("item_id", "item_row", "view", "w", "item_template"), "item_template", sizes, view)
        own = F.lit(None).cast("array<bigint>")
        for size in sizes:
            own = F.when(F.col("w") == size, F.col(f"item_template_{size}")).otherwise(own)
        parts.append(rows.select("item_id", "item_row", "view", F.posexplode(own).alias("item_at", "h")))
    return parts[0].unionByName(parts[1])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), item_id, coverage, slot_consistency, n_slots, at_token for every text and item that it holds."""
    items = stored(_items(benchmark), "items")
    sizes = sorted(r[0] for r in items.select("w").distinct().collect())  # WINDOW values at most
    doc, row = row_key(docs)
    if sizes:
        own = _item_windows(items, sizes)
        if own.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            own = F.broadcast(own)
        rows = docs.filter(docs["text"].isNotNull()).select(doc.alias("doc_id"), row.alias("row"), _numbered(_clean(docs["text"])).alias("marked"))
        rows = rows.select("doc_id", "row", _named(F.col("marked")).alias("v1"), _split(F.col("marked")).alias("v2"))
        rows = _windows(_windows(rows, "v1", sizes, 1), "v2", sizes, 2)
        every = F.explode(F.array(*(F.col(f"v{v}_{s}") for v in (1, 2) for s in sizes)))
        rows = rows.select("doc_id", "row", every.alias("windows")).select("doc_id", "row", F.posexplode("windows").alias("doc_at", "h"))
        found = rows.join(own, "h").select("doc_id", "row", "item_id", "item_row", "view", "item_at", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    else:
        found = docs.sparkSession.createDataFrame([], "doc_id long, row long, item_id long, item_row long, view int, item_at int, diagonal int")
    pair = ["doc_id", "row", "item_id", "item_row", "view"]
    lines = found.groupBy(*pair, "diagonal").agg(F.collect_set("item_at").alias("places"))
    # each diagonal with those that lie within DRIFT of it
    near = Window.partitionBy(*pair).orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    held = lines.withColumn("lines", F.collect_list(F.struct("diagonal", "places")).over(near)).join(items, ["item_id", "item_row", "view"])
    # for every place of the item the diagonal of a matched window that covers it, the nearest if there are several, else null
    at = F.transform(
        F.sequence(F.lit(0), F.size("item_template") - 1),
        lambda p: F.array_min(
            F.transform(
                F.filter("lines", lambda s: F.exists(s["places"], lambda q: (q <= p) & (p < q + F.abs(F.col("w"))))),
                lambda s: F.struct(F.abs(s["diagonal"] - F.col("diagonal")).alias("drift"), s["diagonal"].alias("diagonal")),
            )
        )["diagonal"],
    )
    held = held.withColumn("at", at).withColumn("coverage", F.size(F.filter("at", lambda d: d.isNotNull())) / F.size("at")).filter(F.col("coverage") >= MIN_COVERAGE)
    plain = F.transform("item_template", lambda t: ~t.isin("0", "1", "2"))
    words = F.zip_with(plain, "at", lambda word, d: word & d.isNotNull())
    held = held.filter(F.size(F.filter(words, lambda x: x)) >= F.least(F.lit(MIN_WORDS), F.size(F.filter(plain, lambda x: x))))
    held = stored(held.select(*pair, "at", "coverage", "item_template", "item_raw"), "held")
    ids = held.select("doc_id", "row").distinct()
    raw = docs.select(doc.alias("doc_id"), row.alias("row"), docs["text"].alias("text")).join(ids, ["doc_id", "row"], "left_semi").distinct()
    raw = raw.select("doc_id", "row", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), raw_tokens(F.col("text"), v == 1).alias("doc_raw")) for v in (1, 2)])).alias("p")).select("doc_id", "row", "p.*")
    # places of the item that a matched window covers and that are slots, each with the value on either side
    slots = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("item_raw") - 1),
            lambda p: F.struct(
                F.get("item_template", p).alias("kind"),
                F.get("item_raw", p).alias("theirs"),
                F.get("doc_raw", p + F.get("at", p)).alias("ours"),
                F.get("at", p).isNotNull().alias("covered"),
            ),
        ),
        lambda s: s["covered"] & s["kind"].isin("0", "1", "2"),
    )
    rows = held.join(raw, ["doc_id", "row", "view"]).withColumn("pairs", F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["theirs"], s["ours"]))))
    theirs = F.size(F.array_distinct(F.transform("pairs", lambda s: F.struct(s["kind"], s["theirs"]))))
    ours = F.size(F.array_distinct(F.transform("pairs", lambda s: F.struct(s["kind"], s["ours"]))))
    share = F.when(F.size("pairs") == 0, F.lit(1.0)).otherwise(F.least(theirs, ours) / F.size("pairs"))
    rows = rows.withColumn("slot_consistency", share).filter(F.col("slot_consistency") >= MIN_CONSISTENCY)
    # where the copy begins, in words: a name of several words before it counts by its words
    start = F.get(F.filter("at", lambda d: d.isNotNull()), F.lit(0))
    words = F.aggregate(F.slice("doc_raw", 1, F.greatest(start, F.lit(0))), F.lit(0), lambda n, t: n + F.size(F.split(t, r"[\s\-]+")))
    rows = rows.withColumn("at_token", F.when(start < 0, start).otherwise(words).cast("long"))
    best = F.max(F.struct("coverage", "slot_consistency", F.size("pairs").cast("long").alias("n_slots"), (-F.col("at_token")).alias("before"))).alias("best")
    out = rows.groupBy("doc_id", "row", "item_id").agg(best)
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "row", "item_id", "best.coverage", "best.slot_consistency", "best.n_slots", (-F.col("best.before")).alias("at_token"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns. Rows are decided by doc_id and text together."""
    held_doc, held_row = unclashing(docs, "held_doc", "held_row")
    held = contaminated(docs, benchmark).select(F.col("doc_id").alias(held_doc), F.col("row").alias(held_row)).distinct()
    _, row = row_key(docs)
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(held[held_doc]) & (row == held[held_row]), "left_anti")
