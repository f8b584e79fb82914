"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become templates: decimal marks are joined, and so are a capitalised word after a
lower-case one or a number and up to two more capitalised words: they are one name.  All but
letters and digits is blank, words are lower-cased, digits and number words are numbers, and
a unit word after a number is a unit.  From there on each rewrite keeps the number of words, so
a template's word and the raw word at the same place belong together: the slots.

Windows of ``width`` template words with ``literal`` ordinary words at least are hashed
(64 bits of 8 words; the words are compared as well) and joined with the benchmark's.  Only
the benchmark side is ever broadcast, and only after its windows were counted; beyond
``broadcast_rows`` both sides are shuffled.  Matches are then rare rows: those of one
document, item and diagonal are checked together.  Slot values must map one to one; if they
are equal the match is "exact", if they map to others it is "re-parameterised", and if they
contradict one another the match is dropped.  A match counts if it covers ``cover`` words of
the item in a row of windows, or the item's share ``share``.

Defined results: null or short texts match nothing; items shorter than ``width`` template
words are compared as a whole, with ``whole`` anywhere in a document; windows with too few
ordinary words are left out, with ``whole`` compared by their raw words; repeated rows give one result per id; a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Unit words that become a placeholder after a number, and words that are numbers.
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "ton", "tons", "km", "m", "cm", "mm", "mi", "ft", "in", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons",
         "s", "min", "h", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "pound", "pounds", "gram", "grams", "kilogram", "kilograms", "degree", "degrees", "percent")
NUMBERS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
NAME, NUMBER, UNIT, JOINED = "Ⓝ", "#", "@", "Ⓙ"
#: (pattern, replacement) steps that Java's and RE2's expressions read alike.
CAPITAL = r"\p{Lu}\p{Ll}+"
DECIMAL = (r"([0-9])[.,]([0-9])", r"\1\2")
#: A second and a third name are drawn to the first one, which stands after a lower-case letter or a digit.
SURNAME = (rf"([\p{{Ll}}0-9][,;:]? )({CAPITAL}) ({CAPITAL})", rf"\1\2{JOINED}\3")
THIRD = (rf"({JOINED}{CAPITAL}) ({CAPITAL})", rf"\1{JOINED}\2")
NAMED = (rf"([\p{{Ll}}0-9][,;:]? ){CAPITAL}(?:{JOINED}{CAPITAL})*", rf"\1{NAME}")
BREAK = (rf"[^\p{{L}}\p{{N}}{NAME}{JOINED}]+", " ")
DIGITS = (r"[0-9]+", NUMBER)
MEASURE = (rf"({NUMBER} )({'|'.join(UNITS)})( |$)", rf"\1{UNIT}\3")


def rewritten(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new.replace("\\", "$"))
    return text


def joined(text: Column) -> Column:
    """Decimal marks drawn together, and names of several words."""
    return rewritten(text, DECIMAL, SURNAME, THIRD)


def raw_words(joined_text: Column) -> Column:
    return F.split(F.trim(rewritten(joined_text, BREAK)), " ", -1)


def template_words(joined_text: Column) -> Column:
    lower = F.lower(F.trim(rewritten(joined_text, NAMED, BREAK)))
    words = F.split(rewritten(lower, DIGITS, MEASURE), " ", -1)
    return F.transform(words, lambda w: F.when(w.isin(*NUMBERS), NUMBER).otherwise(w))


def is_slot(word: Column) -> Column:
    return word.contains(NUMBER) | (word == UNIT) | word.contains(NAME.lower())


def windows(df: DataFrame, key: list[str], text: str, width: int) -> DataFrame:
    """(key, raw, words, at): one row per window; the arrays are carried by reference until a row is needed."""
    cut = df.select(*key, joined(F.col(text)).alias("_joined")).withColumn("words", template_words(F.col("_joined"))).withColumn("raw", raw_words(F.col("_joined")))
    last = F.greatest(F.size("words") - width, F.lit(0))
    return cut.where("words[0] <> ''").select(*key, "raw", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))


def _others(ws: Workspace, items: DataFrame, texts: DataFrame, width: int, literal: int, broadcast_rows: int) -> DataFrame:
    """Matches of windows with few ordinary words, by raw words, and of short items anywhere in a document."""
    lowered = lambda df: df.withColumn("low", F.transform("raw", F.lower))
    key = lambda c, n: F.xxhash64(*(F.get(c, F.col("at") + i) for i in range(n)))
    cut = lowered(windows(items, ["item"], "t", width)).withColumn("item_window", F.slice("words", F.col("at") + 1, width))
    plain = F.size(F.filter("item_window", lambda w: ~is_slot(w))) >= F.least(F.lit(literal), F.size("words"))
    side = cut.select("item", F.col("at").alias("item_at"), F.size("words").alias("item_words"), "item_window", F.slice("raw", F.col("at") + 1, width).alias("item_raw"), plain.alias("plain"), F.when(plain, key("words", width)).otherwise(key("low", width)).alias("key"))
    side = ws.save(side.where((F.col("item_words") < width) | ~F.col("plain")).distinct(), "others")
    out = texts.join(side.limit(0).drop("key")).select("id", "item", "item_words", F.col("item_at").alias("shift"), "item_at", "item_window", "item_raw", F.col("item_raw").alias("raw"))
    for n, by_template, count in side.groupBy(F.least("item_words", F.lit(width)), "plain").count().collect():
        c = "words" if by_template else "low"
        asked = side.where((F.least("item_words", F.lit(width)) == n) & (F.col("plain") == by_template)).drop("plain")
        rows = lowered(windows(texts, ["id"], "t", n)).withColumn("key", key(c, n))
        meets = rows.join(F.broadcast(asked) if count <= broadcast_rows else asked.hint("shuffle_merge"), "key")
        same = F.col("item_window") if by_template else F.transform("item_raw", F.lower)
        out = out.unionAll(meets.where(F.slice(c, F.col("at") + 1, n) == same).select("id", "item", "item_words", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_window", "item_raw", F.slice("raw", F.col("at") + 1, n).alias("raw")))
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", width: int = 8, literal: int = 5, cover: int = 10, share: float = 0.5, broadcast_rows: int = 500_000, whole: bool = False) -> DataFrame:
    """(id, item, n_windows, covered, item_words, kind): one row per document and item that leaked into it."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    words = lambda c: [F.get(c, F.col("at") + i) for i in range(width)]
    items = bench.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    cut = windows(items, ["item"], "t", width)
    window = F.slice("words", F.col("at") + 1, width)
    plain = F.size(F.filter(window, lambda w: ~is_slot(w)))
    cut = cut.where(plain >= F.least(F.lit(literal), F.size("words")))
    side = ws.save(cut.select("item", F.col("at").alias("item_at"), F.size("words").alias("item_words"), window.alias("item_window"), F.slice("raw", F.col("at") + 1, width).alias("item_raw"), F.xxhash64(*words("words")).alias("key")).distinct(), "items")
    count = side.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    rows = windows(texts, ["id"], "t", width).withColumn("key", F.xxhash64(*words("words")))
    meets = rows.join(F.broadcast(side) if count <= broadcast_rows else side.hint("shuffle_merge"), "key")
    found = meets.where(F.slice("words", F.col("at") + 1, width) == F.col("item_window")).select(
        "id", "item", "item_words", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_window", "item_raw", F.slice("raw", F.col("at") + 1, width).alias("raw")
    )
    if whole:
        found = found.unionAll(_others(ws, items, texts, width, literal, broadcast_rows))
    # one row per word of a matched window: covered places, and the slots' values
    places = found.select("id", "item", "item_words", "shift", "item_at", F.posexplode(F.arrays_zip("item_window", "item_raw", "raw")).alias("i", "w"))
    slot = F.when(is_slot(F.col("w.item_window")), F.struct(F.lower("w.item_raw").alias("b"), F.lower("w.raw").alias("d")))
    lines = places.groupBy("id", "item", "item_words", "shift").agg(F.count_distinct("item_at").alias("n_windows"), F.count_distinct(F.col("item_at") + F.col("i")).alias("covered"), F.collect_set(slot).alias("slots"))
    one = lambda f: F.size(F.array_distinct(F.transform("slots", lambda s: s[f]))) == F.size("slots")
    same = F.forall("slots", lambda s: s["b"] == s["d"])
    kind = F.when(same, 0).when(one("b") & one("d"), 1)
    kept = lines.withColumn("kind", kind).where("kind is not null").where((F.col("covered") >= cover) | (F.col("covered") >= share * F.col("item_words")))
    best = kept.groupBy("id", "item").agg(F.sum("n_windows").cast("long").alias("n_windows"), F.max("covered").cast("long").alias("covered"), F.max("item_words").cast("long").alias("item_words"), F.min("kind").alias("kind"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "covered", "item_words", F.when(F.col("kind") == 0, "exact").otherwise("re-parameterised").alias("kind"))
