"""Benchmark decontamination by template canonicalisation: DataFrame and SQL functions only.

Texts become words; numbers (digits and English number words), names (a capital and a small letter after a word, comma or
semicolon and spaces) and units become the typed placeholders <n>, <p> and <u>. Windows of `size` template words are hash-joined
with the benchmark's; a text without any of the words that a text with so many windows must have (`_anchors`) is not cut into
windows. A window with slots and fewer plain words than half of `size` says too little: it must match word by word. Other windows
with slots count by chains, windows that follow one another in text and item alike: throughout a chain each benchmark value must
stand for one document value, and each name for one name. A row holds an item if its matches without slots and those of its best
consistent chain are at least half of the item's windows.

An item with fewer words than `size` is one window of all its words, so an item of one word is found in every text with that word.
A capital that begins a sentence is not told from a name, so such names must match. Null and empty texts have no windows; items
without words match nothing; rows are judged one by one, and of rows that share an id the one that holds most is reported (null ids
under null); equal items with different ids are reported each; extra columns are ignored; an empty table gives an empty result.
Rows, items and windows are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headlight.llm.common import small, table

SIZE = 8
#: Words that count as units.
UNITS = (
    "km m cm mm kg g mg lb lbs mile miles meter meters metre metres foot feet inch inches ton tons hour hours minute minutes "
    "second seconds day days week weeks month months year years dollar dollars euro euros pound pounds cent cents percent "
    "degree degrees liter liters litre litres gallon gallons"
).split()
#: Words that count as numbers.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
#: With more different anchor words than this, every text is cut into windows; the result is the same.
MOST_ANCHORS = 20_000
NAME, NAMED = r"([\p{L},;] +)(\p{Lu}\p{Ll})", "$1\u0002$2"


def words_of(text: Column) -> Column:
    """Lower-cased words; a name's first character is U+0002; digits keep a point or comma between them as `_`."""
    marked = F.regexp_replace(F.regexp_replace(F.translate(text, "\u0002", " "), NAME, NAMED), NAME, NAMED)
    joined = F.regexp_replace(F.lower(marked), r"([0-9])[.,]([0-9])", "$1_$2")
    clean = F.trim(F.regexp_replace(joined, "[^\\p{L}\\p{M}\\p{N}_\u0002]+", " "))
    return F.array_remove(F.split(clean, " "), "")


def _template(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    number = first.between("0", "9") | word.isin(NUMBERS)
    return F.when(number, F.lit("<n>")).when(first == "\u0002", F.lit("<p>")).when(word.isin(UNITS), F.lit("<u>")).otherwise(word)


def _is_slot(template: Column) -> Column:
    return template.isin("<n>", "<p>", "<u>")


def _windows(df: DataFrame, size: int) -> DataFrame:
    """row, doc_id and pos and hash of `size` template words from each place."""
    n = F.size("template")
    hashed = F.transform(F.sequence(F.lit(1), n - F.lit(size - 1)), lambda i: F.xxhash64(F.slice("template", i, F.lit(size))))
    return df.where(n >= size).select("row", "doc_id", F.posexplode(hashed).alias("pos", "window"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a hash of the row), item_id, words and template of each different item."""
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").where("text is not null").dropDuplicates(["item"])
    rows = rows.select("item", "item_id", F.col("text").rlike(r"^[^\p{L}\p{M}\p{N}_]*\p{Lu}\p{Ll}").alias("capital"), words_of(F.col("text")).alias("words"))
    return rows.withColumn("template", F.transform("words", _template)).where(F.size("words") > 0)


def _bare(words: str) -> Column:
    return F.transform(words, lambda w: F.translate(w, "\u0002", ""))


def _item_windows(items: DataFrame, size: int) -> DataFrame:
    """item, size, item_pos, slots, strict, the window's hash and its longest adjacent plain words of each window of each item."""
    n = F.least(F.size("template"), F.lit(size))
    at = items.select("item", "capital", "words", "template", n.alias("size"), F.explode(F.sequence(F.lit(0), F.size("template") - n)).alias("item_pos"))
    at = at.select("item", "capital", "size", "item_pos", *(F.slice(c, F.col("item_pos") + 1, F.col("size")).alias(c) for c in ("words", "template")))
    # Behind other words a capital at the item's beginning is a name.
    named = at.where(F.col("capital") & (F.col("item_pos") == 0) & ~_is_slot(F.col("template")[0]))
    at = at.union(named.withColumn("template", F.concat(F.array(F.lit("<p>")), F.slice("template", F.lit(2), F.greatest(F.col("size") - 1, F.lit(1))))))
    at = at.withColumn("slots", F.size(F.filter("template", _is_slot)))
    at = at.withColumn("strict", (F.col("slots") > 0) & (F.col("size") - F.col("slots") < size // 2))
    plain, after = r"^\p{L}+$", F.slice("template", F.lit(2), F.greatest(F.size("template") - 1, F.lit(1)))
    pairs = F.zip_with("template", after, lambda a, b: F.when(a.rlike(plain) & b.rlike(plain), F.struct(F.least(F.length(a), F.length(b)).alias("n"), a.alias("a"), b.alias("b"))))
    window = F.when(F.col("strict"), F.xxhash64(_bare("words"))).otherwise(F.xxhash64("template"))
    return at.select("item", "size", "item_pos", F.when(F.col("strict"), 0).otherwise(F.col("slots")).alias("slots"), "strict", window.alias("window"), F.array_max(pairs).alias("pair"))


def _anchors(windows: DataFrame, share: float) -> tuple[DataFrame, tuple[list[str], list[str]] | None]:
    """(item, anchored) and the first words, and pairs, of which a text that holds an anchored item has one; None if they are too many to list.

    A text that holds `share` of an item's windows holds one of any choice of more than the rest. The choice is the windows with the
    longest adjacent plain words, which are the rarest, and the anchor is that pair. An item with a chosen window without a pair has no anchor.
    """
    item = Window.partitionBy("item")
    windows = windows.groupBy("item", "item_pos").agg(F.min("pair").alias("pair"))  # of both forms of a first window the one that both have
    ranked = windows.select("item", "pair", F.row_number().over(item.orderBy(F.col("pair").desc_nulls_last(), "item_pos")).alias("r"), F.count("*").over(item).alias("m"))
    chosen = ranked.where(F.col("r") <= F.floor(F.col("m") * F.lit(1 - share)) + 1)
    anchored = table(chosen.groupBy("item").agg(F.bool_and(F.col("pair").isNotNull()).alias("anchored")))
    found = chosen.join(anchored.where("anchored").select("item"), "item").select("pair.a", "pair.b").distinct().limit(MOST_ANCHORS + 1).collect()
    if len(found) > MOST_ANCHORS:
        return anchored, None
    return anchored, (sorted({r["a"] for r in found}), sorted(f"{r['a']} {r['b']}" for r in found))


def _may_hold(text: Column, anchors: tuple[list[str], list[str]]) -> Column:
    """Whether a text has one of the anchors' pairs."""
    plain = F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\p{N}_]+", " "), " ")
    after = lambda words: F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1)))
    hit = lambda a, b: F.when(a.isin(anchors[0]), F.concat(a, F.lit(" "), b).isin(anchors[1])).otherwise(False)
    # The words are bound to a lambda's variable, so that they are made once.
    return F.exists(F.array(plain), lambda words: F.exists(F.zip_with(words, after(words), hit), lambda x: F.coalesce(x, F.lit(False))))


def matches(docs: DataFrame, items: DataFrame, windows: DataFrame, share: float = 0.5) -> DataFrame | None:
    """(row, doc_id, item, pos, item_pos, size, slots) of the matching windows of rows that may hold an item; row is a hash of id and text."""
    anchored, anchors = _anchors(windows, share)
    windows = table(windows.join(anchored, "item").drop("pair"))
    kinds = sorted(tuple(r) for r in windows.select("size", "strict", "anchored").distinct().collect())  # at most 4 x `size` rows
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").where("text is not null")
    found = None
    for size, strict, has_anchor in kinds:
        some = texts
        if has_anchor and anchors is not None:
            some = texts.where(_may_hold(F.col("text"), anchors))
        some = some.select("row", "doc_id", words_of(F.col("text")).alias("words"))
        some = some.select("row", "doc_id", (_bare("words") if strict else F.transform("words", _template)).alias("template"))
        mine = windows.where((F.col("size") == size) & (F.col("strict") == strict) & (F.col("anchored") == has_anchor)).select("item", "item_pos", "window", "slots", "size")
        pairs = _windows(some, size).join(small(mine), "window").select("row", "doc_id", "item", "pos", "item_pos", "size", "slots")
        found = pairs if found is None else found.union(pairs)
    return None if found is None else table(found.distinct())


def _slots(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(key, at, value, type) of the slots of the rows of df (key, words) whose key is in ids."""
    some = df.join(small(table(ids.select(key).distinct())), key, "left_semi").select(key, F.posexplode("words").alias("at", "value"))
    return some.withColumn("type", _template(F.col("value"))).where(_is_slot(F.col("type")))


def _chains(slotted: DataFrame) -> DataFrame:
    """slotted with the chain of each window: windows that follow one another in the text and in the item alike, across insertions.

    A place of the text that fits several places of the item goes with the diagonal that has most windows (then the first).
    """
    text = Window.partitionBy("row", "item").orderBy("pos")
    d = slotted.withColumn("shift", F.col("pos") - F.col("item_pos"))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("row", "item", "shift")))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("row", "item", "pos").orderBy(F.desc("n"), "shift"))).where("r = 1")
    back = F.coalesce(F.lag("item_pos").over(text) >= F.col("item_pos"), F.lit(False)).cast("int")
    return d.withColumn("back", back).withColumn("chain", F.sum("back").over(text)).drop("shift", "n", "r", "back")


def _best_chains(docs: DataFrame, items: DataFrame, slotted: DataFrame) -> DataFrame:
    """row, item, windows, slots and changed slots of the consistent chain with most windows."""
    chains = table(_chains(slotted))
    span = chains.select("row", "item", "chain", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("item_pos") + i).alias("item_at"), (F.col("pos") + i).alias("at")))).alias("x"))
    span = span.select("row", "item", "chain", "x.item_at", "x.at").distinct()
    a = _slots(items.select("item", "words"), "item", slotted).select("item", F.col("at").alias("item_at"), F.col("value").alias("item_value"), "type")
    rows = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = rows.join(small(table(slotted.select("row").distinct())), "row", "left_semi").dropDuplicates(["row"]).select("row", words_of(F.col("text")).alias("words"))
    b = _slots(rows, "row", slotted).select("row", "at", "value")
    key = ["row", "item", "chain"]
    pairs = table(span.join(small(table(a)), ["item", "item_at"]).join(b, ["row", "at"]).groupBy(*key, "type", "item_value", "value").agg(F.countDistinct("item_at").alias("n")))
    one = pairs.groupBy(*key, "type", "item_value").agg((F.count("*") > 1).alias("bad"))
    other = pairs.where("type = '<p>'").groupBy(*key, "value").agg((F.countDistinct("item_value") > 1).alias("bad"))
    bad = one.where("bad").select(*key).union(other.where("bad").select(*key)).distinct()
    sums = pairs.groupBy(*key).agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("value") != F.col("item_value"), F.col("n")).otherwise(0)).alias("changed"))
    size = chains.groupBy(*key).agg(F.countDistinct("item_pos").alias("windows"))
    sums = size.join(sums, key, "left").join(bad, key, "left_anti").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("slots", "changed")})
    best = sums.groupBy("row", "item").agg(F.max(F.struct("windows", "slots", (-F.col("changed")).alias("kept"))).alias("best"))
    return best.select("row", "item", "best.windows", "best.slots", (-F.col("best.kept")).alias("changed"))


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, windows found, windows of the item, slots compared, slots changed and kind (verbatim or reparameterised)."""
    items = table(_items(benchmark))
    windows = table(_item_windows(items, size))
    of = windows.groupBy("item").agg(F.countDistinct("item_pos").alias("of"))
    found = matches(docs, items, windows, share)
    if found is None:
        kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, found long, of long, slots long, changed long, kind string")
    slotted = found.where("slots > 0")
    hits = found.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.countDistinct(F.when(F.col("slots") == 0, F.col("item_pos"))).alias("plain"))
    if slotted.isEmpty():
        hits = hits.withColumns({c: F.lit(0).cast("long") for c in ("windows", "slots", "changed")})
    else:
        hits = hits.join(table(_best_chains(docs, items, slotted)), ["row", "item"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("windows", "slots", "changed")})
    hits = hits.withColumn("found", F.col("plain") + F.col("windows")).join(small(table(of)), "item")
    hits = hits.where(F.col("found") >= F.col("of") * F.lit(share)).join(small(table(items.select("item", "item_id"))), "item")
    # Of rows that share an id, and of items that do, the pair with most is reported.
    out = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("found", "of", "slots", "changed")).alias("x")).select("doc_id", "item_id", "x.*")
    return out.withColumn("kind", F.when(F.col("changed") > 0, "reparameterised").otherwise("verbatim"))


def accept(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark; null and repeated ids are decided by row."""
    row = F.xxhash64("doc_id", "text")
    held = table(find(docs.select(row.alias("doc_id"), "text"), benchmark, size, share).select(F.col("doc_id").alias("headlight_held")).distinct())
    return docs.join(small(held), row == F.col("headlight_held"), "left_anti")
