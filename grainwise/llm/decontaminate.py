"""Benchmark decontamination by template canonicalisation (operator 10), in DataFrame operations only.

1. Canonical words: numbers (digits, and English number words from two on), units behind numbers and names (capitalised,
   not shouted, inside a sentence) become typed placeholders, other words are lowered; punctuation goes. A capitalised word
   elsewhere, as at the start of a sentence, may be a name or not: windows with such words are hashed in both forms, on
   both sides, and the word is a slot like a name.
2. Windows of ``WINDOW`` canonical words are hashed and joined to those of the benchmark. Benchmark windows with fewer
   than ``MIN_LITERAL`` literal words aren't indexed: lists of names or numbers would all look alike. Items with such
   windows, or shorter than one, are also looked up verbatim, see ``verbatim``. The first window is
   indexed twice, as a capitalised first word becomes a name where a copy stands inside a sentence. The index is a stored
   table: Spark broadcasts it below its size threshold and shuffles beyond.
3. A document is a candidate for an item if it has at least half of the item's indexed windows (all of them, where the
   item has up to four). Every offset is checked by itself: the values behind the placeholders inside its matched windows
   must be consistent: each value of the item has one value in the document. Two values of the item may share one, as
   small numbers often do in a re-parameterised copy. The windows of an
   offset count together with those of the offsets whose values agree with its own (a copy with an inserted word lies at
   two offsets), and the item is reported if they are enough for any offset.
4. ``RUN_WORDS`` aligned words in a row, with consistent values, are a leak however long the item is.

Defined cases: null or empty texts match nothing; an item with no indexed window (fewer than ``WINDOW`` words, or names
and numbers only) is matched verbatim only; an item of a single word needs a line of its own; repeated items are reported each, repeated documents with equal text are reported
once; a null doc_id is reported as null; of several offsets that pass, the figures are those of the one with most windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.session import scratch_path

WINDOW = 5
MIN_LITERAL = 3
MIN_SHARE = 0.5
MIN_WINDOWS = 4
RUN_WORDS = 13

#: Units that turn into a placeholder behind a number.
UNITS = ("%", "€", "£", "mm", "cm", "dm", "km", "m", "mg", "kg", "g", "t", "ml", "cl", "l", "ms", "s", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "months", "years", "miles", "mile", "feet", "inches", "yards", "pounds", "ounces", "dollars", "euros", "cents", "percent", "degrees", "litres", "liters", "metres", "meters", "grams", "watts", "volts", "mph", "kmh")

# Each pattern asks for its first characters before it looks behind, which most places fail at once.
_NAME = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;:\)] )\p{Lu}\p{Ll}[\p{L}\p{M}]*"
#: A capitalised word that isn't a name by its place; names are replaced before.
_INITIAL = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\p{N}@])\p{Lu}\p{Ll}[\p{L}\p{M}]*"
#: English number words; "one" is a pronoun too often.
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "dozen")
_NUMBER = rf"(?=[defhmnst\p{{N}}])(?<![\p{{L}}\p{{N}}])(\p{{N}}+|(?=[defhmnst])(?:{'|'.join(NUMBER_WORDS)})(?!\p{{L}}))(?:[.,:/](\p{{N}}+))?(?:[.,:/](\p{{N}}+))?(?:[.,:/]\p{{N}}+)*"
_MEASURE = rf"{_NUMBER} ?({'|'.join(UNITS)})(?!\p{{L}})"
_SPLIT = r"[^a-z\p{L}\p{M}\p{N}@]+"


def _words(text: Column, name: str, initial: str, number: str, unit: str) -> Column:
    """Words of ``text`` with its names, numbers and units replaced; a replaced number isn't one again, as a letter precedes it."""
    text = F.regexp_replace(F.regexp_replace(F.translate(text, "@", " "), _NAME, name), _INITIAL, initial)
    text = F.regexp_replace(F.regexp_replace(text, _MEASURE, f"{number} {unit} "), _NUMBER, f"{number} ")
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def marked(text: Column) -> Column:
    """Array of canonical words: @p, @n, @u, @i and a word that may be a name, or a lowered word."""
    return _words(text, "@p", "@i$0", "@n", "@u")


def _plain(word: Column) -> Column:
    """A ``marked`` word; a plain one if it may be a name."""
    return F.when(F.startswith(word, F.lit("@i")), F.substring(word, 3, 1 << 20)).otherwise(word)


def plain(words: Column) -> Column:
    """``marked`` words with those that may be names taken for plain ones."""
    return F.transform(words, _plain)


def _typed(word: Column) -> Column:
    """A ``marked`` word; a name if it may be one."""
    return F.when(F.startswith(word, F.lit("@i")), F.lit("@p")).otherwise(word)


def typed(words: Column) -> Column:
    """``marked`` words with those that may be names taken for names."""
    return F.transform(words, _typed)


def canonical(text: Column) -> Column:
    """Array of canonical words: @p, @n, @u or a lowered word."""
    return plain(marked(text))


def annotated(text: Column) -> Column:
    """As ``marked``, word by word, with the value behind each placeholder: @pname, @iname, @n3x5x, @ukg."""
    return _words(text, "@p$0", "@i$0", "@n$1x$2x$3", "@u$4")


def word_hashes(words: Column) -> Column:
    """Array of a hash for each word."""
    return F.transform(words, lambda w: F.xxhash64(w))  # noqa: PLW0108


def _window(hashes: Column, start: Column) -> Column:
    """Hash of the window of words that begins at ``start``; ``hashes`` are those of the words."""
    return F.xxhash64(*(F.get(hashes, (start + k).cast("int")) for k in range(WINDOW)))


def windows(hashes: Column) -> Column:
    """Array of window hashes; element i covers the words from i on. ``hashes`` are those of the words, a column made in a
    projection below, as an expression would be evaluated again for every element."""
    last = F.size(hashes) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _window(hashes, i))).otherwise(F.array().cast("array<bigint>"))


_EDGE = r"[\p{P}&&[^-%/*#&@]]*"
_LINE = r"\r\n|\r|\n"


def plain_words(text: Column) -> Column:
    """Array of lowered words between blanks, without the punctuation around them; signs like + or = are words."""
    return F.array_remove(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), rf"{_EDGE}[\s\p{{Z}}]+{_EDGE}"), "")


def _plain_windows(words: Column, size: int) -> Column:
    """As ``windows``, over ``size`` plain words; the size is part of the hash."""
    at = lambda i, k: F.get(words, (i + k).cast("int"))
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(size), *(at(i, k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _row_key(doc_id: str = "doc_id") -> list[Column]:
    """Rows with equal id and text have equal verdicts; this names them."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")]


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """item (a row number within the benchmark's items), item_id, words, hash and position of each indexed window, stored."""
    spark = benchmark.sparkSession
    path = scratch_path(spark, "benchmark-windows")
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct().withColumn("marked", marked(F.col("text")))
    rows = rows.withColumns({"words": plain(F.col("marked")), "typed": typed(F.col("marked"))})
    inside = F.slice(canonical(F.concat(F.lit("a "), F.ltrim("text"))), 2, WINDOW)  # the first words as they are behind a word
    literal = lambda words, i: F.size(F.filter(F.slice(words, (i + 1).cast("int"), F.lit(WINDOW)), lambda w: ~F.startswith(w, F.lit("@"))))
    rows = rows.withColumns({"inside": word_hashes(inside), "plain_hashes": word_hashes(F.col("words")), "typed_hashes": word_hashes(F.col("typed"))})
    rows = rows.withColumns({"hashes": windows(F.col("plain_hashes")), "other": windows(F.col("typed_hashes")), "first": F.get(windows(F.col("inside")), F.lit(0))})
    each = rows.select("item_id", F.xxhash64("text").alias("item_key"), "words", "typed", "other", "first", F.posexplode("hashes").alias("item_pos", "hash")).filter(literal("words", F.col("item_pos")) >= MIN_LITERAL)
    second = F.when(literal("typed", F.col("item_pos")) >= MIN_LITERAL, F.get("other", "item_pos"))
    forms = F.array_distinct(F.array_compact(F.array("hash", second, F.when(F.col("item_pos") == 0, F.col("first")))))
    each.select("item_id", "item_key", "item_pos", F.explode(forms).alias("hash")).write.parquet(path)
    return spark.read.parquet(path)


def verbatim_index(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key, number of windows, size, position and hash of the plain windows of each item that has a window of
    too few literal words or none at all, stored. An item below ``WINDOW`` plain words is one window."""
    spark = benchmark.sparkSession
    path = scratch_path(spark, "benchmark-verbatim")
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.select("item_id", F.xxhash64("text").alias("item_key"), canonical(F.col("text")).alias("words"), plain_words(F.col("text")).alias("plain"))
    few = lambda i: F.size(F.filter(F.slice("words", i + 1, WINDOW), lambda w: ~F.startswith(w, F.lit("@")))) < MIN_LITERAL
    poor = (F.size("words") < WINDOW) | F.exists(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0))), few)
    rows = rows.filter(poor & (F.size("plain") > 0)).withColumn("size", F.least(F.size("plain"), F.lit(WINDOW)))
    hashes = _plain_windows(F.col("plain"), WINDOW)
    for k in range(1, WINDOW):
        hashes = F.when(F.col("size") == k, _plain_windows(F.col("plain"), k)).otherwise(hashes)
    rows = rows.withColumn("hashes", hashes).select("item_id", "item_key", "size", F.size("hashes").alias("indexed"), F.posexplode("hashes").alias("item_pos", "hash"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def verbatim(docs: DataFrame, index: DataFrame) -> DataFrame | None:
    """doc_id, text_key, item_id, item_key, matched and indexed of each pair whose plain words are equal in enough windows or
    in ``RUN_WORDS`` words in a row; None where the index is empty."""
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())
    if not sizes:
        return None
    text = F.col("text").cast("string")
    words = docs.filter(text.isNotNull()).select(*_row_key(), plain_words(text).alias("plain"), (F.split(text, _LINE) if 1 in sizes else F.array().cast("array<string>")).alias("lines"))
    single = F.transform(F.filter(F.transform("lines", plain_words), lambda w: F.size(w) == 1), lambda w: F.xxhash64(F.lit(1), F.get(w, F.lit(0))))
    placed = lambda hashes: F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
    each = words.select("doc_id", "text_key", F.inline_outer(F.concat(*(placed(single if k == 1 else _plain_windows(F.col("plain"), k)) for k in sizes))))
    keys = ["doc_id", "text_key", "item_id", "item_key", "indexed"]
    hits = each.join(index, "hash").select(*keys, "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"))
    per_shift = hits.groupBy(*keys, "shift").agg(F.sort_array(F.collect_set("item_pos")).alias("found"))
    run = F.exists(F.transform(F.array("found"), _covered), lambda places: F.size(_run_starts(places)) > 0)
    per_item = per_shift.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("matched"), F.max(run).alias("run"))
    return per_item.filter((F.col("matched") >= _least()) | F.col("run")).drop("run")


def _least() -> Column:
    """How many of an item's ``indexed`` windows are enough."""
    return F.greatest(F.ceil(F.col("indexed") * MIN_SHARE), F.least(F.col("indexed"), F.lit(MIN_WINDOWS)))


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, item_key, indexed and least windows, and the windows found at each offset."""
    text = F.col("text").cast("string")
    words = docs.filter(text.isNotNull()).select(*_row_key(), marked(text).alias("marked"))
    words = words.select("doc_id", "text_key", F.transform("marked", lambda w: F.xxhash64(_plain(w))).alias("words"), F.transform("marked", lambda w: F.xxhash64(_typed(w))).alias("typed"))
    # A row per place: hashes of columns are generated code, which those inside a function over an array are not.
    # Outer, as Spark would otherwise infer a filter on the list and compute it a second time, on every row of the scan.
    last = F.size("words") - WINDOW
    places = words.select("*", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos"))
    forms = places.select("doc_id", "text_key", "pos", _window(F.col("words"), F.col("pos")).alias("first"), _window(F.col("typed"), F.col("pos")).alias("second"))
    # The second form only where it is another one: the window holds a word that may be a name.
    either = F.when(F.col("first") == F.col("second"), F.array("first")).otherwise(F.array("first", "second"))
    doc_windows = forms.filter(F.col("pos").isNotNull()).select("doc_id", "text_key", "pos", F.explode(either).alias("hash"))
    hits = doc_windows.join(index, "hash").select("doc_id", "text_key", "item_id", "item_key", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"))
    keys = ["doc_id", "text_key", "item_id", "item_key"]
    # Per window first: a passage repeated within a document counts once per window.
    per_shift = hits.groupBy(*keys, "shift").agg(F.sort_array(F.collect_set("item_pos")).alias("found"))
    per_item = per_shift.groupBy(*keys).agg(F.collect_list(F.struct("shift", "found")).alias("offsets"))
    sizes = index.groupBy("item_id", "item_key").agg(F.count_distinct("item_pos").alias("indexed"))
    rows = per_item.join(sizes, on=(per_item.item_id.eqNullSafe(sizes.item_id)) & (per_item.item_key == sizes.item_key))
    rows = rows.select(*(per_item[k] for k in keys), "indexed", _least().alias("least"), "offsets")
    run = F.exists(F.transform("offsets", lambda o: _covered(o["found"])), lambda places: F.size(_run_starts(places)) > 0)
    return rows.filter((F.size(_together(F.col("offsets"))) >= F.col("least")) | run)


def _together(offsets: Column) -> Column:
    """The windows found at any of ``offsets``."""
    return F.array_distinct(F.flatten(F.transform(offsets, lambda o: o["found"])))


def _slots(shift: Column, places: Column) -> Column:
    """The distinct pairs of values behind the placeholders at ``places`` of the item and ``shift`` further in the document."""
    pairs = F.transform(places, lambda i: F.struct(F.get("item_words", i.cast("int")).alias("item"), F.get("doc_words", (i + shift).cast("int")).alias("doc")))
    # A word that may be a name has the value of a name, and so has whatever stands in its place.
    named = lambda w: F.when(F.startswith(w, F.lit("@i")), F.concat(F.lit("@p"), F.substring(w, 3, 1 << 20))).when(~F.startswith(w, F.lit("@")), F.concat(F.lit("@p"), w)).otherwise(w)
    slots = F.filter(pairs, lambda p: F.startswith(p["item"], F.lit("@")))
    return F.array_distinct(F.transform(slots, lambda p: F.struct(named(p["item"]).alias("item"), named(p["doc"]).alias("doc"))))


def _consistent(slots: Column) -> Column:
    """Whether each value of the item has one value in the document."""
    return F.size(F.array_distinct(F.transform(slots, lambda p: p["item"]))) == F.size(slots)


def _covered(found: Column) -> Column:
    """Places of the words inside the windows ``found``, in order."""
    return F.array_distinct(F.flatten(F.transform(found, lambda p: F.sequence(p, p + WINDOW - 1))))


def _run_starts(places: Column) -> Column:
    """Those of the ordered, distinct ``places`` at which ``RUN_WORDS`` places in a row begin."""
    return F.filter(places, lambda p, i: F.coalesce(F.get(places, i + RUN_WORDS - 1) == p + RUN_WORDS - 1, F.lit(False)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, matched, indexed, slots and re_parameterised of each (document, item) that leaks."""
    spark = docs.sparkSession
    path = scratch_path(spark, "benchmark-candidates")
    candidates(docs, benchmark_index(benchmark)).write.parquet(path)
    found = spark.read.parquet(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").alias("b_id"), F.xxhash64(text).alias("b_key"), annotated(text).alias("item_words")).distinct()
    wanted = found.select("text_key").distinct().withColumnRenamed("text_key", "wanted")
    texts = docs.select(F.xxhash64(text).alias("t_key"), text.alias("t")).join(wanted, F.col("t_key") == F.col("wanted"), "left_semi")
    texts = texts.groupBy("t_key").agg(F.min("t").alias("t")).select("t_key", annotated(F.col("t")).alias("doc_words"))
    rows = found.join(items, found.item_id.eqNullSafe(items.b_id) & (found.item_key == items.b_key)).join(texts, F.col("text_key") == F.col("t_key"))
    placed = F.transform("offsets", lambda o: F.struct(o["found"].alias("found"), o["shift"].alias("shift"), _covered(o["found"]).alias("places")))
    in_run = lambda o: F.exists(_run_starts(o["places"]), lambda p: _consistent(_slots(o["shift"], F.sequence(p, p + RUN_WORDS - 1))))
    checked = F.transform(placed, lambda o: F.struct(o["found"].alias("found"), _slots(o["shift"], o["places"]).alias("slots"), in_run(o).alias("run")))
    # Offsets with equal windows and values are one.
    aligned = F.transform(F.array_distinct(checked), lambda o: F.struct(o["found"].alias("found"), o["slots"].alias("slots"), o["run"].alias("run"), _consistent(o["slots"]).alias("sound")))
    path = scratch_path(spark, "benchmark-aligned")
    # Stored, as Spark would push the last filter below and evaluate all this again for each element.
    rows.select("doc_id", "text_key", "item_id", "item_key", "indexed", "least", aligned.alias("aligned")).write.parquet(path)
    # An offset that is enough by itself needs no others; they are looked at only where none is.
    rows = spark.read.parquet(path).withColumn("sound", F.filter("aligned", lambda o: o["sound"]))
    alone = F.filter("aligned", lambda o: o["run"] | (o["sound"] & (F.size(o["found"]) >= F.col("least"))))
    alone = F.transform(alone, lambda o: F.struct(o["found"].alias("found"), o["slots"].alias("slots")))
    agreeing = lambda o: F.filter("sound", lambda x: _consistent(F.array_union(o["slots"], x["slots"])))
    joined = lambda o: F.struct(_together(agreeing(o)).alias("found"), o["slots"].alias("slots"))
    several = F.when(F.size(_together(F.col("sound"))) >= F.col("least"), F.filter(F.transform("sound", joined), lambda o: F.size(o["found"]) >= F.col("least")))
    rows = rows.withColumn("passed", F.when(F.size(alone) > 0, alone).otherwise(several)).filter(F.size("passed") > 0)
    ranked = F.transform("passed", lambda o: F.struct(F.size(o["found"]).alias("matched"), o["slots"].alias("slots")))
    rows = rows.withColumn("best", F.array_max(ranked))
    changed = F.exists("best.slots", lambda p: p["item"] != p["doc"])
    figures = [F.col("best.matched").alias("matched"), F.col("indexed").cast("long").alias("indexed"), F.size("best.slots").alias("slots"), changed.alias("re_parameterised")]
    keys = ["doc_id", "text_key", "item_id", "item_key"]
    rows = rows.select(*keys, *figures)
    exact = verbatim(docs, verbatim_index(benchmark))
    if exact is not None:
        exact = exact.select(*keys, "matched", F.col("indexed").cast("long").alias("indexed"), F.lit(0).alias("slots"), F.lit(False).alias("re_parameterised"))
        both = rows.withColumn("way", F.lit(0)).unionByName(exact.withColumn("way", F.lit(1)))
        columns = ["matched", "indexed", "slots", "re_parameterised"]
        rows = both.groupBy(*keys).agg(F.min(F.struct("way", *columns)).alias("one")).select(*keys, *(F.col(f"one.{c}").alias(c) for c in columns))
    return rows.drop("item_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns as in ``docs``."""
    mark = "__leak_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    spark = docs.sparkSession
    path = scratch_path(spark, "benchmark-leaks")
    leaks(docs, benchmark).select("doc_id", "text_key").distinct().write.parquet(path)
    bad = spark.read.parquet(path).select(F.col("doc_id").alias(mark + "id"), F.col("text_key").alias(mark + "key"))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, (key == F.col(mark + "key")) & F.col("doc_id").eqNullSafe(F.col(mark + "id")), "left_anti").select(*docs.columns)
