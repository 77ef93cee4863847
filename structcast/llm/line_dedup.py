"""Exact set-similarity join of lines with prefix, positional and length filters; the later of two matches goes.

Only DataFrame functions. A line is the sorted array of its distinct tokens as longs: the high byte is the token's
frequency class, the rest its hash, so that ascending order is from rare to frequent. Two sets with Jaccard similarity t
or more share one of their first n - ceil(t * n) + 1 tokens. Postings, a row for each of these, meet by token. A line
is first held against the earliest of its group, which ends groups of near copies; only lines without a match are then
joined with all that share a token. Matches are verified on texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import Slots, discard, release, stored, written

COUNTERS = 1 << 16
CHUNK_BITS = 17  # a token that has more occurrences than two to the power of this is dealt in chunks of about as many
BANDS = 3  # of sizes, for each power of two
SKETCH = 1 << 7  # bits of a sketch
# white space, and letters beyond ASCII that lower() would change or that a newer Unicode may call capitals
OTHERS = r"[\t\r\x0b\x0c[\x{80}-\x{10ffff}&&[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(line: Column) -> Column:
    """Lower case in A-Z and spaces for other white space; lines without such and without other capitals take the fast way."""
    return F.when(line.rlike(OTHERS), F.translate(line, UPPER + "\t\r\x0b\x0c", LOWER + " " * 4)).otherwise(F.lower(line))


def _lines(texts: DataFrame, words: str = "words") -> DataFrame:
    """doc_id, tie, line (number) and words of every line."""
    return texts.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line", words))


def _longs(values: list[int]) -> Column:
    """An array of longs as a constant."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def token_classes(texts: DataFrame) -> Column:
    """A column of COUNTERS frequency classes, as high bytes of longs: of all tokens whose hash falls on a counter, four classes for each power of two of their count.

    The counters hold every token of every text, here without case in all letters. The driver gets a number for each.
    """
    token = F.explode(F.split(F.lower("text"), "[ \\t-\\r]")).alias("token")
    slot = F.xxhash64("token").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("slot")
    class_ = F.least(F.floor(4 * F.log2(F.col("count") + 1)), F.lit(127))
    classes = [0] * COUNTERS
    for at, c in texts.select(token).groupBy(slot).count().select("slot", class_).collect():  # at most COUNTERS rows
        classes[at] = c << 56
    return _longs(classes)


def _hashes(line: Column) -> Column:
    """The line's distinct tokens."""
    return F.array_remove(F.array_distinct(F.transform(F.split(_lowered(line), " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def _at(table: Column, number: Column, size: int) -> Column:
    return F.get(table, number.bitwiseAND(F.lit(size - 1)).cast("int"))


def token_set(line: Column, classes: Column) -> Column:
    """The line's distinct tokens, rare ones first."""
    return F.sort_array(F.transform(_hashes(line), lambda h: _at(classes, h, COUNTERS).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _sketch(tokens: Column, half: int) -> Column:
    """64 of 128 parity bits: two sketches differ in no more bits than their sets do in tokens. Tables are faster here than shifts."""
    bits = _longs([(1 << (k % 64)) - (k % 64 == 63) * 2**64 if k // 64 == half else 0 for k in range(SKETCH)])
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda held, t: held.bitwiseXOR(_at(bits, t, SKETCH)))


def _sets(texts: DataFrame, classes: Column, percent: int) -> DataFrame:
    """A row for each line: where it is, size, two hashes of its set, sketch and prefix. Lines without tokens have size 0."""
    sets = _lines(texts).select("doc_id", "tie", "line", token_set(F.col("words"), classes).alias("tokens"))
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return sets.select("doc_id", "tie", "line", n.alias("n"), F.xxhash64("tokens").alias("sid"), F.xxhash64(F.lit(1), "tokens").alias("check"), _sketch(F.col("tokens"), 0).alias("bits"), _sketch(F.col("tokens"), 1).alias("more"), prefix.alias("prefix"))


def _first_lines(lines: DataFrame, several: DataFrame) -> DataFrame:
    """The first line of each set. several: sid, check and first of the sets that occur more than once."""
    marked = Slots(several, "sid").marked(lines, "maybe", "sid")
    again = marked.where("maybe").join(several, ["sid", "check"], "left").where(F.col("first").isNull() | (F.struct("doc_id", "tie", "line") == F.col("first")))
    return marked.where("not maybe").drop("maybe").unionByName(again.drop("maybe", "first"))


def _n(x: str) -> Column:
    return F.shiftrightunsigned(f"{x}place", 32)


def _i(x: str) -> Column:
    return F.shiftrightunsigned(f"{x}place", 1).bitwiseAND(F.lit((1 << 31) - 1))


def _open(x: str) -> Column:
    return F.col(f"{x}place").bitwiseAND(F.lit(1)) == 1


def _fits(percent: int, x: str, y: str) -> Column:
    """Length filter, positional filter and sketch of postings x and y (prefixes of column names)."""
    n, m = _n(x), _n(y)
    need = F.ceil((n + m) * percent / (100 + percent))
    length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    place = F.least(n - _i(x), m - _i(y)) >= need
    away = [F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in ("bits", "more")]
    sketch = away[0] + away[1] <= n + m - 2 * need
    return (F.col(f"{x}sid") != F.col(f"{y}sid")) & length & place & sketch


def _postings(first: DataFrame, prefix: str, open_: Column) -> DataFrame:
    """A row for each token of each prefix: token, sid, doc_id, place (size, number in the prefix and whether it is open, in one number), bits and more (sketch)."""
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(open_.cast("long")).alias("place")
    return first.select("*", F.posexplode(prefix).alias("i", "token")).select("token", "sid", "doc_id", place, "bits", "more", "n")


def _with_hubs(first: DataFrame, percent: int) -> DataFrame:
    """a and b: of each token and each power of sizes the earliest set, and each later one that it fits.

    Tokens that occur very often are dealt in chunks, each with a hub of its own. Of each prefix it takes the part that
    sets share with larger ones; what this leaves is found by _sharing.
    """
    short = F.slice("prefix", F.lit(1), F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)).cast("int") + 1)
    times = F.floor(F.shiftright("token", 56) / 4).cast("int")  # its power of two, as counted
    chunk = F.pmod("sid", F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(times - CHUNK_BITS, F.lit(0))))
    group = F.xxhash64("token", chunk, F.floor(F.log2("n") * BANDS)).alias("group")
    dealt = _postings(first.withColumn("short", short).drop("prefix"), "short", F.lit(True)).select(group, "sid", "doc_id", "place", "bits", "more")
    earliest = Window.partitionBy("group").orderBy("doc_id", "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_hub = dealt.select("*", *[F.first(c).over(earliest).alias(f"hub_{c}") for c in ("sid", "place", "bits", "more")])
    return with_hub.where(_fits(percent, "hub_", "")).select(F.col("hub_sid").alias("a"), F.col("sid").alias("b"))


def _sharing(first: DataFrame, percent: int) -> DataFrame:
    """a and b: sets that share a token and fit, the later of them open. Both sides of the join read one exchange."""
    x, y = (_postings(first, "prefix", F.col("open")).select("token", *[F.col(c).alias(f"{k}_{c}") for c in ("sid", "doc_id", "place", "bits", "more")]) for k in "xy")
    open_ = ((F.col("x_doc_id") <= F.col("y_doc_id")) & _open("y_")) | ((F.col("x_doc_id") >= F.col("y_doc_id")) & _open("x_"))
    both = x.join(y, (x["token"] == y["token"]) & (F.col("x_sid") < F.col("y_sid")) & open_ & _fits(percent, "x_", "y_"))
    return both.select(F.col("x_sid").alias("a"), F.col("y_sid").alias("b"))


def _later(pairs: DataFrame, texts: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """sid and check of the later set of each pair (a, b) of sids whose Jaccard similarity is high enough."""
    both = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    release(texts.sparkSession)
    wanted = stored(both.select(F.col("a").alias("sid")).union(both.select(F.col("b").alias("sid"))).distinct(), "wanted")
    found = Slots(wanted, "sid").among(firsts, "sid").join(wanted, "sid", "left_semi")
    places = stored(found.select("sid", "check", "first", "first.doc_id", "first.tie", "first.line"), "places")
    lines = Slots(places, "doc_id", "tie", "line").among(_lines(Slots(places, "doc_id").among(texts, "doc_id")), "doc_id", "tie", "line")
    sets = stored(lines.join(places, ["doc_id", "tie", "line"]).dropDuplicates(["sid", "check"]).select("sid", "check", "first", _hashes(F.col("words")).alias("tokens")), "sets")
    release(texts.sparkSession)
    x, y = (sets.select(F.col("sid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("check", "first", "tokens")]) for k in ("a", "b"))
    same = F.size(F.array_intersect("tokens_a", "tokens_b"))
    near = both.join(x, "a").join(y, "b").where(same * (100 + percent) >= (F.size("tokens_a") + F.size("tokens_b")) * percent)
    b_late = F.col("first_a") < F.col("first_b")
    late = near.select(F.when(b_late, F.col("b")).otherwise(F.col("a")).alias("sid"), F.when(b_late, F.col("check_b")).otherwise(F.col("check_a")).alias("check"))
    return stored(late.distinct(), "later")


def removed_lines(texts: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, tie (hash of the text) and gone (numbers of the lines that go, from 0) of the documents that lose lines. texts: doc_id, text."""
    spark = texts.sparkSession
    texts = texts.where("doc_id is not null and text is not null").withColumn("tie", F.xxhash64("text"))
    every = stored(_sets(texts, token_classes(texts), percent), "sets").where("n > 0")
    wide = written()[-1]
    firsts = stored(every.groupBy("sid", "check").agg(F.min(F.struct("doc_id", "tie", "line")).alias("first"), F.count("*").alias("times")), "firsts")
    several = firsts.where("times > 1").select("sid", "check", "first")
    first = stored(_first_lines(every, several).select("sid", "check", "doc_id", "n", "bits", "more", "prefix"), "first")
    lines = stored(every.select("doc_id", "tie", "line", "sid", "check"), "lines")
    discard(spark, [wide])
    release(spark)

    # Each set with the earliest of its groups, then every set that has no match yet with all that share a token.
    later = _later(_with_hubs(first, percent), texts, firsts, percent)
    release(spark)
    marked = Slots(later, "sid").marked(first, "maybe", "sid")
    matched = marked.where("maybe").join(later.withColumn("open", F.lit(False)), ["sid", "check"], "left")
    first = marked.where("not maybe").withColumn("open", F.lit(True)).unionByName(matched.withColumn("open", F.coalesce("open", F.lit(True))))
    later = later.unionByName(_later(_sharing(first, percent), texts, firsts, percent))
    release(spark)

    marks = several.withColumn("whole", F.lit(False)).unionByName(later.select("sid", "check", F.lit(None).cast(several.schema["first"].dataType).alias("first"), F.lit(True).alias("whole")))
    marks = stored(marks.groupBy("sid", "check").agg(F.max("first").alias("first"), F.max("whole").alias("whole")), "marks")
    hit = Slots(marks, "sid").among(lines, "sid").join(marks, ["sid", "check"])
    hit = hit.where(F.col("whole") | (F.struct("doc_id", "tie", "line") != F.col("first")))
    return stored(hit.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("gone")), "gone")


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later lines gone from their texts; other columns stay, and n_lines_gone tells how many went.

    Lines are what line feeds part; their tokens are lower-cased in A-Z and parted by ASCII white space. A line goes if
    an earlier line, by id, hash of the text and line number, has a set of tokens with a Jaccard similarity of percent /
    100 or more to its own, whether or not that line goes itself. Lines without tokens stay. Rows with a null id or text
    stay as they are and match nothing; rows equal in id and text count as one. An empty table gives an empty result.
    Lines count as equal if two 64-bit hashes of their sets are; other matches are verified on the 64-bit hashes of all
    their tokens.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = removed_lines(own, percent)
    marked = Slots(gone, "doc_id").marked(docs, "__maybe", F.col(id_col).cast("long"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "tie": "__tie", "gone": "__gone"})
    maybe = marked.where("__maybe")
    changed = maybe.join(gone.hint("shuffle_hash"), (maybe[id_col].cast("long") == gone["__id"]) & (F.xxhash64(maybe[text_col]) == gone["__tie"]), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    changed = changed.withColumn("n_lines_gone", F.coalesce(F.size("__gone"), F.lit(0)))
    changed = changed.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left))
    same = marked.where("not __maybe").withColumn("n_lines_gone", F.lit(0))
    return changed.drop("__maybe", "__id", "__tie", "__gone").unionByName(same.drop("__maybe"))
