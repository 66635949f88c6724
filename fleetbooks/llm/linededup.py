"""Line dedup: later copies of repeated runs of lines are deleted.

Lines become ids, documents become sequences of ids, and windows of these get names
by doubling: the name of the first 2^j lines comes from the names of both halves.
Windows of one name are grouped; two overlapping names give that of a run of any
length. Names double up to the longest window that is asked for. No suffix is ordered:
hashed windows stand in for the suffix array.

A run counts if it has ``MIN_WORDS`` words. It is enough to look at the shortest such
runs from each line on and up to each line: a maximal repeated run is their union.
Everything is DataFrame operations. Lines travel as two 64-bit hashes; texts are
shuffled once, to meet the lines they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbooks.llm.common import written

MIN_WORDS = 5

# Fixed value: what separates words within a line.
WORD = r"[^ \t\r\f\x0B]+"

# A document: struct of its id and a hash of its text. A struct is never null, so
# rows without an id meet in joins as well.
KEY = ["doc"]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(rows: DataFrame) -> DataFrame:
    """A row for each line: its place ``n``, two hashes, words, and words up to its end."""
    lines = rows.select(*KEY, F.posexplode(_split(F.col("text"))).alias("n", "line"))
    hashes = [F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b")]
    words = F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")
    lines = lines.select(*KEY, "n", *hashes, words).repartition(*KEY).dropDuplicates([*KEY, "n"])
    so_far = Window.partitionBy(*KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("upto", F.sum("words").over(so_far))


def _shortest(lines: DataFrame, words: int) -> DataFrame:
    """The shortest runs with enough words, from each line on and up to each line."""
    own = Window.partitionBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goal, end = F.lit(True), F.lit(False)

    def events(at: Column, wanted: Column) -> DataFrame:
        marks = F.explode(F.array(F.struct(at.alias("v"), end.alias("asks")), F.struct(wanted.alias("v"), goal.alias("asks"))))
        return lines.select(*KEY, "n", marks.alias("e")).select(*KEY, "n", "e.v", "e.asks")

    seen = F.last(F.when(~F.col("asks"), F.col("n")), ignorenulls=True)
    ahead = events(F.col("upto"), F.col("upto") - F.col("words") + words)
    ahead = ahead.withColumn("found", seen.over(own.orderBy(F.desc("v"), "asks", F.desc("n"))))
    ahead = ahead.filter("asks and found is not null").select(*KEY, F.col("n").alias("s"), F.col("found").alias("e"))
    back = events(F.col("upto") - F.col("words"), F.col("upto") - words)
    back = back.withColumn("found", seen.over(own.orderBy("v", "asks", "n")))
    back = back.filter("asks and found is not null").select(*KEY, F.col("found").alias("s"), F.col("n").alias("e"))
    return ahead.unionByName(back).dropDuplicates([*KEY, "s", "e"])


def _named(lines: DataFrame, runs: DataFrame, longest: int) -> DataFrame:
    """``runs`` with the names of what they hold."""
    place = Window.partitionBy(*KEY).orderBy("n")
    a, b = [F.col("a")], [F.col("b")]
    names = lines.select(*KEY, "n", "a", "b")
    step = 1
    while 2 * step <= longest:
        k = len(a)
        for x, name in ((a, f"a{k}"), (b, f"b{k}")):
            names = names.withColumn(name, F.xxhash64(x[-1], F.lead(x[-1], step).over(place)))
            x.append(F.col(name))
        step *= 2
    names = names.select(*KEY, "n", F.array(*a).alias("a"), F.array(*b).alias("b"))
    # One line is its own name; of longer runs both ends are looked up.
    size = F.col("e") - F.col("s") + 1
    depth = F.floor(F.log2(size)).cast("int")
    runs = runs.withColumn("size", size).withColumn("depth", depth)
    runs = runs.withColumn("t", (F.col("e") + 1 - F.pow(F.lit(2), F.col("depth"))).cast("int"))
    head = names.withColumnRenamed("n", "s")
    one = runs.filter("size = 1").join(head, [*KEY, "s"])
    one = one.select(*KEY, "s", "e", F.get("a", F.lit(0)).alias("a"), F.get("b", F.lit(0)).alias("b"))
    many = runs.filter("size > 1")
    tail = names.select(*KEY, F.col("n").alias("t"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    many = many.join(head, [*KEY, "s"]).join(tail, [*KEY, "t"])
    pair = lambda x, y: F.xxhash64(F.get(x, F.col("depth")), F.get(y, F.col("depth")), F.col("size"))
    many = many.select(*KEY, "s", "e", pair("a", "ta").alias("a"), pair("b", "tb").alias("b"))
    return one.unionByName(many)


def repeated(rows: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: ``doc`` and ``n``, from rows with ``doc`` and ``text``."""
    lines = written(_lines(rows), "lines")
    runs = written(_shortest(lines, words), "runs")
    longest = runs.agg(F.coalesce(F.max(F.col("e") - F.col("s") + 1), F.lit(1)).alias("n")).first()["n"]
    runs = written(_named(lines, runs, longest), "names")
    # Earlier: by id, then by text, then by place; null ids come first.
    where = F.struct(*KEY, "s")
    first = runs.groupBy("a", "b").agg(F.min(where).alias("first"), F.count("*").alias("times"))
    first = written(first.filter("times > 1"), "intervals")
    later = runs.join(first, ["a", "b"]).filter(~where.eqNullSafe(F.col("first")))
    return later.select(*KEY, F.explode(F.sequence("s", "e")).alias("n")).distinct()


def without_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = MIN_WORDS
) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the lines that stand in a run of at
    least ``words`` words which also begins earlier (smaller id, or earlier line), and
    as last columns ``n_lines`` and ``n_removed``. Columns of ``docs`` with these names are
    replaced.

    Runs are judged on the input and do not cross documents. Lines are parted by
    \\n; what is left is joined by it. A null text stays null and has no lines, an
    empty one has one empty line. Of rows with one id and different texts, an order
    by a hash of the text decides which is earlier; rows equal in id and text are
    one document and lose the same lines. A missing id comes before all others.
    """
    docs = docs.drop("n_lines", "n_removed")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.struct(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("print")).alias("doc"),
        F.col(text).cast("string").alias("text"),
    )
    told = rows.filter(F.col("text").isNotNull()).select(*KEY, "text")
    lost = repeated(told, words).groupBy(*KEY).agg(F.array_sort(F.collect_list("n")).alias("lost"))
    found = rows.join(written(lost, "lost"), KEY, "left")
    lines = _split(F.col("text"))
    # What stands between lost lines stays, cut out as whole slices.
    edges = F.concat(F.array(F.lit(-1)), F.col("lost"), F.array(F.size("lines")))
    cut = lambda k: F.struct((F.get("edges", k) + 2).alias("at"), (F.get("edges", k + 1) - F.get("edges", k) - 1).alias("n"))
    found = found.withColumn("lines", F.when(F.col("lost").isNotNull(), lines)).withColumn("edges", edges)
    cuts = F.filter(F.transform(F.sequence(F.lit(0), F.size("lost")), cut), lambda x: x["n"] > 0)
    kept = F.flatten(F.transform(cuts, lambda x: F.slice("lines", x["at"], x["n"])))
    changed = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    n_removed = F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost"))
    return found.select(
        *((changed if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns),
        n_lines.cast("long").alias("n_lines"),
        n_removed.cast("long").alias("n_removed"),
    )
