"""Mixing sources to target weights by entropy balancing; built-in functions only.

A source's documents get rates r = min(most, exp(lambda * size / mean size)): among all rates that give the source its target
number of words these stay closest, in relative entropy, to one copy of each document. lambda, the dual variable of the
source's word constraint, is found by Newton iterations on the logarithm of its words, kept inside a bracket that holds it. A
rate depends on source and size alone, so documents are counted by (source, size) once, and every iteration is a
join and an aggregate over that table. Sums are decimals, so no order of addition changes them: reruns agree.

Rates become whole copies by systematic rounding: the classes of a source in order of size, a class gets the whole steps between
its first and its last cumulative rate, so a source is off by one longest document at most. What is left is settled by adding or
taking whole copies in the class that leaves the least gap, until none leaves less. The copies of a class go to
its documents in hash order; a class of any share of all rows is ranked in buckets of rows.

Defined results: a size is the number of `[^ \\t-\\r]+` in the text; null and empty texts have none, stay in the result and take no word. Null is a
source of its own, the last. A source without words has target 0; a document without words has one copy. Rows of equal id and text are separate documents and interchangeable.
An empty table gives an empty result. Columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import table, written

MOST = 3
#: A source's words by its rates come this close to its target, relatively.
CLOSE = 1e-9
#: Newton steps and halvings that are always enough: a halving gains a bit of a double.
ROUNDS = 200
#: One copy, in the whole numbers that rates are rounded to.
ONE = 1 << 32
#: Documents of a class that are ranked together: PART_ROWS, or a PARTS-th of all if that is more.
PART_ROWS = 256
PARTS = 50_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def exact(c: Column, places: int = 0) -> Column:
    """c as a decimal, whose sums don't depend on their order."""
    return c.cast(f"decimal(38,{places})")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with number: their place by code points of the source, null last. Ranges deal them, so they may be many."""
    by = F.col("source").asc_nulls_last()
    ranged = written(sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "mix-sources")
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1).drop("part", "start")


def targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """sources (key, source, size, docs) with target and full: all words by weight, none above most times a source's, the excess shared again by weight."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("number", F.lit(len(weights))).cast("int") + 1)
    shares = written(numbered(sources).withColumn("weight", weight).withColumn("cap", F.col("size") * most), "mix-shares")
    total = shares.agg(F.sum(exact(F.col("size"))).alias("t")).first()["t"] or 0
    level, full = 0.0, F.col("cap") <= 0  # words for a unit of weight
    while total:
        r = shares.agg(F.sum(F.when(full, exact(F.col("cap")))).alias("c"), F.sum(F.when(~full, exact(F.col("weight"), 6))).alias("w")).first()
        new = float(total - int(r["c"] or 0)) / float(r["w"]) if r["w"] else level
        if new <= level:
            break
        level, full = new, F.col("cap") <= F.col("weight") * new
    return shares.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).withColumn("full", full)


def rate(most: int) -> Column:
    return F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("dual") * F.col("size") / F.col("mean"))))


def solve(classes: DataFrame, shares: DataFrame, most: int) -> DataFrame:
    """shares with mean and dual: the dual variable at which a source's rates give its target.

    classes: key, size, docs. A Newton step that leaves the bracket is replaced by its middle. Each round is one join and
    aggregate of the classes of sources that aren't solved yet.
    """
    least = classes.where("size > 0").groupBy("key").agg(F.min("size").alias("least"))
    share, mean = F.col("target") / F.greatest("words", F.lit(1)), F.greatest("words", F.lit(1)) / F.col("docs")
    state = shares.withColumnRenamed("size", "words").join(least, "key", "left").withColumn("mean", mean)
    unit = F.col("least") / F.col("mean")
    state = state.withColumn("low", F.when(share < 1, F.log(share) / unit).otherwise(0.0)).withColumn("high", F.when(share > 1, log(most) / unit).otherwise(0.0))
    state = written(state.withColumn("dual", F.lit(0.0)).withColumn("done", F.col("full") | (F.col("words") == 0)), "mix-dual")
    held = F.col("docs") * F.col("size") * F.col("rate")
    for _ in range(ROUNDS):
        if state.where("NOT done").isEmpty():
            return state
        now = classes.join(state.where("NOT done").select("key", "dual", "mean", "full"), "key").withColumn("rate", rate(most))
        sums = now.groupBy("key").agg(F.sum(exact(held, 6)).cast("double").alias("g"), F.sum(exact(F.when(F.col("rate") < most, held * F.col("size") / F.col("mean")), 6)).cast("double").alias("h"))
        low, high = F.when(F.col("g") < F.col("target"), F.col("dual")).otherwise(F.col("low")), F.when(F.col("g") > F.col("target"), F.col("dual")).otherwise(F.col("high"))
        step = F.when((F.col("g") > 0) & (F.col("h") > 0), F.col("dual") + F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("h"))
        met = F.abs(F.col("g") - F.col("target")) <= F.col("target") * CLOSE
        moved = state.where("NOT done").join(sums, "key").withColumn("step", step).withColumn("low_", low).withColumn("high_", high).withColumn("met", met)
        middle = (F.col("low_") + F.col("high_")) / 2
        narrow = (middle <= F.col("low_")) | (middle >= F.col("high_"))
        dual = F.when(F.col("met"), F.col("dual")).when((F.col("step") > F.col("low_")) & (F.col("step") < F.col("high_")), F.col("step")).otherwise(middle)
        moved = moved.withColumn("next", dual).withColumn("done", F.col("met") | narrow).drop("low", "high", "dual", "g", "h", "step", "met").withColumnsRenamed({"low_": "low", "high_": "high", "next": "dual"})
        state = written(state.where("done").unionByName(moved), "mix-dual")
    return state


def whole_copies(classes: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """classes with k: the whole copies of all documents of a class, by systematic rounding in order of size."""
    one, group = F.lit(ONE), F.floor(F.sqrt(F.col("size"))).cast("long")
    rated = classes.join(solved.select("key", "words", "mean", "dual", "full", "target", "source"), "key").withColumn("rate", rate(most)).withColumn("group", group)
    rated = written(rated.withColumn("mass", exact(F.col("docs")) * exact(F.round(F.col("rate") * one))).drop("mean", "dual", "full"), "mix-rates")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = exact(F.lit(0))
    groups = rated.groupBy("key", "group").agg(exact(F.sum("mass")).alias("mass")).select("key", "group", F.coalesce(exact(F.sum("mass").over(before("key", "group"))), none).alias("start"))
    offset = exact(F.pmod(F.xxhash64("key"), one))
    placed = rated.withColumn("inner", F.coalesce(exact(F.sum("mass").over(before("key", "group", "size"))), none)).join(groups, ["key", "group"])
    placed = placed.withColumn("start", exact(F.col("start") + F.col("inner") + offset)).withColumn("end", exact(F.col("start") + F.col("mass")))
    return placed.withColumn("k", F.expr(f"(end div {ONE}) - (start div {ONE})")).select("key", "source", "words", "target", "size", "docs", "k")


def settle(classes: DataFrame, most: int) -> DataFrame:
    """classes whose copies come so near the target that no change of one class brings them nearer: each round, the class of each source that leaves the least
    gap gets or loses whole copies. Gaps shrink by a word a round at least, as a rule to a few words in some rounds."""
    classes = written(classes, "mix-copies")
    while True:
        gaps = classes.groupBy("key").agg((F.first(F.round("target").cast("decimal(38,0)")) - F.sum(exact(F.col("k") * F.col("size")))).cast("long").alias("gap"))
        room = F.when(F.col("gap") > 0, F.col("docs") * most - F.col("k")).otherwise(F.col("k"))
        wide = F.abs("gap")
        near = classes.where("size > 0").join(gaps.where("gap <> 0"), "key").withColumn("room", room).where((F.col("room") > 0) & (F.col("size") < 2 * wide))
        near = near.withColumn("q", F.least(F.col("room"), F.greatest(F.lit(1), F.floor(wide / F.col("size") + 0.5)))).withColumn("left", F.abs(wide - F.col("q") * F.col("size"))).where(F.col("left") < wide)
        best = near.groupBy("key").agg(F.min(F.struct("left", "size", "q", "gap")).alias("b")).select("key", "b.size", (F.col("b.q") * F.signum("b.gap")).cast("long").alias("move"))
        best = written(best, "mix-moves")
        if best.isEmpty():
            return classes
        classes = written(classes.join(best, ["key", "size"], "left").withColumn("k", F.col("k") + F.coalesce("move", F.lit(0))).drop("move"), "mix-copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST, keep: tuple[str, ...] | None = None, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns `keep` of docs (all, if None) with size, source_size, target, copies and taken (copies * size).

    Sources by code point weigh `weights`, repeating. Jobs run while it is called: documents are counted by source and size,
    the dual is solved, copies are rounded.
    """
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    source = F.col(source_col).cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in rest]).alias("row"), source.alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(*[F.col(c).cast("string") for c in rest if dict(docs.dtypes)[c] in ("bigint", "int", "string")], text_col).alias("h"))
    rows = written(rows.select("row", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source", "size", "h"), "mix-rows")
    classes = written(rows.groupBy("key", "source", "size").agg(F.count("*").alias("docs")), "mix-classes")
    sources = classes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("size"), F.sum("docs").alias("docs"))
    shares = targets(sources, weights, most)
    counts = classes.drop("source")
    settled = settle(whole_copies(counts, solve(counts, shares, most), most), most)
    each = max(PART_ROWS, -(-rows.count() // PARTS))
    large = settled.where(F.col("docs") > each).select("key", "size", F.ceil(F.col("docs") / each).cast("int").alias("parts"))  # PARTS rows at most
    dealt = rows.drop("source").join(F.broadcast(large), ["key", "size"], "left").withColumn("part", F.coalesce(F.pmod("h", "parts"), F.lit(0)).cast("int")).drop("parts")
    cells = dealt.groupBy("key", "size", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    facts = cells.join(settled, ["key", "size"])
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h")) - 1
    ranked = dealt.withColumn("place", place).join(facts, ["key", "size", "part"])
    copies = F.expr("k div docs") + F.when(F.col("start") + F.col("place") < F.col("k") % F.col("docs"), 1).otherwise(0)
    return ranked.select("row.*", "size", F.col("words").alias("source_size"), "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix() as many times as it has copies, numbered from 1 in `copy`."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; sources weigh 1, 2, 3, repeating, and give three copies of a document at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken", "copies")
