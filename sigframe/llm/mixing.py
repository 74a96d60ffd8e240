"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of all words by its weight, at most ``CAP`` times its own words; what is above is shared among the others by weight. Of a source that
is to give ``r`` times its words, every document is taken ``floor(r)`` times for certain. The rest is a sample with probability proportional to size: a document's
inclusion probability is ``c`` times its size (its first seven binary digits), with ``c`` such that the expected words are the rest, and documents for which
that is 1 or more are taken for certain too. The others are ranked by their random odds over their inclusion odds, ``u / (1 - u)`` over
``p / (1 - p)``, and taken in that order until the words add up to the rest. ``u`` comes from a hash of the document, so reruns
agree. The last document of a source is taken in part, as many of its words as are wanting; so every source meets its target to a word.

Where the order is cut is found from sums over 4,096 equal ranges of rank, and again within the range of the cut, three times; no source is ever sorted
as a whole, and a hot one is summed before it is shuffled. The table of a row for each source is broadcast if it is counted and found small, and otherwise joined by a shuffle.

Null texts are of size 0, and take part without being taken. A null source is a source of its own, the last one. Repeated rows are sized and taken each on its own. An empty table
gives no rows. No column but id, text and source is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
STEP, LEVELS = 4096, 3
SEED = 9
#: Up to so many sources their table (some hundred bytes a row) is broadcast, so texts are not shuffled; beyond it is a shuffled join.
BROADCAST_SOURCES = 20_000
#: Rows of one rank that are counted together.
BLOCK = 4096


def words_of(text_col: str) -> Column:
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def source_key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(col)), F.lit("n"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(_source, source_size, target) from rows (_source, _size): each source's words and how many the mix is to have."""
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    # From here there is one row per source. "n", the null source, comes after every "s...": so order by code points alone.
    order = Window.orderBy(F.col("_source") == "n", "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sums.select("*", weight.alias("w")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("w"), "_source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))
    rows = rows.withColumn("level", F.coalesce(F.max(fits).over(everything), F.lit(float("inf"))))
    return rows.select("_source", "source_size", F.least(F.col("w") * F.col("level"), F.col("most")).alias("target"))


def measure(size: Column) -> Column:
    """The size with only its first seven binary digits, so a source has some hundred different ones at most."""
    low = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def _wanted(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """With the certain copies of each document, the words wanting beyond them, the factor of inclusion and the largest measure that isn't certain."""
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = goal.withColumn("_copies", F.floor(r + F.lit(1e-12)))
    rest = F.round(F.greatest(F.lit(0.0), F.col("target") - F.col("_copies") * F.col("source_size"))).cast("long")
    rows = stored(rows.withColumn("_rest", rest), "rests")
    classes = sized.where("_size > 0").groupBy("_source", measure(F.col("_size")).alias("_g")).agg(F.sum("_size").alias("w"))
    down = Window.partitionBy("_source").orderBy(F.desc("_g"))
    above = F.coalesce(F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.sum(F.col("_g") * F.col("w")).over(down.rowsBetween(0, Window.unboundedFollowing))
    solved = classes.join(rows.where("_rest > 0").select("_source", "_rest"), "_source").withColumn("_above", above)
    solved = solved.withColumn("_c", (F.col("_rest") - F.col("_above")) / tail).where(F.col("_c") * F.col("_g") <= 1)
    first = solved.groupBy("_source").agg(F.max(F.struct("_g", "_c", "_above")).alias("s"))
    first = first.select("_source", F.col("s._g").alias("_most"), F.col("s._c").alias("_c"), F.col("s._above").alias("_above"))
    joined = rows.join(first, "_source", "left").withColumn("_rest", F.col("_rest") - F.coalesce("_above", F.lit(0)))
    return joined.drop("_above")


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 from the document."""
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")), whole_text(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _certain() -> Column:
    """Taken once more than the other documents of its source, whatever its rank."""
    return F.coalesce((F.col("_size") > 0) & (measure(F.col("_size")) > F.col("_most")), F.lit(False))


def _odds() -> Column:
    """Random odds over inclusion odds; empty documents come last."""
    p = F.col("_c") * measure(F.col("_size"))
    return F.when((F.col("_size") > 0) & (p > 0), (F.col("_u") / (1 - F.col("_u"))) / (p / F.greatest(1 - p, F.lit(1e-15)))).otherwise(F.lit(1e30))


def _rank() -> Column:
    """The odds, brought to [0, 1) in the same order, as a whole number of ``STEP ** LEVELS`` steps."""
    q = _odds()
    return F.least(F.floor(q / (1 + q) * float(STEP**LEVELS)), F.lit(STEP**LEVELS - 1))


def cuts(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with the rank at which each source's order is cut and the words of all lower ranks."""
    wanted = stored(_wanted(sized, goal), "wanted")
    open_ = wanted.where("_rest > 0")
    rows = sized.join(open_.select("_source", "_most", "_c"), "_source").where(~_certain()).select("_source", "_size", _rank().alias("_rank"))
    at = open_.select("_source", "_rest", F.lit(0).cast("long").alias("_cut"), F.lit(0).cast("long").alias("_below"))
    for level in range(1, LEVELS + 1):
        width = STEP ** (LEVELS - level)
        prefix = F.floor(F.col("_rank") / F.lit(width * STEP))
        inside = rows.join(at, "_source").where(prefix == F.col("_cut"))
        sums = inside.groupBy("_source", "_rest", "_below", F.floor(F.col("_rank") / F.lit(width)).alias("_part")).agg(F.sum("_size").alias("n"))
        order = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of STEP rows at most
        sums = sums.withColumn("_below", F.col("_below") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        hit = sums.where((F.col("_below") < F.col("_rest")) & (F.col("_below") + F.col("n") >= F.col("_rest")))
        at = stored(hit.select("_source", "_rest", F.col("_part").alias("_cut"), "_below"), f"cut{level}")
    return stored(wanted.join(at.drop("_rest"), "_source", "left"), "cuts")


def take(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with (_source, _size, _u, _id) and the words taken of each in ``_taken``, the certain ones among them."""
    few = goal.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(goal) if few else goal, "_source").withColumn("_rank", _rank())
    sure = F.col("_copies") * F.col("_size") + F.when(_certain(), F.col("_size")).otherwise(0)
    away = F.col("_cut").isNull() | (F.col("_rank") != F.col("_cut")) | _certain()
    whole = joined.where(away).withColumn("_taken", sure + F.when((F.col("_rank") < F.col("_cut")) & ~_certain(), F.col("_size")).otherwise(0))
    return whole.unionByName(_at_the_cut(joined.where(~away).withColumn("_sure", sure)))


def _at_the_cut(joined: DataFrame) -> DataFrame:
    """What shares the rank of the cut, one of 2 ** 36, put in order, with the words taken of each.

    That is a few rows, or very many equal ones (of one id and text). Equal rows of a block of ``BLOCK`` are counted as one, blocks are put in order by
    these counts, and each row is numbered within its block: no task has all equal rows. The rows are stored, for their places must stay the same.
    """
    names = joined.columns
    tied = stored(joined.withColumns({"_q": _odds(), "_place": F.monotonically_increasing_id()}), "tied")
    tied = tied.withColumn("_block", F.floor(F.col("_place") / BLOCK))
    equal = ["_block", "_source", "_u", "_id"]
    blocks = tied.groupBy("_q", *equal).agg(F.sum("_size").alias("_n"))
    order = Window.partitionBy("_source").orderBy("_q", "_u", "_id", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    blocks = stored(blocks.select(*[F.col(c).alias(f"{c}_of") for c in equal], "_before"), "tied_blocks")
    number = F.row_number().over(Window.partitionBy(*equal).orderBy("_place"))
    same = F.col("_id").eqNullSafe(F.col("_id_of"))
    for c in equal[:-1]:
        same &= F.col(c) == F.col(f"{c}_of")
    rows = tied.withColumn("_number", number).join(blocks, same)
    before = F.col("_below") + F.col("_before") + (F.col("_number") - 1) * F.col("_size")
    taken = F.col("_sure") + F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - before))
    return rows.select(*[c for c in names if c != "_sure"], taken.alias("_taken"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    key = F.col(id_col).cast("long")
    return [key.alias("_id"), source_key(source_col).alias("_source"), words_of(text_col).alias("_size"), _uniform(key, F.col(text_col)).alias("_u")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    rows = stored(docs.select(*_sized(docs, id_col, text_col, source_col)), "sizes")
    goal = cuts(rows, targets(rows, weights, share, cap))
    return take(rows, goal).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: every document as often as it is taken, its columns as they were. Of the one that a source takes in part a whole copy comes if half of it is taken."""
    rows = docs.select("*", *_sized(docs, id_col, text_col, source_col))
    sizes = stored(rows.select("_source", "_size", "_u"), "sizes")
    taken = take(rows, cuts(sizes, targets(sizes, weights, share, cap)))
    copies = F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(F.col("_copies")).cast("int")
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).select(docs.columns)
