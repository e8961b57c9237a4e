"""Mixing sources to target weights by entropy balancing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import checked, cut, drop

WORD = r"[^\x20\x09-\x0D]+"
#: Rounding priorities are first summed by so many classes.
PRIORITY_CLASSES = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for every source of sizes(source, size).

    Sources by code point, null last, weigh `weights` in turn and share all sizes; a
    target stops at `most` times its source's size, and the excess is shared again by
    weight until none is above. Closed form: in the order of size by weight the sources
    fill up one after the other, so the level at which the rest stand follows from
    running sums. Windows here run over one row a source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = each.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    stands = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.withColumn("stands", stands).select("source", "source_size", F.least("cap", F.coalesce(F.col("stands") * F.col("weight"), F.lit(0.0))).alias("target"))


def _priced(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*more, F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def _of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of their source's row in table."""
    named = checked(table.withColumnRenamed("source", "of_source"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def rate_of(size: str, mean: str, tilt: str, most: float):
    """A document's rate: exp(tilt * size / mean size), most at most, 0 without words."""
    raw = F.exp(F.least(F.col(tilt) * F.col(size) / F.col(mean), F.log(F.lit(float(most)))))
    return F.when(F.col(size) == 0, 0.0).when(raw > most - 1e-9, float(most)).otherwise(raw)


def newton_step(state: DataFrame, by_size: DataFrame, most: float, close: float) -> DataFrame:
    """state(source, source_size, target, mean, tilt, low, high, done) after one step.

    The gradient of a source's convex dual is the words at its tilt less the target, the
    second derivative the words times size / mean; both are sums over all documents, with
    map-side sums, made of whole numbers so that reruns agree to the last bit. A step that
    leaves the bracket known so far halves or doubles it instead.
    """
    met = _of_source(by_size, state.where("not done").select("source", "mean", "tilt"))
    words = F.col("n") * F.col("size") * rate_of("size", "mean", "tilt", most)
    bends = F.when(rate_of("size", "mean", "tilt", most) < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
    whole = lambda x: F.sum(F.round(x * 1024).cast("decimal(38,0)")).cast("double") / 1024
    sums = met.groupBy("source").agg(whole(words).alias("words"), whole(bends).alias("slope")).withColumnRenamed("source", "of")
    now = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    over = F.col("words") - F.col("target")
    now = now.withColumn("over", over).withColumns({"low": F.when(F.col("over") <= 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))})
    newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("over") / F.col("slope"))
    inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
    wider = F.when(F.col("low").isNull(), F.col("high") - F.greatest(F.lit(1.0), F.abs("high"))).otherwise(F.col("low") + F.greatest(F.lit(1.0), F.abs("low")))
    other = F.coalesce((F.col("low") + F.col("high")) / 2, wider)
    met_now = F.abs(F.col("over")) <= close * F.col("target")
    step = F.when(F.col("done") | met_now, F.col("tilt")).when(inside, newton).otherwise(other)
    return now.select("source", "source_size", "target", "mean", step.alias("tilt"), "low", "high", (F.col("done") | F.coalesce(met_now, F.lit(False))).alias("done"))


def _tilts(sizes: DataFrame, weights: tuple[float, ...], most: int, close: float = 1e-6, steps: int = 100) -> DataFrame:
    """(source, source_size, target, tilt, mean): the tilts of all sources by distributed
    Newton steps, an aggregate a step over the documents by their own sizes, until each is
    within close of its target (rounding then meets it to the word)."""
    by_size = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "by-size")
    targets = source_targets(by_size.select("source", (F.col("n") * F.col("size")).alias("size")), weights, most)
    means = by_size.groupBy(F.col("source").alias("of")).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    start = targets.join(means, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    none, all_ = (F.col("target") <= 0) | (F.col("source_size") == 0), F.col("target") >= most * F.col("source_size")
    tilt = F.when(none, float("-inf")).when(all_, float("inf")).otherwise(0.0)
    nothing = F.lit(None).cast("double")
    state = cut(start.select("source", "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"), tilt.alias("tilt"), nothing.alias("low"), nothing.alias("high"), (none | all_).alias("done")), "tilts")
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        after = cut(newton_step(state, by_size, most, close), "tilts")
        drop(state)
        state = after
    return state.select("source", "source_size", "target", "tilt", "mean")


def _rated(rows: DataFrame, tilts: DataFrame, most: int, seed: int) -> DataFrame:
    """rows with rate, whole copies, and the place in the order for one copy more (null:
    none is due)."""
    met = _of_source(rows, tilts).withColumn("rate", rate_of("size", "mean", "tilt", most)).drop("mean", "tilt")
    u = (F.xxhash64(F.col("id"), F.lit(seed)).bitwiseAND((1 << 52) - 1) + 1) / float(1 << 52)
    part = F.col("rate") - F.floor("rate")
    return met.withColumn("copies", F.floor("rate")).withColumn("priority", F.when(part > 0, u / part))


def _cuts(rated: DataFrame) -> DataFrame:
    """Where each source's missing words run out in the order of priority, id and size:
    (source, cut_priority, cut_id, cut_size, cut_extra). What stands before the cut takes
    one copy more, the row there cut_extra words. Words are first summed by priority
    class; rows of the one class a source that holds the cut are then ordered."""
    slot = F.floor(F.col("priority") / (1 + F.col("priority")) * PRIORITY_CLASSES).cast("int")
    rated = rated.withColumn("slot", slot)
    slots = rated.groupBy("source", "slot").agg(F.sum(F.col("copies") * F.col("size")).alias("whole"), F.sum("size").alias("words"), F.min("target").alias("target"))
    slots = slots.withColumn("open", F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0))
    of_source = Window.partitionBy("source")
    missing = F.round("target").cast("long") - F.sum("whole").over(of_source)
    before = F.coalesce(F.sum("open").over(of_source.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = cut(slots.select("source", "slot", "open", missing.alias("missing"), (missing - before).alias("room")), "slots")

    cross = slots.where("slot is not null and room > 0 and room <= open").select("source", F.col("slot").alias("cut_slot"), "room")
    rows = _of_source(rated.select("source", "slot", "priority", "id", "size"), cross).where("slot = cut_slot")
    same = rows.groupBy("source", "room", "priority", "id", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("priority", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = same.withColumn("left", F.col("room") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    at = left.where((F.col("left") > 0) & (F.col("left") <= F.col("n") * F.col("size")))
    at = at.select(F.col("source").alias("of"), F.col("priority").alias("cut_priority"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor(F.col("left") / F.col("n")).alias("cut_extra"))
    sources = slots.groupBy("source").agg(F.max("missing").alias("missing"))
    whole = F.when(F.col("missing") > 0, float("inf")).otherwise(-1.0)  # all or none take one more
    met = sources.join(at, F.col("source").eqNullSafe(F.col("of")), "left")
    return cut(met.select("source", F.coalesce("cut_priority", whole).alias("cut_priority"), "cut_id", "cut_size", "cut_extra"), "cuts")


def _taken(rated: DataFrame, cuts: DataFrame) -> DataFrame:
    """rated with taken."""
    p, at = F.col("priority"), F.col("cut_priority")
    earlier = (F.col("id") < F.col("cut_id")) | (F.col("cut_id").isNull() & F.col("id").isNotNull()) | (F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("size") < F.col("cut_size")))
    here = F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("size") == F.col("cut_size"))
    extra = F.when(p < at, F.col("size")).when((p == at) & here, F.col("cut_extra")).when((p == at) & earlier, F.col("size")).otherwise(0)
    return _of_source(rated, cuts).withColumn("taken", F.col("copies") * F.col("size") + extra).drop("priority", "cut_priority", "cut_id", "cut_size", "cut_extra")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """How much of each document the mix takes: id, source, size, source_size, target,
    rate, copies, taken.

    Size: the words of the text, 0 for null. The rates are those nearest to one copy of
    every document (in relative entropy) that give each source its target of words and
    none above `most`: rate = min(most, exp(tilt * size / mean size)), one tilt a source,
    found by Newton steps on sums over all documents. Rates are rounded down to whole
    copies; the words still missing go to documents in the order of u / fraction (u: a
    hash of the id), one copy more each; the last gets the part that fits. So the taken
    words meet the target to the word, and reruns agree: all sums are of integers.

    Ties in the order go by id, then size; rows equal in all are alike, each counted. A
    null source is a source of its own; sources without words get 0. An empty table gives
    no rows. Other columns are ignored.
    """
    sizes = cut(_priced(docs, id_col, text_col, source_col), "sizes")
    rated = _rated(sizes, _tilts(sizes, weights, most), most, seed)
    return _taken(rated, _cuts(rated))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each whole copy that
    mixed() takes of it, and once more cut after the words of a part (one document a
    source at most; its words are joined by one blank). Texts pass through joins with
    tables of one row a source and are not shuffled by id."""
    sizes = cut(_priced(docs, id_col, text_col, source_col), "sizes")
    tilts = _tilts(sizes, weights, most)
    cuts = _cuts(_rated(sizes, tilts, most, seed))
    rows = _priced(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("doc"))
    wide = _taken(_rated(rows, tilts, most, seed), cuts).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = wide.select("doc", F.explode(times).alias("words"))
    text = F.col(f"doc.{text_col}")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, F.greatest(F.lit(1), F.col("words"))), " ")
    rows = rows.withColumn("doc", F.col("doc").withField(text_col, F.when(F.col("words") > 0, first).otherwise(text)))
    return rows.select("doc.*")
