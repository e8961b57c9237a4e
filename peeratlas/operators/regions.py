"""Names of the largest communities from their members' topics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_communities(web: DataFrame, top_n: int = 300) -> DataFrame:
    """community, members, xw, yw, spread, rank of the top_n largest."""
    sums = web.groupBy("community").agg(F.count("*").alias("members"), F.avg("xw").alias("xw"), F.avg("yw").alias("yw"), F.sqrt(F.var_pop("xw") + F.var_pop("yw")).alias("spread"))
    order = [F.col("members").desc(), F.col("community").asc_nulls_last()]
    top = sums.orderBy(*order).limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top_n rows


def member_topics(web: DataFrame, authors: DataFrame, top: DataFrame, once: bool = False) -> DataFrame:
    """community and first topic of the top communities' members that have one. Authors
    repeated in the snapshot count as often as they come; with once, only their latest row
    does (by updated_date, then the larger topics)."""
    if once:
        authors = authors.groupBy("id").agg(F.max(F.struct("updated_date", "topics"))["topics"].alias("topics"))
    members = web.select("id", "community").join(F.broadcast(top.select("community")), "community", "left_semi")  # top_n rows
    topics = authors.select("id", F.get("topics", F.lit(0))["display_name"].alias("topic")).where("topic is not null")
    return members.join(topics, "id").select("community", "topic")


def topic_scores(topics: DataFrame) -> DataFrame:
    """community, topic, c, score = c * ln(N / count of the topic), within the scope."""
    each = topics.groupBy("community", "topic").agg(F.count("*").alias("c"))
    whole = each.groupBy("topic").agg(F.sum("c").alias("g"))
    everything = F.broadcast(each.agg(F.sum("c").alias("all")))  # one row
    met = each.join(whole, "topic").crossJoin(everything)
    return met.select("community", "topic", "c", (F.col("c") * F.ln(F.col("all") * F.lit(1.0) / F.col("g"))).alias("score"))


def topic_ranking(scores: DataFrame, candidates: int = 5) -> DataFrame:
    """The best candidates topics of each community, by score, count and name."""
    order = Window.partitionBy("community").orderBy(F.round("score", 9).desc(), F.col("c").desc(), "topic")
    return scores.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= candidates)


def region_names(top: DataFrame, ranked: DataFrame, keep: int = 120) -> DataFrame:
    """Names in the order of rank: a community's best candidate that no larger one took,
    else its first with the rank (or the next number that is free) behind.

    The order is inherent, and keep communities with five candidates are one short sorted
    array, so one fold names them all.
    """
    lists = ranked.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rn", "topic"))).alias("l"))
    kept = top.where(F.col("rank") <= keep).join(lists, "community", "left")
    rows = kept.select(F.struct("rank", "community", F.coalesce(F.transform("l", lambda x: x["topic"]), F.array().cast("array<string>")).alias("topics")).alias("e"))
    pick = lambda s, e: F.coalesce(
        F.try_element_at(F.filter(e["topics"], lambda x: ~F.array_contains(s["names"], x)), F.lit(1)),
        F.try_element_at(
            F.filter(
                F.transform(F.sequence(e["rank"], e["rank"] + F.size(s["names"])), lambda n: F.concat(F.coalesce(F.try_element_at(e["topics"], F.lit(1)), F.lit("Unnamed")), F.lit(" ("), n.cast("string"), F.lit(")"))),
                lambda x: ~F.array_contains(s["names"], x),
            ),
            F.lit(1),
        ),
    )
    start = F.struct(F.array().cast("array<string>").alias("names"))
    step = lambda s, e: F.struct(F.array_append(s["names"], pick(s, e)).alias("names"))
    one = rows.agg(F.sort_array(F.collect_list("e")).alias("es"))  # keep rows
    named = one.select("es", F.aggregate("es", start, step)["names"].alias("names"))
    pairs = named.select(F.explode(F.arrays_zip("es", "names")).alias("p"))
    return pairs.select(F.col("p.es.community").alias("community"), F.col("p.names").alias("name"))


def regions(web: DataFrame, authors: DataFrame, top_n: int = 300, keep: int = 120, once: bool = False) -> DataFrame:
    """name, xw, yw, spread, members, rank, community, zmin, zmax."""
    top = top_communities(web, top_n)
    names = region_names(top, topic_ranking(topic_scores(member_topics(web, authors, top, once))), keep)
    large = F.col("rank") <= 30
    return top.join(names, "community").select("name", "xw", "yw", "spread", "members", "rank", "community", F.when(large, 2).otherwise(4).alias("zmin"), F.when(large, 4).otherwise(6).alias("zmax"))
