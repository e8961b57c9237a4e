"""Serving index: labels, search shards, id lookups, rosters, top lists."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cell, placed
from ..functions.names import normalize_name, search_tokens
from ..sources.sinks import json_bytes
from ..sources.storage import cut
from .edges import with_row_index

LABELS_A_TILE = {6: 50, 7: 50, 8: 200, 9: 4000}
LONGEST_PREFIX = 5
CODEPOINT_SHARDS = 128
#: Token places in a block of the search's best lists, and blocks in a block of the next level.
FAN = 64


def by_citations() -> list[Column]:
    return [F.col("cited_by_count").desc(), F.col("id").asc()]


def round_coords(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """rows with coordinates as they stand in JSON documents."""
    return rows.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns or ("xw", "yw")})


def label_tiles(web: DataFrame, capacity: dict[int, int] = LABELS_A_TILE) -> DataFrame:
    """z, tx, ty, rn and the label: the most cited of each tile at each zoom. The rank
    filter is applied before the shuffle too (window group limit)."""
    parts = []
    for zoom, most in capacity.items():
        tiles = 1 << zoom
        rows = web.where(placed() & ~F.col("is_ring")).select(F.lit(zoom).alias("z"), cell("xw", tiles).alias("tx"), (tiles - 1 - cell("yw", tiles)).alias("ty"), "display_name", "id", "xw", "yw", "cited_by_count", "community")
        place = F.row_number().over(Window.partitionBy("z", "tx", "ty").orderBy(*by_citations()))
        parts.append(rows.withColumn("rn", place).where(F.col("rn") <= most))
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def community_roster(web: DataFrame, stats: DataFrame, top_n: int = 20_000, least: int = 1000) -> DataFrame:
    """The top_n most cited of each large community; dust counts as a member but isn't listed."""
    big = stats.where(F.col("members") >= least).select("community")
    rows = web.where(~F.col("is_ring")).join(big, "community", "left_semi")
    place = F.row_number().over(Window.partitionBy("community").orderBy(*by_citations()))
    return rows.withColumn("rn", place).where(F.col("rn") <= top_n).select("community", "rn", "display_name", "id", "xw", "yw", "cited_by_count")


def top_authors(web: DataFrame, top_n: int = 50_000) -> DataFrame:
    rows = web.where(~F.col("is_ring")).select("display_name", "id", "xw", "yw", "cited_by_count", "community")
    return rows.orderBy(*by_citations()).limit(top_n)


def id_shards(web: DataFrame, shards: int = 1000) -> DataFrame:
    """shard, id, xw, yw: by the digits of the id modulo shards, 0 without digits."""
    digits = F.regexp_replace("id", "[^0-9]", "")
    shard = F.when(digits == "", 0).otherwise(F.pmod(digits.cast("decimal(38,0)"), F.lit(shards))).cast("int")
    return web.select(shard.alias("shard"), "id", F.round("xw", 6).alias("xw"), F.round("yw", 6).alias("yw"))


def name_entries(web: DataFrame) -> DataFrame:
    """One row per author and search token: token, norm, name, id, xw, yw, cited, bytes:
    the entry's length in a shard, to the byte."""
    rows = web.select(F.coalesce("display_name", F.lit("")).alias("name"), "id", "xw", "yw", "cited_by_count")
    rows = rows.withColumn("norm", normalize_name("name"))
    return rows.withColumn("bytes", json_bytes(["norm", "name", "id", "xw", "yw", "cited_by_count"])).withColumn("token", F.explode(search_tokens(F.col("norm"))))


def search_shards(entries: DataFrame, most_bytes: int = 4_000_000) -> DataFrame:
    """entries with shard: the first two letters (a-z), one more as long as the shard is
    over most_bytes, up to five; other tokens go to `_`, or by code point if that is too
    large.

    Sizes of all prefixes are sums by (length, prefix), pre-aggregated; only prefixes over
    most_bytes are joined back: at most the table's bytes / most_bytes for each length.
    """
    head = lambda k: F.regexp_extract("token", f"^([a-z]{{{k}}})", 1)
    prefixes = F.array(*[head(k) for k in range(2, LONGEST_PREFIX)])
    sized = entries.select("bytes", F.explode(F.array_distinct(F.when(head(2) == "", F.array(F.lit("_"))).otherwise(F.filter(prefixes, lambda p: p != "")))).alias("prefix"))
    large = sized.groupBy("prefix").agg(F.sum("bytes").alias("n")).where(F.col("n") > most_bytes).select("prefix")
    out = entries.withColumn("shard", F.when(head(2) == "", F.lit("_")).otherwise(head(2)))
    for k in range(2, LONGEST_PREFIX):
        big = large.where(F.length("prefix") == k).select(F.col("prefix").alias("_big"))
        met = out.join(big, F.col("shard") == F.col("_big"), "left")
        grow = F.col("_big").isNotNull() & (head(k + 1) != "")
        out = met.withColumn("shard", F.when(grow, head(k + 1)).otherwise(F.col("shard"))).drop("_big")
    other = large.where(F.col("prefix") == "_").select(F.col("prefix").alias("_big"))
    met = out.join(other, F.col("shard") == F.col("_big"), "left")
    by_point = F.concat(F.lit("_"), (F.ascii("token") % CODEPOINT_SHARDS).cast("string"))
    return met.withColumn("shard", F.when(F.col("_big").isNotNull() & (F.col("token") != ""), by_point).otherwise(F.col("shard"))).drop("_big")


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """shard, entries, bytes; parents of split shards are there, if with no entry."""
    own = sharded.groupBy("shard").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))
    letters = F.when(F.col("shard").startswith("_"), F.array(F.lit("_"))).otherwise(F.transform(F.sequence(F.lit(2), F.length("shard")), lambda k: F.substring("shard", F.lit(1), k)))
    parents = own.select(F.explode(letters).alias("shard")).distinct()
    return parents.join(own, "shard", "left").select("shard", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def token_ranges(entries: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, pos) of the different tokens in order, and (prefix, low, high): the tokens
    that begin with a prefix are those with low < pos < high. Tokens and the two ends of
    each prefix are sorted together by ranges, so a place needs no search."""
    end = F.concat("prefix", F.lit("\U0010ffff"))
    marks = prefixes.select(F.col("prefix").alias("s"), F.lit(0).alias("kind"), "prefix").union(prefixes.select(end, F.lit(2), "prefix"))
    tokens = entries.select(F.col("token").alias("s"), F.lit(1), F.lit(None).cast("string")).distinct()
    sorted_ = cut(with_row_index(marks.union(tokens), ["s", "kind", "prefix"], "pos"), "token-places")
    bound = lambda kind, name: sorted_.where(F.col("kind") == kind).select("prefix", F.col("pos").alias(name))
    return sorted_.where("kind = 1").select(F.col("s").alias("token"), "pos"), bound(0, "low").join(bound(2, "high"), "prefix")


def best_lists(entries: DataFrame, best: int, levels: int, fan: int = FAN) -> DataFrame:
    """level, block and the best entries of each block of fan**level token places, in the
    order of answers to a single word: names that begin with it first, then by citations."""
    order = [F.col("kind"), F.col("cited_by_count").desc(), F.col("id")]
    level, out = entries.withColumn("block", F.col("pos")), None
    for n in range(levels):
        if n:
            level = level.withColumn("block", F.floor(F.col("block") / fan))
        place = F.row_number().over(Window.partitionBy("block").orderBy(*order))
        level = cut(level.withColumn("place", place).where(F.col("place") <= best).drop("place"), f"best-lists-{n}")
        rows = level.select(F.lit(n).alias("level"), "block", "kind", "norm", "id", "cited_by_count")
        out = rows if out is None else out.union(rows)
    return out


def blocks_of(low: Column, high: Column, levels: int, fan: int = FAN) -> Column:
    """The blocks (level, block) that make up the places between low and high, larger ones
    in the middle: less than 2 * fan of each level."""
    pieces = []
    first = lambda n: F.ceil((low + 1) / F.lit(fan**n))
    last = lambda n: F.floor(high / F.lit(fan**n))
    named = lambda n: lambda k: F.struct(F.lit(n).alias("level"), k.alias("block"))
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    for n in range(levels):
        a, b = first(n), last(n)
        if n + 1 < levels:
            up, down = first(n + 1), last(n + 1)
            both = F.concat(run(a, up * fan), run(down * fan, b))
            blocks = F.when(up < down, both).otherwise(run(a, b))
        else:
            blocks = run(a, b)
        pieces.append(F.transform(blocks, named(n)))
    return F.concat(*pieces)


def search_lookup(queries: DataFrame, entries: DataFrame, best: int = 12) -> DataFrame:
    """queries(query) to their best entries: query, rn, id, norm, cited_by_count.

    An entry is found by a token that begins with the query's first word; it matches if its
    words begin with the query's, in this order. First come names that begin with the whole
    query, then those whose first word does with the first, then the rest, by citations.

    The tokens that begin with a word are a range of the sorted tokens. For a single word
    it is made up of blocks whose best entries are kept (a token's entries, 64 tokens, 4,096
    and so on), so a query meets some hundred short lists however common its letters are.
    Of several words the later ones decide, so all entries of the first one's range are met
    (none beside it), by tokens at its ends and blocks of 64 between; one that many queries
    ask is met by a join that AQE can split.
    """
    asked = queries.select("query", normalize_name("query").alias("norm_q")).where("norm_q <> ''").distinct()
    words = F.split("norm_q", " ")
    asked = cut(asked.withColumns({"prefix": F.element_at(words, 1), "words": F.size(words)}), "asked")
    tokens, ranges = token_ranges(entries, asked.select("prefix").distinct())
    last = (tokens.agg(F.max("pos")).first()[0] or 0) + 1
    levels = 1
    while FAN**levels < last:
        levels += 1
    of_first = F.when(F.element_at(F.split("norm", " "), 1) == F.col("token"), 0).otherwise(2)
    placed_ = cut(entries.select("token", "norm", "id", "cited_by_count").distinct().join(tokens, "token").select("pos", of_first.alias("kind"), "norm", "id", "cited_by_count"), "placed-entries")
    ranged = cut(asked.join(ranges, "prefix"), "ranged")
    # an entry may be found by both of its tokens, so twice as many are kept
    pieces = ranged.where("words = 1").select("query", F.explode(blocks_of(F.col("low"), F.col("high"), levels)).alias("b")).select("query", "b.level", "b.block")
    single = pieces.join(best_lists(placed_, 2 * best, levels), ["level", "block"]).groupBy("query", "id", "norm", "cited_by_count").agg(F.min("kind").alias("kind"))
    keyed = [placed_.drop("kind").withColumns({"level": F.lit(n), "block": F.floor(F.col("pos") / FAN**n)}) for n in (0, 1)]
    blocks = F.explode(blocks_of(F.col("low"), F.col("high"), 2)).alias("b")
    several = ranged.where("words > 1").select("query", "norm_q", "prefix", blocks).select("query", "norm_q", "prefix", "b.level", "b.block").join(keyed[0].union(keyed[1]), ["level", "block"])
    seen = F.aggregate(F.split("norm", " "), F.lit(0), lambda n, w: F.when(w.startswith(F.coalesce(F.get(words, n), F.lit("\x00"))), n + 1).otherwise(n))
    kind = F.when(F.col("norm").startswith(F.col("norm_q")), 0).when(F.col("norm").startswith(F.col("prefix")), 1).otherwise(2)
    several = several.where(seen == F.size(words)).select("query", "id", "norm", "cited_by_count", kind.alias("kind")).distinct()
    order = Window.partitionBy("query").orderBy("kind", F.col("cited_by_count").desc(), "id")
    hits = single.unionByName(several).withColumn("rn", F.row_number().over(order))
    return hits.where(F.col("rn") <= best).select("query", "rn", "id", "norm", "cited_by_count")
