"""Mixing sources to target weights by blocks of tokens.

The documents of a source are one stream of words, cut into blocks of fixed length.  The mix is a
number of output slots, each filled with one block.  Slots are dealt to sources by a pseudorandom
permutation of all tickets, of which every source holds as many as its target asks for: the counts
of a shard are a multinomial draw conditional on the totals, so the totals are met exactly.  The
j-th ticket of a source is mapped to a block by a pseudorandom permutation of its block numbers, a
new one for every pass over the source; no block is taken twice before all have been taken once.
Finally slots and blocks are joined by (source, block number).

Everything is DataFrame functions, and a function of the seed and the rows alone.  A source of any
size is spread over buckets of ``BUCKET_WORDS`` words by a hash of the document; only sums per
bucket and per source are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.text import SPACED_WORD
from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise

WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, BUCKET_WORDS = 128, 4_096, 250_000
CELL = 4_096  # tickets per cell in which a ticket looks for its source
SLOTS_IN_TASK = 50_000
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
ROUNDS = [(1_103_515_245, 16_807), (1_664_525, 48_271), (214_013, 69_621), (630_360_016, 39_373)]


def _mix(x: Column, key: Column, round_: int) -> Column:
    """A pseudorandom number below the last prime from a number and a key, neither negative."""
    first, second = ROUNDS[round_]
    return ((x + key) % PRIMES[0] * first % PRIMES[1] + 1) * second % PRIMES[2]


def permuted(rows: DataFrame, x: str, n: str, key: str, out: str) -> DataFrame:
    """Add the image of column ``x`` under a permutation of 0..n-1 that depends on ``key``.

    Two passes over the largest full rectangle of a x b numbers, each adding to one coordinate a
    hash of the other in turn, with a rotation of all n numbers between them.  Every step can be
    undone, so no two numbers meet.
    """
    rows = rows.withColumn("_a", F.greatest(F.floor(F.sqrt(F.col(n).cast("double"))), F.lit(1)).cast("bigint"))
    rows = rows.withColumn("_b", F.expr(f"`{n}` div _a")).withColumn("_x", F.col(x).cast("bigint"))
    for half in (0, 1):
        inside = F.col("_x") < F.col("_a") * F.col("_b")
        rows = rows.withColumns({"_in": inside, "_l": F.expr("_x div _b"), "_r": F.col("_x") % F.col("_b")})
        rows = rows.withColumn("_l", (F.col("_l") + _mix(F.col("_r"), F.col(key), 2 * half)) % F.col("_a"))
        rows = rows.withColumn("_r", (F.col("_r") + _mix(F.col("_l"), F.col(key), 2 * half + 1)) % F.col("_b"))
        rows = rows.withColumn("_x", F.when(F.col("_in"), F.col("_l") * F.col("_b") + F.col("_r")).otherwise(F.col("_x")))
        if not half:
            rows = rows.withColumn("_x", (F.col("_x") + F.expr(f"`{n}` div 2") + F.col(key)) % F.col(n))
    return rows.withColumnRenamed("_x", out).drop("_a", "_b", "_in", "_l", "_r")


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, digest, source, size); a null text has no words."""
    return docs.select(
        F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """(rank, source, source_size, target) per source.

    Sources by code point, null last, take the weights in turn.  Each target is its weight times
    one common level, at most ``most_times`` its source's size; the level is what makes the targets
    add up to ``share`` of all words.  It is found in order of the level at which sources fill up.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("weight", weight).withColumn("cap", most_times * F.col("source_size"))
    in_order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = in_order.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onwards)
    levels = filled.withColumn("level", level)
    # Taking too few or too many sources for full gives a lower level, so the greatest one is right.
    target = F.least(F.max("level").over(everything) * F.col("weight"), F.col("cap").cast("double"))
    return levels.withColumn("target", target).select(F.col("rank").cast("bigint").alias("rank"), "source", "source_size", "target")


def placed(rows: DataFrame, goals: DataFrame, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """Where every document stands in the stream of its source, and the buckets of all streams.

    Documents get ``rank``, ``bucket`` and ``at``, the first of their words in the bucket; buckets
    get ``first_block`` and ``blocks``.  A bucket ends with a shorter block.
    """
    ranked = lookup_join(rows, goals, ["source"], "inner", null_safe=True, kept=True)
    buckets = F.greatest(F.ceil(F.col("source_size") / bucket_words), F.lit(1)).cast("bigint")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest")
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint")
    in_bucket = Window.partitionBy("rank", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where("size > 0").withColumn("bucket", number % buckets).withColumn("at", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    # Texts without words have no place in the stream, however many there are.
    none = F.lit(0).cast("bigint")
    docs = materialise(full.unionByName(ranked.where("size = 0").withColumns({"bucket": none, "at": none})))
    counted = docs.where("size > 0").groupBy("rank", "bucket").agg(F.ceil(F.sum("size") / block_words).cast("bigint").alias("blocks"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return docs, materialise(counted.withColumn("first_block", F.coalesce(F.sum("blocks").over(earlier), F.lit(0))))


def slots(goals: DataFrame, buckets: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, rank, pass, block): the block of every output slot."""
    spark = goals.sparkSession
    n_blocks = buckets.groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    quota = goals.join(n_blocks, "rank").where("source_size > 0")
    quota = quota.withColumn("tickets", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")).where("tickets > 0")
    first = F.coalesce(F.sum("tickets").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = materialise(quota.select("rank", "blocks", "tickets", first.alias("first")))
    total = quota.agg(F.sum("tickets")).first()[0] or 0
    cells = F.explode(F.sequence(F.expr(f"first div {CELL}"), F.expr(f"(first + tickets - 1) div {CELL}"))).alias("cell")
    owners = quota.select("rank", "blocks", "first", (F.col("first") + F.col("tickets")).alias("end"), cells)

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // SLOTS_IN_TASK))
    every = spark.range(0, total, 1, tasks).select(F.col("id").alias("slot"), F.lit(total).cast("bigint").alias("total"), F.lit(seed).cast("bigint").alias("seed"))
    # No ticket, cell or block is null.  Where that cannot be seen, the joins' null filters are pushed below the
    # permutations and repeat all of their terms, in code too long for the JVM to compile.
    seen = lambda c: F.coalesce(c, F.lit(-1).cast("bigint"))
    dealt = permuted(every, "slot", "total", "seed", "ticket").withColumn("ticket", seen(F.col("ticket")))
    dealt = dealt.withColumn("cell", seen(F.expr(f"ticket div {CELL}")))
    owned = (F.col("ticket") >= F.col("first")) & (F.col("ticket") < F.col("end"))
    dealt = lookup_join(dealt, owners, ["cell"], "inner", condition=owned, heavy_rows=None)
    dealt = dealt.withColumn("j", F.col("ticket") - F.col("first")).withColumn("pass", F.expr("j div blocks")).withColumn("k", F.col("j") % F.col("blocks"))
    dealt = dealt.withColumn("own_key", (F.col("seed") + 1) * 1_000_003 + F.col("rank") * 7_919 + F.col("pass") * 104_729)
    mapped = permuted(dealt, "k", "blocks", "own_key", "block")
    return mapped.select(F.expr(f"slot div {shard_slots}").alias("shard"), "slot", "rank", "pass", seen(F.col("block")).alias("block"))


def pieces(docs: DataFrame, buckets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and block it touches: the columns of ``docs`` with ``block``, ``from`` and ``words``."""
    full = docs.where("size > 0").join(buckets, ["rank", "bucket"])
    local = F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))).alias("_local")
    touched = full.select("*", local).withColumn("from", F.greatest(F.col("_local") * block_words - F.col("at"), F.lit(0)))
    words = F.least((F.col("_local") + 1) * block_words - F.col("at"), F.col("size")) - F.col("from")
    return touched.withColumn("words", words).withColumn("block", F.col("first_block") + F.col("_local")).drop("_local", "blocks", "first_block")


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row.

    ``taken`` is the number of words that the mix takes from the row, repeats counted.  Empty and
    null texts have none; repeated rows stand in the stream one after another and are taken each
    by its place; an empty table gives an empty result.
    """
    rows = materialise(described(docs, key, text, source))
    goals = materialise(targets(rows))
    at, buckets = placed(rows, goals, block_words)
    times = slots(goals, buckets, seed).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    touched = pieces(at.select("rank", "bucket", "at", "size"), buckets, block_words).select("rank", "bucket", "at", "block", "words")
    sums = touched.join(times, ["rank", "block"]).groupBy("rank", "bucket", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    sums = sums.withColumnsRenamed({"rank": "_rank", "bucket": "_bucket", "at": "_at"})
    place = (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0)
    return at.join(sums, place, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: a row per slot with shard, slot, source, block, doc_ids, n_words and text.

    Words are joined by single spaces; a block may hold the end of one document and the start of the next.
    """
    rows = materialise(described(docs, key, text, source))
    goals = materialise(targets(rows))
    at, buckets = placed(rows, goals, block_words)
    where = pieces(at.select("doc_id", "digest", "rank", "bucket", "at", "size", "source"), buckets, block_words)
    where = where.groupBy("doc_id", "digest", "rank", "source").agg(F.collect_list(F.struct("block", "at", "from", "words")).alias("_pieces"))
    texts = docs.select(F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), F.col(source).alias("source"), F.col(text).alias("text"))
    texts = texts.dropDuplicates(["doc_id", "digest", "source"])
    where = where.withColumnsRenamed({"doc_id": "_id", "digest": "_digest", "source": "_source"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & F.col("source").eqNullSafe(F.col("_source"))
    met = texts.join(where, same).select("doc_id", "rank", "source", "_pieces", F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)).alias("_w"))
    cut = F.transform("_pieces", lambda p: F.struct(
        p["block"].alias("block"), p["at"].alias("at"), p["words"].alias("words"),
        F.array_join(F.slice(F.col("_w"), (p["from"] + 1).cast("int"), F.least(p["words"], F.size("_w") - p["from"]).cast("int")), " ").alias("text"),
    ))
    parts = met.select("doc_id", "rank", "source", F.explode(cut).alias("p")).select("doc_id", "rank", "source", "p.*")
    in_order = F.sort_array(F.collect_list(F.struct("at", "doc_id", "text", "words")))  # at most a block of words
    blocks = parts.groupBy("rank", "source", "block").agg(in_order.alias("_p"))
    blocks = blocks.select(
        "rank", "source", "block", F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"),
        F.aggregate("_p", F.lit(0).cast("bigint"), lambda n, p: n + p["words"]).alias("n_words"),
    )
    return slots(goals, buckets, seed).join(blocks, ["rank", "block"]).select("shard", "slot", "source", "block", "doc_ids", "n_words", "text")

