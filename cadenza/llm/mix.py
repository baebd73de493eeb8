"""Mixing sources to target weights: exact quotas, a multivariate-hypergeometric splitting tree over
output shards, disjoint permuted blocks and a local shuffle. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import WORD, partitions, running, table, written

#: A block of a source is the range of its permuted documents whose keys share some hex digits: so many that there are this
#: many blocks for each shard.
PER_SHARD = 16
#: Digits of a key that name the doc_id, and those of its text that part an id's rows on the way to the row at the cut.
ID_DIGITS, TEXT_DIGITS = 32, 3


def shards_of(spark: SparkSession, shards: int | None) -> int:
    """Output shards: the session's shuffle partitions where none are asked for, so that they grow with the cluster."""
    return max(1, partitions(spark) if shards is None else shards)


def sized(docs: DataFrame, seed: int = 7, shards: int | None = None) -> DataFrame:
    """docs with `size` in words (null: 0), `src` (the source, apart from null), the permutation `key` and `block`.

    The key is a hash of doc_id followed by one of the text, so rows share it only if equal in both; of rows without an id
    the text's hash leads, so they are spread over blocks.
    """
    text = F.coalesce(F.md5("text"), F.lit(""))
    first = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), text))
    digits = math.ceil(math.log(PER_SHARD * shards_of(docs.sparkSession, shards), 16))
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
            "key": F.concat(F.md5(F.concat(F.lit(f"{seed}:"), first)), text),
        }
    ).withColumn("block", F.substring("key", 1, digits))


def targets(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), times: int = 3) -> DataFrame:
    """(src, source_size, target) of each source: weights repeat over the sources by code point, null last.

    target = min(times * size, level * weight), where the level makes all targets meet the total size:
    the sources at their limit are a prefix in order of limit / weight. One row a source from here on.
    """
    per = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("src") == "", "src")) - 1
    per = per.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), place % len(weights)))
    per = per.withColumn("limit", F.col("source_size") * times)
    order = [F.col("limit") / F.col("weight"), "src"]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    first = F.struct((F.col("limit") / F.col("weight")).alias("order"), "src", "level")
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), first)).over(Window.partitionBy())
    per = per.withColumn("level", fits["level"])
    least = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return per.select("src", "source_size", least.alias("target"))


def _hypergeometric(marked: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` from `total` are among `marked`, by the inverse distribution at u.

    Point masses come from their exact ratios, over twelve standard deviations about the mean.
    """
    mean = draws * marked / F.greatest(total, F.lit(1))
    odds = (1 - marked / F.greatest(total, F.lit(1))) * (total - draws) / F.greatest(total - 1, F.lit(1))
    reach = 12 * F.sqrt(F.greatest(mean * odds, F.lit(0.0)))
    low = F.greatest(F.lit(0), draws - (total - marked), F.floor(mean - reach) - 1).cast("long")
    high = F.least(marked, draws, F.ceil(mean + reach) + 1).cast("long")

    def ratio(k: Column) -> Column:
        return (marked - k).cast("double") * (draws - k) / ((k + 1) * F.greatest(total - marked - draws + k + 1, F.lit(1)))

    def fold(goal: Column | None) -> Column:
        """The sum of all masses, or the first k by which `goal` of it is passed."""
        return F.aggregate(
            F.sequence(low, high),
            F.struct(F.lit(1.0).alias("mass"), F.lit(0.0).alias("sum"), low.alias("pick")),
            lambda s, k: F.struct(
                (s["mass"] * ratio(k)).alias("mass"),
                (s["sum"] + s["mass"]).alias("sum"),
                (s["pick"] if goal is None else F.when(s["sum"] <= goal, k).otherwise(s["pick"])).alias("pick"),
            ),
            lambda s: s["sum"] if goal is None else s["pick"],
        )

    return F.get(F.transform(F.array(fold(None) * u), lambda goal: fold(goal)), F.lit(0))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, i, n): how many of source i's blocks go to each shard.

    quotas is one row with `q`, the sources' block counts. Each level halves the shards of every node
    and deals the node's blocks between the halves: the left half gets its exact share of blocks, its
    split over sources being a multivariate hypergeometric draw, one source after another.
    """
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for level in range(max(1, shards - 1).bit_length() if shards > 1 else 0):
        all_ = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        uniform = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "lo", i), F.lit(1 << 40)) / float(1 << 40)
        nodes = nodes.select("lo", "hi", "q", mid.alias("mid"), all_.alias("all")).withColumn(
            "draws", F.floor(F.col("all") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        )
        dealt = F.aggregate(
            F.sequence(F.lit(0), F.size("q") - 1),
            F.struct(F.col("all").alias("all"), F.col("draws").alias("draws"), F.expr("cast(array() as array<bigint>)").alias("left")),
            lambda s, i: F.transform(
                F.array(_hypergeometric(F.get("q", i), s["all"], s["draws"], uniform(i))),
                lambda k: F.struct(
                    (s["all"] - F.get("q", i)).alias("all"),
                    (s["draws"] - k).alias("draws"),
                    F.concat(s["left"], F.array(k)).alias("left"),
                ),
            )[0],
            lambda s: s["left"],
        )
        left = F.when(F.col("mid") > F.col("lo"), dealt).otherwise(F.col("q"))
        nodes = nodes.withColumn("left", left).select(
            F.explode(
                F.when(
                    F.col("mid") > F.col("lo"),
                    F.array(
                        F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q")),
                        F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
                    ),
                ).otherwise(F.array(F.struct("lo", "hi", "q")))
            ).alias("node")
        ).select("node.*")
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("i", "n"))


def draws(docs: DataFrame, shards: int | None = None, seed: int = 7, weights: Sequence[int] = (1, 2, 3), times: int = 3) -> DataFrame:
    """One row for each copy of a document that the mix takes, with its words `taken`, `epoch`, `shard` and `place`.

    docs is what sized() returns. A source is permuted by a keyed hash of doc_id and cut into blocks of
    equal ranges of the hash. It gives all its blocks target // source_size times, then the blocks up to
    the one in which the target ends; the document at that point gives only the words still missing, rows
    of its doc_id standing in order of a text hash and equal rows one after the other. So one document of
    a source at most is cut, and its taken words fall short of its target by less than one word. Only rows
    equal to that document are numbered, in one task for a source. The tree says how many blocks of each
    source each shard gets; which ones is a second permutation. `place` shuffles within a shard.
    Empty texts, and sources without words, take no part. Reruns agree: nothing depends on row order.
    """
    shards = shards_of(docs.sparkSession, shards)
    per_block = written(docs.where("size > 0").groupBy("src", "block").agg(F.sum("size").alias("words")), "blocks")
    goal = targets(per_block.withColumnRenamed("words", "size"), weights, times)
    goal = goal.withColumn("whole", F.floor("target").cast("long")).withColumn("epochs", F.expr("whole div source_size"))
    per_block = per_block.join(goal, "src").withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size"))
    per_block = written(per_block.withColumn("before", running(per_block, ["src"], ["block"], "words")), "blocks")
    edge = per_block.where("before < rest and rest < before + words").select("src", "block", (F.col("rest") - F.col("before")).alias("want"))
    edge_rows = docs.where("size > 0").join(edge, ["src", "block"]).groupBy("src", "key", "want").agg(F.sum("size").alias("words"))
    rest = written(edge_rows, "edge")
    for digits in (ID_DIGITS, ID_DIGITS + TEXT_DIGITS, 2 * ID_DIGITS):  # the doc_id, some of its texts, the text
        part = rest.groupBy("src", F.substring("key", 1, digits).alias("cut"), "want").agg(F.sum("words").alias("words"))
        part = part.withColumn("past", running(part, ["src"], ["cut"], "words"))
        part = part.where("past <= want and want < past + words").select("src", "cut", (F.col("want") - F.col("past")).alias("part"))
        rest = rest.withColumn("cut", F.substring("key", 1, digits)).join(part, ["src", "cut"]).select("src", "key", F.col("part").alias("want"), "words")
    cut = written(rest.select("src", F.col("key").alias("cut"), F.col("want").alias("part")), "cut")
    per_block = per_block.join(cut, "src", "left").withColumn("drawn", F.col("epochs") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    blocks = per_block.where("drawn > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("drawn").cast("int"))).alias("epoch"))
    blocks = blocks.withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "block", "epoch")), "block", "epoch")))
    blocks = written(blocks, "drawn")
    per_source = blocks.groupBy("src").agg(F.count("*").alias("n"))
    quotas = per_source.agg(F.array_sort(F.collect_list(F.struct("src", "n"))).alias("all"))
    names = quotas.select(F.posexplode("all").alias("i", "x")).select("i", "x.src")
    tree = split_tree(quotas.where(F.size("all") > 0).select(F.transform("all", lambda x: x["n"]).alias("q")), shards, seed).join(names, "i")
    tree = tree.withColumn("past", running(tree, ["src"], ["shard"], "n")).where("n > 0")
    # the tree's counts as places in the source's permuted row of blocks
    places = tree.select("src", "shard", F.explode(F.sequence(F.col("past") + 1, F.col("past") + F.col("n"))).alias("at"))
    blocks = blocks.withColumn("at", F.col("at").cast("bigint")).join(places, ["src", "at"])
    # written, so that Spark knows its size before it shuffles any text
    slim = written(blocks.select("src", "block", "epoch", "shard", "epochs", "cut", "part"), "dealt")
    out = docs.where("size > 0").join(slim, ["src", "block"])
    at_cut = F.coalesce((F.col("key") == F.col("cut")) & (F.col("epoch") > F.col("epochs")), F.lit(False))
    before = F.col("cut").isNull() | (F.col("key") < F.col("cut")) | (F.col("epoch") <= F.col("epochs"))
    whole = out.where(~at_cut & before).withColumn("taken", F.col("size"))
    equal = out.where(at_cut)
    missing = F.col("part") - running(equal, ["src"], ["size"], "size")
    some = equal.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least("size", missing)))
    out = whole.unionByName(some.where("taken > 0"))
    out = out.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), "shard", "epoch", "key")))
    return out.drop("epochs", "cut", "part")


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7, weights: Sequence[int] = (1, 2, 3), times: int = 3) -> DataFrame:
    """The mixed corpus: docs' own columns, a row for each copy drawn; each shard is a partition, its rows in shuffled order.

    A copy of which only a part was drawn keeps its first words; n_chars, if there, follows its text.
    Extra columns stay; columns of docs named like the working ones (size, src, key, block, epoch,
    shard, taken, place) are carried through unharmed. An empty table gives an empty one.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shards = shards_of(docs.sparkSession, shards)
    base = sized(row.select("row", "row.doc_id", "row.text", "row.source"), seed, shards)
    base = base.drop("doc_id", "text", "source")
    out = draws(base, shards, seed, weights, times)
    k = F.col("taken").cast("int")
    gaps, words = F.split("row.text", WORD), F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    head = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), k), F.slice(words, F.lit(1), k), lambda g, w: F.concat(g, w)), "")
    text = F.when(F.col("taken") < F.col("size"), head).otherwise(F.col("row.text"))
    out = out.repartitionById(shards, "shard").sortWithinPartitions("place").withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = sized(docs).withColumn("rid", F.monotonically_increasing_id())
    base = written(base.select("rid", "doc_id", "size", "src", "key", "block"), "sized")
    took = draws(base).groupBy("rid").agg(F.sum("taken").alias("taken"), F.count("*").alias("copies"))
    out = base.join(took, "rid", "left").join(targets(base), "src")
    return out.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "copies")])


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(md5(text), ''))) || coalesce(md5(text), '') AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ord FROM s),
v AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ord, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY ord, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM l),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, (ord, coalesce('s' || source, ''))) FROM v WHERE level * w <= cap) * w, CAST(cap AS DOUBLE))) AS target
  FROM v),
g AS (
  SELECT d.doc_id, d.key, d.size, t.source_size, t.target, d.source,
         CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target) AS BIGINT) // t.source_size END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
           - sum(size) OVER (PARTITION BY source, key) AS before,
         sum(size) OVER (PARTITION BY source, key) AS same
  FROM g)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN before + same <= rest THEN size
                                 WHEN before < rest THEN size * (rest - before) // same ELSE 0 END AS BIGINT) AS taken,
       CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN before < rest THEN 1 ELSE 0 END END AS copies
FROM r
"""
