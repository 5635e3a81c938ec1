"""Mixing sources to target weights over a domain - language - source tree, with DataFrame operations only.

A token budget flows down the tree. At every node the children share what the node got by their weights; a child
that cannot use its share (its subtree holds too few tokens, epochs included) takes what it can and the rest goes
to its siblings by their weights. Because a node never gets more than its subtree holds, a shortage is met among
siblings first and reaches the node's own siblings only once they are all used up.

Each leaf takes its quota from its epochs: epoch 0, 1, .. are the leaf's documents, each time in another seeded
order, and the leaf's token-prefix is every document that begins before the quota is reached. So a leaf exceeds
its quota by less than one document, and a leaf whose quota is what it holds keeps everything.

Null levels are levels of their own. Documents without tokens add nothing and are chosen while the prefix lasts.
Rows that tie in key and `ties` are ordered by a hash of their text and the columns kept, so that the order of the input
never matters. Very long texts only count. Names that begin with two underscores may be among the columns kept. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import ROWS_PER_BUCKET, WORD, Scratch, null_safe_join


def n_tokens(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """32 hex digits that order an epoch. MD5 is to hand in every SQL engine, so the order can be checked elsewhere."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), key.cast("string")))


def share(nodes: DataFrame, parents: list[str], given: Column, room: str, weight: str, out: str) -> DataFrame:
    """Water-filling among siblings: out = min(room, level * weight), summing to what the parent was given.

    Children are taken by room / weight; those before the first that is left with room are filled.
    """
    order = Window.partitionBy(*parents).orderBy(F.col(room) / F.col(weight), *[c for c in nodes.columns if c not in (room, weight, "__given")])
    before, upto = (order.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    rest = given - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    weights = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = nodes.withColumn("__level", rest / weights).withColumn("__fits", F.col(room) <= F.col("__level") * F.col(weight) * (1 + 1e-12))
    filled = F.min("__fits").over(upto)
    level = F.first(F.when(~F.col("__fits"), F.col("__level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return fits.withColumn(out, F.when(filled, F.col(room)).otherwise(level * F.col(weight))).drop("__level", "__fits")


def quotas(leaves: DataFrame, levels: list[str], tokens: str, budget: float, max_epochs: int, weight_of: dict[int, Column]) -> DataFrame:
    """Add `quota` to the table of leaves: one row for each path through the levels, with its tokens.

    `weight_of[i]` is the weight of a node at level i, an expression over levels 0..i; 1 where none is given.
    """
    room = (F.col(tokens) * F.lit(max_epochs)).cast("double")
    down = leaves.withColumn("__room", room)
    got = None
    for i in range(len(levels)):
        here, parents = levels[: i + 1], levels[:i]
        nodes = down.groupBy(*here).agg(F.sum("__room").alias("__node_room")).withColumn("__weight", weight_of.get(i, F.lit(1.0)).cast("double"))
        if i == 0:
            one = F.lit(0)
            nodes = share(nodes.withColumn("__root", one), ["__root"], F.least(F.lit(float(budget)), F.sum("__node_room").over(Window.partitionBy("__root"))), "__node_room", "__weight", "__got").drop("__root")
        else:
            nodes = share(null_safe_join(nodes, got.withColumnRenamed("__got", "__given"), parents), parents, F.col("__given"), "__node_room", "__weight", "__got")
        got = nodes.select(*here, "__got")
    return null_safe_join(leaves, got.withColumnRenamed("__got", "quota"), levels)


def mix(df: DataFrame, levels: list[str], key: str = "doc_id", text: str = "text", budget: float | None = None, fraction: float | None = None, max_epochs: int = 4, weight_of: dict[int, Column] | None = None, ties: tuple[str, ...] = (), seed: int = 5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The chosen rows, once for each epoch that takes them, with n_tokens, epoch, start_token and leaf_quota added.

    The budget is given in tokens or as a fraction of all tokens. `keep` narrows the columns that are carried.
    Cumulative sums run inside (leaf, epoch, hash bucket) and add the sums of the buckets before, so that a leaf
    with a third of all rows spreads over many tasks.
    """
    spark = df.sparkSession
    made = ("n_tokens", "epoch", "start_token", "leaf_quota")
    carried = [c for c in (keep or df.columns) if c.lower() not in made]
    needed = [*levels, key, *ties]
    # columns that are only carried get names that clash with none of those made here
    inside_name = {c: c if c in needed else f"__c{i}" for i, c in enumerate(dict.fromkeys([*carried, *needed]))}
    kinds = dict(df.dtypes)
    hashed = [c for c in dict.fromkeys([text, *carried]) if "map<" not in kinds[c] and "variant" not in kinds[c]]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in inside_name.items()], n_tokens(F.col(text)).alias("n_tokens"), F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias("__tie"))
    scratch = Scratch(spark, "mix")
    leaves = scratch.save(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("__tokens"), F.count(F.lit(1)).alias("__rows")), "leaves")
    if budget is None:
        budget = (leaves.agg(F.sum("__tokens")).first()[0] or 0) * (1.0 if fraction is None else fraction)
    plan = quotas(leaves, levels, "__tokens", budget, max_epochs, weight_of or {})
    # the last epoch that the leaf needs; a leaf without tokens has only its first
    last = F.when(F.col("__tokens") > 0, F.least(F.lit(max_epochs - 1), F.floor(F.col("quota") / F.col("__tokens")))).otherwise(F.lit(0))
    plan = plan.select(*levels, F.col("quota").alias("leaf_quota"), "__tokens", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("epoch"), F.greatest(F.lit(1), F.ceil(F.col("__rows") / ROWS_PER_BUCKET)).alias("__buckets"))
    plan = scratch.save(plan, "plan")  # so that the joins know how few leaves there are
    dealt = null_safe_join(rows, plan, levels).withColumn("__h", order_hash(seed, F.col("epoch"), F.col(key)))
    first8 = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double")
    dealt = dealt.withColumn("__bucket", F.floor(first8 * F.col("__buckets") / F.lit(4294967296.0)))
    spots = [*levels, "epoch", "__bucket"]
    before = (
        dealt.groupBy(*spots)
        .agg(F.sum("n_tokens").alias("__sum"))
        .withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*levels, "epoch").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__sum")
    )
    inside = Window.partitionBy(*spots).orderBy("__h", F.col(key), *ties, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.save(before, "before")
    # dealt out by bucket even where the join has dealt the rows by leaf, which would do for the window
    placed = null_safe_join(dealt.repartition(*spots).withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))), before, spots)
    start = F.col("epoch") * F.col("__tokens") + F.col("__before") + F.col("__in")
    chosen = placed.withColumn("start_token", start).filter(F.col("start_token") < F.col("leaf_quota") - 1e-6)
    return chosen.select(*[F.col(inside_name[c]).alias(c) for c in carried], *made)
