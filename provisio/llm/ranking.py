"""One ranking from several differently-scaled scores: outranking net flow.

Per query and criterion, scores become percentiles (mid-ranks over the candidates, 0 to 1). A
candidate is preferred to another by ``min(1, d / threshold)`` where its percentile is higher
by d. The preference over all others minus the preference of all others over it, averaged and
weighted over the criteria, is its net flow; the highest flow comes first.

The pairs are never formed: with the percentiles sorted, the sums over all pairs follow from
running counts and running sums of the percentiles, looked up at p, p - threshold and p +
threshold. With ``threshold=1`` (the default) no pair lies beyond the threshold, and what is looked
up there is nothing and the whole.

A candidate without a usable score (null, NaN, infinite) of a criterion of its query counts as
that criterion's lowest usable one; a criterion with no usable score at all says nothing. Of
several scores of one candidate the highest counts. Null query, candidate or criterion rows are
dropped. Ties go to the smaller candidate id. Neither a query nor a criterion is ever gathered
in one task: equal scores are counted first, and running sums go over range-partitioned rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.llm.prefix_sums import running_sums
from provisio.runtime import cut, over_salts, with_salt

SALTS = 8


def usable(score: Column) -> Column:
    """The score where it is a finite number, else null."""
    return F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score.cast("double"))


def criteria_from_retrieval(retrieved: DataFrame, chunks: DataFrame, default_weight: float = 0.4) -> DataFrame:
    """(query_id, chunk_id, criterion, score): retriever scores, and the authority weight of each candidate.

    Popular chunks come up in many queries, so the join to ``chunks`` is salted by query.
    """
    scores = retrieved.select("query_id", "chunk_id", F.concat(F.lit("retriever:"), "retriever").alias("criterion"), usable(F.col("score")).alias("score"))
    pairs = retrieved.select("query_id", "chunk_id").filter("query_id is not null and chunk_id is not null").distinct()
    weights = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max(usable(F.col("authority_weight"))).alias("_w")).filter("_w is not null")
    weighted = with_salt(pairs, "query_id", SALTS).join(over_salts(weights, SALTS), ["chunk_id", "_salt"], "left")
    return scores.unionByName(
        weighted.select("query_id", "chunk_id", F.lit("authority").alias("criterion"), F.coalesce("_w", F.lit(default_weight)).alias("score"))
    )


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Rows joined to a table with one row for each key, the rows of a key dealt to several tasks by another column."""
    return with_salt(rows, by, SALTS).join(over_salts(one, SALTS), [*keys, "_salt"], how).drop("_salt")


def net_flow(criteria: DataFrame, *, weights: dict[str, float] | None = None, threshold: float = 1.0) -> DataFrame:
    """(query_id, chunk_id, flow): the net flow of each candidate, over rows of ``criteria_from_retrieval``'s shape.

    ``weights`` by criterion, 1 where not given.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = criteria.filter("query_id is not null and chunk_id is not null")
    rows = cut(rows.groupBy("query_id", "chunk_id", "criterion").agg(F.max("score").alias("_s")))
    members = rows.select("query_id", "chunk_id").distinct()
    sizes = members.groupBy("query_id").agg(F.count("*").alias("_n"))
    # equal scores of a group are one row with a count; those without a score are added to the lowest
    values = rows.filter("criterion is not null and _s is not null").groupBy("query_id", "criterion", "_s").agg(F.count("*").alias("_c"))
    known = values.groupBy("query_id", "criterion").agg(F.sum("_c").alias("_known"), F.min("_s").alias("_low"))
    known = known.join(sizes, "query_id")
    values = spread_join(values, known, ["query_id", "criterion"], "_s")
    values = values.withColumn("_c", F.when(F.col("_s") == F.col("_low"), F.col("_c") + F.col("_n") - F.col("_known")).otherwise(F.col("_c")))
    values = running_sums(values, ["query_id", "criterion"], "_s", {"_upto": "_c"})
    n = F.col("_n").cast("double")
    p = F.when(F.col("_n") > 1, (F.col("_upto") - F.col("_c") + (F.col("_c") - 1) / 2.0) / (n - 1)).otherwise(F.lit(0.5))
    values = values.withColumn("_p", p)
    flows = _flows(values, threshold)
    if weights:
        w = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("criterion")], F.lit(1.0))
        flows = flows.withColumn("_f", F.col("_f") * w)
    flows = flows.select("query_id", "criterion", "_s", "_low", "_f").withColumn("_is_low", F.col("_s") == F.col("_low"))
    own = rows.filter("criterion is not null and _s is not null").join(flows.select("query_id", "criterion", "_s", "_f"), ["query_id", "criterion", "_s"])
    # every candidate starts from the sum of the lowest flows; a score of its own lifts it from there
    base = flows.filter("_is_low").groupBy("query_id").agg(F.sum("_f").alias("_base"))
    lowest = flows.filter("_is_low").select("query_id", "criterion", F.col("_f").alias("_f0"))
    lifts = spread_join(own, lowest, ["query_id", "criterion"], "chunk_id").groupBy("query_id", "chunk_id").agg(F.sum(F.col("_f") - F.col("_f0")).alias("_lift"))
    out = spread_join(members.join(lifts, ["query_id", "chunk_id"], "left"), base, ["query_id"], "chunk_id", "left")
    return out.select("query_id", "chunk_id", F.round(F.coalesce("_base", F.lit(0.0)) + F.coalesce("_lift", F.lit(0.0)), 9).alias("flow"))


def _flows(values: DataFrame, threshold: float) -> DataFrame:
    """Flows from running counts and sums at p, p - threshold and p + threshold.

    The look-ups are merged into the sorted rows as rows that weigh nothing. A threshold of 1 needs none.
    """
    keys = ["query_id", "criterion"]
    values = values.withColumn("_w", F.col("_c").cast("double")).withColumn("_wp", F.col("_c") * F.col("_p"))
    if threshold == 1:
        got = running_sums(values, keys, "_s", {"w0": "_w", "p0": "_wp"}).withColumns({"w1": F.lit(0.0), "p1": F.lit(0.0), "w2": F.col("_n").cast("double"), "p2": F.col("_n") / 2.0})
        return _net(got, threshold)
    at = values.select(*keys, "_s", "_low", "_n", "_c", "_p", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("_p").alias("x"), F.col("_w").alias("w"), F.col("_wp").alias("wp")),
        F.struct(F.lit(1).alias("k"), F.round(F.col("_p") - threshold, 12).alias("x"), F.lit(0.0).alias("w"), F.lit(0.0).alias("wp")),
        F.struct(F.lit(2).alias("k"), F.round(F.col("_p") + threshold, 12).alias("x"), F.lit(0.0).alias("w"), F.lit(0.0).alias("wp")),
    )).alias("e"))
    at = at.select(*keys, "_s", "_low", "_n", "_c", "_p", F.struct(F.round(F.col("e.x"), 12).alias("x"), F.col("e.k").alias("k"), F.col("_s").alias("s")).alias("_at"), F.col("e.w").alias("_w"), F.col("e.wp").alias("_wp"))
    at = running_sums(at, keys, "_at", {"_cw": "_w", "_cp": "_wp"})
    pick = lambda k, c: F.max(F.when(F.col("_at.k") == k, F.col(c)))
    got = at.groupBy(*keys, "_s", "_low", "_n", "_c", "_p").agg(
        pick(0, "_cw").alias("w0"), pick(0, "_cp").alias("p0"), pick(1, "_cw").alias("w1"), pick(1, "_cp").alias("p1"),
        pick(2, "_cw").alias("w2"), pick(2, "_cp").alias("p2"),
    )
    return _net(got, threshold)


def _net(got: DataFrame, threshold: float) -> DataFrame:
    """w and p: running counts and sums of the percentiles, 0 up to here, 1 up to p - threshold, 2 up to p + threshold."""
    p, t, total = F.col("_p"), F.lit(threshold), F.col("_n").cast("double")
    gain = F.col("w1") + (p * (F.col("w0") - F.col("w1")) - (F.col("p0") - F.col("p1"))) / t
    loss = (total - F.col("w2")) + ((F.col("p2") - F.col("p0")) - p * (F.col("w2") - F.col("w0"))) / t
    return got.withColumn("_f", F.when(F.col("_n") > 1, (gain - loss) / (total - 1)).otherwise(F.lit(0.0)))


def ranking(criteria: DataFrame, *, top: int | None = None, **how) -> DataFrame:
    """(query_id, chunk_id, flow, place): candidates by flow, ties by id; only the first ``top`` places if given."""
    flows = net_flow(criteria, **how)
    if top == 1:  # no sort of a whole query
        best = flows.groupBy("query_id").agg(F.min(F.struct((-F.col("flow")).alias("f"), F.col("chunk_id").alias("c"))).alias("m"))
        return best.select("query_id", F.col("m.c").alias("chunk_id"), (-F.col("m.f")).alias("flow"), F.lit(1).cast("long").alias("place"))
    if top is not None:
        w = Window.partitionBy("query_id").orderBy(F.desc("flow"), "chunk_id")
        return flows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top)
    ordered = flows.withColumn("_one", F.lit(1)).withColumn("_key", F.struct((-F.col("flow")).alias("f"), F.col("chunk_id").alias("c")))
    return running_sums(ordered, ["query_id"], "_key", {"place": "_one"}).drop("_one", "_key")
