"""Mixing sources to target weights by entropy balancing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import stored, words

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
UNIT = 1 << 26
STEPS, PRECISION = 60, 1e-9
REPAIRS, NEAR = 8, 0.002


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size), one for each source.

    Sources in code point order, NULL last, get the weights in turn and share ``share`` times all sizes by them. No
    target exceeds ``most`` times the size of its source; the excess is shared by weight among the rest. So a target
    is min(cap, weight * level), with the one level at which the targets add up.
    """
    numbers = ", ".join(map(str, weights))
    ranked = sizes.selectExpr("*", f"element_at(array({numbers}), CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INT)) AS weight", f"CAST({most} * source_size AS DOUBLE) AS cap")
    filling = ranked.selectExpr(
        "*",
        f"{share} * sum(source_size) OVER () AS total",
        "coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full",
        "sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight",
    )
    levels = filling.selectExpr("*", "(total - full) / open_weight AS level", "cap / weight AS limit")
    # The level is that of the first source, by limit, that is not filled up.
    level = levels.selectExpr("*", "min(CASE WHEN level <= limit THEN struct(limit, source IS NULL, source, level) END) OVER () AS chosen")
    return level.selectExpr("source", "source_size", "least(cap, weight * coalesce(chosen.level, double('infinity'))) AS target")


def tilts(cells: DataFrame, goals: DataFrame, *, most: int = MOST, steps: int = STEPS, precision: float = PRECISION) -> DataFrame:
    """(source, mean, tilt): the solution of the dual, one number for each source; NULL where all rates are ``most``.

    ``cells`` counts documents by (source, size). The rates that are nearest to 1 in relative entropy, stay at or below
    ``most`` and meet the token targets are min(most, exp(tilt * size / mean)). The dual is convex in the tilts, its
    gradient is the surplus of tokens; each Newton step is one aggregation over the cells, kept inside the bracket
    of the root. One number, the largest relative surplus, comes to the driver after each step. RuntimeError if a source
    is not within ``precision`` after ``steps``.
    """
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    joined = goals.alias("g").join(means.alias("m"), F.expr("g.source <=> m.source")).selectExpr("g.source", "g.target", "g.source_size", "m.mean")
    full = joined.filter(f"target >= {most} * source_size * (1 - 1e-12)").selectExpr("source", "mean", "CAST(NULL AS DOUBLE) AS tilt")
    state = stored(joined.filter(f"target < {most} * source_size * (1 - 1e-12)").selectExpr("source", "mean", "target", "ln(target / source_size) AS tilt", "double('-infinity') AS low", "double('infinity') AS high", "double('infinity') AS off"))
    for _ in range(steps):
        rate = f"least({most}D, exp(tilt * size / mean))"
        sums = (
            cells.alias("c").join(state.alias("s"), F.expr("c.source <=> s.source"))
            .selectExpr("s.source", "n * size AS mass", "size / mean AS z", f"{rate} AS rate")
            .groupBy("source").agg(F.sum(F.expr("mass * rate")).alias("got"), F.sum(F.expr(f"IF(rate < {most}, mass * z * rate, 0)")).alias("slope"))
        )
        moved = state.alias("s").join(sums.alias("t"), F.expr("s.source <=> t.source")).selectExpr("s.*", "got - target AS surplus", "slope")
        moved = moved.selectExpr("source", "mean", "target", "tilt", "IF(surplus < 0, tilt, low) AS low", "IF(surplus > 0, tilt, high) AS high", "surplus", "slope", "abs(surplus) / target AS off")
        newton = "tilt - surplus / slope"
        inside = f"slope > 0 AND {newton} > low AND {newton} < high"
        between = f"CASE WHEN low > double('-infinity') AND high < double('infinity') THEN (low + high) / 2 WHEN surplus < 0 THEN 2 * abs(tilt) + 1 ELSE -2 * abs(tilt) - 1 END"
        state = stored(moved.selectExpr("source", "mean", "target", f"CASE WHEN off <= {precision} THEN tilt WHEN {inside} THEN {newton} ELSE {between} END AS tilt", "low", "high", "off"))
        off = state.agg(F.max("off")).first()[0] or 0
        if off <= precision:
            break
    else:
        raise RuntimeError(f"a source is {off:.2g} from its target after {steps} steps")
    return full.unionAll(state.select("source", "mean", "tilt"))


def mix(docs: DataFrame, *, columns: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", most: int = MOST, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of ``columns``), doc_id, size, source_size, target, rate, copies.

    size counts words. Rates come from entropy balancing; they are rounded into copies by one running sum over each
    source in the order of size, so that a document is counted when the sum passes a whole number: the words taken then
    differ from the target by the largest document at most. Up to ``REPAIRS`` more steps, as long as a source is farther
    than ``NEAR`` from its target, change the copies of one document in each source, the one whose size is nearest to
    what is left over, if that brings it nearer. Everything is decided by
    sizes and ids, so reruns agree. The running sums are sums over the partitions of a sort and over their totals, so a
    source with most of the rows is spread; rates are met by source and size, and repairs look at one document of each
    source, size and number of copies. A source whose documents are too large or too few stays as near as they allow.
    NULL is a source; NULL and blank texts have size 0 and one copy.
    """
    size = F.size(words(F.col(text_column))).cast("long")
    base = docs.select(F.struct(*(columns or [id_column])).alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.alias("size"))
    base = stored(base.withColumn("place", F.monotonically_increasing_id()))
    slim = base.drop("row")
    cells = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = stored(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights=weights, share=share, most=most))
    found = tilts(cells.filter("size > 0"), goals, most=most)
    known = goals.alias("g").join(found.alias("f"), F.expr("g.source <=> f.source"), "left").selectExpr("g.source AS of", "source_size", "target", "mean", "tilt")

    rate = F.expr(f"CASE WHEN size = 0 THEN 1D WHEN target <= 0 THEN 0D WHEN tilt IS NULL THEN {most}D ELSE least({most}D, exp(tilt * size / mean)) END")
    # Rates are those of a source and size, so that the rows of a large source are dealt by size too.
    rates = cells.join(known, F.expr("source <=> of")).select("of", F.col("size").alias("of_size"), "source_size", "target", rate.alias("rate"))
    rated = slim.join(rates, F.expr("source <=> of AND size = of_size")).drop("of", "of_size").withColumn("part_of", F.round(F.col("rate") * UNIT).cast("long"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("place")]
    ordered = stored(stored(rated).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    totals = ordered.groupBy("part", "source").agg(F.sum("part_of").alias("sum"))
    before = totals.selectExpr("part AS in_part", "source AS of", f"coalesce(sum(sum) OVER (PARTITION BY source ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {UNIT // 2} AS before")
    running = ordered.join(before, F.expr("part = in_part AND source <=> of")).selectExpr("*", "before + sum(part_of) OVER (PARTITION BY part, source ORDER BY at) AS upto")
    rounded = stored(running.selectExpr("place", "source", "size", "source_size", "target", "rate", f"upto DIV {UNIT} - (upto - part_of) DIV {UNIT} AS copies"))

    for _ in range(REPAIRS):
        left = stored(rounded.groupBy("source").agg(F.expr("max(target) - sum(copies * size)").alias("left"), F.max("target").alias("of_target")).withColumnsRenamed({"source": "of"}))
        if (left.filter("of_target > 0").agg(F.max(F.expr("abs(left) / of_target"))).first()[0] or 0) <= NEAR:
            break
        kinds = rounded.filter("size > 0").groupBy("source", "size", "copies").agg(F.min("place").alias("place"))
        near = kinds.join(left, F.expr("source <=> of")).filter(f"IF(left > 0, copies < {most}, copies > 0) AND abs(abs(left) - size) < abs(left)")
        change = near.groupBy("source").agg(F.expr("min(struct(abs(abs(left) - size) AS off, place, CAST(signum(left) AS BIGINT) AS by))").alias("best")).selectExpr("best.place AS place", "best.by AS by")
        rounded = stored(rounded.join(change, "place", "left").selectExpr("place", "source", "size", "source_size", "target", "rate", "copies + coalesce(by, 0) AS copies"))
    return base.select("row", "doc_id", "place").join(rounded, "place").select("row", "doc_id", "size", "source_size", "target", "rate", "copies")
