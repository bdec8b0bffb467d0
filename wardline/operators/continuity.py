"""The choice among a frame's candidate readings, where the value chosen is the prior of the frames after it.

A candidate's score is its own plus what nearness to the prior is worth, so each choice waits for the one
before it. But a frame only maps the state before it to one of its own few candidates, and such maps compose.
A long sequence is cut at anchors, frames whose choice is a value whatever the prior. From an anchor there
are as many states as it has candidates: the segment up to the next one is run for all of them at once, which
gives the map from one anchor's candidates to the next one's. Composed along the key, the maps say what each
anchor chose, and every segment is replayed from there. Segments are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .readings import continuity_bonus, hold_last

#: Width of the parts of a key's order, each of which begins a segment at its first anchor.
STEP = 512
#: Segments whose maps are composed in one group.
MAPS = 256
#: What nearness to the prior can be worth, at least and at most.
LOW, HIGH = -0.10, 0.25


def best(candidates: Column, prior: Column) -> Column:
    """The candidate of the greatest score, the first of equals: score, minus its place, value."""
    return F.array_max(F.transform(candidates, lambda c, i: F.struct((c["base"] + continuity_bonus(c["value"], prior)).alias("score"), (-i).alias("back"), c["value"].alias("value"))))


def _after(candidates: Column, prior: Column) -> Column:
    """The state after a frame: a choice without a value leaves the prior."""
    return F.coalesce(best(candidates, prior)["value"], prior)


def anchored(candidates: Column) -> Column:
    """Whether some value is chosen whatever the prior: the least that the best valued one can have beats all without a value."""
    valued = F.array_max(F.transform(F.filter(candidates, lambda c: c["value"].isNotNull()), lambda c: c["base"] + LOW))
    others = F.array_max(F.transform(F.filter(candidates, lambda c: c["value"].isNull()), lambda c: c["base"]))
    return F.coalesce(valued > F.coalesce(others, F.lit(float("-inf"))), F.lit(False))


def choose(frames: DataFrame, keys: Sequence[str], order: str, candidates: str = "candidates", step: int = STEP) -> DataFrame:
    """``keys``, ``order``, ``choice`` (place of the chosen candidate, from 0), ``value`` (its value), ``prior``, ``held`` and ``imputed``.

    ``candidates`` is an array of (``value``, ``base``); a candidate without a base is chosen last. ``order``
    is a whole number, one to a frame of a key. A frame without candidates has a null choice and value, and
    holds the prior. Null keys are keys; an empty table gives no rows. A stretch without an anchor stays in
    one segment, however long.
    """
    number = F.col(order)
    own = F.transform(F.coalesce(F.col(candidates), F.array().cast(frames.schema[candidates].dataType)), lambda c: F.struct(c["value"].cast("double").alias("value"), c["base"].cast("double").alias("base")))
    rows = frames.select(*keys, order, own.alias("_c")).withColumn("_anchor", anchored(F.col("_c")))
    wide = step * 64  # for the scans, whose parts are cheap
    rows = scan.scan(rows, keys, [order], wide, _last=scan.latest(F.when(F.col("_anchor"), number), upto=False))
    starts = F.col("_anchor") & (F.col("_last").isNull() | (scan.part_of("_last", step) < scan.part_of(order, step)))
    rows = rows.withColumn("_start", F.when(starts, number))
    rows = scan.scan(rows, keys, [order], wide, _seg=scan.latest(F.col("_start")), _before=scan.latest(F.col("_start"), upto=False))
    # An anchor that begins a segment also closes the one before it (the null one is what comes before all anchors).
    places = F.when(F.col("_start").isNotNull(), F.array(F.struct(F.col("_seg").alias("seg"), F.lit(0).alias("closes")), F.struct(F.col("_before").alias("seg"), F.lit(1).alias("closes"))))
    places = F.explode(F.coalesce(places, F.array(F.struct(F.col("_seg").alias("seg"), F.lit(0).alias("closes")))))
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    spread = rows.select(group.alias("_k"), number.alias("_o"), "_c", places.alias("_p"))
    segments = spread.groupBy("_k", F.struct("_p.seg").alias("_s")).agg(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_p.closes").alias("closes"), F.col("_c").alias("c")))).alias("_f"))
    seg = F.col("_s.seg")

    # The map of a segment: from each candidate of its anchor (before all anchors: from no prior) to the choice of the frame that closes it.
    last = F.element_at("_f", -1)
    begin = F.when(seg.isNull(), F.array(F.lit(None).cast("double"))).otherwise(F.transform(F.col("_f")[0]["c"], lambda c: c["value"]))
    middle = F.filter("_f", lambda f, i: (f["closes"] == 0) & ((i > 0) | seg.isNull()))
    ends = F.aggregate(middle, begin, lambda states, f: F.transform(states, lambda p: _after(f["c"], p)))
    maps = segments.select("_k", "_s", F.when(last["closes"] == 1, F.transform(ends, lambda p: -best(last["c"], p)["back"])).alias("_m"))
    block = F.when(seg.isNotNull(), F.floor(scan.part_of("_s.seg", step) / MAPS))
    maps = maps.withColumn("_b", F.struct(block.alias("b")))

    def entries(df: DataFrame, by: list[str], at: str, first: Column) -> DataFrame:
        """``by``, ``at`` and ``_i``, the choice at the beginning of each, of a group whose maps (``_m``) stand in the order of ``at``."""
        ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_m").alias("m"))))
        zero = F.struct(first.alias("i"), F.array().cast(f"array<struct<at:{df.schema[at].dataType.simpleString()},i:int>>").alias("out"))
        run = F.aggregate(F.col("_all"), zero, lambda acc, x: F.struct(x["m"][acc["i"]].alias("i"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["i"].alias("i")))).alias("out")))
        done = df.groupBy(*by).agg(ordered.alias("_all"), *([F.first("_i0").alias("_i0")] if "_i0" in df.columns else [])).select(*by, F.explode(run["out"]).alias("_e"))
        return done.select(*by, F.col("_e.at").alias(at), F.col("_e.i").alias("_i"))

    # Blocks of maps composed; what each block begins with, along the key; then what each segment begins with, in its block.
    whole = F.array_sort(F.collect_list(F.struct(F.col("_s").alias("at"), F.col("_m").alias("m"))))
    composed = F.aggregate(F.col("_all"), F.sequence(F.lit(0), F.size(F.col("_all")[0]["m"]) - 1), lambda acc, x: F.transform(acc, lambda i: x["m"][i]))
    blocks = maps.groupBy("_k", "_b").agg(whole.alias("_all")).select("_k", "_b", F.when(F.element_at("_all", -1)["m"].isNotNull(), composed).alias("_m"))
    into = entries(blocks, ["_k"], "_b", F.lit(0)).withColumnRenamed("_i", "_i0")
    at = entries(maps.join(into, ["_k", "_b"]), ["_k", "_b"], "_s", F.col("_i0")).drop("_b")

    # Replay: the anchor's choice is known, the others follow from the state.
    def step_on(acc: Column, f: Column) -> Column:
        b = best(f["c"], acc["p"])
        return F.struct(F.coalesce(b["value"], acc["p"]).alias("p"), F.concat(acc["out"], F.array(F.struct(f["o"].alias("o"), (-b["back"]).alias("choice"), b["value"].alias("value")))).alias("out"))

    anchor = F.col("_f")[0]
    chosen = anchor["c"][F.col("_i")]["value"]
    nothing = F.array().cast(f"array<struct<o:{frames.schema[order].dataType.simpleString()},choice:int,value:double>>")
    zero = F.when(seg.isNull(), F.struct(F.lit(None).cast("double").alias("p"), nothing.alias("out"))).otherwise(
        F.struct(chosen.alias("p"), F.array(F.struct(anchor["o"].alias("o"), F.col("_i").alias("choice"), chosen.alias("value"))).alias("out"))
    )
    replayed = segments.join(at, ["_k", "_s"]).select("_k", F.explode(F.aggregate(middle, zero, step_on)["out"]).alias("_r"))
    out = replayed.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("_r.o").alias(order), F.col("_r.choice").alias("choice"), F.col("_r.value").alias("value"))
    prior = scan.scan(out, keys, [order], wide, prior=scan.latest(F.col("value"), upto=False))
    return hold_last(prior, list(keys), order, "value", step=wide)
