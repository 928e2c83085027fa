"""Square lattices over point tables: pitch, phase, window, refinement, confidence.

points: image_id, idx, x, y (optionally width, height, score); images: image_id, width,
height. All images are fitted at once; every step is an aggregation over points or over
their few lattice indices.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.colors import clamp
from gridloom.lineage import cut_lineage
from gridloom.operators.sizing import lookup_side

# Fixed values of the fit.
PITCH_BIN = 0.25
PHASE_BINS = 160
REFINE_ROUNDS = 5
MINIMUM_POINTS = 10
TOP_CANDIDATES = 1800
PITCH_POINTS, PITCH_RAW, PITCH_KEPT, SUPPORT_POINTS = 900, 100, 80, 700
SALTS = 64


def _span(size: int) -> dict[str, Column]:
    dim = F.least("width", "height").cast("double")
    return {
        "_lo": dim / (size + 8), "_hi": dim / max(1, size - 8),
        "_tol": F.greatest(F.lit(1.5), dim / size * F.lit(0.08)),
    }


def _weighted(points: DataFrame) -> DataFrame:
    """Distinct places with their number of points, so that copies never pair up."""
    return points.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("_w"))


def _axis_neighbours(places: DataFrame, along: str, across: str, lo: Column, hi: Column, tol: Column) -> DataFrame:
    """Distances in [lo, hi] along one axis between places at most tol apart across it.

    Places fall into boxes of hi by tol; a place meets its own and the adjoining boxes, so
    the join is on the box. `places` carries whatever lo, hi and tol are made of.
    """
    boxed = places.withColumns({"_lo_": lo, "_hi_": hi, "_tol_": tol}).withColumns(
        {"_ba": F.floor(F.col(along) / F.col("_hi_")), "_bc": F.floor(F.col(across) / F.col("_tol_"))}
    )
    there = boxed.select(
        "image_id", "_ba", "_bc", F.col(along).alias("_a2"), F.col(across).alias("_c2"), F.col("_w").alias("_w2")
    )
    here = boxed.withColumn("_ba", F.explode(F.array(F.col("_ba"), F.col("_ba") + 1))).withColumn(
        "_bc", F.explode(F.array(F.col("_bc") - 1, F.col("_bc"), F.col("_bc") + 1))
    )
    d = F.col("_a2") - F.col(along)
    near = (d >= F.col("_lo_")) & (d <= F.col("_hi_")) & (F.abs(F.col("_c2") - F.col(across)) <= F.col("_tol_"))
    return here.join(there, ["image_id", "_ba", "_bc"]).where(near & (d > 0)).groupBy("image_id", d.alias("d")).agg(
        F.sum(F.col("_w") * F.col("_w2")).alias("n")
    )


def estimate_pitch(points: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """(image_id, pitch): the most frequent distance between row or column neighbours, refined by a median."""
    spans = lookup_side(cut_lineage(images.select("image_id", *[c.alias(n) for n, c in _span(size).items()])))
    # Distances and places come from many points: only what has one row per image is broadcast.
    places = _weighted(points).join(spans, "image_id")
    args = (F.col("_lo"), F.col("_hi"), F.col("_tol"))
    distances = cut_lineage(_axis_neighbours(places, "x", "y", *args).unionAll(_axis_neighbours(places, "y", "x", *args)))
    edges = F.ceil((F.col("_hi") + PITCH_BIN - F.col("_lo")) / PITCH_BIN)
    index = F.least(F.floor((F.col("d") - F.col("_lo")) / PITCH_BIN), edges - 2)
    binned = distances.join(spans, "image_id").withColumn("_bin", index)
    counts = binned.groupBy("image_id", "_lo", "_bin").agg(F.sum("n").alias("_n"))
    best = counts.groupBy("image_id", "_lo").agg(F.min_by("_bin", F.struct(-F.col("_n"), F.col("_bin"))).alias("_bin"))
    first = lookup_side(cut_lineage(best.select("image_id", (F.col("_lo") + (F.col("_bin") + 0.5) * PITCH_BIN).alias("_p"))))
    reach = F.greatest(F.lit(0.8), F.col("_p") * F.lit(0.035))
    near = distances.join(first, "image_id").where(F.abs(F.col("d") - F.col("_p")) <= reach)
    middle = near.groupBy("image_id").agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("_m"))
    return first.join(middle, "image_id", "left").select("image_id", F.coalesce("_m", "_p").alias("pitch"))


def _long(points: DataFrame, *extra: str) -> DataFrame:
    """One row per point and axis."""
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v"))))
    return points.select("image_id", "idx", *extra, axes.alias("_ax")).select("image_id", "idx", *extra, "_ax.*")


def _periodic(value: Column, phase: Column, period: Column) -> Column:
    return F.pmod(value - phase + period / 2, period) - period / 2


def _mean_shift(values: DataFrame, phases: DataFrame, keys: list[str], reach: Column) -> DataFrame:
    """Move each phase by the mean deviation of the values close to it."""
    both = values.join(phases, keys)
    delta = _periodic(F.pmod(F.col("v"), F.col("pitch")), F.col("_phase"), F.col("pitch"))
    moved = both.withColumn("_d", delta).groupBy(*keys, "_phase", "pitch").agg(F.avg(F.when(F.abs("_d") <= reach, F.col("_d"))).alias("_m"))
    phase = F.when(F.col("_m").isNull(), F.col("_phase")).otherwise(F.pmod(F.col("_phase") + F.col("_m"), F.col("pitch")))
    return moved.select(*keys, "pitch", F.round(phase, 9).alias("phase"))


def fit_phase(points: DataFrame, pitches: DataFrame) -> DataFrame:
    """(image_id, axis, pitch, phase): the fullest of 160 residue bins, moved to its neighbourhood's mean."""
    values = _long(points)
    mods = values.join(lookup_side(cut_lineage(pitches)), "image_id").withColumn(
        "_bin", F.least(F.lit(PHASE_BINS - 1), F.floor(F.pmod(F.col("v"), F.col("pitch")) * PHASE_BINS / F.col("pitch")))
    )
    counts = mods.groupBy("image_id", "axis", "pitch", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("image_id", "axis", "pitch").agg(F.min_by("_bin", F.struct(-F.col("_n"), F.col("_bin"))).alias("_bin"))
    first = best.select("image_id", "axis", "pitch", ((F.col("_bin") + 0.5) * F.col("pitch") / PHASE_BINS).alias("_phase"))
    return _mean_shift(values, lookup_side(cut_lineage(first)), ["image_id", "axis"], F.greatest(F.lit(2.0), F.col("pitch") * F.lit(0.10)))


def lattice_counts(points: DataFrame, phases: DataFrame) -> DataFrame:
    """(image_id, axis, k, n): points within 15 % of lattice index k."""
    k = F.bround((F.col("v") - F.col("phase")) / F.col("pitch")).cast("bigint")
    indexed = _long(points).join(phases, ["image_id", "axis"]).withColumn("k", k)
    close = F.abs(F.col("v") - (F.col("phase") + F.col("k") * F.col("pitch"))) <= F.greatest(F.lit(3.0), F.col("pitch") * F.lit(0.15))
    return indexed.where(close).groupBy("image_id", "axis", "k").agg(F.count(F.lit(1)).alias("n"))


def best_window(counts: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """(…, start, score): the first run of `size` indices with the largest sum of n.

    Every index adds its n to the starts that cover it; there are few indices per image.
    """
    keys = keys or ["image_id", "axis"]
    starts = counts.select(*keys, "n", F.explode(F.sequence(F.col("k") - size + 1, F.col("k"))).alias("start"))
    scores = starts.groupBy(*keys, "start").agg(F.sum("n").alias("score"))
    return scores.groupBy(*keys).agg(F.min_by(F.struct("start", "score"), F.struct(-F.col("score"), F.col("start"))).alias("_b")).select(*keys, "_b.*")


def initial_fit(points: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """(image_id, origin_x, origin_y, pitch) before refinement."""
    phases = lookup_side(cut_lineage(fit_phase(points, estimate_pitch(points, images, size))))
    windows = best_window(lattice_counts(points, phases), size)
    origin = F.col("phase") + F.coalesce("start", F.lit(0)) * F.col("pitch")
    axes = phases.join(windows, ["image_id", "axis"], "left").select("image_id", "axis", "pitch", origin.alias("_o"))
    return axes.groupBy("image_id", "pitch").agg(
        F.max(F.when(F.col("axis") == "x", F.col("_o"))).alias("origin_x"), F.max(F.when(F.col("axis") == "y", F.col("_o"))).alias("origin_y")
    )


def assign_cells(points: DataFrame, fits: DataFrame, size: int) -> DataFrame:
    """Points inside the board and near a lattice point; the closest point per cell, the first of equal ones."""
    ix = F.bround((F.col("x") - F.col("origin_x")) / F.col("pitch")).cast("int")
    iy = F.bround((F.col("y") - F.col("origin_y")) / F.col("pitch")).cast("int")
    placed = points.join(fits, "image_id").withColumns({"row_idx": iy, "col_idx": ix}).where(
        F.col("row_idx").between(0, size - 1) & F.col("col_idx").between(0, size - 1)
    )
    dx = F.col("x") - (F.col("origin_x") + F.col("col_idx") * F.col("pitch"))
    dy = F.col("y") - (F.col("origin_y") + F.col("row_idx") * F.col("pitch"))
    tol = F.greatest(F.lit(3.0), F.col("pitch") * F.lit(0.16))
    near = placed.withColumns({"_dx": dx, "_dy": dy}).where((F.abs("_dx") <= tol) & (F.abs("_dy") <= tol))
    residual = F.round(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")), 9)
    pick = F.struct("idx", "x", "y", residual.alias("residual"))
    return near.groupBy("image_id", "row_idx", "col_idx").agg(F.min_by(pick, F.struct(residual, F.col("idx"))).alias("_p")).select(
        "image_id", "row_idx", "col_idx", "_p.*"
    )


def _solve(occupied: DataFrame, fits: DataFrame) -> DataFrame:
    """Least squares for origin and common pitch from sums; fits with too few cells stay."""
    c, r = F.col("col_idx"), F.col("row_idx")
    s = occupied.groupBy("image_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(c).alias("sc"), F.sum(r).alias("sr"), F.sum(c * c + r * r).alias("sq"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * c + F.col("y") * r).alias("sp"),
    )
    n = F.col("n")
    pitch = (F.col("sp") - F.col("sc") * F.col("sx") / n - F.col("sr") * F.col("sy") / n) / (
        F.col("sq") - F.col("sc") * F.col("sc") / n - F.col("sr") * F.col("sr") / n
    )
    solved = s.withColumn("_p", F.when(n >= MINIMUM_POINTS, F.round(pitch, 9)))
    ok = F.coalesce(F.col("_p") > 1.0, F.lit(False))
    new = lambda value, old: F.when(ok, F.round(value, 9)).otherwise(F.col(old)).alias(old)
    return fits.join(solved, "image_id", "left").select(
        "image_id", new((F.col("sx") - F.col("sc") * F.col("_p")) / n, "origin_x"),
        new((F.col("sy") - F.col("sr") * F.col("_p")) / n, "origin_y"), new(F.col("_p"), "pitch"),
    )


def refine_lattice(points: DataFrame, fits: DataFrame, size: int, rounds: int = REFINE_ROUNDS) -> DataFrame:
    """Alternate assignment and least squares. The fits, one row per image, are written each round.

    Few fits are broadcast, so that the points are not, whatever size Spark expects them to have.
    """
    fits = lookup_side(cut_lineage(fits))
    for _ in range(rounds):
        fits = lookup_side(cut_lineage(_solve(assign_cells(points, fits, size), fits)))
    return fits


def fit_confidence(points: DataFrame, fits: DataFrame, occupied: DataFrame, size: int) -> DataFrame:
    """Match share, coverage and residual of each fit, with bounds and a confidence of .05 to .98."""
    total = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("candidates"))
    span = lambda c: F.max(c) - F.min(c) + 1
    stats = occupied.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("matched"), span("row_idx").alias("_sr"), span("col_idx").alias("_sc"),
        F.avg("residual").alias("avg_residual"), F.median("residual").alias("median_residual"), F.max("residual").alias("max_residual"),
    )
    all_ = fits.join(total, "image_id").join(stats, "image_id", "left")
    cover = (F.col("_sr") / size + F.col("_sc") / size) / 2
    share = F.least(F.lit(1.0), F.col("matched") / F.greatest(F.lit(12.0), F.col("candidates") * F.lit(0.75)))
    quality = F.greatest(F.lit(0.0), 1 - F.col("avg_residual") / F.greatest(F.lit(1.0), F.col("pitch") * F.lit(0.18)))
    score = F.bround(clamp(F.round(share * 0.45 + cover * 0.35 + quality * 0.20, 9), 0.05, 0.98), 3)
    half = F.col("pitch") / 2
    return all_.select(
        "image_id", "origin_x", "origin_y", "pitch", "candidates", F.coalesce("matched", F.lit(0)).alias("matched"),
        "avg_residual", "median_residual", "max_residual",
        (F.col("origin_x") - half).alias("left"), (F.col("origin_y") - half).alias("top"),
        (F.col("origin_x") + (size - 1) * F.col("pitch") + half).alias("right"), (F.col("origin_y") + (size - 1) * F.col("pitch") + half).alias("bottom"),
        F.coalesce(score, F.lit(0.05)).alias("confidence"),
    )


def fit_lattice(points: DataFrame, images: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Fitted boards, and images with too few points or no usable distance."""
    enough = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    enough = lookup_side(cut_lineage(enough))
    usable = points.join(enough.where(F.col("_n") >= MINIMUM_POINTS), "image_id", "left_semi")
    fits = refine_lattice(usable, initial_fit(usable, images, size), size)
    result = fit_confidence(usable, fits, assign_cells(usable, fits, size), size)
    failed = images.select("image_id").join(fits, "image_id", "left_anti").join(enough, "image_id", "left").select(
        "image_id", F.when(F.coalesce("_n", F.lit(0)) < MINIMUM_POINTS, "too_few_points").otherwise("no_pitch").alias("reason")
    )
    return result, failed


# --- the scored variant -----------------------------------------------------

def top_candidates(points: DataFrame, limit: int | None = None) -> DataFrame:
    """The best-scored points per image, numbered in reading order (cand_idx) and by score (rank).

    Without a limit all points stay. With one, every salted part of an image is cut to it before the parts meet.
    """
    part = Window.partitionBy("image_id", "_salt").orderBy(F.desc("score"), "idx")
    whole = Window.partitionBy("image_id").orderBy(F.desc("score"), "idx")
    if limit is None:
        ranked = points.withColumn("rank", F.row_number().over(whole))
    else:
        cut = points.withColumn("_salt", F.pmod(F.xxhash64("idx"), F.lit(SALTS))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= limit)
        ranked = cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= limit).drop("_salt", "_r")
    reading = Window.partitionBy("image_id").orderBy("y", "x", "rank")
    return ranked.withColumn("cand_idx", F.row_number().over(reading) - 1)


def _pitch_range(size: int) -> dict[str, Column]:
    dim = F.least("width", "height").cast("double")
    return {"_min": F.greatest(F.lit(6.0), dim / max(20, size + 8)), "_max": F.least(F.lit(95.0), dim / 10.0)}


def _best(candidates: DataFrame, limit: int | None) -> DataFrame:
    return candidates if limit is None else candidates.where(F.col("rank") <= limit)


def pitch_votes(candidates: DataFrame, images: DataFrame, size: int, voters: int | None = PITCH_POINTS) -> DataFrame:
    """(image_id, key, weight): half-pixel pitch bins voted for by distances and their eighths.

    The `voters` best points vote (None: all); weight 4 for a distance itself, 1.4 / sqrt(d) for its d-th part.
    """
    spans = images.select("image_id", *[c.alias(n) for n, c in _pitch_range(size).items()])
    sizes = candidates.groupBy("image_id").agg(F.median("height").alias("_mh"), F.median("width").alias("_mw"))
    or8 = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 8.0).otherwise(c)
    places = (
        _weighted(_best(candidates, voters)).join(spans, "image_id").join(sizes, "image_id")
        .withColumns({"_ny": F.greatest(F.lit(4.0), or8(F.col("_mh")) * 0.8), "_nx": F.greatest(F.lit(4.0), or8(F.col("_mw")) * 0.55)})
    )
    low, high = F.col("_min"), F.col("_max") * 8
    distances = _axis_neighbours(places, "x", "y", low, high, F.col("_ny")).unionAll(_axis_neighbours(places, "y", "x", low, high, F.col("_nx")))
    parts = distances.join(spans, "image_id").withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("_p", F.col("d") / F.col("_d"))
    weight = F.when(F.col("_d") == 1, 4.0).otherwise(1.4 / F.sqrt(F.col("_d")))
    return parts.where((F.col("_p") >= low) & (F.col("_p") <= F.col("_max"))).groupBy(
        "image_id", F.bround(F.col("_p") * 2).cast("bigint").alias("key")
    ).agg(F.round(F.sum(weight * F.col("n")), 6).alias("weight"))


def _short_pairs(candidates: DataFrame, spans: DataFrame, best: int | None) -> DataFrame:
    """(image_id, d, off, n): distances along an axis up to a little over the largest pitch, with the offset across."""
    places = _weighted(_best(candidates, best)).join(spans, "image_id")
    reach = F.col("_max") * 1.14 + 3
    wide = F.greatest(F.lit(5.0), F.col("_max") * 0.22)
    boxed = places.withColumns({"_reach": reach, "_wide": wide})

    def one(along: str, across: str) -> DataFrame:
        b = boxed.withColumns({"_ba": F.floor(F.col(along) / F.col("_reach")), "_bc": F.floor(F.col(across) / F.col("_wide"))})
        there = b.select("image_id", "_ba", "_bc", F.col(along).alias("_a2"), F.col(across).alias("_c2"), F.col("_w").alias("_w2"))
        here = b.withColumn("_ba", F.explode(F.array(F.col("_ba"), F.col("_ba") + 1))).withColumn(
            "_bc", F.explode(F.array(F.col("_bc") - 1, F.col("_bc"), F.col("_bc") + 1))
        )
        d, off = F.col("_a2") - F.col(along), F.abs(F.col("_c2") - F.col(across))
        near = (d > 0) & (d <= F.col("_reach")) & (off <= F.col("_wide"))
        return here.join(there, ["image_id", "_ba", "_bc"]).where(near).groupBy("image_id", d.alias("d"), off.alias("off")).agg(
            F.sum(F.col("_w") * F.col("_w2")).alias("n")
        )

    return one("x", "y").unionAll(one("y", "x"))


def _near_pitch(pairs: DataFrame, pitches: DataFrame, least: float, share: float) -> DataFrame:
    """Pairs whose distance is close to a pitch; met through distance buckets of eight pixels."""
    tol = F.greatest(F.lit(least), F.col("pitch") * share)
    probes = pitches.withColumn("_tol", tol).withColumn(
        "_b", F.explode(F.sequence(F.floor((F.col("pitch") - F.col("_tol")) / 8), F.floor((F.col("pitch") + F.col("_tol")) / 8)))
    )
    met = pairs.withColumn("_b", F.floor(F.col("d") / 8)).join(probes, ["image_id", "_b"])
    return met.where((F.abs(F.col("d") - F.col("pitch")) <= F.col("_tol")) & (F.col("off") <= F.greatest(F.lit(5.0), F.col("pitch") * 0.22)))


def propose_pitches(
    candidates: DataFrame, images: DataFrame, size: int, voters: int | None = PITCH_POINTS, raw_pitches: int | None = PITCH_RAW,
    supporters: int | None = SUPPORT_POINTS, kept: int | None = PITCH_KEPT,
) -> DataFrame:
    """(image_id, pitch, support, place): refined pitches by how many neighbours they explain.

    The fit's own limits are the defaults: how many of the best points vote and support, how many pitches are refined
    and kept. None lifts one.
    """
    by_vote = Window.partitionBy("image_id").orderBy(F.desc("weight"), "key")
    raw = pitch_votes(candidates, images, size, voters)
    if raw_pitches is not None:
        raw = raw.withColumn("_r", F.row_number().over(by_vote)).where(F.col("_r") <= raw_pitches)
    raw = raw.select("image_id", (F.col("key") / 2.0).alias("pitch"))
    spans = images.select("image_id", *[c.alias(n) for n, c in _pitch_range(size).items()])
    near = _near_pitch(_short_pairs(candidates, spans, voters), raw, 2.0, 0.12)
    middle = near.groupBy("image_id", "pitch").agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("_m"), F.sum("n").alias("_n"))
    refined = raw.join(middle, ["image_id", "pitch"], "left").select(
        "image_id", F.bround(F.when(F.col("_n") >= 3, F.col("_m")).otherwise(F.col("pitch")), 3).alias("pitch")
    ).distinct()
    support = _near_pitch(_short_pairs(candidates, spans, supporters), refined, 2.2, 0.14).groupBy("image_id", "pitch").agg(F.sum("n").alias("support"))
    order = Window.partitionBy("image_id").orderBy(F.desc("support"), "pitch")
    full = refined.join(support, ["image_id", "pitch"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    placed = full.withColumn("place", F.row_number().over(order))
    return placed if kept is None else placed.where(F.col("place") <= kept)


KEYS = ["image_id", "place"]


def smoothed_phase(candidates: DataFrame, pitches: DataFrame) -> DataFrame:
    """(image_id, place, axis, pitch, phase): fullest residue bin after two circular smoothings, then the mean."""
    values = _long(candidates, "score")
    n_bins = F.greatest(F.lit(24), F.bround(F.col("pitch") * 2).cast("int"))
    joined = values.join(pitches.select(*KEYS, "pitch"), "image_id").withColumn("_k", n_bins)
    binned = joined.withColumn("_bin", F.least(F.col("_k") - 1, F.floor(F.pmod(F.col("v"), F.col("pitch")) * F.col("_k") / F.col("pitch")).cast("int")))
    counts = binned.groupBy(*KEYS, "axis", "pitch", "_k", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_bin = counts.groupBy(*KEYS, "axis", "pitch", "_k").agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_h"))
    at = lambda arr, i: F.get(arr, F.pmod(i, F.col("_k")))
    smooth = lambda arr: F.transform(arr, lambda v, i: at(arr, i + 1) * 0.25 + v * 0.5 + at(arr, i - 1) * 0.25)
    dense = by_bin.withColumn("_s", F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.coalesce(F.try_element_at("_h", i), F.lit(0)).cast("double")))
    dense = dense.withColumn("_s", smooth(F.col("_s"))).withColumn("_s", smooth(F.col("_s")))
    peak = F.array_position("_s", F.array_max("_s")) - 1
    first = dense.select(*KEYS, "axis", "pitch", ((peak + 0.5) * F.col("pitch") / F.col("_k")).alias("_phase"))
    spread = values.join(pitches.select(*KEYS), "image_id")
    return _mean_shift(spread, first, [*KEYS, "axis"], F.greatest(F.lit(2.5), F.col("pitch") * 0.18))


def choose_offset(candidates: DataFrame, phases: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """(image_id, place, pitch, offset_x, offset_y): the window of lattice lines with most central, close, well-scored points."""
    tol = F.greatest(F.lit(2.4), F.col("pitch") * 0.19)
    half = F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height")) / 2.0
    joined = _long(candidates, "score").join(phases, ["image_id", "axis"]).join(images, "image_id")
    k = F.bround((F.col("v") - F.col("phase")) / F.col("pitch")).cast("bigint")
    error = F.abs(F.col("v") - (F.col("phase") + F.col("k") * F.col("pitch")))
    central = 1 + F.greatest(F.lit(0.0), 1 - F.abs(F.col("v") - half) / F.greatest(F.lit(1.0), half)) * 0.35
    weight = central * F.greatest(F.lit(0.0), 1 - F.col("_e") / tol) * clamp(F.col("score") / 55.0, 0.5, 2.0)
    scored = joined.withColumn("k", k).withColumn("_e", error)
    indexed = scored.groupBy(*KEYS, "axis", "k").agg(F.round(F.sum(F.when(F.col("_e") <= tol, weight).otherwise(0.0)), 9).alias("n"))
    windows = best_window(indexed, size, [*KEYS, "axis"])
    offset = F.col("phase") + F.col("start") * F.col("pitch")
    axes = phases.join(windows, [*KEYS, "axis"]).select(*KEYS, "axis", "pitch", offset.alias("_o"))
    return axes.groupBy(*KEYS, "pitch").agg(
        F.max(F.when(F.col("axis") == "x", F.col("_o"))).alias("offset_x"), F.max(F.when(F.col("axis") == "y", F.col("_o"))).alias("offset_y")
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cell_components(rows: pd.Series, cols: pd.Series) -> pd.Series:
    """Per board: component number of each occupied cell; cells within two steps are neighbours."""
    near = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a or b) and abs(a) + abs(b) <= 3]

    def label(rs, cs):
        cells = list(zip(rs.tolist(), cs.tolist()))
        number = dict.fromkeys(cells, -1)
        count = 0
        for start in cells:
            if number[start] >= 0:
                continue
            number[start], stack = count, [start]
            while stack:
                r, c = stack.pop()
                for dr, dc in near:
                    nxt = (r + dr, c + dc)
                    if number.get(nxt, 0) < 0:
                        number[nxt] = count
                        stack.append(nxt)
            count += 1
        return [number[c] for c in cells]

    return pd.Series([label(r, c) for r, c in zip(rows, cols)])


def filter_lattice_components(occupied: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keep the largest group of neighbouring cells and other large two-dimensional ones.

    Boards have at most 104 × 104 cells, so a board's cells fit one array.
    """
    keys = keys or KEYS
    boards = occupied.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_idx", "col_idx"))).alias("_c"))
    part = lambda n: F.transform("_c", lambda c: c[n])
    labelled = boards.withColumn("_l", _cell_components(part("row_idx"), part("col_idx"))).select(
        *keys, F.size("_c").alias("_total"), F.explode(F.arrays_zip("_c", "_l")).alias("_z")
    ).select(*keys, "_total", F.col("_z._c.row_idx").alias("row_idx"), F.col("_z._c.col_idx").alias("col_idx"), F.col("_z._l").alias("_l"))
    span = lambda c: F.max(c) - F.min(c) + 1
    comps = labelled.groupBy(*keys, "_total", "_l").agg(F.count(F.lit(1)).alias("_n"), span("row_idx").alias("_sr"), span("col_idx").alias("_sc"))
    group = Window.partitionBy(*keys)
    most = F.max("_n").over(group)
    first = F.row_number().over(group.orderBy(F.desc("_n"), "_l"))
    flat = comps.withColumns({"_most": most, "_first": first})
    large = (F.col("_n") >= F.greatest(F.lit(8), F.floor(F.col("_most") * 0.18))) & (F.col("_sr") >= 4) & (F.col("_sc") >= 4)
    flat = flat.withColumn("_keep", (F.col("_n") == F.col("_most")) | large)
    flat = flat.withColumn("_cells", F.sum(F.when(F.col("_keep"), F.col("_n"))).over(group))
    lone = F.col("_cells") < F.greatest(F.lit(8), F.col("_most"))
    keep = (F.col("_total") < 12) | F.when(lone, F.col("_first") == 1).otherwise(F.col("_keep"))
    kept = labelled.join(flat.where(keep).select(*keys, "_l"), [*keys, "_l"], "left_semi").select(*keys, "row_idx", "col_idx")
    return occupied.join(kept, [*keys, "row_idx", "col_idx"], "left_semi")


def score_lattice(candidates: DataFrame, offsets: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Score and confidence of every proposed lattice: (image_id, place, pitch, offsets, inliers, direct, score, confidence)."""
    tol = F.greatest(F.lit(2.4), F.col("pitch") * 0.19)
    sized = candidates.drop("width", "height").join(images, "image_id").join(offsets, "image_id")
    col_ = F.bround((F.col("x") - F.col("offset_x")) / F.col("pitch")).cast("int")
    row_ = F.bround((F.col("y") - F.col("offset_y")) / F.col("pitch")).cast("int")
    placed = sized.withColumns({"row_idx": row_, "col_idx": col_}).where(F.col("row_idx").between(0, size - 1) & F.col("col_idx").between(0, size - 1))
    placed = placed.withColumns(
        {
            "_dx": F.col("x") - (F.col("offset_x") + F.col("col_idx") * F.col("pitch")),
            "_dy": F.col("y") - (F.col("offset_y") + F.col("row_idx") * F.col("pitch")),
        }
    ).withColumn("_res", F.hypot("_dx", "_dy"))
    hits = placed.where((F.abs("_dx") <= tol) & (F.abs("_dy") <= tol) & (F.col("_res") <= tol * 1.35))
    cx, cy = F.col("width") / 2.0, F.col("height") / 2.0
    central = 1 + F.greatest(F.lit(0.0), 1 - F.hypot(F.col("x") - cx, F.col("y") - cy) / F.greatest(F.lit(1.0), F.hypot(cx, cy))) * 0.35
    match = central * F.greatest(F.lit(0.0), 1 - F.col("_res") / (tol * 1.35))
    keys = [*KEYS, "pitch", "offset_x", "offset_y"]
    cells = hits.groupBy(*keys, "row_idx", "col_idx").agg(
        F.min_by(F.col("_res"), F.struct(-F.col("score"), F.col("cand_idx"))).alias("residual"), F.sum(match).alias("_match")
    )
    cells = cut_lineage(cells)
    matched = cells.groupBy(*KEYS).agg(F.sum("_match").alias("_match"))
    inliers = filter_lattice_components(cells)
    there = lambda dr, dc: inliers.select(*KEYS, (F.col("row_idx") - dr).alias("row_idx"), (F.col("col_idx") - dc).alias("col_idx"), F.lit(1).alias(f"_n{dr}{dc}"))
    linked = inliers.join(there(0, 1), [*KEYS, "row_idx", "col_idx"], "left").join(there(1, 0), [*KEYS, "row_idx", "col_idx"], "left")
    span = lambda c: F.max(c) - F.min(c) + 1
    stats = linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inliers"), span("row_idx").alias("_sr"), span("col_idx").alias("_sc"), F.avg("residual").alias("_avg"),
        (F.count("_n01") + F.count("_n10")).alias("direct"),
    ).where((F.col("inliers") >= 8) & (F.col("_sr") >= 2) & (F.col("_sc") >= 2))
    total = candidates.groupBy("image_id").agg(F.count(F.lit(1)).alias("_total"))
    full = stats.join(matched, KEYS).join(total, "image_id")
    sparse = F.greatest(F.lit(0), F.col("_sr") * F.col("_sc") - F.col("inliers")) * 0.025
    score = F.col("inliers") * 10.0 + F.col("direct") * 16.0 + F.col("_match") * 5.0 - F.col("_avg") * 3.5 - sparse
    sure = (
        F.col("inliers") / F.greatest(F.lit(12.0), F.col("_total") * 0.28) * 0.45 + F.least(F.lit(0.4), F.col("direct") / 90.0)
        + F.greatest(F.lit(0.0), 0.15 - F.col("_avg") / F.greatest(F.lit(1.0), F.col("pitch")))
    )
    return full.select(
        *keys, "inliers", "direct", F.round(score, 6).alias("score"), F.bround(clamp(F.round(sure, 9), 0.05, 0.98), 3).alias("confidence"),
        F.round("_avg", 6).alias("avg_residual"),
    )


def fit_scored_lattice(points: DataFrame, images: DataFrame, size: int, limit: int | None = TOP_CANDIDATES) -> DataFrame:
    """Best-scored lattice per image, the earlier proposal on ties, from its `limit` best points (None: all).

    Whatever the limit, pitches are proposed from the best of them only, within the bounds that `propose_pitches` has by default.
    """
    candidates = cut_lineage(top_candidates(points, limit))
    pitches = cut_lineage(propose_pitches(candidates, images, size))
    phases = cut_lineage(smoothed_phase(candidates, pitches))
    scored = score_lattice(candidates, choose_offset(candidates, phases, images, size), images, size)
    cols = [c for c in scored.columns if c != "image_id"]
    return scored.groupBy("image_id").agg(F.min_by(F.struct(*cols), F.struct(-F.col("score"), F.col("place"))).alias("_b")).select("image_id", "_b.*")
