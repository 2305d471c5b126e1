"""Checks of inputs: one aggregate each; reports are DataFrames, refusals raise.

Counts are long-format nonzeros (side, pert, cell, gene, x); side 0 is measured,
side 1 predicted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far from an integer a count may lie.
INTEGRAL = 1e-6


def profile_of_values(counts: DataFrame) -> DataFrame:
    """side, n, lowest, highest, fraction (largest distance from an integer), n_nan."""
    x = F.col("x")
    number = F.when(~F.isnan(x), x)
    return counts.groupBy("side").agg(
        F.count("*").alias("n"), F.min(number).alias("lowest"), F.max(number).alias("highest"),
        F.max(F.abs(number - F.rint(number))).alias("fraction"), F.sum(F.isnan(x).cast("long")).alias("n_nan"),
    )


def require_type(counts: DataFrame, kind: str, allow_fractional: bool = False) -> None:
    """``counts`` must be whole and non-negative, ``lognorm`` non-negative and not all whole."""
    if kind not in ("counts", "lognorm"):
        raise ValueError(f"unknown input type {kind!r}")
    for r in profile_of_values(counts).collect():  # one row a side
        if r["n_nan"]:
            raise ValueError(f"side {r['side']}: {r['n_nan']} values are NaN")
        if r["lowest"] is not None and r["lowest"] < 0:
            raise ValueError(f"side {r['side']}: the least value is {r['lowest']}")
        if kind == "counts" and not allow_fractional and (r["fraction"] or 0) > INTEGRAL:
            raise ValueError(f"side {r['side']}: counts must be whole numbers")
        if kind == "lognorm" and (r["highest"] or 0) > 0 and (r["fraction"] or 0) <= INTEGRAL:
            raise ValueError(f"side {r['side']}: log-normalised values are all whole, so these look like counts")


def guess_type(libs: DataFrame, sample: int | None = None) -> DataFrame:
    """side, kind: lognorm if any cell total isn't whole; of ``sample`` cells a side, drawn by hash, if given."""
    drawn = libs
    if sample is not None:
        sides = [r["side"] for r in libs.select("side").distinct().collect()]  # two at most
        parts = [libs.filter(F.col("side").eqNullSafe(F.lit(x))).orderBy(F.md5(F.col("cell").cast("string")), "cell").limit(sample) for x in sides]
        drawn = libs.limit(0)
        for part in parts:
            drawn = drawn.unionByName(part)
    off = F.max(F.abs(F.col("lib") - F.rint("lib")))
    return drawn.groupBy("side").agg(F.when(off > INTEGRAL, "lognorm").otherwise("counts").alias("kind"))


def resolved_types(libs: DataFrame, declared: tuple[str, str], guess: bool = False, allow_discrete: bool = False) -> tuple[str, ...]:
    """What both sides are: as declared, or guessed from the cells' totals; ``allow_discrete`` calls all that is whole counts."""
    if not guess:
        return declared
    if allow_discrete:
        return ("counts", "counts")
    kinds = {r["side"]: r["kind"] for r in guess_type(libs).collect()}  # a row a side
    return tuple(kinds.get(s, declared[s]) for s in (0, 1))


def remarks(types: tuple[str, str], group_sums: bool, values: DataFrame | None = None) -> list[str]:
    """What a run should say about its inputs: sides of different kinds, a comparator that isn't the one asked for, fractions among counts."""
    out = []
    if types[0] != types[1]:
        out.append(f"the sides are of different kinds: {types[0]} and {types[1]}")
    if group_sums and set(types) != {"counts"}:
        out.append("group sums need counts on both sides; means of log-normalised cells are compared instead")
    for r in values.collect() if values is not None else ():  # a row a side, of profile_of_values
        if types[r["side"]] == "counts" and (r["fraction"] or 0) > INTEGRAL:
            out.append(f"side {r['side']}: counts with fractions up to {r['fraction']:.3g} are used as they are")
    return out


def beyond_scale(libs: DataFrame, most: float) -> DataFrame:
    """side, pert, cell, lib of cells whose total is NaN or above ``most``."""
    return libs.filter(F.isnan("lib") | (F.col("lib") > most)).select("side", "pert", "cell", "lib")


def beyond_scale_logged(values: DataFrame, most: float) -> DataFrame:
    """side, pert, cell, highest, total of cells of log-normalised values that can't come from totals up to ``most``.

    A single value may reach log(1 + most), give or take 16 units in the last
    place; the values of a cell, taken back, sum to ``most`` at most, but for what
    taking back rounds.  NaN never fits.
    """
    g = values.groupBy("side", "pert", "cell").agg(F.max("x").alias("highest"), F.sum(F.expm1("x")).alias("total"))
    high = F.log1p(F.lit(float(most))) * (1 + 16 * 2.0**-52)
    return g.filter(F.isnan("highest") | (F.col("highest") > high) | (F.col("total") > most * (1 + 1e-12)))


def require_scale(libs: DataFrame, most: float, values: DataFrame | None = None) -> None:
    """Totals of cells up to ``most``; of log-normalised ``values``, what they are taken back to."""
    found = (beyond_scale(libs, most) if values is None else beyond_scale_logged(values, most).withColumnRenamed("total", "lib")).limit(5).collect()
    if found:
        raise ValueError(f"cells with totals beyond {most}: {[(r['side'], r['cell'], r['lib']) for r in found]}")


def unpaired(counts: DataFrame) -> DataFrame:
    """axis (pert or gene), name, side: labels that only this side has."""
    out = None
    for axis in ("pert", "gene"):
        one = counts.groupBy(axis).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi")
        part = one.select(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("name"), F.col("lo").alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


def require_pair(counts: DataFrame, control: int) -> None:
    """Both sides need the same perturbations and genes, and the control."""
    found = unpaired(counts).limit(20).collect()
    if found:
        raise ValueError(f"only on one side: {[(r['axis'], r['name'], r['side']) for r in found]}")
    if counts.filter(F.col("pert") == control).select("side").distinct().count() < 2:
        raise ValueError(f"the control {control!r} is missing")


def require_finite(df: DataFrame, column: str) -> None:
    bad = df.filter(F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf"))).limit(1).count()
    if bad:
        raise ValueError(f"{column} must be finite")


def duplicate_keys(de: DataFrame) -> DataFrame:
    """side, target, feature, times: keys that come more than once."""
    return de.groupBy("side", "target", "feature").agg(F.count("*").alias("times")).filter("times > 1")


def without_own(de: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of ``de`` whose feature isn't the target's own gene (pert, gene)."""
    return de.join(own.select(F.col("pert").alias("target"), F.col("gene").alias("feature")), ["target", "feature"], "left_anti")


def panel_genes(genes: DataFrame, own: DataFrame) -> DataFrame:
    """The genes that no perturbation targets; none left is an error."""
    left = genes.join(own.select("gene").distinct(), "gene", "left_anti")
    if not left.limit(1).count():
        raise ValueError("every gene is some perturbation's own gene")
    return left


def require_targets(real: DataFrame, pred: DataFrame, control: object) -> None:
    """Both differential-expression tables have the same targets, and the control is none of them."""
    a, b = (df.select(F.col("target").cast("string")).distinct() for df in (real, pred))
    other = [r[0] for r in a.exceptAll(b).unionByName(b.exceptAll(a)).limit(20).collect()]
    if other:
        raise ValueError(f"targets of one table only: {sorted(map(str, other))}")
    if a.filter(F.col("target") == str(control)).limit(1).count():
        raise ValueError(f"the control {control!r} is a target")


def require_resolution(own: DataFrame) -> None:
    if not own.limit(1).count():
        raise ValueError("no perturbation is a measured gene; give a map from perturbation to gene")


def uncovered(real: DataFrame, pred: DataFrame, threshold: float = 0.05) -> DataFrame:
    """target, n_missing, n_real: measured significant genes that the prediction never tested."""
    sig = real.filter((F.col("p_adj") < threshold) & ~F.isnan("p_adj")).select("target", "feature")
    seen = pred.select("target", "feature").distinct().withColumn("seen", F.lit(1))
    g = sig.join(seen, ["target", "feature"], "left").groupBy("target")
    return g.agg(F.sum(F.when(F.col("seen").isNull(), 1).otherwise(0)).alias("n_missing"), F.count("*").alias("n_real"))
