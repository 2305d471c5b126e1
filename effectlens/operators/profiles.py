"""Normalisation and group profiles of long-format counts (nonzeros only)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BULK_SUM, CELL_SUM = 5e4, 1e6
GROUP = ["side", "pert"]
#: Cells of a group that one task of the jackknife takes.
SHARE = 2000
#: Cells of a share that are spelled out over all genes at one time.
CELLS = 64
#: Hexadecimal digits of a hash that cells of a group are counted by before they are ranked.
HEAD = 3


def libraries(counts: DataFrame) -> DataFrame:
    """side, pert, cell, lib: totals of cells."""
    return counts.groupBy(*GROUP, "cell").agg(F.sum("x").alias("lib"))


def group_sizes(libs: DataFrame) -> DataFrame:
    return libs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("lib").alias("total_lib"))


def target_sum(libs: DataFrame, control: int) -> DataFrame:
    """The median positive total of the measured control cells."""
    return libs.filter((F.col("side") == 0) & (F.col("pert") == control) & (F.col("lib") > 0)).agg(F.median("lib").alias("target_sum"))


def normalized(counts: DataFrame, libs: DataFrame | None, total: float = CELL_SUM) -> DataFrame:
    """counts with v = x * total / lib; without ``libs`` the counts have the totals themselves."""
    if libs is None:
        return counts.withColumn("v", F.col("x") * total / F.col("lib"))
    return counts.join(libs.select("side", "cell", "lib"), ["side", "cell"]).withColumn("v", F.col("x") * total / F.col("lib"))


def lognormed(counts: DataFrame, libs: DataFrame | None, total: float = CELL_SUM) -> DataFrame:
    """counts with x = log(1 + x * total / lib)."""
    return normalized(counts, libs, total).withColumn("x", F.log1p("v")).drop("v", "lib")


def linear(values: DataFrame, libs: DataFrame | None, kinds: tuple[str, str], total: float = CELL_SUM) -> DataFrame:
    """values with v in linear space, each side by its kind: counts are scaled, log-normalised values taken back."""
    if unknown := set(kinds) - {"counts", "lognorm"}:
        raise ValueError(f"unknown input types {sorted(unknown)}")
    if kinds == ("counts", "counts"):
        return normalized(values, libs, total)
    logged = F.lit(False)
    for side, kind in enumerate(kinds):
        logged = logged | ((F.col("side") == side) & F.lit(kind == "lognorm"))
    return normalized(values, libs, total).withColumn("v", F.when(logged, F.expm1("x")).otherwise(F.col("v")))


def profiles(values: DataFrame, sizes: DataFrame, genes: DataFrame, bulk_sum: float = BULK_SUM) -> DataFrame:
    """One row a (side, pert, gene), zeros included: total, counts, normalized, geometric, lognorm, bulk, sumsq.

    ``values`` holds x and v of nonzeros; means divide by all cells of the group.
    """
    sums = values.groupBy(*GROUP, "gene").agg(
        F.sum("x").alias("total"), F.sum("v").alias("s"), F.sum(F.log1p("v")).alias("ls"), F.sum(F.log1p("v") * F.log1p("v")).alias("lss"), F.sum(F.log1p("x")).alias("lx")
    )
    return from_sums(sums, sizes, genes, bulk_sum)


def from_sums(sums: DataFrame, sizes: DataFrame, genes: DataFrame, bulk_sum: float = BULK_SUM) -> DataFrame:
    """``profiles`` of sums by side, perturbation and gene."""
    listed = genes.agg(F.collect_set("gene").alias("genes"))
    grid = sizes.join(F.broadcast(listed), F.lit(True)).select(*GROUP, "n", "total_lib", F.explode("genes").alias("gene"))  # one row of gene names
    full = grid.join(sums, [*GROUP, "gene"], "left").fillna(0.0, ["total", "s", "ls", "lss", "lx"])
    return full.select(
        *GROUP, "gene", "n", "total", (F.col("total") / F.col("n")).alias("counts"), (F.col("s") / F.col("n")).alias("normalized"),
        F.expm1(F.col("ls") / F.col("n")).alias("geometric"), (F.col("ls") / F.col("n")).alias("lognorm"), F.col("lss").alias("sumsq"),
        F.log1p(F.coalesce(F.try_divide(F.col("total") * bulk_sum, "total_lib"), F.lit(0.0))).alias("bulk"),
    )


def traces(profile: DataFrame) -> DataFrame:
    """side, pert, n, sumsq, trace: tr(Sigma) = (sum |x|^2 - n |m|^2) / (n - 1) of log-normalised cells; NaN below 2 cells."""
    m = profile.groupBy(*GROUP).agg(F.max("n").alias("n"), F.sum("sumsq").alias("sumsq"), F.sum(F.col("lognorm") * F.col("lognorm")).alias("mm"))
    return m.select(*GROUP, "n", "sumsq", F.when(F.col("n") >= 2, F.try_divide(F.col("sumsq") - F.col("n") * F.col("mm"), F.col("n") - 1)).otherwise(F.lit(float("nan"))).alias("trace"))


def trace_over_n(profile: DataFrame) -> DataFrame:
    """side, pert, jk: tr(Sigma) / n, the sampling variance of a mean of log-normalised cells; 0 below 2 cells."""
    return traces(profile).select(*GROUP, F.when(F.col("n") >= 2, F.col("trace") / F.col("n")).otherwise(F.lit(0.0)).alias("jk"))


def jackknife(counts: DataFrame, libs: DataFrame, profile: DataFrame, bulk_sum: float = BULK_SUM, share: int = SHARE) -> DataFrame:
    """side, pert, jk: delete-one-cell variance of the group-sum comparator, summed over genes.

    A zero count still varies through its cell's total, so every cell meets every
    gene of its group.  Cells travel as sparse vectors, in shares of about
    ``share`` cells of a group; each share meets its group's totals as one vector
    and returns two sums a gene, of deviations from the whole group's value.
    """
    cells = F.collect_list(F.struct("gene", "x"))
    sparse = counts.groupBy(*GROUP, "cell").agg(cells.alias("x"), F.sum("x").alias("lib"))
    group = profile.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("gene", "total", "bulk"))).alias("g"), F.sum("total").alias("all"), F.max("n").alias("n"))
    shares = group.select(*GROUP, F.ceil(F.col("n") / share).cast("int").alias("shares"))
    left = libs.select(*GROUP, "cell").join(sparse, [*GROUP, "cell"], "left").join(shares, GROUP)
    left = left.select(*GROUP, F.pmod(F.xxhash64("cell"), F.col("shares")).cast("int").alias("share"), F.col("x.gene").alias("genes"), F.col("x.x").alias("xs"), F.coalesce("lib", F.lit(0.0)).alias("lib"))
    right = group.select(*[F.col(c).alias(c) for c in GROUP], F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / share).cast("int") - 1)).alias("share"), F.col("g.gene").alias("genes"), F.col("g.total").alias("total"), F.col("g.bulk").alias("bulk"), "all")
    key = [*GROUP, "share"]
    names = [*GROUP, "gene", "d1", "d2"]

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        one = {c: b.column(c)[0].as_py() for c in GROUP} if b.num_rows else {}
        genes, total, bulk = (np.array(b.column(c)[0].as_py() if b.num_rows else []) for c in ("genes", "total", "bulk"))
        d1, d2 = np.zeros(len(genes)), np.zeros(len(genes))
        every = b.column("all")[0].as_py() if b.num_rows else 0.0
        lib = a.column("lib").to_numpy()
        size = pc.fill_null(pc.list_value_length(a.column("genes")), 0).to_numpy()
        at, xs = np.searchsorted(genes, pc.list_flatten(a.column("genes")).to_numpy()), pc.list_flatten(a.column("xs")).to_numpy()
        end = np.r_[0, np.cumsum(size)]
        for lo in range(0, len(lib), CELLS):
            hi = min(len(lib), lo + CELLS)
            mine = slice(end[lo], end[hi])
            kept = np.repeat(total[None, :], hi - lo, axis=0)
            kept[np.repeat(np.arange(hi - lo), size[lo:hi]), at[mine]] -= xs[mine]
            rest = every - lib[lo:hi, None]
            d = np.where(rest > 0, np.log1p(kept * bulk_sum / np.where(rest > 0, rest, 1.0)), 0.0) - bulk
            d1 += d.sum(axis=0)
            d2 += (d * d).sum(axis=0)
        n = len(genes)
        return pa.table([pa.array([one.get(c)] * n, b.schema.field(c).type) for c in GROUP] + [pa.array(genes, pa.int32()), pa.array(d1), pa.array(d2)], names)

    kinds = dict(profile.dtypes)
    s = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(sums, f"side {kinds['side']}, pert {kinds['pert']}, gene int, d1 double, d2 double")
    s = s.groupBy(*GROUP, "gene").agg(F.sum("d1").alias("d1"), F.sum("d2").alias("d2")).join(group.select(*GROUP, "n"), GROUP)
    per = s.groupBy(*GROUP).agg(F.max("n").alias("n"), F.sum(F.col("d2") - F.col("d1") * F.col("d1") / F.col("n")).alias("v"))
    return per.select(*GROUP, F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), (F.col("n") - 1) / F.col("n") * F.col("v"))).otherwise(F.lit(0.0)).alias("jk"))


def effects(profile: DataFrame, value: str, control: int, control_side: int | None = 0) -> DataFrame:
    """side, pert, gene, m, c, e: profile, control and their difference; control_side None takes each side's own."""
    ref = profile.filter(F.col("pert") == control).select(F.col("side").alias("cs"), "gene", F.col(value).alias("c"))
    rows = profile.filter(F.col("pert") != control).select(*GROUP, "gene", F.col(value).alias("m"))
    cond = F.col("cs") == (F.col("side") if control_side is None else F.lit(control_side))
    joined = rows.join(ref.withColumnRenamed("gene", "cg"), (F.col("gene") == F.col("cg")) & cond)
    return joined.select(*GROUP, "gene", "m", "c", (F.col("m") - F.col("c")).alias("e"))


def noise(counts: DataFrame, level: float, seed: int, kind: str = "gaussian", whole: bool = True) -> DataFrame:
    """``gaussian``: values times exp(N(0, level)), rounded where they are ``whole``; ``downsample``: each count is kept with probability 1 - level.

    Draws are hashes of the seed and the place of a value, so that neither the
    partitioning nor a retry changes them; level 0 changes nothing.
    """
    if level < 0 or kind not in ("gaussian", "downsample"):
        raise ValueError(f"no noise of kind {kind!r} and level {level}")
    if level == 0:
        return counts
    if kind == "downsample":
        return thinned(counts, 1 - min(level, 1.0), seed)
    place = [F.lit(seed), F.col("side"), F.col("cell"), F.col("gene")]
    unit = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(i), *place), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    scaled = F.col("x") * F.exp(normal * level)
    return counts.withColumn("x", F.greatest(F.lit(0.0), F.rint(scaled)) if whole else scaled).filter("x <> 0")


def thinned(counts: DataFrame, keep: float, seed: int) -> DataFrame:
    """Counts of which every single one stays with probability ``keep``, by a draw of its own; counts must be whole.

    A draw is the first 32 bits of the md5 of seed:side:cell:gene:i.
    """
    odd = counts.filter((F.col("x") < 0) | (F.col("x") != F.floor("x")) | F.isnan("x")).limit(1).count()
    if odd:
        raise ValueError("only whole counts can be thinned")
    place = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("side", "cell", "gene")])
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("_place"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    kept = F.aggregate(F.sequence(F.lit(1), F.col("x").cast("int")), F.lit(0), lambda n, i: n + F.when(drawn(i) < int(keep * 2**32), 1).otherwise(0))
    some = counts.filter("x > 0").withColumn("_place", place)
    return some.withColumn("x", kept.cast("double")).drop("_place").filter("x > 0")


def halvings(libs: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """split_index, side, pert, cell, half (0 or 1): for each seed disjoint halves of floor(n / 2) cells each group, dealt by hash.

    A cell's rank is its rank among the cells whose hashes begin alike, and the
    number of cells in the beginnings before: no task sorts a whole group.
    """
    key = ["split_index", *GROUP]
    cells = libs.select(*GROUP, "cell", F.posexplode(F.array(*[F.lit(str(s)) for s in seeds])).alias("split_index", "seed"))
    cells = cells.withColumn("hash", F.md5(F.concat_ws(":", "seed", F.col("cell").cast("string")))).withColumn("head", F.substring("hash", 1, HEAD))
    tally = cells.groupBy(*key, "head").agg(F.count("*").alias("m"))
    group = Window.partitionBy(*key)
    before = F.sum("m").over(group.orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    tally = tally.select(*key, "head", before.alias("before"), F.floor(F.sum("m").over(group) / 2).alias("h"))
    within = F.row_number().over(Window.partitionBy(*key, "head").orderBy("hash", "cell"))
    ranked = cells.join(tally, [*key, "head"]).withColumn("r", F.col("before") + within).filter((F.col("h") >= 1) & (F.col("r") <= 2 * F.col("h")))
    return ranked.select(*key, "cell", F.when(F.col("r") <= F.col("h"), 0).otherwise(1).alias("half"))


def halves(libs: DataFrame, seed: int) -> DataFrame:
    """side, pert, cell, half: one halving."""
    return halvings(libs, (seed,)).drop("split_index")
