"""One evaluation: the frames that metrics share, each built once when first asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.operators import agreement, cells, de, expression, negative_binomial, profiles
from effectlens.sources import staging, starschema
from effectlens.sources.store import Store, listing


@dataclass(frozen=True)
class Config:
    """Conventions of an evaluation; the defaults are those of version 2."""

    control: int = 0
    bulk_target_sum: float = 5e4
    target_sum: float = 1e6
    p_adj_threshold: float = 0.05
    epsilon: float = 1e-9
    clip_value: float | None = None
    cpm_gate: float = 5.0
    fdr_scope: str = "per_pert"
    auc_floor: str = "min_nonzero"
    nan_lfc_policy: str = "mask"
    min_abs_log2fc: float = 0.0
    pds_scope: str = "panel"
    pds_ties: str = "midrank"
    pds_denominator: str = "n-1"
    mean: str = "normalized"
    control_source: str = "real"
    no_drop: bool = True
    group_sums: bool = True  # compare logarithms of group sums where both sides are counts
    de_method: str = "wilcoxon"  # or deseq2: a negative-binomial model of replicates
    #: What the values of the measured and the predicted side are: counts, or lognorm.
    input_types: tuple[str, str] = ("counts", "counts")

    @staticmethod
    def v1() -> Config:
        return Config(
            epsilon=0.0, clip_value=20.0, cpm_gate=-1.0, fdr_scope="global", auc_floor="replace_zero", nan_lfc_policy="keep", pds_scope="row", pds_ties="position",
            pds_denominator="n", mean="geometric", control_source="pred", no_drop=False, group_sums=False,
        )


#: Settings by group, for files and ``group.name`` on the command line.
GROUPS = {
    "norm": ("target_sum", "bulk_target_sum", "input_types", "group_sums", "mean"),
    "de": ("de_method", "epsilon", "clip_value", "cpm_gate", "fdr_scope", "p_adj_threshold", "nan_lfc_policy", "min_abs_log2fc", "auc_floor"),
    "pds": ("pds_scope", "pds_ties", "pds_denominator"),
    "run": ("control", "control_source", "no_drop"),
}
#: Settings that values in linear space, and differential-expression tables, depend on.
VALUES = ("target_sum", "input_types")
DE = (*VALUES, "bulk_target_sum", "control", "control_source", "de_method", "epsilon", "clip_value", "cpm_gate", "fdr_scope", "mean", "nan_lfc_policy", "min_abs_log2fc")


@dataclass
class Evaluation:
    """Counts of both sides (side, pert, cell, gene, x), genes and own genes in; tables and metrics out."""

    counts: DataFrame
    genes: DataFrame
    own: DataFrame
    config: Config = field(default_factory=Config)
    replicates: DataFrame | None = None  # cell, replicate; deseq2 needs it
    frames: dict[str, DataFrame] = field(default_factory=dict)
    store: Store | None = None  # where tables outlive the session; ``source`` then says what the counts, genes and replicates are
    source: dict | None = None
    packed: DataFrame | None = None  # the same counts a row a cell (see ``cells``), where they were written so

    def kept(self, kind: str, make: Callable[[], DataFrame], *settings: str) -> DataFrame:
        """A table that is written once: for this session, or in the store under its source and the settings it depends on."""
        if self.store is None:
            return staging.written(make(), kind)
        if self.source is None:
            raise ValueError("a store needs to know the source of the counts")
        record = {"source": self.source, "settings": {x: getattr(self.config, x) for x in settings}}
        return self.store.get_or_compute(kind, record, make)

    @cached_property
    def libs(self) -> DataFrame:
        return self.kept("libs", lambda: profiles.libraries(self.counts) if self.packed is None else cells.libraries(self.packed))

    @cached_property
    def sizes(self) -> DataFrame:
        return self.kept("sizes", lambda: profiles.group_sizes(self.libs))

    def require_sides(self) -> None:
        """Where both sides are there, they have the same perturbations, the control among them: none may vanish in a join."""
        sides = self.sizes.groupBy("pert").agg(F.min("side").alias("a"), F.max("side").alias("b"))  # a row a perturbation
        lone = sides.filter("a = b").select("pert", "a").limit(20).collect()
        if lone and self.sizes.select("side").distinct().count() > 1:
            raise ValueError(f"perturbations of one side only: {[(r['pert'], r['a']) for r in lone]}")
        if not self.sizes.filter(F.col("pert") == self.config.control).limit(1).count():
            raise ValueError(f"the control {self.config.control!r} is missing")

    @property
    def comparator(self) -> str:
        """The profile that expression metrics compare: log group sums of counts, else means of log-normalised cells."""
        return "bulk" if self.config.group_sums and set(self.config.input_types) == {"counts"} else "lognorm"

    @property
    def mass_target(self) -> float:
        return self.config.bulk_target_sum if self.comparator == "bulk" else self.config.target_sum

    @cached_property
    def targets(self) -> DataFrame:
        """pert: the predicted perturbations."""
        return self.sizes.filter((F.col("side") == 1) & (F.col("pert") != self.config.control)).select("pert")

    @cached_property
    def values(self) -> DataFrame:
        """Counts scaled to the target sum; log-normalised values taken back to linear space."""
        if self.packed is not None:
            return profiles.linear(cells.unpacked(self.packed), None, self.config.input_types, self.config.target_sum)
        return profiles.linear(self.counts, self.libs, self.config.input_types, self.config.target_sum)

    @cached_property
    def profile(self) -> DataFrame:
        self.require_sides()
        c = self.config
        def make() -> DataFrame:
            if self.packed is None:
                return profiles.profiles(self.values, self.sizes, self.genes, c.bulk_target_sum)
            return profiles.from_sums(cells.sums(self.packed, c.target_sum), self.sizes, self.genes, c.bulk_target_sum)

        return self.kept("profile", make, *VALUES, "bulk_target_sum")

    @cached_property
    def jk(self) -> DataFrame:
        make = lambda: profiles.jackknife(self.counts, self.libs, self.profile, self.config.bulk_target_sum)
        return self.kept("jackknife", make, *VALUES, "bulk_target_sum")

    @cached_property
    def correction(self) -> DataFrame:
        """side, pert, jk: sampling variance of the comparator, by the jackknife of group sums or the trace of means."""
        return self.jk if self.comparator == "bulk" else profiles.trace_over_n(self.profile)

    @cached_property
    def replicate_de(self) -> DataFrame:
        """The table of the negative-binomial model, with means and dispersions."""
        c = self.config
        if self.replicates is None or set(c.input_types) != {"counts"}:
            raise ValueError("deseq2 needs counts of both sides, and the replicate of each cell")
        grid = self.profile.select("side", "pert", "gene")
        if c.control_source == "real":  # the control of both sides is the measured one
            grid = grid.filter(F.col("pert") != c.control).unionByName(grid.filter((F.col("pert") == c.control) & (F.col("side") == 0)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))))
        return self.kept("replicate-de", lambda: negative_binomial.replicate_table(self.counts, self.replicates, grid, c.control, c.control_source), *VALUES, "control", "control_source")

    @cached_property
    def de(self) -> DataFrame:
        c = self.config
        if c.de_method == "deseq2":  # the model has its own fold changes and filter: no gate, no offset, no other scope
            return self.kept("de", lambda: de.apply_policies(self.replicate_de.drop("mean", "dispersion"), c.nan_lfc_policy, c.min_abs_log2fc), *DE)
        if c.de_method != "wilcoxon":
            raise ValueError(f"unknown method {c.de_method!r}")
        gate = c.cpm_gate if c.input_types[0] == "counts" else -1.0  # log-normalised values have no counts per million
        def parts(of: int, side: int | None) -> tuple[DataFrame, DataFrame]:
            return cells.rank_parts(self.packed, self.sizes, self.genes.count(), c.target_sum, c.control, of, side)

        def make() -> DataFrame:
            table = de.de_table(self.values, self.sizes, self.profile, c.control, c.epsilon, gate, c.fdr_scope, c.clip_value, c.mean, c.control_source, parts if self.packed is not None else None)
            return de.apply_policies(table, c.nan_lfc_policy, c.min_abs_log2fc)

        return self.kept("de", make, *DE)

    @cached_property
    def evidence(self) -> agreement.Evidence:
        side = lambda s: self.de.filter(F.col("side") == s).drop("side")
        targets = self.sizes.filter((F.col("side") == 0) & (F.col("pert") != self.config.control)).select(F.col("pert").alias("target"))
        own = self.own.select(F.col("pert").alias("target"), F.col("gene").alias("feature"))
        return agreement.Evidence(side(0), side(1), targets, own, self.config.p_adj_threshold)

    @cached_property
    def standing(self) -> DataFrame:
        c = self.config
        return staging.written(expression.standing(self.profile, self.comparator, self.own, c.control, c.pds_scope), "standing")

    def pds(self, metric: str) -> DataFrame:
        c = self.config
        return expression.discrimination(self.standing, metric, c.pds_ties, c.pds_denominator)


_KNOWN: dict[tuple, Evaluation] = {}
#: Evaluations that are kept at one time.
KEPT = 8


def identity(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of a folder's tables from another: number, size, age and names of their files, by a listing alone."""
    return tuple(listing(spark, [f"{sf_dir}/{t}.parquet" for t in starschema.TABLES]).values())


def stored(spark: SparkSession, sf_dir: str, store: Store, config: Config | None = None, axis: str = "brand") -> Evaluation:
    """The evaluation of a data folder whose tables are taken from ``store`` where an earlier session left them; the counts are planned, and read only for what it lacks."""
    source = {"tables": list(identity(spark, sf_dir)), "axis": axis}
    return Evaluation(starschema.counts(spark, sf_dir, axis), starschema.genes(spark, axis), starschema.own_genes(spark), config or Config(), starschema.replicates(spark, sf_dir), store=store, source=source)


def warm(e: Evaluation, names: tuple[str, ...] = ("profile", "jk", "de")) -> None:
    """Build the named tables of an evaluation ahead of its use."""
    for name in names:
        getattr(e, name)


def forget() -> None:
    """Let the next query build its tables anew."""
    _KNOWN.clear()


def of(spark: SparkSession, sf_dir: str, config: Config | None = None, axis: str = "brand", form: str = "counts") -> Evaluation:
    """The evaluation of a data folder as its files now are, shared by the queries of one application."""
    config = config or Config()
    key = (spark.sparkContext.applicationId, sf_dir, identity(spark, sf_dir), config, axis, form)
    if key not in _KNOWN:
        while len(_KNOWN) >= KEPT:
            _KNOWN.pop(next(iter(_KNOWN)))
        if form == "lognorm":
            packed = None  # the totals of counts are none of their logarithms
            counts = staging.written(profiles.lognormed(starschema.counts(spark, sf_dir, axis, lib=True), None, config.target_sum), "counts")
        else:
            packed = staging.written(starschema.packed(spark, sf_dir, axis), "counts")
            counts = cells.unpacked(packed).drop("lib")
        _KNOWN[key] = Evaluation(counts, starschema.genes(spark, axis), starschema.own_genes(spark), config, starschema.replicates(spark, sf_dir), packed=packed)
    return _KNOWN[key]
