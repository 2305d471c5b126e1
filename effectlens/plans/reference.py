"""The measured side built once: predictions are scored against its tables, piece by piece, without its counts.

A reference holds sizes, profile, jackknife and differential expression of the
measured side, and the control's values in linear space, against which rank sums
of any prediction are taken.  Its record says what it was made from; partial
results carry the record's digest.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.operators import de, profiles
from effectlens.plans import identity
from effectlens.plans.evaluation import Config, Evaluation
from effectlens.sources import staging
from effectlens.sources.store import Store

#: Version of what a reference's tables mean.
SEMANTICS = 1
TABLES = ("sizes", "profile", "jackknife", "de", "control")


@dataclass(frozen=True)
class Reference:
    """Tables of the measured side (side 0) and what they were made from."""

    genes: DataFrame
    own: DataFrame
    config: Config
    record: dict
    sizes: DataFrame
    profile: DataFrame
    jackknife: DataFrame
    de: DataFrame
    control: DataFrame

    @property
    def digest(self) -> str:
        return identity.digest(self.record)


def require_measured_control(config: Config) -> None:
    if config.control_source != "real" or config.de_method != "wilcoxon":
        raise ValueError("a reference serves rank sums against the measured control only")
    if config.fdr_scope == "global":
        raise ValueError("pieces can't share one false-discovery pool")


def build(real: DataFrame, genes: DataFrame, own: DataFrame, config: Config, store: Store | None = None, source: dict | None = None) -> Reference:
    """The reference of measured counts (pert, cell, gene, x); with a store, tables that it has are not built again."""
    require_measured_control(config)
    counts = real.select(F.lit(0).alias("side"), "pert", "cell", "gene", "x")
    source = source or {"real": identity.fingerprint(real, ["pert", "cell", "gene", "x"]), "genes": identity.fingerprint(genes)}
    e = Evaluation(counts, genes, own, config, store=store, source=source | {"side": "real"})
    control = e.kept("control", lambda: e.values.filter(F.col("pert") == config.control).select("side", "pert", "gene", "v"), "control", "target_sum", "input_types")
    record = {
        "semantics": SEMANTICS, "config": asdict(config), "source": source, "comparator": e.comparator, "control": config.control, "mass_target": e.mass_target,
        "perturbations": identity.fingerprint(e.sizes.select(F.col("pert").cast("string"))), "genes": identity.fingerprint(genes), "own": identity.fingerprint(own),
    }
    return Reference(genes, own, config, record, e.sizes, e.profile, e.jk, e.de, control)


@dataclass
class Against(Evaluation):
    """An evaluation whose measured side comes from a reference: ``counts`` are those of the prediction (side 1)."""

    reference: Reference | None = None

    @cached_property
    def _perts(self) -> DataFrame:
        return self._sizes.select("pert").filter(F.col("pert") != self.config.control)

    @cached_property
    def _sizes(self) -> DataFrame:
        return staging.written(profiles.group_sizes(self.libs), "piece-sizes")

    def _measured(self, table: DataFrame, key: str = "pert") -> DataFrame:
        """Rows of the perturbations that the prediction has, and the control's."""
        perts = self._perts.withColumnRenamed("pert", key)
        return table.join(perts, key, "left_semi").unionByName(table.filter(F.col(key) == self.config.control)).select(*table.columns)

    @cached_property
    def sizes(self) -> DataFrame:
        return self._measured(self.reference.sizes).unionByName(self._sizes)

    @cached_property
    def _profile(self) -> DataFrame:
        return staging.written(profiles.profiles(self.values, self._sizes, self.genes, self.config.bulk_target_sum), "piece-profile")

    @cached_property
    def profile(self) -> DataFrame:
        return self._measured(self.reference.profile).unionByName(self._profile)

    @cached_property
    def jk(self) -> DataFrame:
        own = profiles.jackknife(self.counts, self.libs, self._profile, self.config.bulk_target_sum)
        return staging.written(self._measured(self.reference.jackknife).unionByName(own), "piece-jackknife")

    @cached_property
    def de(self) -> DataFrame:
        c, at = self.config, F.col("pert") == self.config.control
        profile = self._profile.filter(~at).unionByName(self.reference.profile.filter(at))
        values = self.values.filter(~at).select("side", "pert", "gene", "v").unionByName(self.reference.control)
        gate = c.cpm_gate if c.input_types[0] == "counts" else -1.0
        table = de.de_table(values, self.sizes, profile, c.control, c.epsilon, gate, c.fdr_scope, c.clip_value, c.mean)
        own = de.apply_policies(table, c.nan_lfc_policy, c.min_abs_log2fc)
        return staging.written(self._measured(self.reference.de, "target").unionByName(own), "piece-de")


def against(reference: Reference, prediction: DataFrame) -> Against:
    """The evaluation of predicted counts (pert, cell, gene, x); their perturbations must be measured ones."""
    counts = prediction.select(F.lit(1).alias("side"), "pert", "cell", "gene", "x")
    e = Against(counts, reference.genes, reference.own, reference.config, reference=reference)
    unknown = e._perts.join(reference.sizes.select("pert"), "pert", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"not measured: {[r[0] for r in unknown]}")
    foreign = prediction.select("gene").distinct().join(reference.genes, "gene", "left_anti").limit(5).collect()
    if foreign:
        raise ValueError(f"genes beyond those measured: {[r[0] for r in foreign]}")
    return e
