"""A competition's rule as a record with a digest, and the list of departures of a run from it."""

from __future__ import annotations

from dataclasses import asdict, fields

from effectlens.operators import agreement
from effectlens.plans import anchoring, catalog, identity
from effectlens.plans.evaluation import Config

#: The version of what members mean; raised by hand when a computation changes that no field below shows.
RULE = 1
PROFILE = "vcc2026"
#: Settings that a run may choose freely, as its record holds them anyway.
FREE = ("control", "de_method")
REDUCER = "unweighted_mean"


def settings(config: Config) -> dict:
    """The settings that the rule fixes."""
    return {k: v for k, v in asdict(config).items() if k not in FREE}


def _member(name: str) -> dict:
    parts = catalog.DERIVED.get(name)
    if parts is None:
        m = catalog.CATALOG[name]
        how = {"agg": "mean", "family": m.family, "column": m.column, "worst": m.worst, "policy": asdict(m.policy)}
    else:  # its parts' worst values move it, their own aggregates don't
        how = {"agg": "ratio_of_sums", "parts": {p: catalog.CATALOG[p].worst for p in parts}, "policy": asdict(catalog.DERIVED_POLICIES[name])}
    return how | {"estimator": anchoring.estimator(name)}


def members() -> list[str]:
    """The scored members: lower is better first, each group by name."""
    policy = lambda n: catalog.DERIVED_POLICIES[n] if n in catalog.DERIVED else catalog.CATALOG[n].policy
    mine = [n for n in catalog.resolve(PROFILE) if policy(n).scored]
    return sorted(mine, key=lambda n: (policy(n).higher, n))


def rule(base_seed: int = 0, n_splits: int = anchoring.SPLITS) -> dict:
    """Every choice that moves a competition's number, resolved, defaults spelled out."""
    config = Config()
    return {
        "rule": RULE, "semantics": identity.SEMANTICS, "profile": PROFILE, "profile_resolved": sorted(catalog.resolve(PROFILE)), "members": {n: _member(n) for n in members()},
        "order": members(), "reducer": REDUCER, "comparator": identity.comparator(config), "settings": settings(config), "free": list(FREE), "seeds": list(anchoring.seeds(base_seed, n_splits)),
        "purity_floor": agreement.REACH_PURITY, "control_source": {"scored": config.control_source, "anchor": "pred"},
    }


def rule_digest(base_seed: int = 0, n_splits: int = anchoring.SPLITS) -> str:
    return identity.digest(rule(base_seed, n_splits))


def departures(config: Config, names: list[str] | str, seeds: tuple[int, ...] | None = None) -> list[tuple[str, object, object]]:
    """(term, wanted, found) of all in which a run isn't the competition's; empty where it conforms.

    The metrics must be exactly those of the profile, diagnostics included.
    ``seeds`` are those of the anchor, where the run has one.
    """
    wanted, found = settings(Config()), settings(config)
    out = [(f"settings.{f.name}", wanted[f.name], found[f.name]) for f in fields(Config) if f.name in wanted and wanted[f.name] != found[f.name]]
    profile, mine = sorted(catalog.resolve(PROFILE)), sorted(catalog.resolve(names, config.de_method))
    if profile != mine:
        out.append(("metrics", profile, mine))
    if (a := identity.comparator(Config())) != (b := identity.comparator(config)):
        out.append(("comparator", a, b))
    if seeds is not None and tuple(seeds) != anchoring.seeds():
        out.append(("seeds", anchoring.seeds(), tuple(seeds)))
    return out


def conforming_digest(config: Config, names: list[str] | str, seeds: tuple[int, ...] | None = None) -> str | None:
    """The rule's digest for a run that conforms, else None."""
    return None if departures(config, names, seeds) else rule_digest()


def require_competition(config: Config, names: list[str] | str, seeds: tuple[int, ...] | None = None) -> None:
    if wrong := departures(config, names, seeds):
        raise ValueError("not a run of the competition: " + "; ".join(f"{t} is {b!r}, not {a!r}" for t, a, b in wrong))
