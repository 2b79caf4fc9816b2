"""Configuration of a split run: canonical and legacy YAML spellings, validated."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

#: Type names of fields and the Spark types they stand for (fixed values).
TYPES = {"str": "string", "float": "double", "int": "bigint", "bool": "boolean"}

#: Similarities that relate records, and the key that holds the threshold of each.
SIMILARITIES = {"set_intersection": None, "boolean": None, "cosine": "cosine_thresh", "gaussian": "gaussian_thresh", "levenshtein": "levenshtein_thresh"}

#: Legacy top-level keys that hold the parameters of a constraint of that name.
_LEGACY = ("mean_tuple", "sum_tuple", "kl_tuple", "max_entropy")


@dataclass(frozen=True)
class ConstraintSpec:
    name: str
    values: Any = None
    reduction: str = "mean"


@dataclass(frozen=True)
class SplitConfig:
    """Everything a run needs. Field indices are 1-based over the columns after the id."""

    factors: tuple[int, ...]
    constraints: tuple[int, ...]
    specs: tuple[ConstraintSpec, ...]
    constraint_weights: tuple[float, ...]
    format: str = "tsv"
    factor_types: tuple[str, ...] = ()
    similarity_functions: tuple[str, ...] = ()
    factor_weights: tuple[float, ...] = ()
    cosine_thresh: float = 0.7
    gaussian_thresh: float = 0.7
    levenshtein_thresh: float = 0.7
    splitter: str = "random"
    seed: int = 0
    max_iter: int | None = None
    max_neighbors: int = 2000
    num_shake_neighborhoods: int = 4
    num_search_neighborhoods: int = 10
    check_complete: bool = True
    num_splits: int = 2
    spectral_smoothing: float = 1e-4
    lhotse_fields: tuple[str, ...] = ()
    lhotse_groupby: str = "recording_id"
    weighting: str = "none"
    use_components: bool = False
    partition_and_split: str | None = None
    extra: dict = field(default_factory=dict)

    def relation(self, i: int) -> tuple[str, float, float]:
        """(similarity, threshold, weight) of the i-th entry of ``factors``."""
        name = self.similarity_functions[i] if self.similarity_functions else "set_intersection"
        thresh = getattr(self, SIMILARITIES[name]) if SIMILARITIES[name] else 0.0
        return name, thresh, self.factor_weights[i] if self.factor_weights else 1.0

    def as_dict(self) -> dict:
        return asdict(self)


def constraint_spec(entry: Any, conf: dict) -> ConstraintSpec:
    """One constraint: a mapping ``{name, values, reduction}`` or a bare name with its parameters at the top level."""
    if isinstance(entry, dict):
        name = entry["name"]
        values = entry.get("values")
        reduction = entry.get("reduction")
    else:
        name, values, reduction = entry, conf.get(entry) if entry in _LEGACY else None, None
    if name in ("kl", "kl_tuple"):
        values = {"values": values} if isinstance(values, list) else dict(values or {})
        if isinstance(values.get("values"), list):
            values.setdefault("dist", values.pop("values"))
        values.setdefault("smooth", conf.get("kl_smooth", 1e-6))
        values.setdefault("direction", conf.get("kl_direction", "forward"))
    if name == "sum_tuple" and isinstance(values, list):
        values = {"values": values, "power": 1.0}
    if name == "max_entropy" and values is None:
        values = [0.0, 1.0]
    if reduction is None:
        reduction = conf.get("constraint_reduction") or ("concat" if name in ("kl", "kl_tuple", "max_entropy") else "mean")
    return ConstraintSpec(name, values, reduction)


def parse_config(conf: dict, n_fields: int | None = None) -> SplitConfig:
    """A checked :class:`SplitConfig`; raises ``ValueError`` on missing or impossible entries."""
    factors, constraints = tuple(conf.get("factor_idxs") or ()), tuple(conf.get("constraint_idxs") or ())
    if not factors:
        raise ValueError("factor_idxs names no field")
    specs = tuple(constraint_spec(c, conf) for c in conf.get("constraints") or ())
    if len(specs) != len(constraints):
        raise ValueError(f"{len(specs)} constraints for {len(constraints)} constraint fields")
    if n_fields is not None and any(not 1 <= i <= n_fields for i in (*factors, *constraints)):
        raise ValueError(f"field indices must be between 1 and {n_fields}")
    types = tuple(conf.get("factor_types") or ())
    unknown = [t for t in types if t not in TYPES]
    if unknown:
        raise ValueError(f"unknown field types {unknown}")
    sims = tuple(conf.get("similarity_functions") or ("set_intersection",) * len(factors))
    weights = tuple(float(w) for w in conf.get("factor_weights") or (1.0,) * len(factors))
    if len(sims) != len(factors) or len(weights) != len(factors):
        raise ValueError("one similarity function and one weight for each factor")
    other = sorted({str(x) for x in sims} - set(SIMILARITIES))
    if other:
        raise ValueError(f"unknown similarities {other}; known: {sorted(SIMILARITIES)}")
    if any(not w > 0 for w in weights):
        raise ValueError("factor_weights must be positive")
    cweights = tuple(float(w) for w in conf.get("constraint_weights") or conf.get("constraints_weights") or (1.0,) * len(specs))
    if len(cweights) != len(specs):
        raise ValueError("one weight for each constraint")
    known = {
        "format": conf.get("format", "tsv"), "splitter": str(conf.get("splitter", "random")).lower(), "seed": int(conf.get("seed", 0)),
        "cosine_thresh": float(conf.get("cosine_thresh", 0.7)), "gaussian_thresh": float(conf.get("gaussian_thresh", conf.get("Gaussian_thresh", 0.7))),
        "levenshtein_thresh": float(conf.get("levenshtein_thresh", 0.7)), "check_complete": bool(conf.get("check_complete", True)),
        "max_neighbors": int(conf.get("max_neighbors", 2000)), "num_shake_neighborhoods": int(conf.get("num_shake_neighborhoods", 4)),
        "num_search_neighborhoods": int(conf.get("num_search_neighborhoods", 10)), "num_splits": int(conf.get("num_cluster", conf.get("num_splits", 2))),
        "spectral_smoothing": float(conf.get("spectral_clustering_smoothing", 1e-4)), "lhotse_fields": tuple(conf.get("lhotse_fields") or ()),
        "lhotse_groupby": conf.get("lhotse_groupby", "recording_id"), "weighting": conf.get("weighting", "none"),
        "use_components": bool(conf.get("use_components", False)), "partition_and_split": conf.get("partition_and_split"),
    }
    return SplitConfig(factors, constraints, specs, cweights, factor_types=types, similarity_functions=sims, factor_weights=weights, max_iter=conf.get("max_iter"), **known)
