"""How far do a model-building procedure's predictions move when its training rows change? Answered on Spark."""

from importlib import import_module

_MODULES = {
    "RepresentativeEstimator": "representative",
    "bootstrap_instability": "audit",
    "bootstrap_predictions": "audit",
    "explanation_instability": "trees",
    "linear_frontier": "linear",
    "linear_instability": "linear",
    "pareto_front": "frontier",
    "path_agreement": "trees",
    "plot_mape_by_prediction": "plotdata",
    "plot_prediction_instability": "plotdata",
    "plot_stability_frontier": "plotdata",
    "root_agreement": "trees",
    "shrinkage_coefficients": "linear",
    "split_feature_paths": "trees",
    "split_features": "trees",
    "stability_frontier": "frontier",
}
__all__ = sorted(_MODULES)


def __getattr__(name: str):
    """Public names load their module when first asked for, so that a task's Python worker loads no more than it runs."""
    if name not in _MODULES:
        raise AttributeError(name)
    return getattr(import_module(f".operators.{_MODULES[name]}", __name__), name)
