"""Query catalogue, one module per inventory section."""

from importlib import import_module

from framesift.plans.registry import REGISTRY

MODULES = (
    "scans rules joins spans signals allocation rollups identity sync_labels grading windows streams"
).split()


def load_all():
    """Import every catalogue module and return the registry."""
    for module in MODULES:
        import_module(f"framesift.plans.{module}")
    return REGISTRY
