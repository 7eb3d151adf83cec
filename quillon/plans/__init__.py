"""The registered queries, by area."""

from quillon.plans import code, diffs, packages, scalars, scans, warehouse  # noqa: F401
