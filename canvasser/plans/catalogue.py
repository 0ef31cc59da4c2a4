"""All query modules; importing this fills the registry."""

from canvasser.plans import flow, load, lookup, measure, merging, review, scalars  # noqa: F401
from canvasser.plans.registry import callables, checks  # noqa: F401
