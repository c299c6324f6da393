"""Registered queries with their SQL equivalents."""

from lagline.plans import build, cleaning, evaluation, joins, profiling, storage, training, windows  # noqa: F401
from lagline.plans.common import REGISTRY  # noqa: F401
