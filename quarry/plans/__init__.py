"""The query catalogue: every module here adds its queries to CATALOGUE."""

from quarry.plans import catalogue, evaluation, files, pixels, splits  # noqa: F401
from quarry.plans.catalogue import CATALOGUE  # noqa: F401
