"""Imports every module that registers queries."""
from tallyforge.plans import text_plans  # noqa: F401
from tallyforge.plans import source_plans  # noqa: F401
from tallyforge.plans import linear_plans  # noqa: F401
from tallyforge.plans import model_plans  # noqa: F401
from tallyforge.plans import factor_plans  # noqa: F401
from tallyforge.plans import layer_plans  # noqa: F401
from tallyforge.plans import stream_plans  # noqa: F401
from tallyforge.plans import training_plans  # noqa: F401
from tallyforge.plans import particle_plans  # noqa: F401
