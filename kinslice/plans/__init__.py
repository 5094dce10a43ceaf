"""Plans: what a run will do, as plain data."""

from .plan import Step, SubsetPlan, make_plan

__all__ = ["Step", "SubsetPlan", "make_plan"]
