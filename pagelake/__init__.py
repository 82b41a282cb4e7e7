"""pagelake: the data work behind web collection, expressed as Spark plans."""

from pagelake.plans.config import ConfigError, JobConfig
from pagelake.plans.job import run_job

__all__ = ["ConfigError", "JobConfig", "run_job"]
