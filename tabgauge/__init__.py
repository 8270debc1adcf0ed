"""Data quality of tables of any size, measured with Spark."""

from tabgauge.plans.assess import Assessment, Options, assess, metrics

__all__ = ["Assessment", "Options", "assess", "metrics"]
