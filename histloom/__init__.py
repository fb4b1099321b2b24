"""Histloom: project history at rest -> instruction-tuning data sets, as Spark DataFrame jobs."""

from histloom.params import CollectParams, FilterParams, RunParams, profile, profile_names

__all__ = ["CollectParams", "FilterParams", "RunParams", "profile", "profile_names"]
