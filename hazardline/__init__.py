"""Survival-cohort analytics on Spark: wide feature rows, risk models, concordance."""
