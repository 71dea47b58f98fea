"""Imports every module that registers catalog queries."""

from epistride.plans import evaluation, generalization, relations, reports, sequences, traces  # noqa: F401
