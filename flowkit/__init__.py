"""Spark-native preparation, balancing and robustness evaluation of labelled flow tables."""

from flowkit.spec import CIC2018, NSLKDD, DatasetSpec

__all__ = ["CIC2018", "NSLKDD", "DatasetSpec"]
