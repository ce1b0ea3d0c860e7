"""Driving-data analytics as Spark jobs: sensor alignment, labels, packing, evaluation, run logs."""
