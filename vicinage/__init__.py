"""Neighbourhood analytics on Spark."""
