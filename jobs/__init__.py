"""Runnable jobs: python -m jobs.catalogue, python -m jobs.links."""
