"""Whole queries: adapters of the supplied tables, artifacts, jobs, studies."""
