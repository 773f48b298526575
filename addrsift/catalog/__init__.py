"""Registered queries over the given tables, each with a check in plain SQL."""


def _load():
    from . import base, extraction, statistics, enrichment, files, streams  # noqa: F401

    return base


def all_queries():
    return dict(_load().QUERIES)


def all_checks():
    return dict(_load().CHECKS)
