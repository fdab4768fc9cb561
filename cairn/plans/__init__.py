"""Fixture views and registered queries. Importing ``all_queries`` loads every
plan module so that the registry is complete."""


def all_queries():
    from . import catalog, oracle_sql  # noqa: F401
    from . import q_candidates, q_feedback, q_feeds, q_harvest, q_more, q_review, q_select, q_text, q_vectors  # noqa: F401
    from .registry import QUERIES, SQL
    return QUERIES, SQL
