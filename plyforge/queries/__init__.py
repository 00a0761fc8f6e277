"""Registered queries, each with the SQL that gives the same rows where SQL can say it."""

from plyforge.queries import answers, corpus, encoding, evaluation, joins, reports, sampling, storage, tasks, varied  # noqa: F401
from plyforge.queries.registry import ORACLES, QUERIES  # noqa: F401
