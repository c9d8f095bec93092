"""Every registered query of the engine, with its SQL."""

from __future__ import annotations

from mailquarry.plans import builds, chosen, evaluation, mailbox, records, search, sources, threads

QUERIES = {**search.QUERIES, **evaluation.QUERIES, **records.QUERIES, **threads.QUERIES, **mailbox.QUERIES, **sources.QUERIES, **chosen.QUERIES, **builds.QUERIES}
ORACLE_SQL = {**search.ORACLE_SQL, **evaluation.ORACLE_SQL, **records.ORACLE_SQL, **threads.ORACLE_SQL, **mailbox.ORACLE_SQL, **sources.ORACLE_SQL, **chosen.ORACLE_SQL, **builds.ORACLE_SQL}
