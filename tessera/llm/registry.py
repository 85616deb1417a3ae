"""Names of the subpackage's queries and, where SQL can express them, the SQL of their rows."""

from __future__ import annotations

import corpus_pipeline

from tessera.llm import queries as q
from tessera.llm import sql


def queries():
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {name: text for name, text in vars(sql).items() if name.startswith("op")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
