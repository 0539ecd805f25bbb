"""Expected results as DuckDB SQL over the input tables; none of it calls the engine."""

from oracle import documents, feeds, relational

SQL = {**documents.SQL, **relational.SQL, **feeds.SQL}
