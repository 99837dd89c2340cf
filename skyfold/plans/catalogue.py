"""All registered queries of the core and their SQL."""

from skyfold.plans import ingest, problems, tree, views

QUERIES = ingest.QUERIES | tree.QUERIES | views.QUERIES | problems.QUERIES
SQL = ingest.SQL | tree.SQL | views.SQL | problems.SQL
