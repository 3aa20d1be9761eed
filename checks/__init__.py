"""The registered queries, each with SQL that gives the same result by another route."""
