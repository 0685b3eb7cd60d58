"""palimpsest: a bi-temporal knowledge-graph analytics engine on Apache Spark."""
