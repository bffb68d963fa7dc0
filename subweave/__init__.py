"""subweave: subgraph enumeration and corpus preparation on Apache Spark."""
