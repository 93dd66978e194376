"""Request sources (files, streams, Kafka), the events bridge and sample requests."""
