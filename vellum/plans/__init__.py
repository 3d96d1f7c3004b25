"""Multi-operator plans: ingest and question answering."""
