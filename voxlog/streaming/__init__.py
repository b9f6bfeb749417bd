"""Extensions on Structured Streaming: continuous ingestion of changes."""
