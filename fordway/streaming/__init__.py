"""Extensions on Structured Streaming; beyond the batch operators' scope."""
