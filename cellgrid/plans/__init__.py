"""Whole pipelines: grid requests to documents, drafts to executable plans."""
