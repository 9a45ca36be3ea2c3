"""Runnable jobs over the library: python -m jobs.chunk_stream, python -m jobs.retrieval_report."""
