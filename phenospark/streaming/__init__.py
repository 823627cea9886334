"""Structured Streaming: phenotype chains over arriving potential-cases files."""

from phenospark.streaming.cases_stream import run_phenotype_stream, start_phenotype_stream

__all__ = ["start_phenotype_stream", "run_phenotype_stream"]
