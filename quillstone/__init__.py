"""Quillstone: a literature-corpus engine written as Spark DataFrame jobs."""
