"""Spark jobs over collections of syndicated content: feeds, entries, pages, threads, jobs and usage."""
