"""Imports every plan module, so that its queries register."""

from corpusforge.plans import capture, corpus, extraction, files, linkage, quality, reading, retrieval, scholarly, sensitive, streams, web  # noqa: F401
