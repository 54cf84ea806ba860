"""Lodestar: semantic retrieval and corpus analytics written as DataFrame -> DataFrame operators."""
