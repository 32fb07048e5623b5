"""Readers and writers of source trees, labelled functions, reports and saved pipelines."""
