"""Spark jobs for sales marts, web-page corpora and message archives."""
