"""Readers and writers of reports, bundles and taxonomies."""
