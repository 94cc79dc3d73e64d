"""Readers and writers: wide tables, manifests, workbooks, result sets and resumable stores."""
