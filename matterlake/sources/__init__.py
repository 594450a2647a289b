"""Tenant-scoped scans and the table writers."""
