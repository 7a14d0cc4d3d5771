"""Structured Streaming entry points.

The analysed workload has no streaming operators (no windows over event
time, watermarks or state).  The one append-only feed it has is the audit
log; :mod:`custspark.streaming.audit_stream` ingests it incrementally.
"""
