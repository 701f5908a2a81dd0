"""The registered queries of the library and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from . import audit_jobs, code_jobs, gate_jobs, graph_jobs, project_jobs, report_jobs, search_jobs, stream_jobs, usage_jobs

JOBS = (search_jobs, usage_jobs, graph_jobs, gate_jobs, stream_jobs, audit_jobs, code_jobs, project_jobs, report_jobs)
QUERIES = {name: query for job in JOBS for name, query in job.QUERIES.items()}
ORACLES = {name: sql for job in JOBS for name, sql in job.ORACLES.items()}
