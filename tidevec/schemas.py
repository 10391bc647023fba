"""Schemas of the tables that the engine reads and returns."""

from __future__ import annotations

VECTORS = "slot BIGINT, id BIGINT, vec ARRAY<FLOAT>"
HITS = "rank INT, id BIGINT, score DOUBLE, slot BIGINT"
CORPUS = (
    "run_id BIGINT, sequence BIGINT, seed BIGINT, row INT, episode_id BIGINT, env_id BIGINT, step BIGINT, obs ARRAY<FLOAT>, "
    "action INT, reward FLOAT, terminal INT, action_mask ARRAY<INT>, value FLOAT, logp FLOAT, states ARRAY<INT>"
)
ACCELERATORS = "id BIGINT, box_id INT, local_index INT, backend STRING, caps BIGINT, state STRING, mem_total_mib BIGINT, mem_used_mib BIGINT, name STRING"
JOBS = "job_id BIGINT, required_caps BIGINT, mem_required_mib BIGINT, vector_mode STRING, state STRING, accel_id BIGINT, submit_ms BIGINT, payload STRING"
