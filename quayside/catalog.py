"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from quayside.plans import q_control, q_design, q_evaluation, q_hypotheses, q_mixture, q_panel, q_pilot, q_policy, q_readouts, q_records, q_text

FLAGSHIP = "stratum_weighted_interval"
QUERIES: dict = dict(q_evaluation.QUERIES) | q_panel.QUERIES | q_text.QUERIES | q_policy.QUERIES | q_hypotheses.QUERIES | q_pilot.QUERIES | q_control.QUERIES | q_records.QUERIES | q_design.QUERIES | q_mixture.QUERIES | q_readouts.QUERIES
SQL: dict = dict(q_evaluation.SQL) | q_panel.SQL | q_text.SQL | q_policy.SQL | q_hypotheses.SQL | q_pilot.SQL | q_control.SQL | q_records.SQL | q_design.SQL | q_mixture.SQL | q_readouts.SQL
