"""All registered queries; importing the modules fills the registry."""

from tidewatch.plans import q_alerts, q_logs, q_ops, q_requests, q_samples, q_text  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES  # noqa: F401
