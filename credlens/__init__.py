"""Finding leaked credentials in large text corpora, as Spark jobs."""

from credlens.operators.detect import detect
from credlens.plans.scan import all_findings, scan_documents, scan_history, verify_documents
from credlens.rules import Allowlist, Rule, RulePack, default_rule_pack, load_rule_pack

__all__ = [
    "Allowlist", "Rule", "RulePack", "all_findings", "default_rule_pack", "detect",
    "load_rule_pack", "scan_documents", "scan_history", "verify_documents",
]
