"""Schemas of the tables this package reads and writes."""

from __future__ import annotations

FILES = "repo string, file_path string, content string, language string, size bigint"

DEPENDENCY_INFO = (
    "struct<package_name:string,installed_version:string,fixed_version:string,cve:string>"
)

FINDING_COLUMNS = [
    "finding_id", "scan_id", "repo", "file_path", "line_no", "rule_id", "category", "severity",
    "title", "description", "code_snippet", "recommendation", "cwe", "owasp", "node_type",
    "method", "dependency_info",
]

# A finding that was worked out for a whole file, before the rule texts are joined;
# ``texts`` fills the markers of the rule's texts.
FILE_ITEM = (
    "struct<rule_no:int,line_no:int,emit_line:int,ordinal:int,severity:string,snippet:string,"
    "texts:map<string,string>>"
)

SCORES = "struct<overall:int,security:int,quality:int,maintainability:int,documentation:int>"
SEVERITY_COUNTS = "struct<critical:int,high:int,medium:int,low:int,info:int>"

ADVISORIES = (
    "ecosystem string, package string, fixed_version string, cve string, severity string, "
    "title string, about string, advice string"
)
