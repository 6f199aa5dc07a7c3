"""Severity ranks, weights, grades and other constant classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import choose, first_where, norm_lower, norm_upper

# Fixed values of the scoring model.
RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
LEVEL = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
WEIGHT = {"CRITICAL": 18.0, "HIGH": 9.0, "MEDIUM": 3.0, "LOW": 1.0, "INFO": 0.0}
UNKNOWN_WEIGHT = 2.0
CONFIDENCE = {"trivy": 0.9, "deploy": 0.8, "network": 0.7, "nfr": 0.6}
GRADES = ((100, "A+"), (90, "A"), (80, "B"), (65, "C"), (50, "D"))
TYPE_ORDER = {"core": 0, "external": 1, "nfr": 2, "deploy": 3, "network": 4}
TYPE_PREFERENCE = {"core": 3, "external": 2, "nfr": 1}

# OWASP Top 10 2021 category of a rule.
OWASP = {
    "ENTROPY-SECRET": "A02:2021 – Cryptographic Failures",
    "ENTR-FRAGILE": "A04:2021 – Insecure Design",
    "ENTR-04": "A04:2021 – Insecure Design",
    "ENTR-12": "A04:2021 – Insecure Design",
    "missing_lockfile": "A06:2021 – Vulnerable and Outdated Components",
    "NFR-API-001": "A04:2021 – Insecure Design",
    "NFR-API-002": "A05:2021 – Security Misconfiguration",
    "NFR-API-003": "A01:2021 – Broken Access Control",
    "NFR-ENV-002": "A02:2021 – Cryptographic Failures",
}
# Rules of different scanners that report the same problem.
SEMANTIC = {
    "FAST-LAZY-EXC": "exception_swallow",
    "B110": "exception_swallow",
    "FAST-AUTH": "missing_authentication",
    "NFR-API-003": "missing_authentication",
    "FAST-RATELIMIT": "missing_rate_limiting",
    "NFR-API-001": "missing_rate_limiting",
    "FAST-CORS": "missing_cors_policy",
    "NFR-API-002": "missing_cors_policy",
}
# Keyword in a message to vulnerability class code.
VULN_CODES = {
    "cross-site scripting": "XSS",
    "xss": "XSS",
    "sql injection": "SQLI",
    "command injection": "EXEC",
    "path traversal": "PATH",
    "ssrf": "SSRF",
    "server-side request forgery": "SSRF",
    "hardcoded secret": "SECRETS",
    "secret": "SECRETS",
    "weak cryptography": "CRYPTO",
    "insecure deserialization": "DESER",
    "csrf": "CSRF",
    "authentication": "AUTH",
    "authorization": "AUTHZ",
    "information exposure": "INFO",
    "information disclosure": "INFO",
    "ssti": "SSTI",
    "server-side template injection": "SSTI",
    "jwt": "JWT",
    "debug mode": "DEBUG",
    "open redirect": "REDIR",
    "xml external entity": "XXE",
    "insecure configuration": "CONFIG",
    "denial of service": "DOS",
    "race condition": "RACE",
    "prototype pollution": "PROTO",
    "directory listing": "DIRLIST",
    "file upload": "UPLOAD",
    "cors misconfiguration": "CORS",
    "cookie": "COOKIE",
    "session": "SESSION",
    "logging": "LOG",
    "error handling": "ERROR",
}
# Service behind a well-known port.
PORT_SERVICES = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 80: "HTTP", 443: "HTTPS",
    3306: "MySQL", 5432: "PostgreSQL", 27017: "MongoDB", 6379: "Redis",
    11211: "Memcached", 9200: "Elasticsearch", 8080: "HTTP Backup", 8443: "HTTPS Alt",
    5000: "Flask/Django/ASP.NET", 3000: "Node/React", 4000: "Dev server",
    9090: "Prometheus", 9091: "Pushgateway", 2181: "Zookeeper", 9092: "Kafka",
    5672: "RabbitMQ", 15672: "RabbitMQ UI", 4200: "Angular Dev", 8888: "Jupyter",
    50070: "Hadoop NameNode",
}
CRITICAL_PORTS = (21, 23, 25)
HIGH_PORTS = (3306, 5432, 27017, 6379, 11211, 9200, 2181, 9092, 50070, 22, 3389)


def severity_rank(col: Column) -> Column:
    return choose(norm_upper(col), RANK, 9)


def severity_level(col: Column) -> Column:
    return choose(F.upper(col), LEVEL, 0)


def severity_weight(col: Column) -> Column:
    return choose(norm_upper(col), WEIGHT, UNKNOWN_WEIGHT)


def source_confidence(col: Column) -> Column:
    return choose(norm_lower(col), CONFIDENCE, 1.0)


def effective_weight(severity: Column, source: Column) -> Column:
    return severity_weight(severity) * source_confidence(source)


def semgrep_severity(col: Column) -> Column:
    u = norm_upper(col)
    return first_where(
        [(u.isin("CRITICAL", "HIGH", "ERROR"), "ERROR"), (u.isin("MEDIUM", "WARNING"), "WARNING")], "INFO"
    )


def sarif_number(col: Column) -> Column:
    return choose(F.upper(col), {"CRITICAL": "9.0", "HIGH": "7.0", "MEDIUM": "5.0", "LOW": "2.0"}, "5.0")


def sarif_level(col: Column) -> Column:
    return choose(F.upper(col), {"CRITICAL": "error", "HIGH": "error", "LOW": "note"}, "warning")


def type_order(col: Column) -> Column:
    return choose(norm_lower(col), TYPE_ORDER, 9)


def grade(score: Column) -> Column:
    return first_where([(score >= floor, name) for floor, name in GRADES], "F")


def owasp_category(rule_id: Column) -> Column:
    return choose(rule_id, OWASP, "")


def semantic_class(rule_id: Column) -> Column:
    return choose(norm_upper(rule_id), SEMANTIC, "")


def vuln_class_code(message: Column) -> Column:
    """Code of the longest keyword in the message, then the first by name."""
    low = F.lower(message)
    keys = sorted(VULN_CODES, key=lambda k: (-len(k), k))
    return first_where([(F.contains(low, F.lit(k)), VULN_CODES[k]) for k in keys], "MISC")


def normalize_confidence(col: Column) -> Column:
    return choose(norm_lower(col), {"high": "high", "medium": "medium", "med": "medium", "low": "low"}, "")


def port_service(port: Column) -> Column:
    return choose(port, PORT_SERVICES, "unknown")


def port_severity(port: Column) -> Column:
    return first_where([(port.isin(*CRITICAL_PORTS), "CRITICAL"), (port.isin(*HIGH_PORTS), "HIGH")], "INFO")


def rule_category(rule_id: Column) -> Column:
    return F.when(F.instr(rule_id, "-") > 1, F.substring_index(rule_id, "-", 1)).otherwise(rule_id)
