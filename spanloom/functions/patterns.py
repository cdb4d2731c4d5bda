"""Patterns, word lists and limits that detectors, classifiers and samplers share."""

from __future__ import annotations

# ---- Fixed values: formats of known non-secrets, in order of precedence (category, pattern)
LOOKALIKES = (
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("sri_integrity", r"\bsha(?:256|384|512)-[A-Za-z0-9+/]{20,}={0,2}"),
    ("hex_sha256", r"\b[0-9a-f]{64}\b"),
    ("hex_sha1_or_git", r"\b[0-9a-f]{40}\b"),
    ("hex_md5", r"\b[0-9a-f]{32}\b"),
    ("ssh_pubkey", r"\bssh-(?:rsa|ed25519|dss)\s+AAAA[0-9A-Za-z+/]+={0,2}"),
    ("pem_public", r"-----BEGIN (?:PGP )?PUBLIC KEY(?: BLOCK)?-----"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("mac", r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b"),
    ("env_var_name", r"\b[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+\b"),
)
HEX_CATEGORIES = ("hex_sha256", "hex_sha1_or_git", "hex_md5")
QUOTAS = {
    "uuid": 600, "sri_integrity": 400, "hex_sha256": 500, "hex_sha1_or_git": 500, "hex_md5": 400,
    "ssh_pubkey": 250, "pem_public": 150, "ipv4": 120, "mac": 80, "env_var_name": 150,
}

# ---- Fixed values: formats of credentials
PEM_PRIVATE = r"(?s:-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)"
VENDOR = (
    r"\b(?:ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}"
    r"|xox[baprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_\-]{20,}|AIza[0-9A-Za-z_\-]{35})"
)
VENDOR_PREFIX = r"(?:ghp_|gho_|github_pat_|AKIA|ASIA|xox[baprs]-|sk-|glpat-|AIza)"
TOKEN = r"[A-Za-z0-9+/=_\-.]{12,}"
KEYWORDED = (
    r"(?i:(?:secret|passw|pwd|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|client[_-]?secret|credential|bearer|auth)"
    r"[a-z0-9_]*\s*[\"'`\]]?\s*(?::=|=(?!=)|[:>])\s*[\"'`{]?\s*)"
)
KEYWORDED_VALUE = r"[A-Za-z0-9+/=_\-]{6,}"
NO_CALL = r"(?![\w.]*\()"

# ---- Fixed values: what tells a label (suggestion rules), case-insensitive
STRONG_KEY = r"(?i)(password|passwd|pwd|secret|private[_\-]?key|access[_\-]?key|api[_\-]?key|client[_\-]?secret|auth[_\-]?token|bearer|credential)"
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your[_\-]|xxxx|redacted|<.*>|\{\{|test[_\-]?(key|token|secret|password)|foobar|123456|000000)"
NEGATIVE_KEY = r"(?i)(url|host|endpoint|version|checksum|sha\d|md5|digest|public[_\-]?key|fingerprint|nonce|salt\b|id\b|uuid|hash)"

# ---- Fixed values: what tells the class of a value
PLACEHOLDER_PARTS = (
    "example", "changeme", "your_", "your-", "yourkey", "placeholder", "dummy", "test", "sample", "redact",
    "xxxx", "<", ">", "replace", "insert", "todo", "fixme", "none", "null", "xxx", "****", "...",
)
VALUE_CLASSES = (
    ("jwt", r"^ey[A-Za-z0-9_-]+\.ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"),
    ("url/connection_string", r"(?i)[a-z][a-z0-9+.-]*://"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("ip_address", r"^\d{1,3}(\.\d{1,3}){3}$"),
    ("mac_address", r"^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$"),
)
ENV_NAME, NUMERIC_ID, BASE64_BLOB, HEX_BLOB = r"^[A-Z][A-Z0-9_]{3,}$", r"^\d{5,}$", r"^[A-Za-z0-9+/=_-]+$", r"^[0-9a-fA-F]+$"
HASH_LENGTHS = (32, 40, 64, 128)

# ---- Fixed values: source files and labels
EXTENSIONS = {
    "py": "py", "js": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "go": "go", "java": "java", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "ini": "ini", "cfg": "cfg", "conf": "conf", "env": "env", "sh": "sh", "bash": "sh", "properties": "properties", "json": "json", "xml": "xml",
}
SKIPPED_FOLDERS = ("node_modules", "vendor", "dist", "build", ".git")
MAX_FILE_BYTES = 64000
POSITIVE, NEGATIVE, AMBIGUOUS = "POLICY_POSITIVE", "POLICY_NEGATIVE", "AMBIGUOUS_EXCLUDED"
FAMILIES = ("generic_password", "generic_api_key", "generic_high_entropy", "basic_auth_header")

# ---- Fixed values: how each kind of source file assigns a value {V} to a key {K}, and the key of each family
INJECTED_LINES = {
    "py": '{K} = "{V}"', "js": 'const {K} = "{V}";', "ts": 'const {K}: string = "{V}";', "go": '\t{K} := "{V}"', "java": 'String {K} = "{V}";',
    "yaml": '{K}: "{V}"', "toml": '{K} = "{V}"', "ini": "{K} = {V}", "cfg": "{K} = {V}", "conf": "{K} = {V}", "env": "{K}={V}",
    "sh": 'export {K}="{V}"', "properties": "{K}={V}", "json": '  "{K}": "{V}",', "xml": "<{K}>{V}</{K}>",
}
UPPER_KEYS = ("java", "sh")
FAMILY_KEYS = ("password", "api_key", "secret", "authorization")
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SYMBOLS, BASE64_SYMBOLS, DIGITS = "!@#$%^&*-_", "+/", "0123456789"
