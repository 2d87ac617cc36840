"""Word lists, patterns and vocabularies that results depend on."""

# --- sensitivity of a column, searched in its name, then in its description -----------------
CATEGORY_PATTERNS = (
    ("Credential", r"password|passwd|pwd|secret|token|api.?key|credential|salt|hash"),
    ("Financial", r"bank|account.?no|iban|swift|card|cvv|salary|income|payment"),
    ("Health", r"health|medical|diagnos|disease|blood|patient"),
    (
        "PII",
        r"email|e.?mail|phone|mobile|address|aadhaar|aadhar|pan.?no|passport|dob|birth"
        r"|father|mother|guardian|name",
    ),
    ("Potentially Sensitive", r"user|login|ip.?address|location|photo|signature|remark|note"),
)
SENSITIVE_CATEGORIES = ("Credential", "PII", "Financial", "Health", "Potentially Sensitive")
ALL_CATEGORIES = SENSITIVE_CATEGORIES + ("Unknown", "Non-sensitive")
# from the least to the most sensitive
CATEGORIES_BY_RISK = ALL_CATEGORIES[::-1]
MASKING_ACTIONS = ("REDACT", "PSEUDONYMIZE", "PRESERVE")

# Normalized column names (lower case, letters and digits only) that are personal data.
LEGACY_PII_NAMES = (
    "studnm", "studname", "sname", "fname", "mname", "fathernm", "mothernm", "guardiannm",
    "mobno", "mobileno", "phno", "phoneno", "contactno", "addr1", "addr2", "resadd", "paddr",
    "dob", "bdate", "birthdt", "aadhaar", "aadhar", "panno", "passport", "email", "emailid",
    "emailaddr",
)

# --- sensitivity of a value, matched against the whole trimmed text, lowest rank wins --------
VALUE_PATTERNS = (
    (1, "email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$", "email value pattern"),
    (2, "phone", r"^(?:\+?\d[\d ()-]{7,}\d)$", "phone value pattern"),
    (3, "id", r"^\d{4}[ -]?\d{4}[ -]?\d{4}$", "Aadhaar-like value pattern"),
    (4, "tax", r"(?i)^[A-Z]{5}\d{4}[A-Z]$", "PAN-like value pattern"),
)

# --- evidence and token texts ------------------------------------------------------------------
EVIDENCE_LEGACY = "BUILTIN_LEGACY_COLUMN_NAME"
EVIDENCE_NAME = "BUILTIN_COLUMN_NAME"
EVIDENCE_DESCRIPTION = "EXTENDED_PROPERTY_HEURISTIC"
EVIDENCE_NONE = "NO_SENSITIVITY_SIGNAL"
EVIDENCE_VALUE = "VALUE_SIGNAL: "
EVIDENCE_OVERRIDE = "OVERRIDE: "
REDACTED = "[REDACTED]"
BINARY_REDACTED = "[BINARY_REDACTED]"
MASKED_TOKEN = r"^\[MASKED:[0-9a-f]{16}\]$"

# --- secrets in free text ------------------------------------------------------------------------
CONNECTION_PASSWORD = r"(?i)(\b(?:PWD|PASSWORD)\s*=\s*)[^;]*"
SECRET_ASSIGNMENT = (
    r"(?i)\b(password|pwd|token|secret|api[_-]?key|access[_-]?key)\s*=\s*([^;\s]+)"
)
QUOTED_SECRET_ASSIGNMENT = r"(?i)(password|passwd|pwd|secret|token|api.?key)\s*=\s*N?'[^']*'"
SECRET_WORD = r"(?i)\b(?:password|passwd|pwd|token|secret|api[-_]?key|access[-_]?key)\b"
SECRET_ARGUMENT = (
    r"(?i)((?:--?|/)?(?:password|passwd|pwd|token|secret|api[-_]?key|access[-_]?key))"
    r"\s*(?:=|:|\s)\s*(?:'[^']*'|\"[^\"]*\"|[^\s;]+)"
)

# --- column names that look like identifiers ----------------------------------------------------
RELATION_NAME = r"(?i)(^id$|id$|_id$|code$|no$)"
IDENTIFIER_NAME = r"(?i)(^id$|id$|_id$)"

# --- statement text ---------------------------------------------------------------------------------
NAME_PART = r"(?:\[[^\]]+\]|[A-Za-z_][A-Za-z0-9_$#@]*)"
JOB_NAME_PART = r"(?:\[[^\]]*(?:\]\][^\]]*)*\]|[A-Za-z_#][A-Za-z0-9_$#@]*)"
DYNAMIC_DEFINITION = r"(?i)\bSP_EXECUTESQL\b|\bEXEC\s*\(|\bEXECUTE\s*\("
DYNAMIC_JOB_STEP = (
    r"(?i)\bsp_executesql\b|\bEXEC(?:UTE)?\s*\(|\bEXEC(?:UTE)?\s+@[A-Za-z_]"
    r"|\bEXEC(?:UTE)?\b[^;]*\+"
)
EXTERNAL_CALLS = ("OPENQUERY", "OPENROWSET", "OPENDATASOURCE")
ALIAS_STOP_WORDS = (
    "where", "join", "left", "right", "inner", "outer", "full", "cross", "on", "group",
    "order", "having", "union", "except", "intersect", "with",
)
FORBIDDEN_TOKENS = (
    "ALTER", "BACKUP", "BEGIN", "BULK", "CHECKPOINT", "COMMIT", "CREATE", "DBCC", "DELETE",
    "DENY", "DISABLE", "DROP", "ENABLE", "EXEC", "EXECUTE", "GRANT", "INSERT", "INTO", "KILL",
    "MERGE", "RECONFIGURE", "RESTORE", "REVOKE", "ROLLBACK", "SAVE", "SHUTDOWN", "TRUNCATE",
    "UPDATE", "USE", "WAITFOR",
)
FORBIDDEN_PHRASES = (
    r"\bNEXT\s+VALUE\s+FOR\b", r"\bOPENQUERY\s*\(", r"\bOPENROWSET\s*\(",
    r"\bOPENDATASOURCE\s*\(",
)

# --- table roles, first matching name pattern wins ------------------------------------------------
ROLE_NAME_PATTERNS = (
    ("AUDIT", r"audit|log"),
    ("HISTORY", r"history"),
    ("ARCHIVE", r"archive|backup|old"),
    ("STAGING", r"stage|staging|import|temp"),
    ("CONFIGURATION", r"config|setting|option"),
)
BRIDGE_NAME = r"map|bridge|link|detail"
LOOKUP_NAME = r"lookup|type|status|master"
TRANSACTION_NAME = r"transaction|invoice|payment|receipt|order|entry"

# --- error texts -------------------------------------------------------------------------------------
TIMEOUT_MARKERS = ("timeout", "timed out", "hyt00", "hyt01")
SAMPLE_ACCESS_MARKERS = (
    "permission was denied", "select permission denied", "not authorized",
    "could not use view", "binding errors", "definition is encrypted",
)
ACCESS_MARKERS = (
    "permission was denied", "select permission denied", "not authorized",
    "does not have permission", "user does not have permission", "access is denied",
    "insufficient permission", "view database state permission", "cannot open database",
    "login failed", "binding errors", "could not use view or function",
    "definition is encrypted",
)
UNSUPPORTED_MARKERS = (
    "invalid object name", "invalid column name", "is not a recognized built-in function name",
    "feature is not supported", "not supported in this version", "not supported on this edition",
)

# --- type names of catalogues -----------------------------------------------------------------------
STRING_TYPES = ("char", "varchar", "nchar", "nvarchar", "text", "ntext", "xml", "string")
NUMERIC_TYPES = (
    "tinyint", "smallint", "int", "bigint", "decimal", "numeric", "money", "smallmoney",
    "float", "real", "bit", "double", "boolean",
)
DATE_TYPES = (
    "date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "time", "timestamp",
    "timestamp_ntz", "timestamp_ltz",
)
BINARY_TYPES = ("binary", "varbinary", "image", "rowversion")
UNPROFILED_TYPES = (
    "binary", "varbinary", "image", "text", "ntext", "xml", "sql_variant", "rowversion",
    "hierarchyid", "geography", "geometry", "variant",
)

# --- comparison ---------------------------------------------------------------------------------------
TIMELINE_PRIORITY = (
    "REVERTED_TO_A", "CHANGED_BOTH", "ADDED_IN_B", "ADDED_IN_C", "REMOVED_IN_B",
    "REMOVED_IN_C", "CHANGED_A_TO_B", "CHANGED_B_TO_C",
)
