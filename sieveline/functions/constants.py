"""Fixed values shared by the operators: sets, limits, patterns and texts that decide the results."""

# --- fixed values: file selection -------------------------------------------------------------
SUPPORTED_EXTENSIONS = (
    ".java", ".py", ".js", ".ts", ".go", ".cs", ".cpp", ".c",
    ".rb", ".php", ".kt", ".scala", ".xml", ".yaml", ".yml",
    ".properties", ".gradle", ".json",
)
SKIPPED_DIRECTORIES = (
    ".git", "node_modules", "target", "build", "__pycache__",
    ".idea", ".mvn", "dist", "out", ".gradle",
)
# The wide preset: declared sets that are larger than the ones used by default.
WIDE_SOURCE_EXTENSIONS = (
    ".java", ".py", ".js", ".ts", ".go", ".cs", ".cpp", ".c",
    ".rb", ".php", ".kt", ".scala", ".rs", ".swift", ".m", ".h",
)
WIDE_CONFIG_EXTENSIONS = (
    ".xml", ".yaml", ".yml", ".properties", ".gradle", ".json",
    ".toml", ".ini", ".conf",
)
ARCHIVE_EXTENSIONS = (".zip", ".tar", ".gz", ".tar.gz", ".tgz")
WIDE_SKIPPED_DIRECTORIES = (
    ".git", ".svn", ".hg",
    "node_modules", "bower_components",
    "target", "build", "dist", "out",
    "__pycache__", ".pytest_cache",
    ".idea", ".vscode", ".eclipse",
    ".mvn", ".gradle",
    "vendor", "packages",
)
TEXT_EXTENSIONS = (
    "java", "py", "js", "ts", "go", "cs", "cpp", "c", "rb", "php",
    "kt", "scala", "xml", "yaml", "yml", "properties", "gradle", "json", "txt", "md",
)
LANGUAGE_BY_EXTENSION = {
    ".java": "java", ".py": "python", ".js": "javascript", ".ts": "typescript",
    ".go": "go", ".cs": "csharp", ".kt": "kotlin", ".rb": "ruby",
    ".php": "php", ".scala": "scala",
}
UNKNOWN_LANGUAGE = "unknown"

# --- fixed values: limits and thresholds ------------------------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_METHOD_LENGTH = 50
MAX_FILE_LINES = 500
MAX_COMPLEXITY = 10
SEVERE_COMPLEXITY = 20
MAX_PARAMETERS = 5
MAX_NESTING = 4
MIN_COMMENT_DENSITY = 10.0
CHUNK_CHARS = 8000
CHUNK_OVERLAP = 0.1
JOB_RETENTION_HOURS = 24
MAX_REPLY_TOKENS = 2000
REPLY_TEMPERATURE = 0.2
REPLY_TOP_P = 0.9

# --- fixed values: severities and categories, worst first -------------------------------------
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

OWASP_2021 = {
    "A01": "A01:2021-Broken Access Control",
    "A02": "A02:2021-Cryptographic Failures",
    "A03": "A03:2021-Injection",
    "A04": "A04:2021-Insecure Design",
    "A05": "A05:2021-Security Misconfiguration",
    "A06": "A06:2021-Vulnerable and Outdated Components",
    "A07": "A07:2021-Identification and Authentication Failures",
    "A08": "A08:2021-Software and Data Integrity Failures",
    "A09": "A09:2021-Security Logging and Monitoring Failures",
    "A10": "A10:2021-Server-Side Request Forgery",
}

# --- fixed values: default texts --------------------------------------------------------------
DEFAULT_PROJECT = "Unnamed Project"
PROMPT_PROJECT = "Unknown"
DEFAULT_FILE_NAME = "snippet.java"
SKIPPED_SUMMARY = "LLM analysis skipped"
NO_SUMMARY = "No summary available"
UNPARSED_CHUNK = "Could not parse LLM response"
UNPARSED_PROJECT = "Meta-analysis parsing failed."
UNPARSED_ASSESSMENT = "Could not generate architectural assessment."
REPLY_RULE_PREFIX = "LLM-ARCH-"
REPLY_SOURCE_PREFIX = "LLM_"

# --- fixed values: validation word lists and patterns -----------------------------------------
SQL_MARKERS = (
    "select", "insert", "update", "delete", "drop", "create",
    "alter", "exec", "execute", "union", "declare", "--", "/*", "*/",
)
XSS_MARKERS = (
    "<script", "javascript:", "onerror=", "onload=", "onclick=",
    "<iframe", "<object", "<embed", "eval(",
)
GIT_URL = r"(https?://|git@)[\w.-]+[:/][\w.-]+/[\w.-]+(\.git)?"
EMAIL = r"[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ALPHANUMERIC = r"[a-zA-Z0-9]+"
SAFE_FILE_NAME = r"[a-zA-Z0-9._-]+"
JAVA_PACKAGE = r"[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)*"
JAVA_CLASS = r"[A-Z][a-zA-Z0-9]*"
IPV4 = r"((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
URL_SCHEMES = ("http", "https", "ftp", "file", "jar", "mailto", "jmod", "jrt")
CAMEL_CASE = r"[a-z][a-zA-Z0-9]*"
PASCAL_CASE = r"[A-Z][a-zA-Z0-9]*"
SNAKE_CASE = r"[a-z][a-z0-9_]*"
SCREAMING_SNAKE_CASE = r"[A-Z][A-Z0-9_]*"

# --- fixed values: per-file counting patterns --------------------------------------------------
METHOD_PATTERN = r"(public|private|protected)\s+(static\s+)?(final\s+)?\w+(<[^>]+>)?\s+\w+\s*\("
CLASS_PATTERN = r"(public|private|protected)?\s*(static\s+)?(final\s+)?(abstract\s+)?class\s+\w+"
IMPORT_PATTERN = r"(?m)^import\s+"
BRANCH_KEYWORDS = ("if", "else", "for", "while", "do", "switch", "case", "catch")
BRANCH_OPERATORS = ("&&", "||", "?")
