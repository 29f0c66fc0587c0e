"""The built-in rule catalogue and the rule table that users extend.

A rule says what to look for (``pattern``), in which ``view`` of the text (``raw``, ``no_comments`` or ``masked``),
and in which ``scope``: ``line`` tests each line alone, ``text`` takes the start line of every match in the whole
text, ``both`` is the union of the two. ``probes`` are lower-case substrings of which at least one must be present
for the pattern to match at all; they let most texts skip the regex. A rule without probes is simply tried. ``starts``,
for a pattern of several branches, are the characters with which every match begins: places with others skip the branches.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = (
    "rule_id string, title string, description string, recommendation string, severity string, category string, "
    "source string, pattern string, view string, scope string, probes array<string>"
)
#: A rule table is configuration. It is turned into literal patterns, so its size is checked.
MAX_RULES = 2000


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    pattern: str
    title: str = ""
    description: str = ""
    recommendation: str = ""
    category: str = "SECURITY"
    source: str = "OWASP_SCANNER"
    view: str = "masked"
    scope: str = "both"
    probes: tuple[str, ...] = ()
    starts: str = field(default="", compare=False)  # changes the time only, never what is found


# Ids, severities and patterns decide which findings come out. (?i) ignores case, (?s) lets a dot
# match a line break.
SECURITY_RULES = (
    Rule(
        "OWASP-A03-SQL-001", "CRITICAL",
        r"(?i)(Statement|createStatement)\s*\.[a-zA-Z]*execute(Query|Update)?\s*\([^;]*\+[^;]*\)|"
        r'"(SELECT|INSERT|UPDATE|DELETE)[^"]*"\s*\+\s*[a-zA-Z0-9_]+',
        "SQL text built by joining strings",
        "A SQL command is glued together from text and a value, so the value can change the command.",
        "Bind the value as a parameter of a prepared statement.",
        view="no_comments", probes=("statement", '"select', '"insert', '"update', '"delete'), starts='sScC"',
    ),
    Rule(
        "OWASP-A03-CMD-001", "CRITICAL",
        r"(?i)Runtime\.getRuntime\s*\(\s*\)\.exec\s*\([^;]*\+[^;]*\)|"
        r"new\s+ProcessBuilder\s*\([^;]*\+[^;]*\)",
        "Operating-system command built by joining strings",
        "A process is started with a command line that contains a computed part.",
        "Pick the command from a fixed list and pass arguments separately, after checking them.",
        probes=("getruntime", "processbuilder"), starts="rRnN",
    ),
    Rule(
        "OWASP-A02-CRED-001", "HIGH",
        r'(?i)(password|passwd|secret|access[_-]?token)\s*=\s*"(?!your-|change-me|example|dummy|test)[^"]{8,}"|'
        r'(api[_-]?key)\s*=\s*"(?!x-api-key|api-key|authorization|content-type)[^"]{12,}"',
        "Secret written into the source",
        "A password, token or key is assigned from a literal, so everyone with the source has it.",
        "Read secrets from the environment or a secret store.",
        view="no_comments", probes=("password", "passwd", "secret", "token", "api"), starts="pPsSaA",
    ),
    Rule(
        "OWASP-A02-CRYPTO-001", "HIGH",
        r'(?i)MessageDigest\.getInstance\s*\(\s*"(MD5|SHA-1|SHA1)"\s*\)',
        "Broken hash function",
        "MD5 and SHA-1 no longer resist collisions.",
        "Use SHA-256 or better; for passwords use a slow password hash.",
        view="no_comments", probes=("messagedigest",),
    ),
    Rule(
        "OWASP-A02-RAND-001", "MEDIUM",
        r"(?i)new\s+Random\s*\(\s*\)|Math\.random\s*\(\s*\)",
        "Predictable random numbers",
        "The general-purpose generator can be predicted and does not suit tokens or session ids.",
        "Use a cryptographically secure generator.",
        probes=("random",), starts="nNmM",
    ),
    Rule(
        "OWASP-A08-DESER-001", "CRITICAL",
        r"(?i)new\s+ObjectInputStream\s*\([^)]*\)|"
        r"[a-zA-Z_$][a-zA-Z0-9_$]*\s*\.\s*readObject\s*\(",
        "Native deserialisation",
        "Reading native object streams from outside lets the sender run code.",
        "Exchange data in a plain format, or restrict the accepted classes.",
        probes=("objectinputstream", "readobject"),
    ),
    Rule(
        "OWASP-A01-AUTH-001", "HIGH",
        r"(?i)@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)"
        r"(?![\s\S]{0,250}(health|actuator|login|register|public|status))"
        r"(?![\s\S]{0,250}@(PreAuthorize|Secured|RolesAllowed))",
        "Endpoint without an authorisation mark",
        "A request mapping has no authorisation annotation near it and does not look public.",
        "Annotate the endpoint, or state in the security set-up that it is open on purpose.",
        view="no_comments", scope="text", probes=("mapping",),
    ),
    Rule(
        "OWASP-A05-CSRF-001", "HIGH",
        r"(?i)\.csrf\s*\(\s*\)\s*\.disable\s*\(\s*\)|csrf\s*\.\s*disable",
        "CSRF protection switched off",
        "Requests forged from other sites are no longer rejected.",
        "Keep the protection on for cookie sessions; write down why where it is off.",
        probes=("csrf",), starts=".cC",
    ),
    Rule(
        "OWASP-A05-TLS-001", "CRITICAL",
        r"(?i)setHostnameVerifier\s*\(\s*(NoopHostnameVerifier\.INSTANCE|[^)]*ALLOW_ALL_HOSTNAME_VERIFIER[^)]*)\s*\)|"
        r"new\s+X509TrustManager\s*\(\s*\)\s*\{[\s\S]{0,700}"
        r"checkServerTrusted\s*\([^)]*\)\s*\{\s*\}",
        "Certificate checks switched off",
        "Any certificate or host name is accepted, so the connection can be intercepted.",
        "Use a trust manager with a proper certificate chain.",
        probes=("sethostnameverifier", "x509trustmanager"), starts="sSnN",
    ),
    Rule(
        "OWASP-A07-PWD-001", "CRITICAL",
        r"(?i)password\.equals\s*\(|equals\s*\(\s*password|getPassword\s*\(\s*\)\.equals",
        "Password compared as plain text",
        "Passwords seem to be kept and compared unhashed.",
        "Store a slow salted hash and use its verify function.",
        probes=("password",), starts="pPeEgG",
    ),
    Rule(
        "OWASP-A09-LOG-001", "MEDIUM",
        r"(?i)log\.(info|debug|warn|error)\s*\([^;]*(password|token|secret)",
        "Secret written to a log",
        "A value named like a secret is passed to a logger.",
        "Leave such values out of log calls or blank them first.",
        probes=("log.",),
    ),
    Rule(
        "OWASP-A03-LDAP-001", "HIGH",
        r"(?i)(DirContext|LdapTemplate)\s+[a-zA-Z_$][a-zA-Z0-9_$]*[\s\S]{0,300}"
        r"\.search\s*\([^;]*\+[^;]*\)",
        "LDAP filter built by joining strings",
        "A directory search filter contains a computed part that can change its meaning.",
        "Encode the value or use filter parameters.",
        probes=("dircontext", "ldaptemplate"), starts="dDlL",
    ),
    Rule(
        "OWASP-A03-XXE-001", "HIGH",
        r"(?i)DocumentBuilderFactory\.newInstance\s*\(\s*\)|"
        r"SAXParserFactory\.newInstance\s*\(\s*\)|"
        r"XMLInputFactory\.newInstance\s*\(\s*\)",
        "XML parser with default entity handling",
        "A parser made with defaults may follow external entities in hostile input.",
        "Forbid document types and external entities before parsing.",
        probes=("factory.newinstance",), starts="dDsSxX",
    ),
)


def _quality(rule_id, severity, pattern, title, description, recommendation, scope="line", probes=()):
    return Rule(
        rule_id, severity, pattern, title, description, recommendation,
        category="CODE_QUALITY", source="QUALITY_SCANNER", view="raw", scope=scope, probes=probes,
    )


# Fixed values, as above.
QUALITY_RULES = (
    _quality(
        "QA-PRINT-001", "LOW", r"System\.out\.println|System\.err\.println",
        "Print to the console",
        "Console output has no level, no target and cannot be switched off.",
        "Write through a logger.",
        probes=("system.",),
    ),
    _quality(
        "QA-EMPTY-CATCH-001", "MEDIUM", r"(?s)catch\s*\([^)]+\)\s*\{\s*\}",
        "Catch block with nothing in it",
        "The error disappears and nobody can tell that it happened.",
        "Log it at least, or pass it on.",
        scope="both", probes=("catch",),
    ),
    _quality(
        "QA-TODO-001", "INFO", r"(?i)//\s*(TODO|FIXME|HACK|XXX)",
        "Open work note",
        "A comment says that something is missing or wrong here.",
        "Do the work, or move the note to the issue tracker.",
        probes=("todo", "fixme", "hack", "xxx"),
    ),
    _quality(
        "QA-DEPRECATED-001", "LOW", r"@Deprecated|new Date\(\)|Date\.getYear|Date\.getMonth|StringBuffer\(\)",
        "Outdated call or marker",
        "The code uses or declares something marked as outdated.",
        "Move to the replacement named in the documentation.",
        probes=("@deprecated", "new date()", "date.get", "stringbuffer()"),
    ),
    _quality(
        "QA-HARDCODE-001", "MEDIUM", r'"https?://[a-zA-Z0-9.-]+|"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}',
        "Fixed address in the source",
        "A URL or IP address ties the code to one environment.",
        "Take addresses from configuration.",
        probes=('"http', *[f'"{digit}' for digit in range(10)]),
    ),
    _quality(
        "QA-NPE-001", "MEDIUM", r"(?i)\.(get|find|fetch|load|retrieve)\w*\(.*\)\.",
        "Result used without a null check",
        "A look-up result is used at once although it may be null.",
        "Check it, or return an optional value.",
        probes=(".get", ".find", ".fetch", ".load", ".retrieve"),
    ),
    _quality(
        "QA-STATIC-001", "MEDIUM", r"private static (?!final)\w+\s+\w+\s*=",
        "Shared field that can change",
        "A static field that is not final is shared by all threads.",
        "Make it final, or keep the state per instance.",
        probes=("private static ",),
    ),
    _quality(
        "QA-INSTANCEOF-CHAIN-001", "LOW", r"(?s)instanceof.{0,100}instanceof.{0,100}instanceof",
        "Chain of type tests",
        "Several type tests in a row stand in for a missing common operation.",
        "Give the types a common method.",
        scope="both", probes=("instanceof",),
    ),
)

# Ids and severities of the rules that compare a measure with a limit. Their titles and descriptions
# take the subject and the measured value, see ``enrich_findings``.
METRIC_RULES = (
    Rule(
        "QA-LONG-METHOD-001", "MEDIUM", "", "Body of {subject} is too long to take in",
        "From its header to its closing brace '{subject}' takes {measured} lines; limit {limit}.",
        "Split it into smaller methods with telling names.",
        "CODE_QUALITY", "JAVAPARSER_AST", "", "metric",
    ),
    Rule(
        "QA-PARAMS-001", "LOW", "", "{subject} asks for too many arguments",
        "A call of '{subject}' has to supply {measured} values; limit {limit}.",
        "Group parameters that belong together in one object.",
        "CODE_QUALITY", "JAVAPARSER_AST", "", "metric",
    ),
    Rule(
        "QA-COMPLEXITY-001", "MEDIUM", "", "Too many ways through {subject}",
        "The branches of '{subject}' give it complexity {measured}, limit {limit}; each path wants a test.",
        "Move branches into methods of their own.",
        "CODE_QUALITY", "JAVAPARSER_AST", "", "metric",
    ),
    Rule(
        "QA-NESTING-001", "LOW", "", "{subject} buries its work under blocks",
        "In '{subject}' {measured} control statements stand inside each other; limit {limit}.",
        "Return early, or move inner blocks out.",
        "CODE_QUALITY", "JAVAPARSER_AST", "", "metric",
    ),
    Rule(
        "QA-GOD-CLASS-001", "MEDIUM", "", "Very large file",
        "File '{subject}' has {measured} lines (limit {limit}).",
        "Divide it by responsibility.",
        "CODE_QUALITY", "STRUCTURAL_METRICS", "", "metric",
    ),
)

CATALOG = SECURITY_RULES + QUALITY_RULES + METRIC_RULES


def security_rules(profile: str = "documented") -> tuple[Rule, ...]:
    """``documented`` lets rules about quoted text see quoted text. ``as_coded`` runs every rule on fully masked
    text, line by line and on the whole text, in which rules that need a quote cannot fire."""
    if profile == "documented":
        return SECURITY_RULES
    if profile == "as_coded":
        return tuple(replace(r, view="masked", scope="both") for r in SECURITY_RULES)
    raise ValueError(f"unknown profile: {profile}")


def quality_rules(profile: str = "documented") -> tuple[Rule, ...]:
    """``documented`` also tries the two patterns that span lines on the whole text; ``as_coded`` does not."""
    if profile == "documented":
        return QUALITY_RULES
    if profile == "as_coded":
        return tuple(replace(r, scope="line") for r in QUALITY_RULES)
    raise ValueError(f"unknown profile: {profile}")


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = CATALOG) -> DataFrame:
    """The rules as a table of known, checked size: small enough for every task to hold."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule table may hold at most {MAX_RULES} rules")
    names = [f.split()[0] for f in RULE_SCHEMA.split(", ")]
    columns = {n: pa.array([list(r.probes) if n == "probes" else getattr(r, n) for r in rules],
                           pa.list_(pa.string()) if n == "probes" else pa.string()) for n in names}
    return spark.createDataFrame(pa.table(columns))


def rules_from_frame(frame: DataFrame) -> tuple[Rule, ...]:
    """Read a rule table back. It is configuration of checked size, so the driver may hold it."""
    rows = frame.select(*[f.split()[0] for f in RULE_SCHEMA.split(", ")]).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table may hold at most {MAX_RULES} rules")
    rules = tuple(Rule(**{**row.asDict(), "probes": tuple(row.probes or ())}) for row in rows)
    for rule in rules:
        if rule.view not in ("raw", "no_comments", "masked", "") or rule.scope not in ("line", "text", "both", "metric"):
            raise ValueError(f"rule {rule.rule_id}: bad view or scope")
    return rules
