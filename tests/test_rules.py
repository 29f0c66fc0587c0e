"""Every rule: one text that fires, with its exact lines, and one near miss."""

from sieveline.operators.rule_catalog import METRIC_RULES, QUALITY_RULES, SECURITY_RULES
from sieveline.plans import scan

FIRES = {
    "OWASP-A03-SQL-001": ('x\nq = "select a from b where c = " + value;', [2]),
    "OWASP-A03-CMD-001": ('Runtime.getRuntime().exec("rm " +\n   name);\nnew ProcessBuilder(a + b);', [1, 3]),
    "OWASP-A02-CRED-001": ('String passwd = "correct-horse";\napi-key = "0123456789ab";', [1, 2]),
    "OWASP-A02-CRYPTO-001": ('\nvar d = MessageDigest.getInstance( "sha1" );', [2]),
    "OWASP-A02-RAND-001": ("int a;\ndouble d = Math.random();\nnew   Random()", [2, 3]),
    "OWASP-A08-DESER-001": ("in = new ObjectInputStream(s);\no = in\n  .readObject();", [1, 2, 3][:2]),
    "OWASP-A01-AUTH-001": ("@GetMapping\nint f() { }" + " " * 300, [1]),
    "OWASP-A05-CSRF-001": ("http\n  .csrf()\n  .disable();", [2]),
    "OWASP-A05-TLS-001": ("new X509TrustManager() {\n void checkServerTrusted(A a) {\n }\n};", [1]),
    "OWASP-A07-PWD-001": ("if (user.getPassword().equals(given)) { }", [1]),
    "OWASP-A09-LOG-001": ("log.info(a,\n   token);", [1]),
    "OWASP-A03-LDAP-001": ("LdapTemplate t = x;\n\nt.search(base + name);", [1]),
    "OWASP-A03-XXE-001": ("f = SAXParserFactory.newInstance();", [1]),
    "QA-PRINT-001": ('a();\nSystem.err.println("x");', [2]),
    "QA-EMPTY-CATCH-001": ("try { } catch (E e) { }\ncatch (F f)\n{\n}", [1, 2]),
    "QA-TODO-001": ("// fixme\n/* todo */\n//   Hack", [1, 3]),
    "QA-DEPRECATED-001": ("@Deprecated\nnew StringBuffer()", [1, 2]),
    "QA-HARDCODE-001": ('a = "http://x.y";\nb = "127.0.0.1";', [1, 2]),
    "QA-NPE-001": ("x = repo.findOne(1).name();", [1]),
    "QA-STATIC-001": ("private static int n = 1;", [1]),
    "QA-INSTANCEOF-CHAIN-001": ("a instanceof B\n|| a instanceof C\n|| a instanceof D", [1]),
}
MISSES = {
    "OWASP-A03-SQL-001": 'q = "select a from b"; // "select a" + value',
    "OWASP-A03-CMD-001": 'Runtime.getRuntime().exec("a + b");',
    "OWASP-A02-CRED-001": 'secret = "your-secret-here"; password = "short"; // password = "longenough"',
    "OWASP-A02-CRYPTO-001": 'MessageDigest.getInstance("SHA-256")',
    "OWASP-A02-RAND-001": "new SecureRandom(); new Random(seed)",
    "OWASP-A08-DESER-001": '// new ObjectInputStream(s)\nString s = "x.readObject()";',
    "OWASP-A01-AUTH-001": "@GetMapping\n@PreAuthorize\nint f() { }",
    "OWASP-A05-CSRF-001": '"csrf.disable"',
    "OWASP-A05-TLS-001": "new X509TrustManager() {\n void checkServerTrusted(A a) { verify(a); }\n};",
    "OWASP-A07-PWD-001": "encoder.matches(password, hash)",
    "OWASP-A09-LOG-001": 'log.info("token"); int token;',
    "OWASP-A03-LDAP-001": "LdapTemplate t;\nt.search(base);",
    "OWASP-A03-XXE-001": "SAXParserFactory.newInstance(name)",
    "QA-PRINT-001": "System.out.print(1)",
    "QA-EMPTY-CATCH-001": "catch (E e) { log(e); }",
    "QA-TODO-001": "int todo; # TODO",
    "QA-DEPRECATED-001": "new Date(1)",
    "QA-HARDCODE-001": '"1.2.3" ; http://x.y',
    "QA-NPE-001": "repo.findOne(1);",
    "QA-STATIC-001": "private static final int N = 1;",
    "QA-INSTANCEOF-CHAIN-001": "a instanceof B || a instanceof C",
}


def found(frame):
    out = {}
    for row in frame.collect():
        out.setdefault((row.path, row.rule_id), []).append(row.line_number)
    return {k: sorted(v) for k, v in out.items()}


def test_catalogue_is_complete():
    assert (len(SECURITY_RULES), len(QUALITY_RULES), len(METRIC_RULES)) == (13, 8, 5)
    assert set(FIRES) == set(MISSES) == {r.rule_id for r in SECURITY_RULES + QUALITY_RULES}


def test_each_rule_fires_on_its_lines_and_not_on_the_near_miss(files):
    table = files({f"hit/{r}": text for r, (text, _) in FIRES.items()} | {f"miss/{r}": t for r, t in MISSES.items()})
    hits = found(scan.security_hits(table)) | found(scan.quality_hits(table))
    assert {r: hits.get((f"hit/{r}", r)) for r in FIRES} == {r: lines for r, (_, lines) in FIRES.items()}
    assert [r for r in MISSES if (f"miss/{r}", r) in hits] == []


def test_probes_never_change_the_result(spark, files):
    """Rules with and without probe words give the same hits."""
    from dataclasses import replace

    from fixtures.source_tables import source_files

    table = files({f"hit/{r}": text for r, (text, _) in FIRES.items()}).unionByName(
        source_files(spark, "/root/testdata/sf0.001"))
    rules = SECURITY_RULES + QUALITY_RULES
    from sieveline.operators.matching import match_rules

    bare = tuple(replace(r, probes=()) for r in rules)
    a = match_rules(table, rules)
    b = match_rules(table, bare)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_as_coded_profile_masks_quoted_text(files):
    table = files({
        "Dao.java": 'String q = "SELECT * FROM users WHERE id = " + id;',
        "Config.java": 'password = "0123456789";',
        "Hash.java": 'MessageDigest.getInstance("MD5")',
        "Web.java": "@GetMapping @PreAuthorize",
    })
    assert found(scan.security_hits(table, profile="as_coded")) == {}
    assert {r for _, r in found(scan.security_hits(table))} == {
        "OWASP-A03-SQL-001", "OWASP-A02-CRED-001", "OWASP-A02-CRYPTO-001"}


def test_scope_and_paths(files):
    bad = "new Random()"
    table = files({
        "a/src/test/X.java": bad, "a\\test\\Y.java": bad, "test/Z.java": bad, "win\\W.java": bad, "  ": bad,
        "blank.java": " \n ", "empty.java": "", "null.java": None,
    })
    assert {p for p, _ in found(scan.security_hits(table))} == {"test/Z.java", "win/W.java"}


def test_equal_paths_after_normalising_are_deduplicated(files):
    table = files({"a/b.java": "new Random()", "a\\b.java": "new Random()"})
    assert scan.security_scan(table).count() == 1
    # in the combined pass quality findings keep one per file
    both = scan.all_findings(files({"a/b.java": "new Random() // TODO", "a\\b.java": "new Random() // TODO"}))
    counts = {r.rule_id: r["count"] for r in both.groupBy("rule_id").count().collect()}
    assert counts == {"OWASP-A02-RAND-001": 1, "QA-TODO-001": 2}


def test_combined_pass_equals_the_separate_scans(spark):
    from fixtures.source_tables import source_files

    table = source_files(spark, "/root/testdata/sf0.001")
    both = scan.all_findings(table)
    apart = scan.security_scan(table).unionByName(scan.quality_scan(table))
    assert both.exceptAll(apart).count() == 0 and apart.exceptAll(both).count() == 0 and both.count() > 1000


def test_empty_table_gives_empty_findings_with_schema(files, spark):
    empty = spark.createDataFrame([], "job_id string, path string, content string")
    out = scan.all_findings(empty)
    assert out.count() == 0 and out.columns[:3] == ["job_id", "severity", "category"]


def test_line_numbers_with_carriage_returns(files):
    table = files({"crlf.java": "a\r\nnew Random()\r\nb", "cr.java": "a\rnew Random()"})
    assert found(scan.security_hits(table)) == {
        ("crlf.java", "OWASP-A02-RAND-001"): [2], ("cr.java", "OWASP-A02-RAND-001"): [2]}
