"""The twelve cases that state what the scans must find, with snippets of our own."""

from sieveline.plans import scan


def run(files, path, code):
    table = files({path: code})
    return scan.all_findings(table).collect()


def rules(rows):
    return {(r.rule_id, r.severity) for r in rows}


def test_query_joined_with_a_value(files):
    rows = run(files, "OrderDao.java", 'String sql = "SELECT name FROM orders WHERE no = " + no;\nvar s = c.createStatement();\ns.executeQuery(sql);\n')
    assert rules(rows) == {("OWASP-A03-SQL-001", "CRITICAL")}


def test_password_literal(files):
    rows = run(files, "Db.java", 'String password = "top_secret_4711";\nopen(url, "root", password);\n')
    assert rules(rows) == {("OWASP-A02-CRED-001", "HIGH")}


def test_weak_digest(files):
    rows = run(files, "Auth.java", 'var md = MessageDigest.getInstance("MD5");\nbyte[] h = md.digest(b);\n')
    assert rules(rows) == {("OWASP-A02-CRYPTO-001", "HIGH")}


def test_deserialisation(files):
    rows = run(files, "Load.java", "ObjectInputStream in = new ObjectInputStream(raw);\nvar o = in.readObject();\n")
    assert rules(rows) == {("OWASP-A08-DESER-001", "CRITICAL")}
    assert sorted(r.line_number for r in rows) == [1, 2]


def test_csrf_off(files):
    rows = run(files, "Web.java", 'http.csrf().disable()\n    .rules().path("/x/**").role("R");\n')
    assert rules(rows) == {("OWASP-A05-CSRF-001", "HIGH")}


def test_password_equals(files):
    rows = run(files, "Login.java", "if (givenPassword.equals(knownPassword)) {\n    enter();\n}\n")
    assert rules(rows) == {("OWASP-A07-PWD-001", "CRITICAL")}


def test_clean_class(files):
    code = "@Service\npublic class Customers {\n    private final Repo repo;\n\n    public Optional<User> byId(Long id) {\n        return repo.byId(id);\n    }\n}\n"
    assert run(files, "Customers.java", code) == []


def test_console_print_without_a_class(files):
    assert rules(run(files, "Foo.java", 'System.out.println("v: " + v);')) == {("QA-PRINT-001", "LOW")}


def test_empty_catch(files):
    assert rules(run(files, "Foo.java", "try {\n    work();\n} catch (Exception e) {}\n")) == {("QA-EMPTY-CATCH-001", "MEDIUM")}


def test_work_note(files):
    assert rules(run(files, "Retry.java", "// TODO: retry\npublic void retry() {}")) == {("QA-TODO-001", "INFO")}


def test_very_large_file(files):
    code = "public class Big {\n" + "".join(f"    private int f{i};\n" for i in range(510)) + "}"
    rows = run(files, "Big.java", code)
    assert rules(rows) == {("QA-GOD-CLASS-001", "MEDIUM")}
    assert rows[0].line_number == 1 and "512 lines" in rows[0].description


def test_complex_method(files):
    branches = "".join(f"        if (s.length() == {i}) return {i};\n" for i in range(6))
    code = (
        "class A {\n    int f(String s) {\n" + branches
        + '        if (s.startsWith("a")) {\n            for (int i = 0; i < 3; i++) {\n                if (i > 1) return i;\n            }\n'
        + '        } else if (s.startsWith("b")) {\n            return 7;\n        }\n        return 0;\n    }\n}\n'
    )
    rows = run(files, "A.java", code)
    assert rules(rows) == {("QA-COMPLEXITY-001", "MEDIUM")}
    assert rows[0].line_number == 2 and "complexity 11" in rows[0].description
