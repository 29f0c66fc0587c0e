"""Method facts against programs that are generated together with their answers."""

import random
import time

from pyspark.sql import functions as F

from sieveline.operators.java_tokens import method_facts_of
from sieveline.operators.methods import method_facts
from sieveline.plans import scan


class Program:
    """Random Java. Each statement writer returns (decisions, deepest nesting below it)."""

    def __init__(self, seed):
        self.rnd = random.Random(seed)
        self.lines, self.facts = [], []

    def put(self, depth, text):
        self.lines.append("    " * depth + text)

    def block(self, depth, budget):
        decisions = nesting = 0
        for _ in range(self.rnd.randint(1, 3)):
            d, n = self.statement(depth, budget - 1)
            decisions, nesting = decisions + d, max(nesting, n)
        return decisions, nesting

    def statement(self, depth, budget):
        kind = self.rnd.choice(["plain", "ternary", "text"] if budget <= 0 else [
            "plain", "ternary", "text", "if", "chain", "bare", "for", "each", "while", "do", "switch", "try", "lambda", "inner", "scope"])
        return getattr(self, "s_" + kind)(depth, budget)

    def s_plain(self, depth, _):
        self.put(depth, self.rnd.choice(["x = x + 1;", "call(a, b);", "return;", "new Thing(a) ;", "Map<String, ? extends Key> m = null;"]))
        return 0, 0

    def s_ternary(self, depth, _):
        self.put(depth, "x = (a > b) ? a : b;")
        return 1, 0

    def s_text(self, depth, _):
        self.put(depth, 's = "if (x) { while (y) ? }"; // for (;;) {')
        self.put(depth, "/* } else if (z) { */ c = '{';")
        return 0, 0

    def s_if(self, depth, budget):
        self.put(depth, "if (call(a, (b))) {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        return d + 1, n + 1

    def s_chain(self, depth, budget):
        links = self.rnd.randint(1, 3)
        self.put(depth, "if (a) {")
        d, n = self.block(depth + 1, budget)
        decisions, nesting = d + 1, n + 1
        for k in range(1, links + 1):
            self.put(depth, "} else if (b) {")
            d, n = self.block(depth + 1, budget)
            decisions, nesting = decisions + d + 1, max(nesting, n + 1 + k)
        self.put(depth, "} else {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        return decisions + d, max(nesting, n + 1 + links)

    def s_bare(self, depth, _):
        which = self.rnd.randint(0, 3)
        if which == 0:
            self.put(depth, "if (a) x = 1;")
            return 1, 1
        if which == 1:
            self.put(depth, "if (a)")
            self.put(depth + 1, "for (int i = 0; i < 3; i++)")
            self.put(depth + 2, "while (b) x++;")
            return 3, 3
        if which == 2:
            self.put(depth, "if (a) return; else if (b) return; else x = 2;")
            return 2, 2
        self.put(depth, "while (a) { if (b ? c : d) x = 1; }")
        return 3, 2

    def s_for(self, depth, budget):
        self.put(depth, "for (int i = 0; i < n(); i++) {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        return d + 1, n + 1

    def s_each(self, depth, budget):
        self.put(depth, "for (String s : all()) {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        return d, n

    def s_while(self, depth, budget):
        self.put(depth, "while (more()) {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        return d + 1, n + 1

    def s_do(self, depth, budget):
        self.put(depth, "do {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "} while (more());")
        return d + 1, n + 1

    def s_switch(self, depth, budget):
        self.put(depth, "switch (x) {")
        self.put(depth + 1, "case 1:")
        d, n = self.block(depth + 2, budget)
        self.put(depth + 1, "case 2: break;")
        self.put(depth + 1, "default:")
        e, m = self.block(depth + 2, budget)
        self.put(depth, "}")
        return d + e + 3, max(n, m) + 1

    def s_try(self, depth, budget):
        self.put(depth, self.rnd.choice(["try {", "try (Res r = open(x)) {"]))
        d, n = self.block(depth + 1, budget)
        self.put(depth, "} catch (A | B e) {")
        e, m = self.block(depth + 1, budget)
        self.put(depth, "} finally {")
        f, o = self.block(depth + 1, budget)
        self.put(depth, "}")
        return d + e + f + 1, max(n, m, o) + 1

    def s_lambda(self, depth, budget):
        self.put(depth, "run(() -> {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "});")
        return d, n

    def s_scope(self, depth, budget):
        self.put(depth, "synchronized (lock) {")
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        return d, n

    def s_inner(self, depth, budget):
        self.put(depth, "Runnable r = new Runnable() {")
        d, n = self.method(depth + 1, budget)
        self.put(depth, "};")
        return d, n

    def method(self, depth, budget):
        params = self.rnd.choice([("", 0), ("int a", 1), ("final Map<String, List<Integer>> a, int... b", 2),
                                  ('@Named("x, y") String a, int[] b, T c', 3)])
        name = f"m{len(self.lines)}"
        start = len(self.lines) + 1
        self.put(depth, self.rnd.choice([
            f"public static int {name}({params[0]}) {{", f"@Override\n{'    ' * depth}public <T> List<T> {name}({params[0]}) throws A, b.C {{",
            f"void {name}({params[0]})\n{'    ' * depth}{{", f"protected final Map<String, int[]> {name}({params[0]}) {{"]))
        self.lines = "\n".join(self.lines).split("\n")
        slot = len(self.facts)
        self.facts.append(None)
        d, n = self.block(depth + 1, budget)
        self.put(depth, "}")
        self.facts[slot] = (name, start, len(self.lines), params[1], d + 1, n)
        return d, n

    def build(self):
        self.put(0, "package p;")
        self.put(0, "public class Any extends Other {")
        self.put(1, "public Any(int a) { if (a) x(); }")
        for _ in range(self.rnd.randint(1, 4)):
            self.method(1, 4)
        self.put(1, "abstract int noBody(int a, int b);")
        self.facts.append(("noBody", len(self.lines), len(self.lines), 2, 1, 0))
        self.put(0, "}")
        return "\n".join(self.lines) + "\n", sorted(self.facts)


def test_generated_programs(spark):
    programs = [Program(seed).build() for seed in range(400)]
    table = spark.createDataFrame(
        [("j", f"p{i}.java", text) for i, (text, _) in enumerate(programs)], "job_id string, path string, content string").repartition(8)
    got = {}
    for r in method_facts(table).collect():
        got.setdefault(r.path, []).append((r["name"], r.start_line, r.end_line, r.n_params, r.complexity, r.nesting))
    for i, (text, facts) in enumerate(programs):
        assert sorted(got[f"p{i}.java"]) == facts, text


def test_only_java_and_broken_texts(files):
    table = files({
        "a.py": "int f() { }", "open.java": "class A { void f() { if (x) {", "none.java": "int x = 1;",
        "closing.java": "}}} void g() { }", "null.java": None})
    assert [(r.path, r["name"]) for r in method_facts(table).collect()] == [("closing.java", "g")]


def facts_of(files, text):
    return [(r["name"], r.start_line, r.n_params, r.complexity, r.nesting) for r in method_facts(files({"a.java": text})).collect()]


def test_brackets_of_any_depth(files):
    deep = "f(" * 30 + "1" + ")" * 30
    assert facts_of(files, f"void g() {{ for (int i = {deep}; i < {deep}; i++) {{ if ({deep} > 1) {{ x(); }} }} }}") == [("g", 1, 0, 3, 2)]
    assert facts_of(files, "void f(@Foo(bar = @Baz(x = g(1))) String a) { if (a) x(); }") == [("f", 1, 1, 2, 1)]
    assert facts_of(files, "void f(@Roles({A, B}) String a, int b) { }") == [("f", 1, 2, 1, 0)]
    assert facts_of(files, "void f(Map<A,Map<B,Map<C,Map<D,Map<E,Map<G,H>>>>>> a, int b) { }") == [("f", 1, 2, 1, 0)]
    assert facts_of(files, "void f(@Min(a > b, c) int a, @X(y < z) int b) { }") == [("f", 1, 2, 1, 0)]


def test_brackets_five_hundred_deep(files):
    deep, at = "f(" * 500 + "1" + ")" * 500, "@A(" + "(" * 500 + ")" * 500 + ")"
    text = f"void g() {{ for (int i = {deep}; i < {deep}; i++) {{ if ({deep} > 1) {{ x(); }} }} }}\n{at}\nvoid h({at} int a, int b) {{ }}"
    assert facts_of(files, text) == [("g", 1, 0, 3, 2), ("h", 2, 2, 1, 0)]
    blocks = "void f() { " + "if (a) { " * 2000 + "x();" + " }" * 2000 + " }"
    assert facts_of(files, blocks) == [("f", 1, 0, 2001, 2000)]


def test_time_is_linear_in_methods_and_depth():
    def seconds(text):
        began = time.perf_counter()
        method_facts_of(text)
        return time.perf_counter() - began

    methods = "void m(int a) { if (a) x(); }\n"
    assert seconds(methods * 20_000) < 12 * seconds(methods * 5_000)  # four times, with much room for a busy machine
    for text in ("f(" * 100_000, "{" * 100_000 + "}" * 100_000, "x<" * 50_000 + "y> f(int a) { }", "a.b " * 100_000, "for (" * 50_000 + ";"):
        assert seconds(text) < 10


def test_odd_texts_of_tokens():
    assert method_facts_of("") == [] == method_facts_of("}}}} )) (( ;;") and method_facts_of("f(") == []
    assert method_facts_of("void f(int a) { } void g(") == [("f", 1, 1, 1, 1, 0)]
    assert method_facts_of("int[] f(int a)[] throws A, b.C;") == [("f", 1, 1, 1, 1, 0)]
    assert method_facts_of("a.b<C>.d g(int x) { }") == []  # no plain type before the name


def test_lambdas_in_conditions(files):
    assert facts_of(files, "void f() { if (xs.anyMatch(x -> { return x > 1; })) { if (a) { y(); } } }") == [("f", 1, 0, 3, 2)]
    assert facts_of(files, "void f() { while (xs.any(x -> { if (x) return a; return b; })) { y(); } }") == [("f", 1, 0, 3, 1)]


def test_annotation_with_braces_belongs_to_its_method(files):
    assert facts_of(files, "class A {\n  @Test(groups = {B})\n  public void f() { }\n}") == [("f", 2, 0, 1, 0)]


def test_markers_in_the_text(files):
    assert facts_of(files, "void f() {\x01 if (a) \x02 x(); }") == [("f", 1, 0, 2, 1)]


def test_very_many_methods_in_one_file(files):
    text = "class A {\n" + "".join(f"void m{i}(int a) {{ if (a) x(); }}\n" for i in range(5_000)) + "}\n"
    rows = method_facts(files({"a.java": text})).select("name", "start_line", "complexity").collect()
    assert [tuple(r) for r in rows] == [(f"m{i}", i + 2, 2) for i in range(5_000)]


def test_boolean_operators_only_on_request(files):
    table = files({"a.java": "void f() { if (a && b || c) { x = d && e; } }"})
    assert method_facts(table).first().complexity == 2
    assert method_facts(table, count_boolean_ops=True).first().complexity == 5


def test_metric_rules_are_strictly_above_the_limit(files, spark):
    def method(lines):
        return "void f() {\n" + "  x();\n" * (lines - 1) + "}\n"

    table = files({"at.java": method(50), "over.java": method(51), "params.java": "void f(int a, int b, int c, int d, int e, int f) { }"})
    rows = scan.quality_scan(table).select("file_path", "rule_id", "title", "line_number").collect()
    assert sorted(map(tuple, rows)) == [
        ("over.java", "QA-LONG-METHOD-001", "Body of f is too long to take in", 1), ("params.java", "QA-PARAMS-001", "f asks for too many arguments", 1)]
    strict = scan.quality_scan(table, limits={"QA-LONG-METHOD-001": 49}).where("rule_id = 'QA-LONG-METHOD-001'")
    assert strict.count() == 2 and strict.where(F.col("description").contains("limit 49")).count() == 2


def test_severe_complexity(files):
    table = files({"a.java": "void f() {\n" + "if (a) b();\n" * 21 + "}", "b.java": "void f() {\n" + "if (a) b();\n" * 19 + "}"})
    rows = scan.quality_scan(table).where("rule_id = 'QA-COMPLEXITY-001'").collect()
    assert {r.file_path: r.severity for r in rows} == {"a.java": "HIGH", "b.java": "MEDIUM"}
